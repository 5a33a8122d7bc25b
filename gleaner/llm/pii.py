"""Surrogates for personal data, with DataFrame functions only.

Entities are found by pattern: e-mail addresses, phone, card and social security
numbers, IP addresses, secrets in hexadecimal, and names after a title; a name found so
is then looked for in the rest of its text as well, where it may stand without a title.
Each is replaced by a surrogate that a keyed hash derives from its type and value, so
equal values get equal surrogates everywhere. Digits stay digits, letters stay letters of
the same case and script, separators stay, and so does whether a card number's check
digit is right; names come from lists of the title's gender (or of names of any gender,
after titles such as Dr) and the name's script. Given name and surname are entities of
their own, so "Mr. John Smith" and "Mr. Smith" stay the same person.

Collision check: all distinct entities of the corpus with equal surrogates, or whose
surrogate is itself an entity of the corpus, are derived anew with a higher attempt
number, but for the first of them; this repeats until none collide. Names and e-mail
addresses grow with the attempts, so they never run out; a format of which too few
values are free is an error. The few overridden entities reach the texts by a join; all
others' surrogates are computed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shielded, with_few

#: Attempts after which a format counts as exhausted: each leaves the free share of it unserved.
ATTEMPTS = 100
#: Attempts that keep an e-mail address's length.
SAME_LENGTH = 4

# Titles by gender.
_MALE = ("Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Господин")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа")
_ANY = ("Dr", "Prof", "Professor", "Доктор")
_TITLES = "|".join(sorted(_MALE + _FEMALE + _ANY, key=len, reverse=True))
# Groups repeat a bounded number of times, and classes give nothing back: a group that repeats
# without bound would take the matcher's stack, and a class that is tried again from each of its
# characters the square of its length.
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++){0,4}+(?<=[\p{Ll}\p{M}])"
_TITLE = rf"(?:(?:{_TITLES})\.? ){{1,4}}"
_LOCAL, _LABEL = r"[\p{L}\p{M}\p{N}._%+-]", r"[\p{L}\p{M}\p{N}-]"
_ALONE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Patterns by type; where two begin at the same character the first wins.
PATTERNS = (
    # From the beginning of a run or the end of the match before; up to 127 labels, as many as a domain may have.
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?:{_LABEL}++\.){{1,127}}[\p{{L}}\p{{M}}]{{2,}}"),
    ("secret", rf"{_ALONE}(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{{32,128}}{_AFTER}"),
    ("phone", rf"{_ALONE}\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2,3}}(?!\d)|{_ALONE}\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\p{{L}}\p{{N}}.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\p{{L}}\p{{N}}-])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"),
    ("ip6", rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,5}})(?![\p{{L}}\p{{N}}:])"),
    ("ssn", r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("card", rf"{_ALONE}\d(?:[ -]?\d){{12,18}}{_AFTER}"),
    # M. alone may be an initial, so it is a title before two names only.
    ("name", rf"{_ALONE}(?:{_TITLE}(?!(?:{_TITLES})[. ]){_WORD}(?: {_WORD})?|M\.? {_WORD} {_WORD})"),
)
PATTERN = "|".join(p for _, p in PATTERNS)

_GIVEN = {
    ("m", "Latin"): ("Adrian Albert Bruno Carl Daniel Edgar Felix Gabriel Henry Ivan Jonas Konrad Leon Martin Nestor Oscar Paul Robert Simon Victor"),
    ("f", "Latin"): ("Alma Beatrice Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera"),
    ("n", "Latin"): ("Alex Andrea Ariel Casey Charlie Dana Dominique Eden Jamie Jessie Kim Lou Morgan Noel Pat Quinn Robin Sam Sasha Taylor"),
    ("n", "Cyrillic"): ("Валя Вася Женя Саша Слава Шура"),
    ("m", "Cyrillic"): ("Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур Фёдор Юрий Ян"),
    ("f", "Cyrillic"): ("Анна Вера Галина Дарья Ева Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия Яна"),
}
_SURNAMES = {
    "Latin": "Albrin Barnel Castor Delmar Ebrin Falken Garnel Harwin Ismar Jarden Keller Lorin Marlow Norwin Orban Parnel Quint Rosmer Salden Tarnow Ulmer Valden Warnel Zander",
    "Cyrillic": "Алдин Бармин Вагин Гордин Даров Ершин Жарин Зорин Исаин Карин Ларин Марин Нарин Орлин Парин Рубин Савин Тарин Ушин Фарин",
}
_SYLLABLES = {"Latin": "ba de li mo nu ra se ti vo za", "Cyrillic": "ба де ли мо ну ра се ти во за"}
def _run(first: str, n: int) -> str:
    return "".join(chr(ord(first) + i) for i in range(n))


#: Characters that stand for characters of a class: letters by script and case, digits by script.
_ALPHABETS = (
    ("[0-9]", _run("0", 10)),
    ("[a-z]", _run("a", 26)),
    ("[A-Z]", _run("A", 26)),
    (r"[\p{IsLatin}&&\p{Ll}]", _run("à", 23) + _run("ø", 5)),
    (r"[\p{IsLatin}&&\p{Lu}]", _run("À", 23) + _run("Ø", 5)),
    (r"[\p{IsCyrillic}&&\p{Ll}]", _run("а", 26)),
    (r"[\p{IsCyrillic}&&\p{Lu}]", _run("А", 26)),
    (r"[\p{IsGreek}&&\p{Ll}]", _run("α", 17) + _run("σ", 7)),
    (r"[\p{IsGreek}&&\p{Lu}]", _run("Α", 17) + _run("Σ", 7)),
    (r"[\p{IsArmenian}&&\p{Ll}]", _run("ա", 38)),
    (r"[\p{IsArmenian}&&\p{Lu}]", _run("Ա", 38)),
    (r"[\p{IsHebrew}&&\p{L}]", _run("א", 27)),
    (r"[\p{IsArabic}&&\p{L}]", _run("ب", 19) + _run("ف", 8)),
    (r"[\p{IsDevanagari}&&\p{L}]", _run("क", 37)),
    (r"[\p{IsBengali}&&\p{L}]", _run("ক", 20)),
    (r"[\p{IsThai}&&\p{L}]", _run("ก", 46)),
    (r"[\p{IsGeorgian}&&\p{L}]", _run("ა", 33)),
    (r"[\p{IsHiragana}&&\p{L}]", _run("か", 60)),
    (r"[\p{IsKatakana}&&\p{L}]", _run("カ", 60)),
    (r"[\p{IsHangul}&&\p{L}]", _run("가", 200)),
    (r"[\p{IsHan}&&\p{L}]", _run("一", 200)),
    ("[٠-٩]", _run("٠", 10)),
    ("[۰-۹]", _run("۰", 10)),
    ("[०-९]", _run("०", 10)),
    ("[০-৯]", _run("০", 10)),
    ("[０-９]", _run("０", 10)),
    (r"\p{Lu}", _run("A", 26)),
    (r"\p{L}", _run("a", 26)),
    (r"\p{N}", _run("0", 10)),
)


def kind_of(value: Column) -> Column:
    """The type of a whole match."""
    out = F.when(value.rlike(rf"^(?:{PATTERNS[0][1]})$"), PATTERNS[0][0])
    for name, pattern in PATTERNS[1:]:
        out = out.when(value.rlike(rf"^(?:{pattern})$"), name)
    return out.otherwise("name")


def _draw(seed: Column, i: Column, n) -> Column:
    """A number below n from the seed and a position."""
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _pick(seed: Column, i, text: str) -> Column:
    items = F.split(F.lit(text), " ")
    return F.get(items, _draw(seed, F.lit(i), len(text.split())))


def _letters(value: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """value with each digit and letter replaced by one of its kind."""

    def one(c, i):
        out = F.when(c.rlike(r"^[\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), c)
        if hexadecimal:
            out = out.when(c.rlike("^[a-f]"), F.substr(F.lit("abcdef"), _draw(seed, i, 6) + 1, F.lit(1)))
            out = out.when(c.rlike("^[A-F]"), F.substr(F.lit("ABCDEF"), _draw(seed, i, 6) + 1, F.lit(1)))
        for kind, letters in _ALPHABETS:
            out = out.when(c.rlike(f"^{kind}"), F.substr(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit of digits."""

    def one(c, i):
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, c.cast("int")).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda acc, x: acc + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def _checked(original: Column, new: Column) -> Column:
    """new with a right check digit, if the original has one. Both end with it."""
    plain = lambda c: F.regexp_replace(c, "[^0-9]|.$", "")
    right = _luhn(plain(original)) == F.right(original, F.lit(1))
    return F.when(right, F.concat(F.substr(new, F.lit(1), F.length(new) - 1), _luhn(plain(new)))).otherwise(new)


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "Cyrillic").otherwise("Latin")


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity; kind may also be given_m, given_f, given_n or surname."""
    seed = F.xxhash64(F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 256))
    at = F.instr(value, "@")
    domain = F.substring_index(value, "@", -1)
    email = F.concat(
        _letters(F.substr(value, F.lit(1), at - 1), seed),
        F.array_join(F.transform(F.sequence(F.lit(SAME_LENGTH), F.greatest(attempt, F.lit(SAME_LENGTH))), lambda i: F.when(
            i == SAME_LENGTH, "").otherwise(F.substr(F.lit(_run("a", 26)), _draw(F.xxhash64(seed, F.lit(1)), i, 26) + 1, F.lit(1)))), ""),
        F.lit("@"),
        _letters(F.regexp_replace(domain, r"\.[^.]*$", ""), F.xxhash64(seed)),
        F.regexp_extract(domain, r"\.[^.]*$", 0),
    )
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _draw(seed, i, 254)).cast("string"))
    # A phone number's country code and a card number's first digit stay: they are its format.
    country = F.regexp_extract(value, r"^(\+\d{1,3}[ .-]|\+\d)?", 0)
    phone = F.concat(country, _letters(F.substr(value, F.length(country) + 1, F.length(value)), seed))
    card = F.concat(F.substr(value, F.lit(1), F.lit(1)), _letters(F.substr(value, F.lit(2), F.length(value)), seed))
    card = _checked(value, card)
    cyrillic = _script(value) == "Cyrillic"

    def by_script(texts, i):
        return F.when(cyrillic, _pick(seed, i, texts["Cyrillic"])).otherwise(_pick(seed, i, texts["Latin"]))

    # Later attempts grow by syllables, so that names never run out.
    more = F.array_join(
        F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i == 0, "").otherwise(
            F.when(cyrillic, F.get(F.split(F.lit(_SYLLABLES["Cyrillic"]), " "), _draw(seed, i + 9, 10))).otherwise(
                F.get(F.split(F.lit(_SYLLABLES["Latin"]), " "), _draw(seed, i + 9, 10))
            )
        )),
        "",
    )
    given = lambda g: F.concat(by_script({s: _GIVEN[g, s] for s in _SYLLABLES}, 1), more)
    return (
        F.when(kind == "email", email)
        .when(kind.isin("secret", "ip6"), _letters(value, seed, hexadecimal=True))
        .when(kind == "phone", phone)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", card)
        .when(kind == "given_m", given("m"))
        .when(kind == "given_f", given("f"))
        .when(kind == "given_n", given("n"))
        .when(kind == "surname", F.concat(by_script(_SURNAMES, 2), more))
        .otherwise(_letters(value, seed))
    )


def name_parts(match: Column) -> tuple[Column, Column, Column, Column]:
    """(title with its space, given name or '', surname, gender) of a match of type name."""
    title = F.regexp_extract(match, rf"^(?:{_TITLE}|M\.? )", 0)
    rest = F.substr(match, F.length(title) + 1, F.length(match))
    given = F.when(F.contains(rest, F.lit(" ")), F.substring_index(rest, " ", 1)).otherwise("")
    surname = F.substring_index(rest, " ", -1)
    has = lambda titles: title.rlike(rf"(?:^| )(?:{'|'.join(titles)})\.? ")
    gender = F.when(has((*_MALE, "M")), "given_m").when(has(_FEMALE), "given_f").otherwise("given_n")
    return title, given, surname, gender


def entities_of(match: Column) -> Column:
    """The entities of a match, as two (kind, value): the second is a given name, or has no value."""
    kind = kind_of(match)
    _, given, surname, gender = name_parts(match)
    is_name = kind == "name"
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    return F.array(
        one(F.when(is_name, "surname").otherwise(kind), F.when(is_name, surname).otherwise(match)),
        one(gender, F.when(is_name, given).otherwise("")),
    )


def overrides(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the distinct entities whose first surrogate collides.

    entities: distinct (kind, value). Ends when no two entities of a kind share a
    surrogate and no surrogate is an entity; if that is not so after ATTEMPTS attempts, each
    of which lengthens names and later e-mail addresses and redraws the rest, ValueError.
    """
    state = materialise(
        entities.withColumn("attempt", F.lit(0)).withColumn("s", surrogate(F.col("kind"), F.col("value"), F.lit(0), key))
    )
    for tried in range(ATTEMPTS + 1):
        # The keeper of a surrogate is its entity with the fewest attempts, then the smallest value.
        keepers = state.groupBy("kind", "s").agg(
            F.min(F.struct((-F.col("attempt")).alias("o"), "value")).alias("k"), F.count(F.lit(1)).alias("n")
        )
        taken = entities.select(F.col("kind").alias("_k"), F.col("value").alias("_v"))
        judged = keepers.join(taken, (F.col("kind") == F.col("_k")) & (F.col("s") == F.col("_v")), "left")
        shared = materialise(
            judged.where((F.col("n") > 1) | F.col("_v").isNotNull()).select(
                F.col("kind").alias("_k2"), F.col("s").alias("_s2"), F.col("k.value").alias("keeper"), F.col("_v").isNotNull().alias("real")
            )
        )
        if shared.isEmpty():
            break
        if tried == ATTEMPTS:
            kinds = sorted(r[0] for r in shared.select("_k2").distinct().collect())
            raise ValueError(f"too few free surrogates for {', '.join(kinds)}")
        joined = state.join(shared, (F.col("kind") == F.col("_k2")) & (F.col("s") == F.col("_s2")), "left")
        again = F.col("_k2").isNotNull() & (F.col("real") | (F.col("value") != F.col("keeper")))
        moved = joined.select(
            "kind", "value", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), "s", again.alias("again")
        )
        before = state
        state = materialise(
            moved.select(
                "kind",
                "value",
                "attempt",
                F.when(F.col("again"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("s")).alias("s"),
            )
        )
        discard(before, shared)
    return state.where("attempt > 0").select("kind", "value", "s")


@shielded
def pseudonymise(docs: DataFrame, key: str, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and n_entities (the number of places replaced).

    key: the secret that surrogates derive from; without it they can't be traced back by
    trying values. A null text stays null with n_entities 0. Rows with equal key_col and
    text get equal results; the surrogate of an entity depends on the key, the entity and
    on which other entities the corpus has. A name after a title is replaced in all of its
    text, with or without the title, where its parts stand as words of their own. A column
    of docs named n_entities is replaced.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    docs = docs.drop("n_entities")
    text = F.coalesce(F.col(text_col), F.lit(""))
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    slim = docs.select(
        F.col(key_col).alias("_key"), F.xxhash64(F.col(text_col)).alias("_th"), F.array_distinct(matches).alias("m")
    )
    found = materialise(
        slim.where(F.size("m") > 0)
        .select("_key", "_th", F.explode("m").alias("match"))
        .select("_key", "_th", F.explode(entities_of(F.col("match"))).alias("e"))
        .select("_key", "_th", "e.kind", "e.value")
        .where("value != ''")
    )
    changed = overrides(materialise(found.select("kind", "value").distinct()), key)
    changed = materialise(changed.withColumnsRenamed({"kind": "_kind", "value": "_value"}))
    theirs = materialise(
        found.join(changed, (F.col("kind") == F.col("_kind")) & (F.col("value") == F.col("_value")))
        .groupBy("_key", "_th")
        .agg(F.collect_set(F.struct(F.concat_ws("\u0001", "kind", "value").alias("e"), "s")).alias("_own"))
    )
    discard(found, changed)
    joined = with_few(docs, theirs, key_col, text_col)

    def of(e):
        mine = F.filter("_own", lambda o: o["e"] == F.concat_ws("\u0001", e["kind"], e["value"]))
        derived = F.coalesce(F.get(mine, F.lit(0))["s"], surrogate(e["kind"], e["value"], F.lit(0), key))
        return F.when(e["value"] == "", "").otherwise(derived)

    def replaced(match, i):
        """From the surrogates of the match's two entities."""
        whole, given = F.get("_s", 2 * i), F.get("_s", 2 * i + 1)
        first = F.when(given == "", "").otherwise(F.concat(given, F.lit(" ")))
        is_name = F.get("_e", 2 * i)["kind"] == "surname"
        return F.when(is_name, F.concat(name_parts(match)[0], first, whole)).otherwise(whole)

    def woven(between, new):
        """The pieces between, with new ones after all but the last."""
        first = F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0)))
        return F.concat(F.array_join(F.zip_with(first, new, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))

    def bare(word):
        """The surrogate of a name without a title."""
        return F.get(F.filter("_names", lambda e: e["value"] == word), F.lit(0))["s"]

    named = F.col("_pattern").isNotNull()
    out = joined.withColumn("_m", matches)
    out = out.withColumn("_b", F.when(F.size("_m") > 0, F.split(text, PATTERN, -1)))
    out = out.withColumn("_e", F.flatten(F.transform("_m", entities_of)))
    out = out.withColumn("_s", F.transform("_e", of))
    both = F.zip_with("_e", "_s", lambda e, s: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), s.alias("s")))
    is_part = lambda e: e["kind"].isin("surname", "given_m", "given_f", "given_n") & (e["value"] != "")
    out = out.withColumn("_names", F.array_distinct(F.filter(both, is_part)))
    words = F.array_join(F.transform("_names", lambda e: F.concat(F.lit("\\Q"), e["value"], F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(f"{_ALONE}(?:"), words, F.lit(f"){_AFTER}"))
    out = out.withColumn("_pattern", F.when(F.size("_names") > 0, pattern))
    # The names' places in each piece between matches, and the piece with their surrogates.
    places = lambda x: F.regexp_extract_all(x, F.col("_pattern"), F.lit(0))
    out = out.withColumn("_more", F.when(named, F.aggregate("_b", F.lit(0), lambda n, x: n + F.size(places(x)))).otherwise(F.lit(0)))
    rest = F.transform("_b", lambda x: F.when(F.rlike(x, F.col("_pattern")), woven(F.split(x, F.col("_pattern"), -1), F.transform(places(x), bare))).otherwise(x))
    out = out.withColumn("_b", F.when(F.col("_more") > 0, rest).otherwise(F.col("_b")))
    out = out.withColumn("n_entities", (F.size("_m") + F.col("_more")).cast("long"))
    new = F.when(F.col("n_entities") > 0, woven(F.col("_b"), F.transform("_m", replaced))).otherwise(F.col(text_col))
    return out.withColumn(text_col, new).select(*docs.columns, "n_entities")
