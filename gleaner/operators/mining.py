"""Templates from token lists: infrequent words give way to asterisks.

Lines with equal tokens are one vector with a weight. The prefix tree over frequency-
ordered tokens is a table of prefix hashes with counts; a vector's stop is the first of
its prefixes that is rare, found by joining its prefixes to that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.tokens import STAR
from gleaner.session import erase, small, written

LEAST = 3
#: What stands for a term below the border in a pattern; words are parted at spaces, so none is it.
RARE = " "
#: Common terms beyond which a join finds them.
MOST_LISTED = 4000


def vectors(lines: DataFrame, weight: str | None = None, *more) -> DataFrame:
    """(vid, tokens, w) of lines with tokens, and more aggregates; lines are exchanged by the vector's id."""
    w = F.col(weight) if weight else F.lit(1)
    return lines.groupBy(vector_id().alias("vid")).agg(F.first("tokens").alias("tokens"), F.sum(w).alias("w"), *more)


def vector_id():
    return F.md5(F.array_join("tokens", "\u0001"))


def ordered(vecs: DataFrame, terms: DataFrame, border: int = 0) -> DataFrame:
    """vecs with n, real (tokens that are no asterisks), `counts` (of each token) and `path`, written as a table.

    A path has the terms that reach the border, by falling count, then first seen: of each
    its place i, its count and the key of the prefix that it ends. A key is the XOR of its
    terms' hashes, each with its place, so keys add up along a vector. Terms below the border
    count 0, as asterisks do. vecs should be dealt by vid, and terms be a table, so that tokens
    stay where they are if it is small enough to be broadcast.
    """
    common = terms.where(F.col("cnt") >= border).select("term", "cnt", "first")
    each = vecs.select("vid", F.posexplode("tokens").alias("pos", "term")).join(common, "term", "left")
    each = each.withColumns({"cnt": F.coalesce("cnt", F.lit(0)), "off": (F.col("term") == STAR) | (F.coalesce("cnt", F.lit(0)) < border)})
    by = Window.partitionBy("vid").orderBy("off", F.desc("cnt"), "first", "term")
    along = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("i", F.row_number().over(by) - 1).withColumn("key", F.bit_xor(F.xxhash64("term", "i")).over(along))
    each = each.groupBy("vid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "cnt"))), lambda x: x["cnt"]).alias("counts"),
        F.sort_array(F.collect_list(F.when(~F.col("off"), F.struct("i", "cnt", "key")))).alias("path"),
    )
    out = vecs.withColumns({"n": F.size("tokens"), "real": F.size(F.array_remove("tokens", STAR))}).join(each, "vid", "left")
    none = F.array()
    return written(out.withColumns({c: F.coalesce(c, none.cast(each.schema[c].dataType)) for c in ("counts", "path")}))


def prefixes(vecs: DataFrame, *more: str) -> DataFrame:
    """(i, key, more) for each prefix of each ordered vector's path; i is its last index."""
    return vecs.select(*more, F.explode("path").alias("x")).select(*more, "x.i", "x.key")


def lengths(n, min_rate: float, max_rate: float):
    """(least, most) numbers of terms for n tokens."""
    least = F.floor(n * F.lit(float(min_rate))) if min_rate > 0 else F.lit(LEAST)
    return (
        F.when(n > LEAST, least).otherwise(LEAST).cast("int"),
        F.when(n > LEAST, F.floor(n * F.lit(float(max_rate)))).otherwise(0).cast("int"),
    )


def _least_search(min_rate: float) -> int:
    """The smallest `search` of any vector: no prefix before it is looked for."""
    return min(LEAST, max(1, int((LEAST + 1) * min_rate))) if min_rate > 0 else LEAST


def stops(vecs: DataFrame, border: int, min_rate: float = 0.6, max_rate: float = 0.0) -> DataFrame:
    """Ordered vectors with least, min_cnt and stop (-1 for none).

    A path's terms come by falling count, so from the first one below the border on every
    prefix is rare; only the prefixes before it are counted.
    """
    least, most = lengths(F.col("n"), min_rate, max_rate)
    search = F.when(least == 0, LEAST).otherwise(least)
    real = F.col("real")
    common = F.filter("path", lambda x: x["cnt"] >= border)
    # A prefix of weight 1 has one vector, so the smallest of its hashes (128 bits, as a vid has) is its own.
    named = vecs.withColumns({"path": common, "_a": F.xxhash64("vid"), "_b": F.xxhash64("vid", F.lit(1)), "_search": search})
    pre = prefixes(named, "_a", "_b", "_search", "w").where(F.col("i") >= _least_search(min_rate))
    own = lambda c: F.min(F.when((F.col("w") <= 1) & (F.col("i") >= F.col("_search")), F.col(c))).alias(c)
    nodes = pre.groupBy("key").agg(F.sum("w").alias("node"), own("_a"), own("_b"), F.min("i").alias("i"))
    first = nodes.where("node <= 1 and _a is not null").groupBy("_a", "_b").agg(F.min("i").alias("_single"))
    same = (F.xxhash64("vid") == F.col("_a")) & (F.xxhash64("vid", F.lit(1)) == F.col("_b"))
    out = vecs.join(first, same, "left").drop("_a", "_b").withColumn("least", least)
    inside = lambda i: F.when(i < real, i)
    rare = F.least("_single", inside(F.greatest(F.size(common), search)))
    long_enough = F.when(most >= search, inside(most - 1))
    cnt = lambda i: F.coalesce(F.get("path", i)["cnt"], F.lit(0))
    out = out.withColumn("_rare", rare).withColumn("_long", long_enough)
    before = F.col("_rare") <= F.coalesce("_long", "_rare")
    return out.withColumns(
        {
            # Without a stop before, the first asterisk is one: no prefix has it.
            "stop": F.coalesce(F.least("_rare", "_long"), F.when(F.col("n") > real, real).otherwise(-1)),
            "min_cnt": F.when(before, F.when(F.col("_rare") > 0, cnt(F.col("_rare") - 1)).otherwise(0))
            .when(F.col("_long").isNotNull(), cnt(F.col("_long")))
            .otherwise(cnt(real - 1)),
        }
    ).drop("_single", "_rare", "_long")


def templates(vecs: DataFrame, border: int, keywords=()) -> DataFrame:
    """(tokens, kept, use): for vectors with stops the tokens that stay, asterisks for others, and whether this is the template."""
    words = F.lit([k.lower() for k in keywords]) if keywords else F.array().cast("array<string>")

    def keep(t, c):
        return F.array_contains(words, t) | ((t != STAR) & (c >= F.col("min_cnt")) & (c >= border))

    kept = F.zip_with("tokens", "counts", lambda t, c: F.when(keep(t, c), t).otherwise(STAR))
    n_kept = F.size(F.filter(F.col("kept"), lambda t: t != STAR))
    use = (F.col("stop") >= F.col("least")) & (n_kept >= F.col("least"))
    return vecs.withColumn("kept", kept).select("tokens", "kept", use.alias("use"))


def _shown(vecs: DataFrame, common: DataFrame, few: list[str] | None, keywords=()) -> DataFrame:
    """vecs with pattern: their tokens, of which those that are neither common, keywords nor asterisks are RARE.

    A few common terms are a list in the expression; more (few is None) are joined, token by token.
    """
    words = [STAR, *(k.lower() for k in keywords)]
    if few is not None:
        pattern = F.transform("tokens", lambda t: F.when(t.isin([*words, *few]), t).otherwise(RARE))
        # Never null, or a join by it would compute it once more to leave out nulls.
        return vecs.withColumn("pattern", F.coalesce(pattern, F.array().cast("array<string>")))
    each = vecs.select("vid", "tokens").groupBy("vid").agg(F.first("tokens").alias("tokens")).select("vid", F.posexplode("tokens").alias("pos", "term"))
    each = each.join(common.select("term", F.lit(True).alias("common")), "term", "left")
    each = each.withColumn("term", F.when(F.col("common") | F.col("term").isin(words), F.col("term")).otherwise(RARE))
    each = each.groupBy("vid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("pattern"))
    none = F.array().cast("array<string>")
    return written(vecs.join(each, "vid", "left").withColumn("pattern", F.coalesce("pattern", none)))


def mine(lines: DataFrame, terms: DataFrame, border: int, min_rate=0.6, max_rate=0.0, keywords=(), weight=None) -> DataFrame:
    """Templates of the vectors of lines (seq, tokens)."""
    vecs = written(vectors(lines, weight))
    out = mined(vecs, terms, border, min_rate, max_rate, keywords)
    out._work.append(vecs)
    return out


def mined(vecs: DataFrame, terms: DataFrame, border: int, min_rate=0.6, max_rate=0.0, keywords=(), by=(), sums=()) -> DataFrame:
    """vecs (vid, tokens, w and more; a table) with phrase, their template, and hidden, the terms that it hides.

    Below the border all terms are treated alike, so vectors that differ in such terms only
    have one pattern; the patterns are mined, and each vector takes its pattern's template,
    or its own tokens. A minimum below the border keeps the same terms as any other below
    it, so these terms need no counts.

    by, sums: more columns that patterns are grouped by, and aggregates of theirs (`_groups`).
    """
    common = terms.where(F.col("cnt") >= border).select("term", "cnt", "first")
    few = common.limit(MOST_LISTED + 1).collect()
    common = small(terms.sparkSession, few, common.schema.simpleString()[7:-1]) if len(few) <= MOST_LISTED else written(common)
    shown = _shown(vecs, common, [r.term for r in few] if len(few) <= MOST_LISTED else None, keywords)
    groups = written(shown.groupBy("pattern", *by).agg(F.sum("w").alias("w"), *sums))
    patterns = (groups.groupBy("pattern").agg(F.sum("w").alias("w")) if by else groups).select(F.col("pattern").alias("tokens"), "w")
    paths = ordered(patterns.withColumn("vid", vector_id()).repartition("vid"), common, border)
    kinds = written(templates(stops(paths, border, min_rate, max_rate), border, keywords).withColumnRenamed("tokens", "pattern"))
    chosen = F.when(F.col("use"), F.col("kept")).otherwise(F.col("tokens"))
    hidden = F.array_except("tokens", F.array_union(chosen, F.array(F.lit(STAR))))
    phrase = F.coalesce(F.array_join(chosen, " "), F.lit("")).alias("phrase")
    named = lambda rows, kinds=kinds: rows.join(kinds, "pattern").select(*vecs.columns, phrase, hidden.alias("hidden"))
    out = named(shown)
    out._some = lambda keep: named(keep(shown))  # of some vectors only, chosen before they get phrases
    # Patterns whose template is their phrase, and the vectors whose phrase is their own tokens (a function, as a job looks for them; None without such).
    out._groups = groups.join(kinds.where("use"), "pattern").withColumn("tokens", F.col("pattern")).select(phrase, *[c for c in groups.columns if c != "pattern"])
    own = kinds.where(~F.col("use"))
    out._own = lambda: None if own.isEmpty() else named(shown, own)
    erase(paths)
    out._work = [groups, kinds, *(t for t in (common, shown) if hasattr(t, "_written"))]
    return out


def custom_match(vecs: DataFrame, custom: list[list[str]]) -> DataFrame:
    """vecs (tokens, phrase) with the phrase of the first custom template of equal length that fits."""
    phrase = F.col("phrase")
    for t in reversed(custom):
        fits = F.forall(F.zip_with("tokens", F.lit(t), lambda a, b: (b == STAR) | (a == b)), lambda x: x)
        phrase = F.when((F.size("tokens") == len(t)) & fits, " ".join(t)).otherwise(phrase)
    return vecs.withColumn("phrase", phrase)


def phrases(lines: DataFrame) -> DataFrame:
    """(phrase, cnt, created, updated, last_value) of lines (seq, value, epoch, phrase, w)."""
    return lines.groupBy("phrase").agg(
        F.sum("w").alias("cnt"),
        F.min("epoch").alias("created"),
        F.max("epoch").alias("updated"),
        F.max_by("value", "seq").alias("last_value"),
    )


#: What may stand around a word in a line.
AROUND = r"[\r\n\t\"'\\,;\[\]<>{}=()|:&?+/\s!.]+"


def subject(line, hidden):
    """A line with its hidden words starred and neighbouring stars merged."""

    def star(acc, word):
        quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
        pattern = F.concat(F.lit(rf"(?i)(^|{AROUND})"), quoted, F.lit(rf"(?={AROUND}|$)"))
        return F.regexp_replace(acc, pattern, F.lit("$1*"))

    return F.regexp_replace(F.aggregate(F.array_sort(hidden), line, star), r"\*(?:[\s\t]*\*)+", "*")


def scores(phrase_table: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """phrase_table with score: the mean IDF of a phrase's terms, asterisks left out."""
    from .terms import idf

    each = phrase_table.select("phrase", F.explode(F.split("phrase", " ")).alias("term")).where((F.col("term") != STAR) & (F.col("term") != ""))
    value = F.coalesce(idf(F.col("cnt"), F.lit(total)), F.lit(0.0))
    mean = each.join(terms.select("term", "cnt"), "term", "left").groupBy("phrase").agg(F.avg(value).alias("score"))
    return phrase_table.join(mean, "phrase", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top_rare(scored: DataFrame, n: int, most: int, since: int = 0) -> DataFrame:
    """The n best-scored phrases that occurred at most `most` times and since an epoch."""
    keep = (F.col("cnt") <= most) & (F.col("updated") >= since if since else F.lit(True))
    return scored.where(keep).orderBy(F.desc("score"), "phrase").limit(n)
