"""Phrase collocation mining: contiguous phrases that occur more often than their halves let expect.

Words that occur `least` times in their language get a number each, which also stands for
the language; every other word breaks the piece of text that it is in, as no phrase with it
can occur often enough. A text is then a run of numbers with zeros between pieces. Phrases
of 2 words, then 3, and so on, are packed into keys of fixed width, most significant byte
first and zeros behind; a task sorts its keys by radix and counts runs of equal ones before
any exchange, so the commonest phrase sends one row for each task. The counts are then
partitioned by ranges of the key, sorted, and run-length counted once more. A phrase of n
words is only packed where Bloom filters of fixed size may hold both of its phrases of n - 1
words, so each step makes at most one key for each word.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, mix, prepare, shielded

LEAST = 100
LONGEST = 5
TOP = 2000
#: A phrase is dropped if a longer one has this share (in percent) of its occurrences.
COVERED = 100
#: What the part of the dictionary that each worker holds may take: about so many bytes.
DICTIONARY_BYTES = 64 << 20
#: Bytes that a word takes there beside its own.
WORD_COST = 120
#: Bits of the filter of frequent phrases; a fuller one lets more phrases through, which counting then drops.
FILTER_BITS = 1 << 26
#: Keys that a task holds before it sorts and counts them.
BUFFER_KEYS = 1 << 20
#: Parts in which words are numbered, and in which each language's best phrases are first looked for.
DEALT = 4096
SALTS = 64
#: What parts pieces, and what parts words.
PIECE_END, SPACES = ".,;:!?\n\v\f\r", " \t"
_TABLE = bytearray(range(256))
for _i in range(65, 91):
    _TABLE[_i] = _i + 32
for _c in PIECE_END:
    _TABLE[ord(_c)] = ord(".")
_TABLE = bytes(_TABLE)
_WORDS_ONLY = _TABLE.replace(b".", b" ").replace(b"\t", b" ")
_BREAK = b"."


def words_of(text: bytes) -> list[bytes]:
    """The words of all pieces, in order."""
    return text.translate(_WORDS_ONLY).split()


def pieces_of(text: bytes) -> list[bytes]:
    """The words in order, with b"." (which no word holds) where a piece ends."""
    return text.translate(_TABLE).replace(_BREAK, b" . ").split()


# --- words -----------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word binary, cnt) of docs (text, lang); tasks count before any exchange."""

    def run(batches):
        from collections import Counter

        held: dict = {}

        def out():
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                    names=["lang", "word", "cnt"],
                )

        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text or b""))
            if sum(map(len, held.values())) > BUFFER_KEYS // 2:
                yield from out()
                held.clear()
        yield from out()

    each = docs.select("text", "lang").mapInArrow(run, "lang string, word binary, cnt long")
    return each.groupBy("lang", "word").agg(F.sum("cnt").alias("cnt"))


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """(id from 1, lang, word, cnt) of the words that occur often enough, as a table."""
    often = materialise(counts.where(F.col("cnt") >= least).withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(DEALT))))
    sizes = often.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # DEALT rows at most
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    out = materialise(often.withColumn("place", place).join(F.broadcast(starts), "part").select((F.col("place") + F.col("start")).alias("id"), "lang", "word", "cnt"))
    discard(often)
    return out


def held_and_rest(words: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words of a dictionary, which fit into most_bytes, and the others (None if there are none)."""
    cost = F.sum(F.length("word") + WORD_COST)
    by_count = words.groupBy("cnt").agg(cost.alias("cost"))
    down = Window.orderBy(F.desc("cnt"))  # over distinct counts, of which there are few
    from_count = by_count.withColumn("all", F.sum("cost").over(down)).where(F.col("all") <= most_bytes).agg(F.min("cnt")).first()[0]
    if from_count is None:
        return words.limit(0), None if words.isEmpty() else words
    rest = words.where(F.col("cnt") < from_count)
    return words.where(F.col("cnt") >= from_count), None if rest.isEmpty() else rest


def encoded(docs: DataFrame, words: DataFrame, width: int, most_bytes: int) -> DataFrame:
    """(ids binary) of docs (text, lang), as a table: each text's word numbers, big-endian, with 0 for breaks and other words.

    The most frequent words are numbered from a broadcast of bounded size; occurrences
    of others, if the dictionary is larger, by a join.
    """
    held, rest = held_and_rest(words, most_bytes)
    known: dict = {}
    for r in held.select("lang", "word", "id").toLocalIterator():
        known.setdefault(r.lang, {})[bytes(r.word)] = r.id
    sent = docs.sparkSession.sparkContext.broadcast(known)
    known = None
    parts = rest is not None
    unknown_type = pa.list_(pa.struct([("word", pa.binary()), ("at", pa.list_(pa.int32()))]))

    def run(batches):
        known = sent.value
        for batch in batches:
            ids, others = [], []
            for text, lang in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()):
                found = pieces_of(text or b"")
                numbers = np.fromiter(map(known.get(lang, {}).get, found, repeat(0)), np.int64, len(found))
                ids.append(numbers.astype(f">u{width}").tobytes())
                if parts:
                    places: dict = {}
                    for i in np.flatnonzero(numbers == 0).tolist():
                        if found[i] != _BREAK:
                            places.setdefault(found[i], []).append(i)
                    others.append([{"word": w, "at": p} for w, p in places.items()])
            arrays = [pa.array(ids, pa.binary()), batch.column(1)]
            names = ["ids", "lang"]
            if parts:
                arrays.append(pa.array(others, unknown_type))
                names.append("others")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    slim = docs.select("text", "lang")
    if not parts:
        return materialise(slim.mapInArrow(run, "ids binary, lang string").select("ids"))
    first = slim.mapInArrow(run, "ids binary, lang string, others array<struct<word binary, at array<int>>>")
    first = materialise(first.withColumn("row", F.monotonically_increasing_id()))
    each = first.select("row", "lang", F.explode("others").alias("o")).select("row", "lang", "o.word", "o.at")
    places = each.join(rest.select("lang", "word", "id"), ["lang", "word"]).select("row", F.struct("id", "at").alias("p"))
    patches = places.groupBy("row").agg(F.collect_list("p").alias("p"))  # what one text holds

    def patch(batches):
        for batch in batches:
            out = []
            for ids, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.frombuffer(ids, f">u{width}").copy()
                for x in p or ():
                    a[x["at"]] = x["id"]
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    out = materialise(first.join(patches, "row", "left").select("ids", "p").mapInArrow(patch, "ids binary"))
    discard(first)
    return out


# --- phrases ---------------------------------------------------------------------------


def radix_order(columns: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned numbers, by the first column, then the second, and so on; 16 bits at a time."""
    order = None
    for k in range(columns.shape[1] - 1, -1, -1):
        c = columns[:, k]
        top = int(c.max(initial=0))
        for shift in range(0, max(top.bit_length(), 1), 16):
            digit = ((c >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys, sorted, and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = radix_order(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.add.reduceat(counts, first)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """The bit of each key (rows of numbers) in a filter."""
    h = np.zeros(len(keys), np.uint64)
    for k in range(keys.shape[1]):
        h = mix(h * np.uint64(31) + keys[:, k])
    return h & np.uint64(FILTER_BITS - 1)


def packed(keys: np.ndarray, width: int, longest: int) -> pa.Array:
    """Keys as binary of fixed width, zeros behind."""
    out = np.zeros((len(keys), longest), f">u{width}")
    out[:, : keys.shape[1]] = keys
    size = width * longest
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(keys), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def phrase_counts(texts: DataFrame, n: int, sieve: np.ndarray | None, width: int, longest: int) -> DataFrame:
    """(key, cnt) of the phrases of n words, counted by task, from texts (ids) and the filter of phrases of n - 1 words."""
    sent = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        sieve = sent.value
        keys, counts, waiting = np.zeros((0, n), np.uint64), np.zeros(0, np.int64), []

        def merged():
            k = np.concatenate([keys, *waiting])
            c = np.concatenate([counts, np.ones(sum(map(len, waiting)), np.int64)])
            return run_lengths(k, c)

        def out():
            return pa.RecordBatch.from_arrays([packed(keys, width, longest), pa.array(counts)], names=["key", "cnt"])

        def windows(a):
            if len(a) < n:
                return
            at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(a != 0, n).all(axis=1))
            if sieve is not None and len(at):
                inner = np.lib.stride_tricks.sliding_window_view(a, n - 1)
                for step in (0, 1):
                    bit = bits_of(inner[at + step])
                    at = at[(sieve[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            for i in range(0, len(at), BUFFER_KEYS):  # a very long text makes several
                yield np.lib.stride_tricks.sliding_window_view(a, n)[at[i : i + BUFFER_KEYS]]

        zero = np.zeros(1, np.uint64).astype(f">u{width}").tobytes()
        size = 0
        for batch in batches:
            a = np.frombuffer(zero.join(batch.column(0).to_pylist()), f">u{width}").astype(np.uint64)
            for w in windows(a):
                waiting.append(w)
                size += len(w)
                if size >= BUFFER_KEYS:
                    keys, counts = merged()
                    waiting, size = [], 0
                    if len(keys) >= BUFFER_KEYS:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield out()

    return texts.mapInArrow(run, "key binary, cnt long")


def summed(partial: DataFrame, least: int) -> DataFrame:
    """(key, cnt) of a written table of partial counts: ranges of the key, sorted, and runs of equal keys added up."""

    def run(batches):
        last, total = None, 0
        for batch in batches:
            k, c = batch.column(0).cast(pa.binary()), batch.column(1).to_numpy()
            if not len(k):
                continue
            values = k.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            sums = np.add.reduceat(c, first)
            heads = values[first]
            if heads[0] == last:
                sums[0] += total
            elif last is not None and total >= least:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([total], pa.int64())], names=["key", "cnt"])
            last, total = heads[-1], int(sums[-1])
            keep = np.flatnonzero(sums[:-1] >= least)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(heads[:-1][keep], pa.binary()), pa.array(sums[:-1][keep])], names=["key", "cnt"])
        if last is not None and total >= least:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([total], pa.int64())], names=["key", "cnt"])

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key binary, cnt long")


def filter_of(frequent: DataFrame, n: int, width: int) -> np.ndarray:
    """The filter of phrases (key) of n words: FILTER_BITS bits, whatever their number."""

    def run(batches):
        for batch in batches:
            raw = b"".join(x[: n * width] for x in batch.column(0).to_pylist())
            bit = np.unique(bits_of(np.frombuffer(raw, f">u{width}").astype(np.uint64).reshape(-1, n)))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    got = frequent.select("key").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in got.toLocalIterator():  # FILTER_BITS / 64 rows at most
        out[r.word] = r.mask & 0xFFFFFFFFFFFFFFFF
    return out.view(np.uint8)


def part_of(key: Column, first, n, width: int, longest: int) -> Column:
    """The key of n words of a key, from word `first` (from 0) on."""
    inner = F.substring(key, F.lit(first) * width + 1, F.lit(n) * width) if not isinstance(first, Column) else F.substr(key, first * width + 1, n * width)
    return F.rpad(inner, width * longest, F.lit(b"\x00"))


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, longest: int, width: int, most_bytes: int) -> DataFrame:
    """(key, n, cnt) of all phrases of 1 to `longest` words that occur often enough, as a table."""
    texts = encoded(docs, words, width, most_bytes)
    one = F.rpad(F.unhex(F.lpad(F.hex("id"), 2 * width, "0")), width * longest, F.lit(b"\x00"))
    levels, sieve = [words.select(one.alias("key"), F.lit(1).alias("n"), "cnt")], None
    written = [texts]
    for n in range(2, longest + 1):
        partial = materialise(phrase_counts(texts, n, sieve, width, longest))
        level = materialise(summed(partial, least))
        discard(partial)
        written.append(level)
        levels.append(level.select("key", F.lit(n).alias("n"), "cnt"))
        if n == longest or level.isEmpty():
            break
        sieve = filter_of(level, n, width)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    out = materialise(out)
    discard(*written)
    return out


def scored(frequent: DataFrame, totals: DataFrame, words: DataFrame, width: int, longest: int) -> DataFrame:
    """Phrases of 2 words or more (key, n, a, lang, total) with the cut that scores lowest: l, r, score."""
    first = F.conv(F.hex(F.substring("key", 1, width)), 16, 10).cast("long")
    phrases = frequent.where("n > 1").select("key", F.col("n").alias("len"), F.col("cnt").alias("a"), first.alias("id"))
    known = materialise(phrases.join(words.select("id", "lang"), "id").join(F.broadcast(totals), "lang").drop("id"))
    cut = known.select("*", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    # n is as long as needed: only its first words belong to the phrase.
    left = part_of(F.col("key"), F.lit(0), F.col("k"), width, longest)
    right = part_of(F.col("key"), F.col("k"), F.col("len") - F.col("k"), width, longest)
    f = frequent.select(F.col("key").alias("sub"), F.col("cnt"))
    cut = cut.withColumn("left", left).withColumn("right", right)
    cut = cut.join(f.withColumnsRenamed({"sub": "left", "cnt": "l"}), "left").join(f.withColumnsRenamed({"sub": "right", "cnt": "r"}), "right")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.select("key", F.struct(score_of(big("a"), big("total"), big("l"), big("r")).alias("score"), "k", "l", "r").alias("c"))
    cut = cut.groupBy("key").agg(F.min("c").alias("c"))
    out = materialise(known.join(cut, "key").select("key", "len", "a", "lang", "total", "c.l", "c.r", "c.score"))
    discard(known)
    return out


def score_of(a: Column, total: Column, left: Column, right: Column) -> Column:
    """floor(1000 a total / (left right)), exactly."""
    return F.call_function("div", (a * F.lit(1000).cast("decimal(4,0)")) * total, left * right).cast("long")


def without_covered(phrases: DataFrame, width: int, longest: int, percent: int) -> DataFrame:
    """Phrases that no longer one holds with `percent` of their occurrences."""
    sub = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("len") - 1),
            lambda m: F.transform(F.sequence(F.lit(0), F.col("len") - m), lambda i: part_of(F.col("key"), i, m, width, longest)),
        )
    )
    longer = phrases.where("len > 2").select(F.explode(sub).alias("key"), F.col("a").alias("longer"))
    longer = longer.groupBy("key").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(100 * F.col("longer").cast("decimal(20,0)") >= percent * F.col("a").cast("decimal(20,0)"), F.lit(False))
    return phrases.join(longer, "key", "left").where(~covered).drop("longer")


def spelled(phrases: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """phrases with `phrase`, their words joined by spaces."""
    word = lambda i: F.conv(F.hex(F.substr("key", i * width + 1, F.lit(width))), 16, 10).cast("long")
    each = phrases.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("len") - 1), word)).alias("pos", "id"))
    each = each.join(words.select("id", F.col("word").cast("string").alias("word")), "id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return phrases.join(each.groupBy("key").agg(text.alias("phrase")), "key")


@shielded
def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    covered: int = COVERED,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    a: how often a phrase occurs inside pieces of text, overlaps included, `least` at
    least; n: all words of its language. Of its cuts into two parts, which occur l and r
    times, the one of the lowest score = floor(1000 a n / (l r)) counts, of equal ones the
    shortest first part. Phrases that a longer one holds with `covered` percent of their
    occurrences are dropped. Ranks go by falling score, falling a, and phrase. A null text is
    empty; a null language is "und". Every row counts, repeated ones too; other columns
    play no part.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counts = materialise(word_counts(docs))
    totals = materialise(counts.groupBy("lang").agg(F.sum("cnt").alias("total")))
    words = dictionary(counts, least)
    discard(counts)
    width = 4 if words.count() < 1 << 32 else 8
    frequent = frequent_phrases(docs, words, least, longest, width, dictionary_bytes)
    phrases = scored(frequent, totals, words, width, longest)
    kept = materialise(spelled(without_covered(phrases, width, longest, covered), words, width))
    discard(frequent, phrases)
    order = (F.desc("score"), F.desc("a"), "phrase")
    # First by parts, so that no task sorts a whole language.
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    some = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
