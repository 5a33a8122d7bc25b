"""Substring deduplication by MinHash banding of paragraphs.

Passages are pasted into the middle of lines, so a paragraph here is a sentence of
MIN_WORDS words or more (half of the passages below): lines are cut after words that
end in . ! or ?. Shorter sentences that follow each other, over line ends too, are joined
until they have as many and the last one's hash ends a group; such ends depend on the
words there only, so copies in other surroundings are grouped alike soon. Shingles are five consecutive lower-cased words. BANDS bands of ROWS minima are tuned for recall:
a pair with Jaccard similarity 0.8 shares a band with probability
1 - (1 - 0.8 ** 3) ** 6 = 0.987, and equal paragraphs always do.

Equal paragraphs are collapsed to their hash. Bands that two different paragraphs share
give candidates, whose exact Jaccard similarity is then computed inside buckets, without
passing on pairs (see simhash.link). Components of the links, together with paragraphs
that occur more than once, are the clusters: their first occurrence stays, the others go.

Wherever sentences begin and end, any RUN words that stand earlier in the corpus are
found as well, by winnowing: of the grams of GRAM words in every RUN words the smallest
is a fingerprint, so equal runs have an equal one. Around fingerprints that recur all
runs are compared, and overlapping later ones make up a passage, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _LOWER, _SPACE, discard, extend, materialise, mix, powers, prepare, shielded, sieve, sifted, slices, with_few
from .components import components
from .simhash import TASK_ROWS, deal, link

MIN_WORDS = 25
#: One in so many short sentences may end a group.
GROUP = 2
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 6, 3
BUCKET_ROWS = 4096
RUN, GRAM = 50, 25

_Q = np.uint64(0xC6A4A7935BD1E995)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def words_of(offsets: np.ndarray, data: np.ndarray):
    """(hash, first byte, last byte, text index) of each word of a slice of texts, A-Z lower-cased."""
    data = _LOWER[data]
    space = _SPACE[data]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    first = np.r_[True, space[:-1]]
    first[inside] = True
    last = np.r_[space[1:], True]
    last[inside - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, starts
    up, down = powers(len(data))
    v = _BYTE[data] * up
    v[space] = 0
    return mix(np.add.reduceat(v, starts) * down[starts]), starts, ends, np.searchsorted(offsets, starts, "right") - 1


def joined(start: np.ndarray, stop: np.ndarray, texts: np.ndarray, ends: np.ndarray, least: int):
    """Spans (start, stop, number of the first sentence) of words: sentences of `least` words, and shorter ones joined.

    Only sentences that follow each other are joined, up to one that `ends` marks or that
    makes them three times as long; what is left over goes to the group before it, or is
    one if it is long enough, and is dropped otherwise.
    """
    size = stop - start
    whole, short = np.flatnonzero(size >= least), np.flatnonzero(size < least)
    new = np.flatnonzero((np.diff(short) != 1) | (texts[short[1:]] != texts[short[:-1]])) + 1
    from_, to = short[np.r_[0, new][: len(short)]], short[np.r_[new - 1, len(short) - 1][: len(short)]]
    spans: list = []
    for a, z in zip(from_.tolist(), to.tolist()):
        if stop[z] - start[a] < least:
            continue
        some = False
        for k in range(a, z + 1):
            size_now = stop[k] - start[a]
            if size_now >= least and (ends[k] or size_now >= 3 * least or (k == z and not some)):
                spans.append([start[a], stop[k], a])
                some, a = True, k + 1
        spans[-1][1] = stop[z]
    more = np.array(spans, np.int64).reshape(-1, 3)
    all_of = np.concatenate([np.stack([start[whole], stop[whole], whole], 1), more])
    return all_of[np.argsort(all_of[:, 0], kind="stable")].T


class Paragraphs:
    """The paragraphs of a slice of texts: hash, text index, ordinal, bytes and shingles of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, min_words: int):
        self.count = 0
        if not len(data):
            return
        h, starts, ends, doc = words_of(offsets, data)
        if not len(h):
            return
        raw = data
        lines = np.cumsum(raw == 10)
        cut = _ENDS[raw[ends]]
        cut[:-1] |= (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[ends[:-1]])
        cut[-1] = True
        stop = np.flatnonzero(cut) + 1
        start = np.r_[0, stop[:-1]]
        texts = doc[start]
        ordinal = np.arange(len(start)) - np.searchsorted(texts, texts)
        ends_group = mix(h[stop - 1]) % np.uint64(GROUP) == 0
        start, stop, sentence = joined(start, stop, texts, ends_group, max(min_words, SHINGLE))
        size = stop - start
        self.count = len(start)
        if not self.count:
            return
        self.doc, self.ordinal, self.words = texts[sentence], ordinal[sentence], size
        self.first, self.end = starts[start] - offsets[self.doc], ends[stop - 1] + 1 - offsets[self.doc]
        # Shingles: all windows of words, of which those inside one paragraph count.
        s = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            s[: len(h) - k] = s[: len(h) - k] * _Q + h[k:]
        n = size - SHINGLE + 1
        self.offset = np.r_[0, np.cumsum(n)]
        at = np.arange(self.offset[-1]) + np.repeat(start - self.offset[:-1], n)
        self.shingles = mix(s[at])
        # A paragraph's hash is of its shingles in their order: it stands for all its words.
        place = np.arange(self.offset[-1]) - np.repeat(self.offset[:-1], n)
        self.hash = mix(
            np.add.reduceat(mix(self.shingles + place.astype(np.uint64) * _Q), self.offset[:-1]) + size.astype(np.uint64)
        )

    def bands(self, which: np.ndarray):
        """(band keys, paragraph hash) of the chosen paragraphs, a band at a time."""
        minima = [np.minimum.reduceat(mix(self.shingles ^ seed), self.offset[:-1])[which] for seed in _SEEDS]
        for b in range(BANDS):
            key = np.full(len(which), b + 1, np.uint64)
            for m in minima[b * ROWS : (b + 1) * ROWS]:
                key = mix(key * _Q + m)
            yield key, self.hash[which]


def _found(column, min_words):
    for i, _, offsets, data in slices(column):
        p = Paragraphs(offsets, data, min_words)
        if p.count:
            yield i, p


def _batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def occurrences(docs: DataFrame, key_col: str, text_col: str, min_words: int) -> DataFrame:
    """(para, key, th, place, words, first, end): every paragraph, with its bytes [first, end) in the text.

    th, a hash of the text, tells rows with equal keys apart.
    """
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, p in _found(batch.column(1), min_words):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p.hash.view(np.int64)),
                        batch.column(0).take(pa.array(p.doc + i)),
                        batch.column(2).take(pa.array(p.doc + i)),
                        *(pa.array(x.astype(np.int32)) for x in (p.ordinal, p.words, p.first, p.end)),
                    ],
                    names=["para", "key", "th", "place", "words", "first", "end"],
                )

    slim = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    return slim.mapInArrow(run, f"para long, key {kind}, th long, place int, words int, first int, end int")


def band_rows(docs: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """(band, para), once for each paragraph in a batch."""

    def run(batches):
        for batch in batches:
            for _, p in _found(batch.column(0), min_words):
                _, which = np.unique(p.hash, return_index=True)
                for key, para in p.bands(which):
                    yield _batch(band=key.view(np.int64), para=para.view(np.int64))

    return docs.select(text_col).mapInArrow(run, "band long, para long")


def shingle_rows(docs: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """(para, shingles), once for each paragraph in a batch."""

    def run(batches):
        for batch in batches:
            for _, p in _found(batch.column(0), min_words):
                _, which = np.unique(p.hash, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(p.offset.astype(np.int32)), pa.array(p.shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.hash[which].view(np.int64)), lists.take(pa.array(which))], names=["para", "shingles"]
                )

    return docs.select(text_col).mapInArrow(run, "para long, shingles array<long>")


def verified_edges(candidates: DataFrame, similarity: float, bucket_rows: int) -> DataFrame:
    """(a, b): edges that join the similar paragraphs of each band. candidates: (band, para, shingles)."""
    spark = candidates.sparkSession
    rows = deal(candidates, "band", "para", bucket_rows)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() * 8 // TASK_ROWS))
    dealt = rows.select(F.xxhash64("_block").alias("block"), "para", "shingles").repartition(tasks, "block")

    def join(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        para = t.column(1).to_numpy().view(np.uint64)
        sets = [frozenset(x) for x in t.column(2).to_pylist()]

        def linked(i, j):
            return np.array(
                [len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]) for x, y in zip(i.tolist(), j.tolist())], bool
            )

        a, b = link(t.column(0).to_numpy(), np.ones(len(para), bool), para, linked)
        yield _batch(a=a.view(np.int64), b=b.view(np.int64))

    return dealt.mapInArrow(join, "a long, b long")


class Grams:
    """The fingerprints of a slice of texts, and its runs of RUN words."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.at = np.zeros(0, np.int64)
        if not len(data):
            return
        h, starts, ends, doc = words_of(offsets, data)
        n = len(h) - RUN + 1
        if n < 1:
            return
        up, self.down = powers(len(h) + 1)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
        self.doc, self.base = doc, np.searchsorted(doc, np.arange(len(offsets)))
        self.first, self.last = starts - offsets[doc], ends + 1 - offsets[doc]
        all_grams = np.arange(len(h) - GRAM + 1)
        self.gram = self.hash(all_grams, all_grams + GRAM)
        # The least gram of each run, zero where two texts meet; a gram that is the least of a run is picked.
        self.least = _sliding(self.gram, RUN - GRAM + 1, np.minimum)
        self.least[doc[:n] != doc[RUN - 1 :]] = 0
        pad = np.zeros(RUN - GRAM, np.uint64)
        most = _sliding(np.r_[pad, self.least, pad], RUN - GRAM + 1, np.maximum)
        self.at = np.flatnonzero((most == self.gram) & (most > 0))

    def hash(self, start, stop):
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def around(self):
        """(start, stop, hash) of the words that runs with each fingerprint can have."""
        d = self.doc[self.at]
        start = np.maximum(self.base[d], self.at - (RUN - GRAM))
        stop = np.minimum(self.base[d + 1], self.at + RUN)
        return start, stop, mix(self.hash(start, stop) + (self.at - start).astype(np.uint64) * _Q + (stop - start).astype(np.uint64))


def _sliding(x: np.ndarray, w: int, of) -> np.ndarray:
    """of() over each w neighbours, by doubling."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[:n], x[w - have : w - have + n]).copy()


def _rows(keys, texts_hash, names, *columns):
    """A batch of the words' rows: keys and hashes are Arrow arrays, of which the others are numpy."""
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32)) for c in columns]
    return pa.RecordBatch.from_arrays([keys, texts_hash, *arrays], names=["key", "th", *names])


_SPAN = "place int, stop int, first int, end int"


def repeated_passages(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, th, words, first, end, cluster, kept_key): passages of RUN words or more that stand earlier, word for word."""
    kind = docs.schema[key_col].dataType.simpleString()
    slim = docs.select(F.col(key_col).alias("key"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def fingerprints(batches):
        for batch in batches:
            for _, _, offsets, data in slices(batch.column(0)):
                g = Grams(offsets, data)
                if len(g.at):
                    fp, n = np.unique(g.gram[g.at], return_counts=True)
                    yield _batch(fp=fp.view(np.int64), n=n)

    def surroundings(batches):
        for batch in batches:
            for i, _, offsets, data in slices(batch.column(2)):
                g = Grams(offsets, data)
                if not len(g.at):
                    continue
                start, stop, around = g.around()
                doc = g.doc[g.at]
                row, base = pa.array(doc + i), g.base[doc]
                yield _rows(
                    batch.column(0).take(row), batch.column(1).take(row),
                    ["fp", "run", "at", "place", "stop", "first", "end"],
                    g.gram[g.at], around, g.at - base, start - base, stop - base, g.first[start], g.last[stop - 1],
                )

    def runs(batches):
        for batch in batches:
            for i, j, offsets, data in slices(batch.column(2)):
                g = Grams(offsets, data)
                wanted = [np.asarray(x, np.int64) for x in batch.column(3).slice(i, j - i).to_pylist()]
                at = np.concatenate([x + b for x, b in zip(wanted, g.base)])
                start = (at[:, None] - np.arange(RUN - GRAM + 1)).ravel()
                of = np.repeat(at, RUN - GRAM + 1)
                fits = (start >= 0) & (start < len(g.least))
                start, of = start[fits], of[fits]
                start = np.unique(start[g.least[start] == g.gram[of]])
                row, base = pa.array(g.doc[start] + i), g.base[g.doc[start]]
                yield _rows(
                    batch.column(0).take(row), batch.column(1).take(row), ["run", "place", "stop", "first", "end"],
                    g.hash(start, start + RUN), start - base, start - base + RUN, g.first[start], g.last[start + RUN - 1],
                )

    counts = slim.select("text").mapInArrow(fingerprints, "fp long, n long")
    again = materialise(counts.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp"))
    near = slim.mapInArrow(surroundings, f"key {kind}, th long, fp long, run long, at int, {_SPAN}")
    near = materialise(near.join(again, "fp", "left_semi"))
    here = F.struct("key", "th", "place")
    first_of = F.struct("a.key", "a.th", "a.place")

    def later(rows):
        first = rows.groupBy("run").agg(F.min(F.struct("key", "th", "place", "end")).alias("a"), F.max(here).alias("z"))
        first = materialise(first.where(~first_of.eqNullSafe(F.col("z"))).select("run", "a"))
        found = rows.join(first, "run", "left")
        return found, F.col("a").isNotNull() & ~here.eqNullSafe(first_of)

    found, is_later = later(near)
    found = materialise(found.withColumn("later", is_later))
    # Where the words around a fingerprint differ, single runs are compared; later equal ones need no more.
    differ = materialise(near.groupBy("fp").agg(F.min("run").alias("x"), F.max("run").alias("y")).where("x != y").select("fp"))
    edges = found.where("not later").join(differ, "fp", "left_semi").groupBy("key", "th").agg(F.collect_set("at").alias("at"))
    edges = edges.select(F.col("key").alias("_k"), F.col("th").alias("_t"), "at")
    with_text = slim.join(edges, F.col("key").eqNullSafe(F.col("_k")) & (F.col("th") == F.col("_t")))
    single = materialise(with_text.select("key", "th", "text", "at").mapInArrow(runs, f"key {kind}, th long, run long, {_SPAN}"))
    more, is_later = later(single)
    columns = ["key", "th", "run", "place", "stop", "first", "end", "a"]
    copies = found.where("later").select(columns).unionByName(more.where(is_later).select(columns))
    # A copy that overlaps its first occurrence in the same text begins after it.
    same = F.col("key").eqNullSafe(F.col("a.key")) & (F.col("th") == F.col("a.th"))
    copies = copies.withColumn("first", F.when(same, F.greatest("first", "a.end")).otherwise(F.col("first"))).where("first < end")
    copies = copies.withColumn("kept_key", F.col("a.key")).withColumn("kept_th", F.col("a.th")).withColumn("ahead", F.col("place") - F.col("a.place"))
    one = ("key", "th", "kept_key", "kept_th", "ahead")
    ordered = Window.partitionBy(*one).orderBy("place", "stop")
    reached = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("_new", F.coalesce((F.col("place") > reached).cast("int"), F.lit(0)))
    copies = copies.withColumn("_part", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return copies.groupBy(*one, "_part").agg(
        (F.max("stop") - F.min("place")).alias("words"),
        F.min("first").alias("first"),
        F.max("end").alias("end"),
        F.min("run").alias("cluster"),
    ).select("key", "th", "words", "first", "end", "cluster", "kept_key")


def repeated_paragraphs(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row for each occurrence of a paragraph that recurs, exactly or nearly, anywhere in docs.

    Columns: key_col, text_hash (xxhash64 of the text, which tells rows with equal keys
    apart), paragraph (its ordinal in the text, from 0), n_words, first and end (its bytes
    [first, end) in the UTF-8 text), cluster (a hash), kept_key and kept_paragraph (the
    cluster's first occurrence, by key, text_hash and ordinal; a null key comes first) and
    removed (whether this is a later one). A passage of RUN words or more that stands word
    for word earlier, by key, text_hash and place, gives a row too, with null paragraph and
    kept_paragraph, wherever its sentences begin; it may overlap paragraphs. Texts that are
    null, empty or without a paragraph give no rows. Rows of docs with equal keys and texts
    count as one document: their paragraphs are the same occurrences, each listed. Other
    columns of docs play no part.
    """
    prepare(docs.sparkSession)
    found = materialise(occurrences(docs, key_col, text_col, min_words))
    bands = band_rows(docs, text_col, min_words)
    shared = (
        bands.groupBy("band")
        .agg(F.min("para").alias("a"), F.max("para").alias("z"))
        .where("a != z")
        .select("band")
    )
    shared = materialise(shared)
    # Most bands are seen once; a filter keeps them out of the exchange.
    likely = sifted(bands, sieve(shared), F.col("band"), "hit").where("hit").drop("hit")
    candidates = materialise(likely.join(shared, "band", "left_semi").distinct())
    names = candidates.select("para").distinct()
    shingles = shingle_rows(docs, text_col, min_words).join(materialise(names), "para", "left_semi")
    shingles = materialise(shingles.groupBy("para").agg(F.first("shingles").alias("shingles")))
    roots = components(verified_edges(materialise(candidates.join(shingles, "para")), similarity, bucket_rows))
    clustered = materialise(
        found.join(roots, found["para"] == roots["node"], "left").select(
            F.coalesce("root", "para").alias("cluster"), "key", "th", "place", "words", "first", "end"
        )
    )
    discard(found)
    here = F.struct("key", "th", "place")
    clusters = materialise(
        clustered.groupBy("cluster")
        .agg(F.min(here).alias("a"), F.max(here).alias("z"))
        .where(~F.col("a").eqNullSafe(F.col("z")))
        .select("cluster", "a")
    )
    paragraphs = clustered.join(clusters, "cluster").select(
        F.col("key").alias(key_col),
        F.col("th").alias("text_hash"),
        F.col("place").alias("paragraph"),
        F.col("words").alias("n_words"),
        "first",
        "end",
        "cluster",
        F.col("a.key").alias("kept_key"),
        F.col("a.place").alias("kept_paragraph"),
        (~here.eqNullSafe(F.col("a"))).alias("removed"),
    )
    passages = repeated_passages(docs, key_col, text_col).select(
        F.col("key").alias(key_col),
        F.col("th").alias("text_hash"),
        F.lit(None).cast("int").alias("paragraph"),
        F.col("words").alias("n_words"),
        "first",
        "end",
        "cluster",
        "kept_key",
        F.lit(None).cast("int").alias("kept_paragraph"),
        F.lit(True).alias("removed"),
    )
    return paragraphs.unionByName(passages)


@shielded
def remove_paragraphs(docs: DataFrame, repeated: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed paragraphs cut out of the text, and n_removed instead of any such column.

    repeated: what repeated_paragraphs found in docs. Every row of docs comes out: one
    without removed paragraphs as it is, a null text as null, each with n_removed 0. Rows
    with equal keys and texts get equal results; rows with equal keys and other texts are
    cut apart. Overlapping cuts are one.
    """
    spans = (
        repeated.where("removed")
        .groupBy(F.col(key_col).alias("_key"), F.col("text_hash").alias("_th"))
        .agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("_cut"))
    )
    joined = with_few(docs.drop("n_removed"), materialise(spans), key_col, text_col)
    at, cut_at = joined.columns.index(text_col), joined.columns.index("_cut")

    def make():
        def step(batch):
            out, n = [], []
            for text, cut in zip(batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(cut_at).to_pylist()):
                n.append(len(cut or ()))
                spans: list = []  # they may overlap
                for c in cut or ():
                    if spans and c["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c["end"])
                    else:
                        spans.append([c["first"], c["end"]])
                for first, end in reversed(spans):
                    text = text[:first] + text[end:]
                out.append(text if text is None else text.decode())
            return [pa.array(out, pa.string()), pa.array(n, pa.int64())]

        return step

    new = [T.StructField(text_col, T.StringType()), T.StructField("n_removed", T.LongType())]
    return extend(joined, make, new, drop=("_cut",)).select(*docs.drop("n_removed").columns, "n_removed")
