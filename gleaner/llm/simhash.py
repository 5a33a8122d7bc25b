"""SimHash near-duplicates by multi-index hashing.

A text's 64-bit fingerprint has a bit set where over half of the XXH64 hashes of its
4-word shingles have it set. Fingerprints are cut into m segments. Two that differ in r
bits or fewer differ in at most floor(r / m) bits in some segment, so each fingerprint
is filed under its value in each segment, and looked up under every value of the small
Hamming ball around it; what meets in a bucket is verified on all 64 bits.

Equal fingerprints are collapsed first. Of two values one bit apart only the smaller
looks up the other, so a pair meets in one bucket of a segment. A bucket passes on no
pairs: its linked members are joined by union-find inside the task, and one edge for
each is emitted. Buckets over BUCKET_ROWS rows are dealt over blocks of pairs of chunks,
which compares everything with bounded memory in each task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, extend, materialise, prepare, shielded, texts, with_few
from .components import components

WORDS = 4
SEED = 42
DISTANCE = 4
BUCKET_ROWS = 4096
#: Rows of buckets that one task holds.
TASK_ROWS = 1_000_000

_SPLIT = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Zero for a text without words; fewer words than a shingle are one shingle."""
    w = text.translate(_SPLIT).split(b" ")
    w = [x for x in w if x] if b"" in w else w
    n = len(w)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(b" ".join(w), SEED)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = [0, *ends[: n - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    h = np.fromiter([digest(joined[a:z], SEED) for a, z in zip(starts, stops)], np.uint64, len(stops))
    return majority(h)


def majority(h: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", words: int = WORDS, name: str = "fingerprint"
) -> DataFrame:
    """docs with the fingerprint (long, the 64 bits as a signed number) instead of any column of that name."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def make():
        def step(batch):
            h = np.array([fingerprint(t, words) for t in texts(batch.column(at))], np.uint64)
            return [pa.array(h.view(np.int64))]

        return step

    return extend(docs, make, [T.StructField(name, T.LongType())])


def spans(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def buckets(fp: np.ndarray, segments: int, distance: int):
    """Yields (bucket ids, indices into fp, filed rather than looking up) for all segments."""
    radius = distance // segments
    for k, (shift, bits) in enumerate(spans(segments)):
        value = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        yield mix_id(value, k), np.arange(len(fp)), True
        flips = [0]
        for _ in range(radius):
            flips = sorted({f | 1 << b for f in flips for b in range(bits)} | set(flips))
        for f in flips[1:]:
            near = value ^ np.uint64(f)
            up = np.flatnonzero(near > value)
            yield mix_id(near[up], k), up, False


def mix_id(value: np.ndarray, k: int) -> np.ndarray:
    return (value | (np.uint64(k) << np.uint64(58))).view(np.int64)


def link(bucket: np.ndarray, filed: np.ndarray, fp: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join the linked members of each bucket, few of which are redundant.

    linked(i, j) says for two index arrays which pairs are links. Pairs of rows that
    both look up are not compared: they meet elsewhere.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, filed, fp = bucket[order], filed[order], fp[order]
    _, node = np.unique(fp, return_inverse=True)
    names = np.unique(fp)
    root = np.arange(len(names))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    i, d = np.arange(len(bucket)), 1
    while True:
        i = i[i + d < len(bucket)]
        i = i[bucket[i] == bucket[i + d]]
        if not len(i):
            break
        some = i[(filed[i] | filed[i + d]) & (root[node[i]] != root[node[i + d]])]
        if len(some):
            some = some[linked(order[some], order[some + d])]
            for x, y in zip(node[some].tolist(), node[some + d].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(some):
                while (root[root] != root).any():
                    root = root[root]
        d += 1
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]


def deal(rows: DataFrame, by: str, chunk_of: str, most: int) -> DataFrame:
    """rows with _block: rows of a bucket of up to `most` rows share it; larger ones go to pairs of chunks.

    Each two rows of a bucket share at least one block.
    """
    large = materialise(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))
    if large.isEmpty():
        return rows.withColumn("_block", F.struct(F.col(by), F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.join(large, by, "left")
    chunks = F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("int")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(F.col(chunk_of)), chunks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_o")
    return rows.select("*", other).select(
        *[c for c in rows.columns if c not in ("_n", "_c")],
        F.struct(F.col(by), F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j")).alias("_block"),
    )


def segments_for(n: int) -> int:
    """The number of segments for n fingerprints; any number gives the same result.

    With 3 a fingerprint makes 34 rows, and buckets of 21 bits compare it with 17 n / 2 ** 21
    others on the average; with 2, which probe balls of radius 2, it makes 530 rows, and
    chance partners are rare. A row costs about as much as some hundred comparisons, so
    the second is cheaper from some billions of fingerprints on.
    """
    return 3 if n <= 1 << 33 else 2


def near_edges(fps: DataFrame, distance: int, segments: int | None, bucket_rows: int) -> DataFrame:
    """(a, b): edges between linked fingerprints, enough to connect all that links connect. fps: distinct."""
    n = fps.count()
    segments = segments or segments_for(n)
    radius = distance // segments
    probes = sum(sum(math.comb(b, r) for r in range(radius + 1)) for _, b in spans(segments))
    spark = fps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * probes // TASK_ROWS))

    def emit(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for bucket, at, filed in buckets(fp, segments, distance):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(fp[at].view(np.int64)), pa.array(np.full(len(at), filed))],
                    names=["bucket", "fp", "filed"],
                )

    emitted = fps.repartition(tasks, "fingerprint").mapInArrow(emit, "bucket long, fp long, filed boolean")
    rows = deal(emitted, "bucket", "fp", bucket_rows)
    dealt = rows.select(F.xxhash64("_block").alias("block"), "fp", "filed").repartition(tasks, "block")

    def join(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        block = t.column(0).to_numpy()
        fp = t.column(1).to_numpy().view(np.uint64)
        filed = t.column(2).to_numpy()

        def linked(i, j):
            return np.bitwise_count(fp[i] ^ fp[j]) <= distance

        a, b = link(block, filed, fp, linked)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(join, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
    segments: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(key_col, fingerprint long, component_id): one row for each row of docs.

    Fingerprints that differ in `distance` bits or fewer are linked; component_id is the
    smallest key that links reach, the row's own included. Texts that are null or have
    no word have fingerprint 0 and are linked like any others. Null keys are no
    candidates for component_id; it is null where a component has no other key. Rows
    with equal keys each get a row. Other columns of docs play no part.
    """
    slim = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    fp = materialise(with_fingerprint(slim, "text", words).select("key", "fingerprint"))
    distinct = materialise(fp.groupBy("fingerprint").agg(F.min("key").alias("least")))
    roots = components(near_edges(distinct.select("fingerprint"), distance, segments, bucket_rows))
    named = roots.join(distinct, F.col("node") == F.col("fingerprint")).select("node", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("of_root"))
    linked = named.join(least, "root").select("node", "of_root")
    labels = materialise(
        distinct.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", F.coalesce("of_root", "least").alias("component_id")
        )
    )
    discard(distinct)
    return fp.join(labels, "fingerprint").select(F.col("key").alias(key_col), "fingerprint", "component_id")


@shielded
def keep_one(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
    segments: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row of docs for each component that near_duplicates finds, with the columns of docs.

    It is a row with the component's smallest key; a null key counts as the largest, of
    rows with equal keys those with the smallest hash of the text come first, and of rows
    with equal keys and texts any one stays. Rows with equal keys whose texts are in
    different components are judged apart.
    """
    th = F.xxhash64(F.col(text_col))
    slim = docs.select(F.col(key_col).alias("_key"), th.alias("_th"), F.col(text_col).alias("text"))
    slim = with_fingerprint(slim, "text", words).groupBy("_key", "_th", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(slim)
    place = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_th").alias("th"))
    firsts = materialise(rows.groupBy("fingerprint").agg(F.min(place).alias("first")))
    roots = components(near_edges(firsts.select("fingerprint"), distance, segments, bucket_rows))
    grouped = firsts.join(roots, F.col("fingerprint") == F.col("node"), "left")
    grouped = materialise(grouped.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("g")))
    chosen = grouped.groupBy("g").agg(F.min("first").alias("chosen"))
    judged = rows.join(grouped.join(chosen, "g").select("fingerprint", "chosen"), "fingerprint")
    stays = place.eqNullSafe(F.col("chosen"))
    # What is not said about a document is that all its rows, of which there is one, stay.
    few = materialise(judged.where(~stays | (F.col("n") > 1)).select("_key", "_th", stays.alias("_stays")))
    discard(rows, firsts, grouped)
    said = with_few(docs, few, key_col, text_col)
    repeated = said.where("_stays").withColumn("_th", th).dropDuplicates([key_col, "_th"])
    return said.where("_stays is null").select(*docs.columns).union(repeated.select(*docs.columns))
