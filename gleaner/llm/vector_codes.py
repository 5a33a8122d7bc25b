"""Vector code compression: each vector becomes one byte for each of its parts.

A component x becomes the integer floor(1024 x), and a vector is cut into PARTS equal
consecutive parts. Each part position has a codebook of ENTRIES integer vectors, which a
few rounds of k-means fit to all vectors: workers get the codebooks as a broadcast
(ENTRIES vectors at most, whatever the input), compute all distances of an Arrow batch by
|x|^2 + |c|^2 - 2 x.c with int64 matrix products, take the first least one, and add parts
up by entry; those sums are merged by a grouped shuffle, whose result is as large as the
codebooks. Everything is exact: products wrap around modulo 2^64, and rows with a distance
that might not fit are computed with Python's integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, materialise, prepare, shielded

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Integers beyond this are confined to it: components of about 10^9.
LIMIT = 1 << 40
#: Rows after which a task gives out its sums: fewer than could pass a long.
FLUSH_ROWS = 1 << 20
#: Labels of which all sums are broadcast; beyond them only those of over one row in FEW_LABELS.
FEW_LABELS = 10_000
LONG = (1 << 63) - 1


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers from lists of doubles; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(values * float(SCALE)), -LIMIT, LIMIT).astype(np.int64)
    lengths = np.asarray(column.value_lengths(), np.int64)
    if (lengths == width).all():
        return whole.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance, at most LONG) of each row; ties go to the lower index."""
    d = (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)
    at = d.argmin(axis=1)
    best = d[np.arange(len(x)), at]
    reach = np.abs(x).max(axis=1, initial=0).astype(float) + float(np.abs(book).max(initial=0))
    for i in np.flatnonzero(x.shape[1] * reach**2 >= 2.0**62):
        exact = ((x[i].astype(object) - book.astype(object)) ** 2).sum(axis=1)
        at[i] = min(range(len(book)), key=exact.__getitem__)
        best[i] = min(exact[at[i]], LONG)
    return at, best


def split(x: np.ndarray, parts: int):
    """The parts of each row."""
    m = x.shape[1] // parts
    return [np.ascontiguousarray(x[:, p * m : (p + 1) * m]) for p in range(parts)]


def sums_of(at: np.ndarray, x: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the number of its rows, and their sum."""
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    if len(used):
        out[used, 0] = np.diff(np.append(first, len(at)))
        out[used, 1:] = np.add.reduceat(x[order], first, axis=0) if x.shape[1] else 0
    return out


def one_round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks (parts, entries, width of a part): each entry the floor of its parts' mean."""
    parts, entries, m = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = sent.value
        total, rows = np.zeros((parts, entries, m + 1), np.int64), 0

        def out():
            p, e = np.nonzero(total[:, :, 0])
            arrays = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "s"])

        for batch in batches:
            x = integers(batch.column(0), parts * m)
            for p, piece in enumerate(split(x, parts)):
                total[p] += sums_of(nearest(piece, books[p])[0], piece, entries)
            rows += len(x)
            if rows >= FLUSH_ROWS:
                yield out()
                total[:], rows = 0, 0
        if rows:
            yield out()

    each = vectors.mapInArrow(run, "part int, entry int, s array<long>").select("part", "entry", F.posexplode("s").alias("at", "v"))
    # Halves of 32 bits, so that sums of any number of rows fit.
    high, low = F.shiftright("v", 32), F.col("v").bitwiseAND(F.lit((1 << 32) - 1))
    merged = each.groupBy("part", "entry", "at").agg(F.sum(high).alias("high"), F.sum(low).alias("low"))
    got = {(r.part, r.entry, r["at"]): (r.high << 32) + r.low for r in merged.collect()}
    sent.unpersist()
    out = books.copy()
    for (p, e, i), v in got.items():
        if i:
            out[p, e, i - 1] = v // got[p, e, 0]
    return out


def codebooks(vectors: DataFrame, first: list[list[float]], parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks fitted to vectors (one column, array<double>), from the vectors `first` as entries."""
    width = vectors.agg(F.max(F.size(vectors.columns[0]))).first()[0] or 0
    width = -(-width // parts) * parts
    x = integers(pa.array(first, pa.list_(pa.float64())), width)
    books = np.stack(split(x, parts))
    for _ in range(rounds):
        books = one_round(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_group_sum(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df (a written table) with the sum of value over rows of equal `by`, nulls together; at most LONG.

    Sums of few groups are broadcast. Of many, those that hold over one row in FEW_LABELS
    are, so fewer than FEW_LABELS; the others come by a join, without a hot key.
    """
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = materialise(df.groupBy(F.col(by).alias("_by")).agg(total.alias(name), F.count(F.lit(1)).alias("_n")))
    on = F.col(by).eqNullSafe(F.col("_by"))
    columns = [*df.columns, name]
    if sums.count() <= FEW_LABELS:
        return df.join(F.broadcast(sums), on).select(columns)
    most = (sums.agg(F.sum("_n")).first()[0]) // FEW_LABELS
    hot = F.broadcast(sums.where(F.col("_n") > most))
    rest = df.join(hot, on, "left_anti").join(sums.where(F.col("_n") <= most), on)
    return df.join(hot, on).select(columns).union(rest.select(columns))


@shielded
def compress(
    docs: DataFrame,
    key_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """docs without the vector, with code, error, label_error and codebooks_sha256; one row for each that is kept.

    Rows whose vector is null or holds a null or a component that is no finite number are
    dropped. code: the index of the nearest entry for each part, two hex digits each;
    error: the squared distances to them, summed; label_error: error summed over rows of
    equal labels, nulls together. Both are at most the largest long. Codebooks start from
    the vectors with the smallest keys (null keys last; of equal keys the smaller vector
    first), so repeated rows may fill several entries, of which the first is used; with
    fewer vectors than entries there are fewer entries. Vectors of unequal length, or of
    one that `parts` doesn't divide, count as ending in zeros. Components beyond about 10^9
    count as that. Columns of docs with one of the new names are replaced. docs is read
    once for each round and three times besides.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part, so 256 entries at most")
    spark = docs.sparkSession
    prepare(spark)
    new = ("code", "error", "label_error", "codebooks_sha256")
    docs = docs.drop(*[c for c in new if c not in (key_col, label_col)])
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = docs.where(F.col(vector_col).isNotNull() & finite).withColumn(vector_col, vector)
    first = kept.select(F.col(key_col).alias("k"), F.col(vector_col).alias("v")).orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()
    books = codebooks(kept.select(vector_col), [r.v for r in first], parts, rounds)
    sent = spark.sparkContext.broadcast(books)
    at = kept.columns.index(vector_col)
    width = books.shape[0] * books.shape[2]

    def make():
        books = sent.value

        def step(batch):
            x = integers(batch.column(at), width)
            found = [nearest(piece, books[p]) for p, piece in enumerate(split(x, parts))]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            text = codes.tobytes().hex()
            n = 2 * parts
            whole = [min(sum(e), LONG) for e in zip(*(f[1].tolist() for f in found))]
            return [pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), pa.array(whole, pa.int64())]

        return step

    fields = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    coded = materialise(extend(kept, make, fields, drop=(vector_col.lower(),)))
    out = with_group_sum(coded, label_col, "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))
