"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch; bounds what a Python worker holds of whole texts.
BATCH_ROWS = 500
#: Bytes in an Arrow batch (one row may be longer).
BATCH_BYTES = 16 << 20
#: Bytes of text that a vectorised step looks at together (one text may be longer).
SLICE_BYTES = 1 << 20
#: Bits of a Bloom filter that decides which rows are exchanged.
FILTER_BITS = 1 << 23

_own_dir: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches to ours, so that a Python worker holds few whole texts.

    They stay lowered, as Spark looks at them when a result is evaluated.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, and there only, one of our own if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="gleaner-")
    return _own_dir[app]


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/gleaner/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote, once all that was made of them has been written too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bit(h: Column) -> tuple[Column, Column]:
    """The word and the mask of a hash in a filter of FILTER_BITS bits."""
    bit = F.pmod(h, F.lit(FILTER_BITS))
    return F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def sieve(hashes: DataFrame) -> DataFrame:
    """A Bloom filter of the one column of hashes (long), as a table of at most FILTER_BITS / 64 words."""
    word, mask = _bit(F.col(hashes.columns[0]))
    return materialise(hashes.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask")))


def sifted(df: DataFrame, filter_: DataFrame, h: Column, name: str) -> DataFrame:
    """df with a boolean: whether the filter may hold h. The filter's size is bounded, so it is broadcast."""
    word, mask = _bit(h)
    joined = df.withColumn("_at", word).join(F.broadcast(filter_), F.col("_at") == F.col("_word"), "left")
    hit = F.coalesce(F.col("_mask").bitwiseAND(mask) != 0, F.lit(False))
    return joined.withColumn(name, hit).drop("_at", "_word", "_mask")


def with_few(docs: DataFrame, few: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """docs with the columns that few has beside _key and _th (key and xxhash64 of the text); null for other rows.

    Texts are not exchanged, but for those of rows that a Bloom filter of few lets
    through; as few grows these become all, so the result is exact at any size. docs is
    read twice.
    """
    new = [f for f in few.schema if f.name not in ("_key", "_th")]
    found = few.select(F.col("_key").alias("_k"), F.col("_th").alias("_t"), *[f.name for f in new])
    filter_ = sieve(few.select(F.xxhash64("_key", "_th").alias("h")))
    th = F.xxhash64(F.col(text_col))
    marked = sifted(docs, filter_, F.xxhash64(F.col(key_col), th), "_hit")
    on = F.col(key_col).eqNullSafe(F.col("_k")) & (th == F.col("_t"))
    theirs = marked.where("_hit").join(found, on, "left")
    others = marked.where("not _hit").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    columns = [*docs.columns, *[f.name for f in new]]
    return theirs.select(columns).union(others.select(columns))


def shielded(operator):
    """operator, with columns whose names begin with _ renamed while it runs: its own helpers have such names.

    Columns are those of the first argument; other tables and column names among the
    arguments follow them.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named):
        aside = {c: f"aside{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not aside:
            return operator(docs, *args, **named)

        def follow(x):
            if isinstance(x, DataFrame):
                return x.withColumnsRenamed(aside)
            return aside.get(x, x) if isinstance(x, str) else x

        out = operator(follow(docs), *map(follow, args), **{k: follow(v) for k, v in named.items()})
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run


def extend(df: DataFrame, make, new: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns `new`, which make() computes from each Arrow batch.

    make() is called once in a task and returns a function from a RecordBatch to a
    list of arrays in the order of `new`. A column of df that has the name of a new
    one, in any case of its letters, is replaced by it.
    """
    names = {f.name.lower() for f in new} | set(drop)
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    schema = T.StructType([df.schema[i] for i in keep] + new)

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in keep] + list(step(batch)), names=schema.names
                )

    return df.mapInArrow(run, schema)


def revive(kind: type, state: dict):
    """An object of a class from its attributes; broadcasts hold attributes, as executors lack the class."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9DDFEA08EB382D69)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array):
    """Parts of a text column, as (row from, row to, offsets, bytes), of about SLICE_BYTES."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, at[i : j + 1] - at[i], data[at[i] : at[j]]
        i = j


def token_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and each text's number of words."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    up, down = powers(len(data))
    v = _BYTE[data] * up
    v[space] = 0
    h = mix(np.add.reduceat(v, starts) * down[starts])
    doc = np.searchsorted(offsets, starts, "right") - 1
    return h, np.bincount(doc, minlength=docs)
