"""Line deduplication by winnowing over line hashes.

Each text is a sequence of hashes of its lines that are not blank. From every window of
`min_lines` consecutive hashes the smallest (the rightmost of equals) is selected as a
fingerprint, so any run of min_lines equal lines holds one, wherever it stands. A
fingerprint's row carries its position and the runs of min_lines lines around it.

Fingerprints that occur at one position only are dropped. At the others the match is
extended both ways: the runs around the positions are compared, each run's first
position in the corpus is found, and all later ones are deleted; overlapping deleted
runs make up a whole repeated run, however long. No pairs of positions are made.

Lines of over `line_words` words can be runs of their own too, with a salted hash for
both fingerprint and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, prepare, shielded, sieve, sifted, texts, with_few

MIN_LINES = 2
#: A line of more words than this is a run of its own for the query and the pipeline.
LONG_LINE = 50
#: Seed of the hashes of lines that are runs of their own.
ALONE = 1


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the window minima, the rightmost of equals; none if there are fewer than w hashes."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - np.argmin(views, axis=1))


def runs_of(text: bytes, w: int, line_words: int | None = None):
    """(fingerprint, [(run's hash, its first line, its last line)]) of a text; a line of over line_words is a run."""
    at, hashes = [], []
    for i, line in enumerate(text.split(b"\n")):
        line = line.strip()
        if line:
            at.append(i)
            hashes.append(xxhash.xxh64_intdigest(line))
            if line_words is not None and len(line.split()) > line_words:
                alone = xxhash.xxh64_intdigest(line, ALONE)
                yield alone, [(alone, i, i)]
    h = np.array(hashes, np.uint64)
    picked = winnow(h, w)
    if not len(picked):
        return
    raw = h.tobytes()
    run = [xxhash.xxh64_intdigest(raw[8 * i : 8 * (i + w)]) for i in range(len(h) - w + 1)]
    for p in picked.tolist():
        around = range(max(0, p - w + 1), min(p, len(h) - w) + 1)
        yield hashes[p], [(run[i], at[i], at[i + w - 1]) for i in around]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def repeated_runs(docs: DataFrame, key_col: str, text_col: str, min_lines: int, line_words: int | None) -> DataFrame:
    """(_key, _th, _runs): the line ranges to delete in each document that has any."""
    kind = docs.schema[key_col].dataType.simpleString()
    slim = docs.select(
        F.col(key_col).alias("_key"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("_text")
    )

    def fingerprints(batches):
        for b in batches:
            h, row, runs = [], [], []
            for i, text in enumerate(texts(b.column(2))):
                for fp, around in runs_of(text, min_lines, line_words):
                    h.append(_signed(fp))
                    row.append(i)
                    runs.append([{"run": _signed(r), "first": a, "last": z} for r, a, z in around])
            row = pa.array(row, pa.int64())
            struct = pa.struct([("run", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), b.column(0).take(row), b.column(1).take(row), pa.array(runs, pa.list_(struct))],
                names=["h", "_key", "_th", "runs"],
            )

    picked = slim.mapInArrow(
        fingerprints, f"h long, _key {kind}, _th long, runs array<struct<run: long, first: int, last: int>>"
    )
    picked = materialise(picked)
    # Whether there are several places is seen from their hashes alone, so that rows stay small.
    place = F.xxhash64("_key", "_th", F.col("runs")[0]["first"])
    again = materialise(
        picked.select("h", place.alias("p"))
        .groupBy("h")
        .agg(F.min("p").alias("a"), F.max("p").alias("z"))
        .where("a <> z")
        .select("h")
    )
    # Fingerprints that a Bloom filter of the repeated ones holds back keep their runs where they are.
    maybe = sifted(picked, sieve(again), F.col("h"), "_maybe").where("_maybe")
    runs = materialise(
        maybe.join(again, "h", "left_semi")
        .select("_key", "_th", F.explode("runs").alias("r"))
        .select("_key", "_th", "r.run", "r.first", "r.last")
    )
    discard(picked, again)
    here, place = F.struct("_key", "_th", "first"), F.xxhash64("_key", "_th", "first")
    first = materialise(
        runs.groupBy("run")
        .agg(F.min(here).alias("a"), F.min(place).alias("lo"), F.max(place).alias("hi"))
        .where("lo <> hi")
        .select("run", "a")
    )
    later = runs.join(first, "run").where(~here.eqNullSafe(F.col("a")))
    found = materialise(later.groupBy("_key", "_th").agg(F.collect_set(F.struct("first", "last")).alias("_runs")))
    discard(runs, first)
    return found


@shielded
def dedup_lines(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = MIN_LINES,
    line_words: int | None = None,
) -> DataFrame:
    """docs with later repeated runs of lines deleted from the text, and n_lines and n_removed.

    Lines are what \\n parts; they are equal if they are without their leading and
    trailing ASCII white space. A run of min_lines or more lines that are not blank
    (blank ones between them don't count) goes if the same lines, in this order, stand
    earlier: in a document with a smaller key (null is the smallest; among equal keys,
    the smaller hash of the text), or further up in the same one. Blank lines inside a
    deleted run go with it. Unless line_words is None, a single line of more words than
    that goes as well if it stands earlier, in the same sense. Rows equal in key and text are one document: they get the
    same result and don't delete each other's lines. A null text stays null with
    n_lines 0; an empty one has one line. Columns of docs named n_lines or n_removed are
    replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("n_lines", "n_removed")
    found = repeated_runs(docs, key_col, text_col, min_lines, line_words)
    joined = with_few(docs, found, key_col, text_col)
    all_lines = F.split(F.col(text_col), "\n", -1)
    gone = F.array_distinct(
        F.flatten(F.transform("_runs", lambda r: F.sequence(r["first"], r["last"])))
    )
    with_lists = joined.withColumn("_gone", F.when(F.col("_runs").isNotNull(), gone))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_gone"))
    # The lines that stay, joined again; only texts that lose lines are taken apart.
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    out = with_lists.withColumn("_lines", F.when(F.col("_gone").isNotNull(), all_lines))
    n_lines = F.coalesce(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    out = out.withColumn("n_lines", n_lines.cast("long")).withColumn(
        "n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    )
    out = out.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept))
    return out.select(*docs.columns, "n_lines", "n_removed")
