"""Log lines from files, in an order that does not depend on how Spark reads them."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, mtime, part, at, value) of plain and gzip files; ordered by these four the lines are in order."""
    raw = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("mtime"),
        F.col("_metadata.file_block_start").alias("part"),
    )
    value = F.regexp_replace("value", "\r$", "")
    return raw.select("file", "mtime", "part", F.monotonically_increasing_id().alias("at"), value.alias("value"))


def files_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file, mtime) of files: a listing, which reads none of them. file is named as in read_lines."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.unix_timestamp("modificationTime").alias("mtime"), "modificationTime")


def new_files(files: DataFrame, mtime: int, file: str) -> list:
    """The files of a listing that were changed after a position's file, and this one, by time and name.

    The driver holds the names of new files, as it does to read them.
    """
    since = F.timestamp_seconds(F.lit(mtime))
    later = (F.col("mtime") > mtime) | (F.col("file") >= file)
    return files.where((F.col("modificationTime") >= since) & later).drop("modificationTime").orderBy("mtime", "file").collect()


def read_files(spark: SparkSession, files: list) -> DataFrame:
    """read_lines of listed files, whatever characters their names have."""
    return read_lines(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", f.path) for f in files])


def line_hash(value):
    """What a position remembers of the last line that was read."""
    return F.xxhash64(value)


def after_row(lines: DataFrame, row: int, last: int) -> DataFrame | None:
    """The lines of one file after line `row`, whose hash is `last`; None if that line is another one."""
    found = numbered(lines)
    if found.where((F.col("line_no") == row) & (line_hash("value") == last)).isEmpty():
        return None
    return found.where(F.col("line_no") > row).drop("line_no")


def first_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The first `limit` lines: whole splits, by their sizes, and a part of one; only that one is ranked."""
    split = ["mtime", "file", "part"]
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))  # one row for each split
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    used = sizes.withColumn("_room", room).where(F.col("_room") > 0)
    whole, cut = used.where("_n <= _room"), used.where("_n > _room")  # one split at most is cut
    rank = F.row_number().over(Window.partitionBy(*split).orderBy("at"))
    parted = lines.join(F.broadcast(cut), split).withColumn("_rank", rank).where("_rank <= _room")
    return lines.join(whole, split, "left_semi").unionByName(parted.select(*lines.columns))


def end_of(lines: DataFrame, resumed: str = "", row: int = 0) -> dict | None:
    """The position after lines: time, name, line and the line's hash of the last file; None without lines.

    resumed, row: a file that was read from a line on.
    """
    by_file = lines.groupBy("mtime", "file").agg(F.count(F.lit(1)).alias("n"), F.max_by(line_hash("value"), F.struct("part", "at")).alias("last"))
    end = by_file.orderBy(F.desc("mtime"), F.desc("file")).first()
    if end is None:
        return None
    return {"mtime": end["mtime"], "file": end["file"], "row": end["n"] + (row if end["file"] == resumed else 0), "last": end["last"]}


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line_no, from 1 in each file: the rank in a split and the sizes of the splits before it."""
    sizes = lines.groupBy("file", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    return (
        lines.withColumn("_rank", rank)
        .join(starts, ["file", "part"])
        .withColumn("line_no", F.col("_rank") + F.col("_start"))
        .drop("_rank", "_start")
    )


def select_new(lines: DataFrame, last_mtime: int, last_file: str, last_row: int) -> DataFrame:
    """Numbered lines after a saved position, which belongs to one file; older files are read already."""
    later = (F.col("mtime") > last_mtime) | ((F.col("mtime") == last_mtime) & (F.col("file") > last_file))
    return lines.where((F.col("mtime") >= last_mtime) & (later | ((F.col("file") == last_file) & (F.col("line_no") > last_row))))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where("value != ''")


def count_files(lines: DataFrame, first: int = 0) -> DataFrame:
    """(file, mtime, n) of each file that has lines, or of the first ones by time and name."""
    n = lines.groupBy("file", "mtime").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy("mtime", "file").limit(first) if first else n


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table, plain or gzip: with a header, or without one if its columns are named."""
    if columns:
        return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, escape='"')
    return spark.read.csv(path, header=True, mode="PERMISSIVE", escape='"')


def write_table(df: DataFrame, path: str, delim: str = ",", header: bool = True) -> None:
    """A CSV table as read_table reads it: values as they are, quotes in them doubled."""
    df.write.csv(path, sep=delim, header=header, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_words(spark: SparkSession, path: str) -> list[str]:
    """The lines of a short text file that are not blank: a list of settings, so the driver holds it."""
    return [r.value for r in spark.read.text(path).where("value != ''").collect()]


def write_words(spark: SparkSession, words: list[str], path: str) -> None:
    """A text file with one line for each word."""
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, value string").coalesce(1).orderBy("i").select("value").write.text(path)


_LINE = "file string, mtime long, part long, at long, value string"


def lines_of(spark: SparkSession, texts) -> DataFrame:
    """Lines from memory, such as standard input."""
    rows = [("", 0, 0, i, t.rstrip("\r\n")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, _LINE)


def spooled(spark: SparkSession, texts, path: str, chunk: int = 100_000) -> DataFrame:
    """lines_of for a stream of any length, such as standard input: written to a folder, `chunk` lines at a time.

    The driver holds one chunk; each is a part, in which lines are numbered.
    """
    for part, some in enumerate(itertools.batched(texts, chunk)):
        lines_of(spark, some).withColumn("part", F.lit(part).cast("long")).write.mode("append").parquet(path)
    lines_of(spark, []).write.mode("append").parquet(path)  # so that there is a folder without lines, too
    return spark.read.schema(_LINE).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, two tasks for each, if its files give fewer partitions than four for each; a larger scan is left alone.

    A file's row groups can be fewer than its partitions, of which some are empty then. Rows
    go by all their columns' hash, so none is sorted; equal rows, if any, stay together.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < cores:
        return df.repartition(cores)
    return df.repartition(2 * cores, *df.columns) if parts < 4 * cores else df
