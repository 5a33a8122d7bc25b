"""Blocks of counts by time or size, and how many of them are kept."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.parse import LABELS, UNIT_SECONDS
from gleaner.session import written


def block_by_time(df: DataFrame, pos: str = "retention_pos") -> DataFrame:
    """df with block_seq: the rank of its time bucket, from 0. Late rows join their own bucket."""
    ranks = df.select(pos).distinct().withColumn("block_seq", F.dense_rank().over(Window.orderBy(pos)) - 1)
    return df.join(ranks, pos)


def ranked(items: DataFrame, order: str, key: str) -> DataFrame:
    """Items with rank, from 0, by a column that can be ordered and then a key.

    Rows are dealt by ranges of both and of their number, so that neither equal values nor
    equal rows meet in one task, and sorted there; a row's rank is its place in its range and
    the sizes of the ranges before.
    """
    dealt = items.withColumn("_n", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(order, key, "_n").sortWithinPartitions(order, key, "_n").drop("_n")
    # The id's upper bits number the range, its lower 33 bits the row in it.
    table = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = table.groupBy(part.alias("_u")).agg(F.count(F.lit(1)).alias("_m"))  # one row for each range
    before = Window.orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_u", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    out = table.join(F.broadcast(starts), part == F.col("_u"))
    out = out.withColumn("rank", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")).drop("_at", "_u", "_start")
    out._written = table._written  # so that it can be erased
    return out


def block_by_size(items: DataFrame, block_size: int, order: str = "first", key: str = "term") -> DataFrame:
    """Items with block_seq: a block is full after block_size new ones, in the order of first sight."""
    return ranked(items, order, key).withColumn("block_seq", F.floor(F.col("rank") / block_size)).drop("rank")


def keep_last(df: DataFrame, max_blocks: int) -> DataFrame:
    """Rows of the newest max_blocks blocks, with block_no: their place in the ring. 0 keeps all."""
    if max_blocks <= 0:
        return df.withColumn("block_no", F.col("block_seq"))
    newest = df.agg(F.max("block_seq").alias("_newest"))
    out = df.join(F.broadcast(newest), F.col("block_seq") > F.col("_newest") - max_blocks).drop("_newest")
    return out.withColumn("block_no", F.pmod("block_seq", F.lit(max_blocks)))


def retained(blocks: DataFrame, retention: int, frequency: str) -> DataFrame:
    """Blocks whose last_epoch is within `retention` units of the newest; 0 keeps all."""
    if retention <= 0:
        return blocks
    newest = blocks.agg(F.max("last_epoch").alias("_newest"))
    unit = UNIT_SECONDS.get(frequency, 86400)
    return blocks.join(F.broadcast(newest), F.col("last_epoch") >= F.col("_newest") - retention * unit + 1).drop("_newest")


def sizing(most_in_bucket: int, retention: int) -> tuple[int, int]:
    """(block size, number of blocks; 0 for any) for the most lines that a time bucket had."""
    size = 10_000 if most_in_bucket < 3000 else 100_000 if most_in_bucket < 300_000 else 1_000_000
    return size, math.ceil(most_in_bucket / size) * retention


def most_in_bucket(lines: DataFrame, pos: str = "retention_pos") -> DataFrame:
    return lines.groupBy(pos).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def history(phrases: DataFrame, unit: int) -> DataFrame:
    """(phrase, at, cnt) by time bucket of when a block first saw a phrase."""
    at = (F.floor(F.col("created") / unit) * unit).alias("at")
    return phrases.groupBy("phrase", at).agg(F.sum("cnt").alias("cnt"))


def history_grid(long: DataFrame, ranked: list[str], unit: int) -> DataFrame:
    """One row for each bucket from the first to the last, one column for each phrase, null where it is absent."""
    span = long.agg(F.min("at").alias("a"), F.max("at").alias("z")).where("a is not null")
    times = span.select(F.explode(F.sequence("a", "z", F.lit(unit).cast("long"))).alias("at"))
    names = {p: f"p{i + 1}" for i, p in enumerate(ranked)}
    wide = long.where(F.col("phrase").isin(ranked)).groupBy("at").agg(
        *[F.sum(F.when(F.col("phrase") == p, F.col("cnt"))).alias(c) for p, c in names.items()], F.lit(1).alias("_")
    )
    return times.join(wide.drop("_"), "at", "left").orderBy("at")


def history_lines(long: DataFrame, ranks: DataFrame, n: int, unit: int, frequency: str, delim: str = ",") -> DataFrame:
    """(at, line): the grid of n phrases as text, one line for each bucket, cells parted by delim and empty where a phrase is absent.

    ranks: (phrase, rank from 0). A line is put together from the cells that are there, so
    its cost follows them and the line's length, however many phrases there are.
    """
    span = long.agg(F.min("at").alias("a"), F.max("at").alias("z")).where("a is not null")
    times = span.select(F.explode(F.sequence("a", "z", F.lit(unit).cast("long"))).alias("at"))
    cells = long.join(ranks.select("phrase", "rank"), "phrase").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rank", "cnt"))).alias("cells"))
    gap = lambda k: F.repeat(F.lit(delim), k.cast("int"))
    last = F.coalesce(F.try_element_at("cells", F.lit(-1))["rank"], F.lit(-1))
    text = F.transform("cells", lambda x, i: F.concat(gap(x["rank"] - F.when(i > 0, F.get("cells", i - 1)["rank"]).otherwise(-1)), x["cnt"].cast("string")))
    time = label(F.col("at"), frequency)
    time = F.when(F.contains(time, F.lit(delim)), F.concat(F.lit('"'), time, F.lit('"'))).otherwise(time)
    out = times.join(cells, "at", "left").withColumn("cells", F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)))
    return out.select("at", F.concat(time, F.array_join(text, ""), gap(F.lit(n - 1) - last)).alias("line"))


def label(at, frequency: str):
    return F.date_format(F.timestamp_seconds(at), LABELS.get(frequency, "yyyy-MM-dd HH:mm:ss"))
