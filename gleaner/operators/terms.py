"""Counts of terms and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.tokens import STAR

BORDER_RATE = 0.999


def order_codes(df: DataFrame, *places: str, room: Column | None = None) -> list[Column] | None:
    """For each of some columns (whole numbers or structs of them, all alike) a long that orders rows as it does; None if longs are too small.

    Spark aggregates longs by hash, but sorts the rows to find the least of structs. room (an
    aggregate): how far codes of different places are apart at least. df is read once, for the ranges.
    """
    leaves = [_leaves(df.select(F.col(c).alias("c")).schema["c"].dataType, c) for c in places]
    ends = [F.struct(F.min(F.least(*x) if len(x) > 1 else x[0]).alias("a"), F.max(F.greatest(*x) if len(x) > 1 else x[0]).alias("z")) for x in zip(*leaves)]
    gaps = F.coalesce(F.sum(sum(c.isNull().cast("int") for x in leaves for c in x)), F.lit(0))
    *spans, gaps, room = df.agg(*[e.alias(f"_{i}") for i, e in enumerate(ends)], gaps.alias("_gaps"), (F.lit(1) if room is None else room).alias("_room")).first()
    if gaps or any(s["a"] is None for s in spans):
        return None
    room, codes, size = max(room or 1, 1), [F.lit(0).cast("long") for _ in places], 1
    for s, at in zip(spans, zip(*leaves)):
        n = s["z"] - s["a"] + 1
        codes, size = [code * F.lit(n).cast("long") + (c - F.lit(s["a"])) for code, c in zip(codes, at)], size * n
        if size * room >= 1 << 63:
            return None
    return [code * F.lit(room).cast("long") for code in codes]


def _leaves(kind: T.DataType, name: str) -> list[Column]:
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in _leaves(f.dataType, f"{name}.{f.name}")]
    return [F.col(name).cast("long")]


def term_counts(lines: DataFrame, weight: str | None = None) -> DataFrame:
    """(term, cnt, first) of lines with tokens and seq: first orders terms by where they were first seen."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        lines.select("seq", w.alias("w"), F.posexplode("tokens").alias("pos", "term"))
        .where(F.col("term") != STAR)
        .groupBy("term")
        .agg(F.sum("w").alias("cnt"), F.min(F.struct("seq", "pos")).alias("first"))
    )


def vector_terms(vecs: DataFrame, place: str, code: Column | None, *by: str) -> DataFrame:
    """term_counts of vectors (tokens, w), by more columns: first seen at the column `place`, or at its code, with room for tokens."""
    first = F.struct(F.col(place).alias("seq")) if code is None else code
    each = vecs.select(*by, "w", first.alias("at"), F.posexplode("tokens").alias("pos", "term")).where(F.col("term") != STAR)
    first = F.struct("at.seq", "pos") if code is None else F.col("at") + F.col("pos")
    return each.groupBy("term", *by).agg(F.sum("w").alias("cnt"), F.min(first).alias("first"))


def with_ids(counts: DataFrame, order: str) -> DataFrame:
    """counts with id: a term's number in the order of first sight (a column that can be ordered), from 1."""
    from .ring import ranked

    return ranked(counts, order, "term").withColumn("id", F.col("rank") + 1).drop("rank")


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of two batches as one; first places of the older one come first."""
    both = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)))
    return both.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.min_by("first", "_b").alias("first"))


def count_border(counts: DataFrame, rate: float, column: str = "cnt") -> DataFrame:
    """One row (border): how often a term must occur for the terms above it to make up `rate` of all.

    Works on the distinct counts, of which there are about the square root of the total.
    """
    sizes = counts.groupBy(F.col(column).alias("c")).agg(F.sum(column).alias("s"))
    down = Window.orderBy(F.desc("c"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.select(
        "c",
        ((F.coalesce(F.sum("s").over(before), F.lit(0)) + F.col("c")) / F.sum("s").over(everything)).alias("share"),
        F.max("c").over(everything).alias("top"),
    )
    inside = F.sort_array(F.collect_set(F.when(F.col("share") < F.lit(float(rate)), F.col("c"))))
    return ranked.agg(inside.alias("k"), F.max("top").alias("top")).select(
        F.coalesce(F.get("k", F.lit(1)), F.get("k", F.lit(0)), F.col("top"), F.lit(0)).alias("border")
    )


def border_of(counts: DataFrame, rate: float = BORDER_RATE, border: int = 0) -> int:
    """The border as a number; one that is given wins."""
    return border if border > 0 else int(count_border(counts, rate or BORDER_RATE).first()["border"])


def idf(count: Column, total: Column) -> Column:
    return F.when((total > 0) & (count > 0), F.log(total / count) + 1).otherwise(F.lit(0.0))


def histogram(counts: DataFrame, samples: int = 5, cut: int = 10) -> DataFrame:
    """(term_count, n_terms, sample) by falling count; a sample's words are cut to `cut` characters."""
    rank = F.row_number().over(Window.partitionBy("cnt", "_p").orderBy("term"))
    # Samples come from a few terms of each hash part, so no count's terms meet in one task.
    few = counts.withColumn("_p", F.pmod(F.xxhash64("term"), F.lit(64))).withColumn("_r", rank).where(F.col("_r") <= samples)
    word = F.when(F.length("term") > cut, F.concat(F.substring("term", 1, cut), F.lit("..."))).otherwise(F.col("term"))
    words = few.groupBy("cnt").agg(F.slice(F.sort_array(F.collect_list(F.struct("term", word.alias("w")))), 1, samples).alias("s"))
    n = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n_terms"))
    return n.join(words, "cnt").select(
        F.col("cnt").alias("term_count"), "n_terms", F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("sample")
    )
