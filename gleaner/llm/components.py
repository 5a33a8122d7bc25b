"""Connected components by contraction: tables in, tables out, nothing gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); equal roots mean one component.

    In each round every node hooks onto that one of itself and its neighbours which a
    hash of the round puts first; the graph of those it hooked onto is the next round's.
    Rounds shrink by a constant factor. Aggregation is partial before any exchange, and
    each join reads tables, so that Spark can split a hot node's partition.
    """
    edges = materialise(edges.where("a != b").distinct())
    levels = []
    while not edges.isEmpty():
        salt = F.lit(len(levels))
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.xxhash64(salt, F.col(c))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(order("a").alias("o"), F.col("a").alias("v"))
        up = materialise(best.select(F.col("a").alias("node"), F.least(own, F.col("m"))["v"].alias("up")))
        levels.append(up)
        at = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("up_a != up_b")
        before, edges = edges, materialise(
            moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct()
        )
        discard(before)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0].select("node", F.col("up").alias("root"))
    for up in levels[1:]:
        next_up = up.select(F.col("node").alias("root"), F.col("up").alias("_next"))
        out = out.join(next_up, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    out = materialise(out)
    discard(edges, *levels)
    return out
