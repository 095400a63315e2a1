"""Connected components of an edge list by alternating large-star and
small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond"): O(log^2 n) rounds of joins and partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest member of each node's neighbourhood, itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_smallest(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the edges ``a, b`` (longs): the
    smallest node it can reach.  Self-loops and nulls are ignored; nodes without
    another end are not listed.  Every round is written once and reread."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct()
    e = cut_lineage(e, "cc")
    size = None
    while True:
        before, e = e, cut_lineage(_small_star(_large_star(e)), "cc")
        drop_cut(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")),
                    F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == size:
            break
        size = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
