"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lookup, saved


def _least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with m, the least of u and all its v."""
    table = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    found = lookup(rows, table, ["u"], "degree", total, F.xxhash64("v"))
    return found.select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node bigint, component bigint (its least node) for each node of ``edges`` (a, b bigint).

    Loops, repeated edges and edges with nulls are harmless; nodes without an edge to another one do not
    appear. Every step is a shuffle of edges, of which there never are more than at first but for one a
    node; the number of steps grows with the logarithm of the longest chain.
    """
    most = edges.count()
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = saved(now, "edges", most)
    before = None
    while True:
        n = now.count()
        if not n:
            break
        both = saved(now.union(now.select(F.col("v"), F.col("u"))), "both", 2 * n)
        large = _least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large", n)
        small = _least(large, max(1, large.count()))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = saved(small.where("u <> v").distinct(), "small", 2 * n)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
