"""Connected components of an edge table, without collecting any of it: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges are (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, F.col("u") == F.col("k")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Each u keeps its edge to its own least neighbour, so no component falls apart.
    own = least.filter("k > m").select(F.col("k").alias("u"), F.col("m").alias("v"))
    large = large.unionByName(own).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    small = large.join(low, F.col("u") == F.col("k")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a long, b long); root is the least node that it reaches."""
    now = edges.filter("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = common.materialise(now, "edges")
    mark = _mark(now)
    while mark[0]:
        old, now = now, common.materialise(_stars(now), "edges", rows=2 * mark[0])
        common.release(old)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
