"""Connected components of an edge table by alternating star contraction, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import joined_by, saved


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node long, root long): each node's smallest reachable node.

    Every round moves larger neighbours to the smallest neighbour (large star),
    then ties smaller neighbours together (small star); rounds grow with the
    logarithm of a component's diameter. All minima are combined before the
    shuffle, and a hub's edges meet its minimum where they lie (`joined_by`), so
    no task holds all edges of a hub. Nodes without edges are not
    returned; null ends and loops are left out. An empty table gives no rows.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    pairs = saved(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        larger = pairs.select(F.col("m").alias("u"), F.col("v").alias("w"))
        large = (
            joined_by(larger, low.withColumnRenamed("v", "u"), "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        )
        large = saved(large)
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = (
            joined_by(large, least, "v")
            .where(F.col("m") != F.col("low"))
            .select(F.col("m").alias("v"), F.col("low").alias("m"))
            .unionByName(least.select("v", F.col("low").alias("m")))
            .distinct()
        )
        pairs, before = saved(small), mark
        mark = _mark(pairs)
        if mark == before:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
