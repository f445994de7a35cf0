"""Quantile buckets of a date's cross-section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.window import finite


def daily_quintile(panel: DataFrame, value: str, out: str = "bucket", groups: int = 5, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Add the quantile bucket of each value within its date, from 1: linear edges, closed to the right, the lowest included.

    Equal edges count once, as labels do then. NULL for a missing value, for a
    date with fewer than `groups` values, and where all values are equal. The
    edges of a date are one row, joined back.
    """
    x = finite(F.col(value).cast("double"))
    steps = F.array(*[F.lit(i / groups) for i in range(groups + 1)])
    cuts = panel.groupBy(*keys).agg(F.percentile(x, steps).alias("edges_"), F.count(x).alias("values_"))
    cuts = cuts.where(F.col("values_") >= groups).select(*keys, F.array_distinct("edges_").alias("edges_"))
    place = F.greatest(F.size(F.filter("edges_", lambda e: e < x)) - 1, F.lit(0)) + 1
    bucket = F.when(x.isNotNull() & (F.size("edges_") > 1), place)
    return panel.join(cuts, list(keys), "left").withColumn(out, bucket).drop("edges_")


def label_bins(panel: DataFrame, label: str, out: str = "bin", bins: int = 20, tail: float = 0.01) -> DataFrame:
    """Clip a label to its date's tail quantiles and number its quantile bin from 0; rows without a label go."""
    held = panel.where(F.col(label).isNotNull())
    ends = held.groupBy("date").agg(F.percentile(label, F.array(F.lit(tail), F.lit(1 - tail))).alias("ends_"))
    low, high = F.element_at("ends_", 1), F.element_at("ends_", 2)
    clipped = held.join(ends, "date").withColumn("kept_", F.least(F.greatest(F.col(label), low), high))
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = clipped.groupBy("date").agg(F.percentile("kept_", steps).alias("edges_"))
    return clipped.join(edges, "date").withColumn(out, F.size(F.filter("edges_", lambda e: e < F.col("kept_")))).drop("ends_", "edges_", "kept_")
