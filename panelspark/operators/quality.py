"""Profiles and checks of tables: keys, prices, coverage, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per key: the last by the given columns."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place_", F.row_number().over(last)).where(F.col("place_") == 1).drop("place_")


def merge_rows(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Old rows with new ones put over them by key; columns that one side lacks are NULL there."""
    both = old.withColumn("fresh_", F.lit(0)).unionByName(new.withColumn("fresh_", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ("fresh_",)).drop("fresh_")


def duplicate_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(rows, duplicates): all rows, and those beyond the first of each key. Counted after a partial aggregation by key."""
    by_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def ohlc_violations(panel: DataFrame, prefix: str = "") -> DataFrame:
    """(checked, violations): rows with all four prices, and those whose prices contradict each other. prefix: of another price group."""
    o, h, lo, c = (F.col(prefix + x) for x in ("open", "high", "low", "close"))
    whole = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull()
    wrong = (h < F.greatest(o, c)) | (lo > F.least(o, c)) | (h < lo)
    return panel.agg(F.count_if(whole).alias("checked"), F.count_if(whole & wrong).alias("violations"))


def verdict(rows: DataFrame, required: tuple[str, ...], keys: tuple[str, ...], stated_rows: int | None = None, dates: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """One row: required_fields, row_count_matches, duplicate_keys, ohlc_violations, date_range_stated and the status they make."""
    dup, bad = duplicate_keys(rows, keys), ohlc_violations(rows)
    told = dup.join(F.broadcast(bad))  # one row each
    matches = F.lit(True) if stated_rows is None else F.col("rows") == stated_rows
    told = told.select(
        "rows", F.lit(set(required) <= set(rows.columns)).alias("required_fields"), matches.alias("row_count_matches"), F.col("duplicates").alias("duplicate_keys"),
        F.col("violations").alias("ohlc_violations"), F.lit(all(dates)).alias("date_range_stated"),
    )
    passed = F.col("required_fields") & F.col("row_count_matches") & (F.col("duplicate_keys") == 0) & (F.col("ohlc_violations") == 0) & F.col("date_range_stated")
    return told.withColumn("status", F.when(passed, "passed").otherwise("needs_review"))


def publish_gate(summary: DataFrame, floors: DataFrame, name: str = "name") -> DataFrame:
    """(name, publish, reason): coverage and effective days of each factor against its floors (name, least_days, least_coverage)."""
    joined = summary.join(floors, name, "left")
    few = F.coalesce(F.col("effective_days") < F.col("least_days"), F.lit(True))
    thin = F.coalesce(F.col("coverage") < F.col("least_coverage"), F.lit(True))
    reason = F.when(few, "too few days").when(thin, "too little coverage").otherwise("passed")
    return joined.select(name, (~few & ~thin).alias("publish"), reason.alias("reason"))


def coverage(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, share): the share of values that are not NULL, one pass for all columns."""
    wide = rows.agg(F.count("*").alias("n_"), *[F.count(c).alias(c) for c in columns])
    share = [F.struct(F.lit(c).alias("column"), (F.col(c) / F.greatest("n_", F.lit(1))).alias("share")) for c in columns]
    return wide.select(F.explode(F.array(*share)).alias("p")).select("p.*")


def profile(rows: DataFrame, date: str = "date", name: str = "instrument") -> DataFrame:
    """(rows, names, first, last) of a table."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct(name).alias("names"), F.min(date).alias("first"), F.max(date).alias("last"))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rows that only one of two profiles has, with the side: (side, ...)."""
    gone, come = baseline.exceptAll(current), current.exceptAll(baseline)
    return gone.withColumn("side", F.lit("baseline")).unionByName(come.withColumn("side", F.lit("current")))


def dense_panel(panel: DataFrame, calendar: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Every calendar day of an instrument between its first and last; missing values are NULL."""
    spans = panel.groupBy("instrument").agg(F.min("date").alias("first_"), F.max("date").alias("last_"))
    days = F.broadcast(calendar.select("date"))  # one row a session
    every = spans.join(days, F.col("date").between(F.col("first_"), F.col("last_"))).select("instrument", "date")
    return every.join(panel.select("instrument", "date", *values), ["instrument", "date"], "left")


def page(rows: DataFrame, order: tuple[str, ...], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of the sorted rows; pages end before what they skip is shuffled whole."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def tail(rows: DataFrame, keys: tuple[str, ...], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("place_", F.row_number().over(back)).where(F.col("place_") <= n).drop("place_")


def downsample(rows: DataFrame, keys: tuple[str, ...], order: str, k: int) -> DataFrame:
    """k evenly placed rows of each key, first and last among them; all rows if there are no more."""
    by = Window.partitionBy(*keys)
    placed = rows.withColumns({"i_": F.row_number().over(by.orderBy(order)) - 1, "n_": F.count("*").over(by)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n_") - 1) / (k - 1) + 0.5))
    return placed.where((F.col("n_") <= k) | F.array_contains(wanted, F.col("i_").cast("long"))).drop("i_", "n_")


def missing_sessions(calendar: DataFrame, present: DataFrame, instruments: DataFrame) -> DataFrame:
    """(instrument, date): sessions between an instrument's first and last day that it lacks."""
    spans = instruments.groupBy("instrument").agg(F.min("date").alias("first_"), F.max("date").alias("last_"))
    every = spans.join(F.broadcast(calendar.select("date")), F.col("date").between(F.col("first_"), F.col("last_"))).select("instrument", "date")
    return every.join(present, ["instrument", "date"], "left_anti")
