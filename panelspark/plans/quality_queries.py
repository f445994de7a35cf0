"""Scans, profiles and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import quality
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.sources.panel import BARS_SQL, CALENDAR_SQL, MONEYFLOW_SQL, SUSPEND_SQL, bars, calendar, moneyflow, suspend, table, with_sql

SPAN = "span AS (SELECT instrument, min(date) AS a, max(date) AS b FROM bars GROUP BY 1)"
EVERY = "every AS (SELECT instrument, c.date FROM span JOIN calendar c ON c.date BETWEEN a AND b)"


@REGISTRY.query("panel_scan", "SELECT l_suppkey AS instrument, l_shipdate::DATE AS date, l_extendedprice AS amount FROM lineitem WHERE l_shipdate BETWEEN '1995-01-01' AND '1995-06-30' AND l_suppkey BETWEEN 3 AND 40")
def panel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection and date range reach the Parquet scan."""
    day = F.col("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").where(day.between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-06-30").cast("timestamp")) & F.col("l_suppkey").between(3, 40))
    return lines.select(F.col("l_suppkey").alias("instrument"), day.cast("date").alias("date"), F.col("l_extendedprice").alias("amount"))


@REGISTRY.query("dense_panel", with_sql(BARS_SQL, CALENDAR_SQL, SPAN, EVERY, select="SELECT e.instrument, e.date, b.close, b.vol FROM every e LEFT JOIN bars b USING (instrument, date)"))
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return quality.dense_panel(panel, calendar(panel), ("close", "vol"))


@REGISTRY.query("missing_sessions", with_sql(BARS_SQL, CALENDAR_SQL, SPAN, EVERY, select="SELECT e.instrument, e.date FROM every e ANTI JOIN bars b USING (instrument, date)"))
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return quality.missing_sessions(calendar(panel), panel.select("instrument", "date"), panel)


@REGISTRY.query("dup_key_count", "SELECT count(*) AS rows, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS duplicates FROM lineitem")
def dup_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@REGISTRY.query("keep_last_dedupe", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1")
def keep_last_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.keep_last(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), ("l_shipdate", "l_partkey", "l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), "l_partkey", "l_suppkey")


@REGISTRY.query("keyed_merge", with_sql(BARS_SQL, MONEYFLOW_SQL, select="SELECT instrument, date, CASE WHEN m.net_mf_amount IS NOT NULL THEN NULL ELSE b.close END AS close, m.net_mf_amount FROM bars b FULL JOIN moneyflow m USING (instrument, date)"))
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones of the same key as a whole."""
    return quality.merge_rows(bars(spark, sf_dir).select("instrument", "date", "close"), moneyflow(spark, sf_dir), ("instrument", "date"))


@REGISTRY.query("ohlc_violations", with_sql(BARS_SQL, select="SELECT count(*) AS checked, count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close) OR high < low) AS violations FROM bars"))
def ohlc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ohlc_violations(bars(spark, sf_dir))


@REGISTRY.query("column_coverage", with_sql(BARS_SQL, select="SELECT 'close' AS \"column\", round(count(close) / count(*), 6) AS share FROM bars UNION ALL SELECT 'pe_ttm', round(count(pe_ttm) / count(*), 6) FROM bars UNION ALL SELECT 'turn', round(count(turn) / count(*), 6) FROM bars"))
def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(bars(spark, sf_dir), ("close", "pe_ttm", "turn")).select("column", r(F.col("share")).alias("share"))


@REGISTRY.query("table_profile", with_sql(BARS_SQL, select="SELECT count(*) AS rows, count(DISTINCT instrument) AS names, min(date) AS first, max(date) AS last FROM bars"))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(bars(spark, sf_dir))


@REGISTRY.query("profile_drift", with_sql(BARS_SQL, MONEYFLOW_SQL, "a AS (SELECT instrument, count(*) AS n, min(date) AS first FROM bars GROUP BY 1)", "b AS (SELECT instrument, count(*) AS n, min(date) AS first FROM moneyflow GROUP BY 1)", select="SELECT *, 'baseline' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'current' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"))
def profile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lambda df: df.groupBy("instrument").agg(F.count("*").alias("n"), F.min("date").alias("first"))
    return quality.drift(per(bars(spark, sf_dir)), per(moneyflow(spark, sf_dir)))


@REGISTRY.query("page_of_panel", with_sql(BARS_SQL, select="SELECT instrument, date, close FROM bars ORDER BY date, instrument LIMIT 50 OFFSET 100"))
def page_of_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.page(bars(spark, sf_dir).select("instrument", "date", "close"), ("date", "instrument"), 3, 50)


@REGISTRY.query("tail_points", with_sql(BARS_SQL, select="SELECT instrument, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY date DESC) <= 5"))
def tail_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tail(bars(spark, sf_dir).select("instrument", "date", "close"), ("instrument",), "date", 5)


@REGISTRY.query("page_tail_downsample", with_sql(BARS_SQL, "n AS (SELECT instrument, date, close, row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS m FROM bars)", select="SELECT instrument, date, close FROM n WHERE m <= 40 OR list_contains(list_transform(range(40), lambda k: floor(k * (m - 1) / 39 + 0.5)::BIGINT), i)"))
def page_tail_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.downsample(bars(spark, sf_dir).select("instrument", "date", "close"), ("instrument",), "date", 40)


@REGISTRY.query("suspend_apply", with_sql(BARS_SQL, SUSPEND_SQL, select="SELECT instrument, date, suspend_type IS NOT NULL AS is_suspended, (suspend_type IS NULL AND st_status = 0) AS eligible, CASE WHEN suspend_type IS NULL THEN close END AS close FROM bars LEFT JOIN suspend USING (instrument, date)"))
def suspend_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.operators.universe import apply_suspensions

    panel = bars(spark, sf_dir).withColumn("eligible", F.col("st_status") == 0)
    marked = apply_suspensions(panel, suspend(spark, sf_dir))
    return marked.select("instrument", "date", "is_suspended", "eligible", F.when(~F.col("is_suspended"), F.col("close")).alias("close"))
