"""Folders of files: dated snapshots whose columns grow, drift of interfaces, run archives, bounded exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import archive
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.sources import files
from panelspark.sources.panel import BARS_SQL, RUNS_SQL, bars, runs, table, with_sql

#: A file for each year holds its orders, and those of the year before as they were restated; clerks are known from FROM_YEAR on.
FROM_YEAR = 1995


def _write_snapshots(spark: SparkSession, sf_dir: str, folder: str) -> list[int]:
    placed = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.round("o_totalprice", 2).alias("price"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("buyer"))
    first, last = placed.agg(F.min("year"), F.max("year")).first()
    for year in range(first, last + 1):  # a file a year
        rows = placed.where(F.col("year").isin(year - 1, year)).withColumn("price", F.when(F.col("year") < year, F.col("price") + 1).otherwise(F.col("price")))
        rows = rows.select("o_orderkey", "price", *(["buyer"] if year >= FROM_YEAR else []))
        rows.write.parquet(f"{folder}/{year}0101.parquet")
    return list(range(first, last + 1))


SNAPSHOT_SQL = f"""
years AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders),
told AS (SELECT *, year(o_orderdate) AS y, least(year(o_orderdate) + 1, b) AS file_year FROM orders, years)
"""


@REGISTRY.query("dated_folder_scan", with_sql(SNAPSHOT_SQL, select=f"SELECT o_orderkey, round(CASE WHEN file_year > y THEN round(o_totalprice, 2) + 1 ELSE round(o_totalprice, 2) END, 2) + 0.0 AS price, CASE WHEN file_year >= {FROM_YEAR} THEN 'c' || o_custkey END AS buyer, NULL::VARCHAR AS broker FROM told"))
def dated_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each order over yearly files; early files lack a column, none has a broker."""
    folder = files.shared(spark, "dated")
    _write_snapshots(spark, sf_dir, folder)
    found = files.read_dated_folder(spark, f"{folder}/*", ("o_orderkey",), ("o_orderkey", "price", "buyer", "broker"))
    return found.select("o_orderkey", r(F.col("price"), 2).alias("price"), "buyer", "broker")


@REGISTRY.query(
    "interface_drift",
    with_sql(SNAPSHOT_SQL,
        "sizes AS (SELECT f.y, count(*) AS n FROM (SELECT unnest(generate_series(a, b)) AS y FROM years) f JOIN told t ON t.y IN (f.y - 1, f.y) GROUP BY 1)",
        select="""SELECT 'orders' AS interface, 'gone' AS change, count(*) AS files, sum(n)::BIGINT AS rows, min(y) || '0101' AS first, max(y) || '0101' AS last FROM sizes WHERE y < (SELECT b FROM years)
        UNION ALL SELECT 'orders', 'new', count(*), sum(n)::BIGINT, min(y) || '0101', max(y) || '0101' FROM sizes"""),
)
def interface_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has changed since the last year's file came; an interface that is as it was is not told of."""
    folder = files.shared(spark, "dated")
    years = _write_snapshots(spark, sf_dir, folder)
    early = "{" + ",".join(f"{y}0101.parquet" for y in years[:-1]) + "}"
    same = files.interface_profile(spark, f"{folder}/{years[0]}0101.parquet")
    return files.interface_drift({"orders": files.interface_profile(spark, f"{folder}/{early}"), "first": same}, {"orders": files.interface_profile(spark, f"{folder}/*"), "first": same})


ARCHIVED = (
    "run_id bigint, status string, finished date, config_json string, metrics struct<" + ", ".join(f"{name}: double" for name in archive.MEASURES) + ">, "
    "equity_curve array<struct<date: date, equity: double>>, trades array<struct<instrument: bigint, quantity: double, profit: double>>"
)
ARCHIVE_SQL = """
lines AS (
  SELECT l_orderkey AS run_id, count(*) AS points, min(l_shipdate)::DATE AS first_date, max(l_shipdate)::DATE AS last_date, round(max(l_extendedprice), 2) AS peak,
    count(*) FILTER (WHERE l_linestatus = 'F') AS trades, round(sum(floor(l_extendedprice * l_discount * 100 + 0.5) / 100) FILTER (WHERE l_linestatus = 'F'), 2) AS profit FROM lineitem GROUP BY 1
)"""


@REGISTRY.query(
    "run_archive_scan",
    with_sql(RUNS_SQL, ARCHIVE_SQL, select=f"SELECT run_id, status, {', '.join(archive.MEASURES)}, coalesce(points, 0) AS points, first_date, last_date, peak, coalesce(trades, 0) AS trades, profit FROM runs LEFT JOIN lines USING (run_id)"),
)
def run_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as nested JSON over several lines, read again: measures, curves and trades of each."""
    folder, lines = files.shared(spark, "archive"), table(spark, sf_dir, "lineitem")
    point = F.struct(F.col("l_shipdate").cast("date").alias("date"), F.round("l_extendedprice", 2).cast("double").alias("equity"))
    trade = F.struct(F.col("l_suppkey").alias("instrument"), F.col("l_quantity").cast("double").alias("quantity"), (F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100 + 0.5).cast("double") / 100).alias("profit"))
    nested = lines.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sort_array(F.collect_list(point)).alias("equity_curve"), F.collect_list(F.when(F.col("l_linestatus") == "F", trade)).alias("trades"))  # an order has few lines
    measures = F.from_json("metrics_json", archive.METRICS)
    own = runs(spark, sf_dir).select("run_id", "status", "finished", "config_json", measures.alias("metrics"))
    files.write_run_archive(own.join(nested, "run_id", "left"), folder)
    found, curve = files.read_run_archive(spark, folder, ARCHIVED)
    points = curve.groupBy("run_id").agg(F.count("*").alias("points"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.max("equity"), 2).alias("peak"))
    trades = files.archived_trades(spark, folder, ARCHIVED).groupBy("run_id").agg(F.count("*").alias("trades"), F.round(F.sum("profit"), 2).alias("profit"))
    joined = found.drop("trades").join(points, "run_id", "left").join(trades, "run_id", "left").fillna(0, ["points", "trades"])
    return joined.select("run_id", "status", "metrics.*", "points", "first_date", "last_date", "peak", "trades", "profit")


@REGISTRY.query("csv_round_trip", with_sql(BARS_SQL, select="SELECT instrument, date, round(close, 4) + 0.0 AS close, st_status FROM bars ORDER BY close DESC, instrument, date LIMIT 500"))
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 highest closes, exported as CSV and read again."""
    path = files.shared(spark, "export")
    panel = bars(spark, sf_dir).select("instrument", "date", "close", "st_status", (-F.col("close")).alias("turned_"))
    files.export_csv(panel, path, ("turned_", "instrument", "date"), 500)
    found = spark.read.schema("instrument long, date date, close double, st_status int, turned_ double").option("header", True).csv(path)
    return found.select("instrument", "date", r(F.col("close"), 4).alias("close"), "st_status")
