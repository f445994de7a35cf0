"""Streams that arrive in several parts, with late and repeated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.sources.files import shared
from panelspark.sources.panel import table
from panelspark.streaming import jobs


def _delivered(spark: SparkSession, arrivals: list[DataFrame], name: str, run: Callable[[DataFrame, str], None]) -> None:
    """Put one arrival after the other into a folder; after each, run a stream over what is new there."""
    home = shared(spark, name)
    for arrival in arrivals:
        arrival.write.mode("append").parquet(f"{home}/in")
        run(jobs.event_stream(spark, f"{home}/in"), f"{home}/state")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


LANDING_SQL = """
WITH arrivals AS (
  SELECT *, event_id % 3 AS arrival FROM events UNION ALL
  SELECT *, 2 FROM events WHERE event_id % 3 = 0 AND event_id % 30 = 0
)
SELECT user_id, ts::DATE AS day, round(arg_max(value, ROW(arrival, event_id)), 6) + 0.0 AS value, arg_max(event_id, ROW(arrival, event_id)) AS event_id FROM arrivals GROUP BY ALL"""


@REGISTRY.query("stream_landing", LANDING_SQL)
def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of daily values, each with days of all others; the last also brings rows of the first again, which win as the latest."""
    rows = _events(spark, sf_dir).select("user_id", F.col("ts").cast("date").alias("day"), "value", "event_id")
    third = F.col("event_id") % 3
    again = rows.where((third == 0) & (F.col("event_id") % 30 == 0))
    target = shared(spark, "landed")
    land = lambda stream, state: jobs.land(stream, target, ("user_id", "day"), ("event_id",), "day", state).awaitTermination()
    _delivered(spark, [rows.where(third == 0), rows.where(third == 1), rows.where(third == 2).unionByName(again)], "landing", land)
    return spark.read.parquet(target).select("user_id", "day", r(F.col("value")).alias("value"), "event_id")


#: Events arrive in thirds of ten days; every eleventh comes one third late, every thirteenth a second time one third later.
ARRIVALS_SQL = """
WITH bounds AS (SELECT date_trunc('day', min(ts)) AS day0 FROM events),
placed AS (SELECT e.*, least(2, date_diff('day', day0, ts) // 10) AS third FROM events e, bounds),
arrivals AS (
  SELECT * EXCLUDE (third), CASE WHEN event_id % 11 = 0 THEN least(2, third + 1) ELSE third END AS arrival, 0 AS turn FROM placed UNION ALL
  SELECT * EXCLUDE (third), third + 1, 1 FROM placed WHERE event_id % 13 = 0 AND event_id % 11 <> 0 AND third < 2
),
marks AS (SELECT arrival + 1 AS arrival, max(max(ts)) OVER (ORDER BY arrival) - INTERVAL 1 DAY AS mark FROM arrivals GROUP BY arrival)"""
SESSIONS_SQL = (
    ARRIVALS_SQL
    + """,
kept AS (SELECT a.*, ts::DATE AS day, hour(ts) < 16 AS inside, coalesce(value > 0, FALSE) AS good FROM arrivals a LEFT JOIN marks USING (arrival) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
SELECT user_id AS instrument, day AS date, round(arg_min(value, ROW(ts, event_id)) FILTER (WHERE inside AND good), 6) + 0.0 AS open, round(max(value) FILTER (WHERE inside AND good), 6) + 0.0 AS high,
  round(min(value) FILTER (WHERE inside AND good), 6) + 0.0 AS low, round(arg_max(value, ROW(ts, event_id)) FILTER (WHERE inside AND good), 6) + 0.0 AS close,
  count(*) FILTER (WHERE inside AND good) AS ticks, count(*) FILTER (WHERE NOT good) AS violations, count(*) FILTER (WHERE good AND NOT inside) AS after_close
FROM kept GROUP BY user_id, day HAVING day + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks)"""
)
UNIQUE_SQL = (
    ARRIVALS_SQL
    + """
SELECT event_id, user_id, ts::DATE AS date FROM arrivals a LEFT JOIN marks USING (arrival) WHERE turn = 0 AND (mark IS NULL OR ts > mark)"""
)


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = _events(spark, sf_dir)
    first = rows.agg(F.date_trunc("day", F.min("ts")).alias("day0_"))
    placed = rows.crossJoin(F.broadcast(first)).withColumn("third_", F.least(F.lit(2), F.floor(F.datediff("ts", "day0_") / 10)))  # one row
    late, again = F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0
    last: Column = F.when(late, F.least(F.lit(2), F.col("third_") + 1)).otherwise(F.col("third_"))
    repeats = placed.where(again & ~late & (F.col("third_") < 2)).withColumn("arrival_", F.col("third_") + 1)
    every = placed.withColumn("arrival_", last).unionByName(repeats).drop("day0_", "third_")
    return [every.where(F.col("arrival_") == k).drop("arrival_") for k in range(3)]


def _appended(spark: SparkSession, sf_dir: str, name: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out, schema = shared(spark, name), []

    def run(rows: DataFrame, state: str) -> None:
        found = stream(rows)
        schema.append(found.schema)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    _delivered(spark, _arrivals(spark, sf_dir), f"{name}-in", run)
    return spark.read.schema(schema[-1]).parquet(out)


@REGISTRY.query("stream_sessions", SESSIONS_SQL)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of three arrivals: ticks whose day the watermark has passed are dropped, those after the session's close are counted apart."""
    found = _appended(spark, sf_dir, "sessions", jobs.session_bars)
    return found.select("instrument", "date", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "ticks", "violations", "after_close")


@REGISTRY.query("stream_unique_ticks", UNIQUE_SQL)
def stream_unique_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three arrivals, every tick once; ticks that come behind the watermark are dropped."""
    unique = lambda rows: jobs.first_of_key(rows, ("event_id",), "ts", "1 day").select("event_id", "user_id", F.col("ts").cast("date").alias("date"))
    return _appended(spark, sf_dir, "unique", unique)
