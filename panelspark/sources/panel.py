"""Panel tables in the shapes of the operators, derived from the order tables by Spark.

An instrument is a supplier, a bar a week of its shipped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week(column: str) -> Column:
    return F.date_trunc("week", column).cast("date")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instrument and week: prices, volume, amount, valuation columns and a status flag."""
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("double") / 100  # whole cents
    tick = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    weekly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("instrument"), week("l_shipdate").alias("date"))
        .agg(
            F.min_by(price, tick).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, tick).alias("close"),
            F.sum("l_quantity").alias("vol"),
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
            (F.sum("l_quantity") / F.count("*")).alias("turn"),
            F.nullif(F.round(F.avg("l_discount"), 8), F.lit(0.0)).alias("pe_ttm"),
            F.round(F.avg("l_tax"), 8).alias("dividend_yield_ratio"),
            F.max(((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int")).alias("st_status"),
        )
    )
    so_far = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return weekly.withColumns(
        {"total_market_cap": F.round(F.sum("amount").over(so_far), 2), "float_market_cap": F.sum("vol").over(so_far)}
    )


#: The same in SQL, as the begin of a WITH list.
BARS_SQL = """
priced AS (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS px FROM lineitem),
weekly AS (
  SELECT l_suppkey AS instrument, date_trunc('week', l_shipdate)::DATE AS date,
    arg_min(px, ROW(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
    max(px) AS high, min(px) AS low,
    arg_max(px, ROW(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
    sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) / count(*) AS turn,
    nullif(round(avg(l_discount), 8), 0.0) AS pe_ttm, round(avg(l_tax), 8) AS dividend_yield_ratio,
    max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END)::INTEGER AS st_status
  FROM priced GROUP BY 1, 2
),
bars AS (
  SELECT *, round(sum(amount) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING), 2) AS total_market_cap,
    sum(vol) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING) AS float_market_cap FROM weekly
)"""


def calendar(panel: DataFrame) -> DataFrame:
    """(date, session): all dates of a panel, numbered from 1. One row per session, so one task orders few rows."""
    return panel.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")))


CALENDAR_SQL = "calendar AS (SELECT date, (row_number() OVER (ORDER BY date))::INTEGER AS session FROM (SELECT DISTINCT date FROM bars))"


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_code, snapshot, con_code, weight): monthly members of five indexes with at least the median weight."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    summed = lines.groupBy(
        F.col("o_orderpriority").alias("index_code"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("snapshot"),
        F.col("l_suppkey").alias("con_code"),
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    total = summed.groupBy("index_code", "snapshot").agg(F.round(F.sum("value"), 2).alias("total"), F.percentile("value", F.lit(0.5)).alias("middle"))
    kept = summed.join(total, ["index_code", "snapshot"]).where(F.col("value") >= F.col("middle"))
    return kept.select("index_code", "snapshot", "con_code", F.round(F.col("value") / F.col("total"), 8).alias("weight"))


MEMBERSHIP_SQL = """
member_value AS (
  SELECT o_orderpriority AS index_code, date_trunc('month', o_orderdate)::DATE AS snapshot, l_suppkey AS con_code, round(sum(l_extendedprice), 2) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
),
membership AS (
  SELECT index_code, snapshot, con_code, round(value / total, 8) AS weight FROM member_value
  JOIN (SELECT index_code, snapshot, round(sum(value), 2) AS total, quantile_cont(value, 0.5) AS middle FROM member_value GROUP BY 1, 2) USING (index_code, snapshot)
  WHERE value >= middle
)"""


def index_daily(spark: SparkSession, sf_dir: str, panel: DataFrame) -> DataFrame:
    """(ts_code, date, close): amount-weighted close of each supplier region."""
    region = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("instrument"), F.col("r_name").alias("ts_code"))
    )
    weighted = F.sum(F.col("close") * F.col("amount")) / F.sum("amount")
    return panel.join(region, "instrument").groupBy("ts_code", "date").agg(F.round(weighted, 6).alias("close"))


INDEX_SQL = """
index_daily AS (
  SELECT r_name AS ts_code, date, round(sum(close * amount) / sum(amount), 6) AS close
  FROM bars JOIN supplier ON instrument = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
)"""


def moneyflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, date, net_mf_amount): shipped value by week, open lines counted up and finished ones down; no March."""
    signed = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").where(F.month("l_shipdate") != 3)
    return lines.groupBy(F.col("l_suppkey").alias("instrument"), week("l_shipdate").alias("date")).agg(F.round(F.sum(signed), 2).alias("net_mf_amount"))


MONEYFLOW_SQL = """
moneyflow AS (
  SELECT l_suppkey AS instrument, date_trunc('week', l_shipdate)::DATE AS date,
    round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END), 2) AS net_mf_amount
  FROM lineitem WHERE month(l_shipdate) <> 3 GROUP BY 1, 2
)"""


def suspend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, date, suspend_type): weeks with a discount of ten per cent."""
    weekly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), week("l_shipdate").alias("date"))
    return weekly.agg(F.max("l_discount").alias("most")).where(F.col("most") >= 0.1).select("instrument", "date", F.lit("S").alias("suspend_type"))


SUSPEND_SQL = """
suspend AS (
  SELECT l_suppkey AS instrument, date_trunc('week', l_shipdate)::DATE AS date, 'S' AS suspend_type FROM lineitem GROUP BY 1, 2 HAVING max(l_discount) >= 0.1
)"""


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with adj_factor (taxes added up), hfq_ prices, ten per cent limit prices in cents (none for a first bar) and a suspension flag."""
    so_far = Window.partitionBy("instrument").orderBy("date")
    factor = F.round(1 + F.sum("dividend_yield_ratio").over(so_far.rowsBetween(Window.unboundedPreceding, 0)), 8)
    before = F.lag("close").over(so_far)
    limit = lambda share: F.floor(before * share + 0.5).cast("double") / 100
    panel = bars(spark, sf_dir).withColumns({"adj_factor": factor, "up_limit": limit(110), "down_limit": limit(90)})
    panel = panel.withColumns({f"hfq_{p}": F.col(p) * F.col("adj_factor") for p in PRICES})
    return panel.join(suspend(spark, sf_dir).select("instrument", "date", F.lit(1).alias("is_suspended")), ["instrument", "date"], "left")


ADJUSTED_SQL = """
factored AS (
  SELECT *, round(1 + sum(dividend_yield_ratio) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING), 8) AS adj_factor,
    floor(lag(close) OVER (PARTITION BY instrument ORDER BY date) * 110 + 0.5) / 100 AS up_limit, floor(lag(close) OVER (PARTITION BY instrument ORDER BY date) * 90 + 0.5) / 100 AS down_limit FROM bars
),
adjusted AS (
  SELECT f.*, open * adj_factor AS hfq_open, high * adj_factor AS hfq_high, low * adj_factor AS hfq_low, close * adj_factor AS hfq_close, s.suspend_type IS NOT NULL AS halted
  FROM factored f LEFT JOIN suspend s USING (instrument, date)
)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, buy_date, sell_date, quantity, buy_price, sell_price, pnl): one round trip an order, open if it is."""
    day = F.col("o_orderdate").cast("date")
    sell = F.when(F.col("o_orderstatus") != "O", F.date_add(day, (1 + F.col("o_orderkey") % 30).cast("int")))
    price = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("double") / 10000
    out = F.when(F.col("o_orderstatus") != "O", F.floor(F.col("o_totalprice") * (100 + F.col("o_orderkey") % 7 - 3)).cast("double") / 10000)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trade_id"), (F.col("o_custkey") % 100).alias("instrument"), day.alias("buy_date"), sell.alias("sell_date"),
        F.lit(100).alias("quantity"), price.alias("buy_price"), out.alias("sell_price"), (F.floor((out - price) * 10000 + 0.5).cast("double") / 100).alias("pnl"),
    )


TRADES_SQL = """
priced_trades AS (
  SELECT *, floor(o_totalprice * 100 + 0.5) / 10000 AS bought, CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice * (100 + o_orderkey % 7 - 3)) / 10000 END AS sold FROM orders
),
trades AS (
  SELECT o_orderkey AS trade_id, o_custkey % 100 AS instrument, o_orderdate::DATE AS buy_date,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + (1 + o_orderkey % 30)::INTEGER END AS sell_date, 100 AS quantity,
    bought AS buy_price, sold AS sell_price, floor((sold - bought) * 10000 + 0.5) / 100 AS pnl
  FROM priced_trades
)"""


#: Measures of a run, each from its order's price: a factor, and what is taken off the thousandths.
MEASURES = {
    "total_return": (3, 0.2), "annual_return": (7, 0.3), "benchmark_return": (11, 0.4), "sortino": (13, 0.1), "calmar": (17, 0.25), "max_drawdown": (19, 1.0), "win_rate": (23, 0.0), "turnover": (29, 0.0),
    "capital_usage": (31, 0.0), "information_ratio": (37, 0.5), "trade_count": (41, 0.0), "losing_streak": (43, 0.0),
}
#: One run in nine has no benchmark.
UNMEASURED = {"benchmark_return": 9}


def _measure(name: str) -> Column:
    factor, off = MEASURES[name]
    value = F.round((F.floor("o_totalprice").cast("long") * factor % 997).cast("double") / 1000 - off, 6)
    return F.when(F.col("o_orderkey") % UNMEASURED[name] != 0, value) if name in UNMEASURED else value


def _measure_sql(name: str) -> str:
    factor, off = MEASURES[name]
    value = f"round((floor(o_totalprice)::BIGINT * {factor} % 997)::DOUBLE / 1000 - {off}, 6)"
    return f"CASE WHEN o_orderkey % {UNMEASURED[name]} <> 0 THEN {value} END AS {name}" if name in UNMEASURED else f"{value} AS {name}"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, finished, status, config_json, metrics_json): one run an order, with nested settings as JSON text."""
    config = F.struct(
        F.struct(F.concat_ws("-", F.year("o_orderdate").cast("string"), F.lit("01-01")).alias("date_from"), F.concat_ws("-", F.year("o_orderdate").cast("string"), F.lit("12-31")).alias("date_to")).alias("test"),
        (F.col("o_custkey") % 5 + 1).alias("top_n"),
        F.array(F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string"))).alias("factor_versions"),
        F.col("o_orderpriority").alias("weighting"),
        F.array(F.concat(F.lit("ma"), (F.col("o_custkey") % 3 * 20).cast("string")), F.concat(F.lit("ma"), (F.col("o_orderkey") % 2 * 20).cast("string"))).alias("gates"),
    )
    metrics = F.struct(*[_measure(name).alias(name) for name in MEASURES], F.round(F.floor("o_totalprice") / 100000 - 1, 6).alias("sharpe"), F.round(F.floor("o_totalprice") / 1000000 - 0.1, 6).alias("excess_return"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("finished"), status.alias("status"), F.to_json(config).alias("config_json"), F.to_json(metrics).alias("metrics_json")
    )


RUNS_SQL = """
runs AS (
  SELECT o_orderkey AS run_id, o_orderdate::DATE AS finished, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
    year(o_orderdate) AS year, o_custkey % 5 + 1 AS top_n, list_sort(list_distinct(['f' || (o_custkey % 3), 'f' || (o_orderkey % 3)])) AS factors,
    o_orderpriority AS weighting, round(floor(o_totalprice) / 100000 - 1, 6) AS sharpe, round(floor(o_totalprice) / 1000000 - 0.1, 6) AS excess_return,
    list_sort(list_distinct(['ma' || (o_custkey % 3 * 20), 'ma' || (o_orderkey % 2 * 20)])) AS gates, """ + ", ".join(map(_measure_sql, MEASURES)) + """
  FROM orders
)"""


def with_sql(*parts: str, select: str) -> str:
    """A query over the named parts."""
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n" + select
