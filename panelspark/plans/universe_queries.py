"""Filters, membership and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.operators import labels, universe
from panelspark.functions import sqltext as q
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.sources.panel import BARS_SQL, CALENDAR_SQL, INDEX_SQL, MEMBERSHIP_SQL, MONEYFLOW_SQL, bars, calendar, index_daily, membership, moneyflow, table, with_sql

POOLED_SQL = """
marks AS (SELECT DISTINCT snapshot FROM membership),
last_seen AS (SELECT c.date, max(m.snapshot) AS snapshot FROM calendar c JOIN marks m ON m.snapshot <= c.date GROUP BY 1),
current AS (SELECT DISTINCT date, con_code AS instrument FROM last_seen JOIN membership USING (snapshot))"""


@REGISTRY.query("asof_membership", with_sql(BARS_SQL, CALENDAR_SQL, MEMBERSHIP_SQL, POOLED_SQL, select="SELECT instrument, date, close FROM bars SEMI JOIN current USING (date, instrument)"))
def asof_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return universe.members_pooled(panel, calendar(panel), membership(spark, sf_dir)).select("instrument", "date", "close")


ASOF_SQL = """
dates AS (SELECT DISTINCT index_code, snapshot FROM membership),
last_seen AS (SELECT index_code, date, max(snapshot) AS snapshot FROM calendar JOIN dates ON snapshot <= date GROUP BY 1, 2),
members AS (SELECT a.index_code, a.date, con_code AS instrument, weight FROM last_seen a JOIN membership m USING (index_code, snapshot))"""
BEFORE_SQL = """
marks AS (SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS use_ FROM (SELECT DISTINCT snapshot FROM membership)),
last_seen AS (SELECT date, max(snapshot) AS snapshot FROM calendar JOIN marks ON snapshot <= date GROUP BY 1)"""


@REGISTRY.query("asof_index_weight", with_sql(BARS_SQL, CALENDAR_SQL, MEMBERSHIP_SQL, ASOF_SQL, select="SELECT index_code, date, instrument, weight FROM members"))
def asof_index_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.members_by_index(calendar(bars(spark, sf_dir)), membership(spark, sf_dir))


@REGISTRY.query("prev_snapshot_membership", with_sql(BARS_SQL, CALENDAR_SQL, MEMBERSHIP_SQL, BEFORE_SQL, select="SELECT index_code, date, con_code AS instrument, weight FROM last_seen l JOIN marks k USING (snapshot) JOIN membership m ON m.snapshot = k.use_"))
def prev_snapshot_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.members_before(calendar(bars(spark, sf_dir)), membership(spark, sf_dir))


GATE_SQL = f"gates AS (SELECT ts_code, date, coalesce(close > {q.mean('close', 20)}, false) AS open FROM (SELECT ts_code AS instrument, * FROM index_daily))"


@REGISTRY.query("sma_gate_dates", with_sql(BARS_SQL, INDEX_SQL, GATE_SQL, select="SELECT date FROM gates WHERE open AND ts_code IN ('ASIA', 'EUROPE') GROUP BY 1 HAVING count(*) = 2"))
def sma_gate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = universe.moving_average_gate(index_daily(spark, sf_dir, bars(spark, sf_dir)), 20)
    return universe.open_dates(gates, ("ASIA", "EUROPE"))


PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM")
PRIORITY_SQL = """
first_index AS (SELECT date, instrument, min(index_code) AS index_code FROM members WHERE index_code IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2),
opened AS (SELECT date FROM gates WHERE open AND ts_code = 'ASIA')"""


@REGISTRY.query("priority_gate", with_sql(BARS_SQL, CALENDAR_SQL, MEMBERSHIP_SQL, ASOF_SQL, INDEX_SQL, GATE_SQL, PRIORITY_SQL, select="SELECT b.instrument, b.date, b.close FROM bars b JOIN first_index USING (date, instrument) WHERE index_code = '2-HIGH' OR date IN (SELECT date FROM opened)"))
def priority_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index but the second follows one regional gate; the second is always open."""
    panel = bars(spark, sf_dir)
    days = calendar(panel)
    asia = universe.moving_average_gate(index_daily(spark, sf_dir, panel), 20).where(F.col("index_code") == "ASIA").select("date", "open")
    codes = spark.createDataFrame([(code,) for code in PRIORITY], "index_code string")
    always = F.when(F.col("index_code") == "2-HIGH", F.lit(True))
    gates = days.select("date").join(asia, "date", "left").crossJoin(F.broadcast(codes)).select("index_code", "date", F.coalesce(always, "open", F.lit(False)).alias("open"))
    found = universe.priority_gate(panel, universe.members_by_index(days, membership(spark, sf_dir)), gates, PRIORITY)
    return found.select("instrument", "date", "close")


@REGISTRY.query("asof_period_bar", with_sql(BARS_SQL, "month_end AS (SELECT instrument, max(date) AS date, arg_max(close, date) AS month_close FROM bars GROUP BY instrument, date_trunc('month', date))", select="SELECT b.instrument, b.date, m.month_close FROM bars b ASOF LEFT JOIN month_end m ON b.instrument = m.instrument AND b.date >= m.date"))
def asof_period_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    ends = panel.groupBy("instrument", F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("month_close"))
    return universe.asof_backward(panel.select("instrument", "date"), ends.drop("m"), "month_close").select("instrument", "date", "month_close")


ISLAND_SQL = """
dates AS (SELECT index_code, snapshot, row_number() OVER (PARTITION BY index_code ORDER BY snapshot) AS n FROM (SELECT DISTINCT index_code, snapshot FROM membership)),
islands AS (SELECT m.*, n - row_number() OVER (PARTITION BY index_code, con_code ORDER BY snapshot) AS island FROM membership m JOIN dates USING (index_code, snapshot))"""


@REGISTRY.query("membership_tenure", with_sql(MEMBERSHIP_SQL, ISLAND_SQL, select="SELECT index_code, snapshot, con_code, (row_number() OVER (PARTITION BY index_code, con_code, island ORDER BY snapshot))::INTEGER AS tenure FROM islands"))
def membership_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.tenure(membership(spark, sf_dir))


@REGISTRY.query("membership_spans", with_sql(MEMBERSHIP_SQL, ISLAND_SQL, select="SELECT index_code, con_code, min(snapshot) AS start, max(snapshot) AS \"end\", count(*) AS snapshots FROM islands GROUP BY index_code, con_code, island"))
def membership_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.spans(membership(spark, sf_dir))


@REGISTRY.query("period_end_sessions", with_sql(BARS_SQL, CALENDAR_SQL, select="SELECT date_trunc('month', date)::DATE AS month, max(date) AS date FROM calendar GROUP BY 1"))
def period_end_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.period_ends(calendar(bars(spark, sf_dir)), "month")


@REGISTRY.query("outer_join_moneyflow", with_sql(BARS_SQL, MONEYFLOW_SQL, select="SELECT instrument, date, pe_ttm, net_mf_amount FROM bars FULL JOIN moneyflow USING (instrument, date)"))
def outer_join_moneyflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("instrument", "date", "pe_ttm").join(moneyflow(spark, sf_dir), ["instrument", "date"], "full")


FUNNEL_SQL = f"""
f AS (SELECT *, {q.mean('close', 20)} AS sma, coalesce(st_status = 0, false) AS p1, coalesce(close > low, false) AS p2, coalesce(turn < 30, false) AS p3 FROM bars)"""


@REGISTRY.query("filter_funnel", with_sql(BARS_SQL, FUNNEL_SQL, select="SELECT count(*) AS rows, count(*) FILTER (WHERE p1) AS not_flagged, count(*) FILTER (WHERE p1 AND p2) AS off_low, count(*) FILTER (WHERE p1 AND p2 AND p3) AS quiet, count(*) FILTER (WHERE p1 AND p2 AND p3 AND NOT coalesce(close > sma, false)) AS not_above_mean FROM f"))
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after each stage, in one pass; a comparison with NULL is false, so its negation is true."""
    panel = bars(spark, sf_dir).withColumn("sma", w.rolling_mean(F.col("close"), 20))
    stages = {"not_flagged": F.col("st_status") == 0, "off_low": F.col("close") > F.col("low"), "quiet": F.col("turn") < 30, "not_above_mean": ~w.two_valued(F.col("close") > F.col("sma"))}
    return labels.funnel(panel, stages)


@REGISTRY.query("sma_filtered", with_sql(BARS_SQL, f"f AS (SELECT *, {q.mean('close', 20)} AS sma FROM bars)", select="SELECT instrument, date, round(sma, 6) AS sma FROM f WHERE close > sma AND st_status = 0"))
def sma_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean sees the whole history; filters come after it."""
    panel = bars(spark, sf_dir).withColumn("sma", w.rolling_mean(F.col("close"), 20))
    return panel.where((F.col("close") > F.col("sma")) & (F.col("st_status") == 0)).select("instrument", "date", r(F.col("sma")).alias("sma"))


@REGISTRY.query("amount_units", with_sql(BARS_SQL, "unit AS (SELECT CASE WHEN quantile_cont(amount, 0.5) >= 1e5 THEN 1 ELSE 1000 END AS k FROM bars)", select="SELECT instrument, date, amount * k AS amount FROM bars, unit"))
def amount_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts are in thousands if their median is below a bound."""
    return labels.unit_normalised(bars(spark, sf_dir), "amount", 1e5).select("instrument", "date", "amount")


@REGISTRY.query("walk_folds", with_sql(BARS_SQL, CALENDAR_SQL, """
months AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(date)) FROM calendar), (SELECT date_trunc('month', max(date)) FROM calendar), INTERVAL 6 MONTH))::DATE AS train_from),
f AS (SELECT train_from, (train_from + INTERVAL 24 MONTH)::DATE AS test_from, (train_from + INTERVAL 30 MONTH)::DATE AS test_to FROM months),
first_session AS (SELECT train_from, min(session) AS s FROM f JOIN calendar ON date >= test_from GROUP BY 1)""", select="SELECT (row_number() OVER (ORDER BY f.train_from))::INTEGER AS fold, f.train_from, c.date AS label_cutoff, test_from, test_to FROM f JOIN first_session USING (train_from) JOIN calendar c ON c.session = s - 3 WHERE test_to <= (SELECT max(date) FROM calendar)"))
def walk_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.walk_forward_folds(calendar(bars(spark, sf_dir)), train_months=24, test_months=6, hold=2)


@REGISTRY.query("holdout_split", with_sql(BARS_SQL, CALENDAR_SQL, select="SELECT instrument, b.date, CASE WHEN session > (SELECT max(session) FROM calendar) - ceil((SELECT max(session) FROM calendar) * 0.2) THEN 'valid' ELSE 'train' END AS split FROM bars b JOIN calendar c ON b.date = c.date"))
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return labels.holdout(panel, calendar(panel)).select("instrument", "date", "split")


@REGISTRY.query("embargo_rows", with_sql(BARS_SQL, CALENDAR_SQL, "cut AS (SELECT min(session) - 3 AS s FROM calendar WHERE date >= DATE '1997-01-01')", select="SELECT instrument, b.date FROM bars b JOIN calendar c ON b.date = c.date WHERE session <= (SELECT s FROM cut)"))
def embargo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return labels.embargoed(panel, calendar(panel), "1997-01-01", hold=2).select("instrument", "date")


@REGISTRY.query("missing_codes", """
WITH asked AS (SELECT DISTINCT o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '-' || o_orderstatus END AS index_code FROM orders)
SELECT index_code FROM asked WHERE index_code NOT IN (SELECT o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1993-02-01')""")
def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that orders ask for, of which some name no index, without members as of a day."""
    ending = F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("o_orderstatus")))
    asked = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", ending).alias("index_code"))
    return universe.missing_indexes(asked, "1993-01-31", membership(spark, sf_dir))


@REGISTRY.query("session_shift", with_sql(BARS_SQL, CALENDAR_SQL, select="SELECT a.date, b.date AS later FROM calendar a LEFT JOIN calendar b ON b.session = a.session + 5"))
def session_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.shift_sessions(calendar(bars(spark, sf_dir)), 5)


GATED_SQL = f"asia AS (SELECT date, close, {q.mean('close', 20)} AS sma_20 FROM (SELECT ts_code AS instrument, * FROM index_daily WHERE ts_code = 'ASIA'))"


@REGISTRY.query("allowed_dates", with_sql(BARS_SQL, INDEX_SQL, GATED_SQL, select="SELECT b.date, instrument, round(b.close, 6) + 0.0 AS close FROM bars b WHERE b.date IN (SELECT date FROM asia WHERE close > sma_20)"))
def allowed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on the dates that an index gate leaves open."""
    panel = bars(spark, sf_dir)
    gates = universe.moving_average_gate(index_daily(spark, sf_dir, panel), 20)
    kept = universe.allowed_dates(panel, universe.open_dates(gates, ("ASIA",)))
    return kept.select("date", "instrument", (F.round("close", 6) + 0.0).alias("close"))


@REGISTRY.query(
    "pretrade_filter",
    with_sql(BARS_SQL, INDEX_SQL, GATED_SQL, select="SELECT b.date, instrument, round(turn, 6) + 0.0 AS turn FROM bars b JOIN asia a USING (date) WHERE turn < 28 AND NOT coalesce(pe_ttm > 0.06, false) AND st_status = 0 AND a.close > 0.98 * sma_20"),
)
def pretrade_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their own predicate, dates by the benchmark's; an unknown ratio is not above its bound."""
    panel = bars(spark, sf_dir)
    index = index_daily(spark, sf_dir, panel).where(F.col("ts_code") == "ASIA").select("date", "close")
    stock = (F.col("turn") < 28) & ~w.two_valued(F.col("pe_ttm") > 0.06) & (F.col("st_status") == 0)
    kept = universe.before_trading(panel, stock, index, F.col("close") > 0.98 * F.col("sma_20"), mean=20)
    return kept.select("date", "instrument", (F.round("turn", 6) + 0.0).alias("turn"))
