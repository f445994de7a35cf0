"""Price basis, halts, limits, splits, gates, benchmark curves and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.operators import archive, books, diagnostics, labels, models, quality, trading, universe
from panelspark.plans.book_queries import BOOK_SQL, CURVE_SQL, LEDGER_SQL
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.plans.diagnostic_queries import SCORED_SQL, scored
from panelspark.sources import files
from panelspark.sources.panel import (
    ADJUSTED_SQL, BARS_SQL, CALENDAR_SQL, INDEX_SQL, RUNS_SQL, SUSPEND_SQL, TRADES_SQL, adjusted_bars, bars, calendar, index_daily, runs, table, trades, with_sql,
)

BASIS = (BARS_SQL, SUSPEND_SQL, ADJUSTED_SQL)
KEYS = ("instrument", "date")


def _rounded(df: DataFrame, keys: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r(F.col(c), digits).alias(c) for c in df.columns if c not in keys])


@REGISTRY.query("adjusted_prices", with_sql(*BASIS, select="SELECT instrument, date, round(CASE WHEN NOT halted THEN hfq_open END, 6) AS open, round(CASE WHEN NOT halted THEN hfq_high END, 6) AS high, round(CASE WHEN NOT halted THEN hfq_low END, 6) AS low, round(CASE WHEN NOT halted THEN hfq_close END, 6) AS close, CASE WHEN NOT halted THEN vol END AS vol, round(hfq_close / close, 6) AS factor FROM adjusted"))
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on the adjusted basis, NULL on halted days, with the factor between the two bases."""
    panel = adjusted_bars(spark, sf_dir).withColumn("factor", trading.adjust_factor(F.col("hfq_close"), F.col("close"), F.col("adj_factor")))
    own = trading.without_halts(panel, F.col("is_suspended") == 1, ("hfq_open", "hfq_high", "hfq_low", "hfq_close", "vol"))
    found = trading.on_basis(own, "adjusted", ("open", "high", "low", "close", "vol", "factor"))
    return _rounded(found, (*KEYS, "vol"))


@REGISTRY.query("open_fills", with_sql(*BASIS, "v AS (SELECT *, coalesce(open < up_limit AND open > down_limit, false) AS fills FROM adjusted WHERE close IS NOT NULL AND up_limit IS NOT NULL AND down_limit IS NOT NULL)", select="SELECT instrument, date, close > low AND coalesce(lead(fills) OVER (PARTITION BY instrument ORDER BY date), false) AS may_open FROM v"))
def open_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that close off their low, and that the next bar can fill inside its limits."""
    filters = [
        trading.OpenFilter(frozenset({"open", "up_limit", "down_limit"}), trading.open_inside_limits()),
        trading.OpenFilter(frozenset({"close", "low"}), F.col("close") > F.col("low")),
    ]
    return trading.may_open(trading.verifiable(adjusted_bars(spark, sf_dir)), filters).select(*KEYS, "may_open")


@REGISTRY.query("sample_rows", with_sql(*BASIS, select="SELECT instrument, date, close FROM adjusted WHERE st_status = 0 AND NOT halted AND close > low AND close < up_limit AND close > down_limit AND float_market_cap <= 5000"))
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = adjusted_bars(spark, sf_dir)
    rule = trading.sample_filter(F.col("st_status"), F.col("is_suspended") == 1, most_cap=5000)
    return panel.where(rule).select(*KEYS, "close")


@REGISTRY.query("three_way_split", with_sql(BARS_SQL, select="SELECT instrument, date, CASE WHEN date <= DATE '1995-06-30' THEN 'train' WHEN date <= DATE '1996-12-31' THEN 'validation' ELSE 'test' END AS split FROM bars WHERE date BETWEEN DATE '1993-01-01' AND DATE '1998-06-30'"))
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.three_way(bars(spark, sf_dir), "1993-01-01", "1995-06-30", "1996-12-31", "1998-06-30").select(*KEYS, "split")


@REGISTRY.query("score_masks", with_sql(BARS_SQL, select="SELECT instrument, date, date <= DATE '1995-06-30' AS is_train, date > DATE '1995-06-30' AND date <= DATE '1996-12-31' AS is_valid, date > DATE '1996-06-30' AND date <= DATE '1997-06-30' AS is_score FROM bars"))
def score_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.score_parts(bars(spark, sf_dir), "1995-06-30", "1996-12-31", "1996-06-30", "1997-06-30").select(*KEYS, "is_train", "is_valid", "is_score")


@REGISTRY.query("segment_rows", with_sql(BARS_SQL, "edges AS (SELECT date, list_sort(list_distinct(quantile_cont(turn, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM bars GROUP BY 1 HAVING count(turn) >= 5)", select="SELECT instrument, date, close FROM bars JOIN edges USING (date) WHERE len(e) > 1 AND greatest(len(list_filter(e, lambda v: v < turn)) - 1, 0) + 1 = 5"))
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return trading.in_segment(panel.select(*KEYS, "close"), panel, "turn", 5)


@REGISTRY.query("stored_factor", with_sql(*BASIS, "stored AS (SELECT instrument, date, adj_factor AS factor_value FROM adjusted WHERE date >= DATE '1995-01-01')", select="SELECT instrument, date, close, factor_value AS carried FROM bars LEFT JOIN stored USING (instrument, date)"))
def stored_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = adjusted_bars(spark, sf_dir).where(F.col("date") >= F.lit("1995-01-01").cast("date")).select(*KEYS, F.col("adj_factor").alias("factor_value"))
    return trading.with_stored(bars(spark, sf_dir).select(*KEYS, "close"), stored, "carried").select(*KEYS, "close", "carried")


VERDICT_SQL = """
told AS (
  SELECT count(*) AS rows, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS duplicate_keys, count(*) FILTER (WHERE l_extendedprice + (0.05 - l_discount) > l_extendedprice) AS ohlc_violations,
    (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS stated FROM lineitem
)"""


@REGISTRY.query("table_verdict", with_sql(VERDICT_SQL, select="SELECT rows, true AS required_fields, rows = stated AS row_count_matches, duplicate_keys, ohlc_violations, true AS date_range_stated, CASE WHEN rows = stated AND duplicate_keys = 0 AND ohlc_violations = 0 THEN 'passed' ELSE 'needs_review' END AS status FROM told"))
def table_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick table as received: repeated keys and lows above the open ask for a review."""
    price, low = F.col("l_extendedprice"), F.col("l_extendedprice") + (0.05 - F.col("l_discount"))
    ticks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("open"), F.greatest(price, low).alias("high"), low.alias("low"), price.alias("close"))
    # The table's manifest: lines that the orders were counted with.
    stated = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count(), F.col("o_orderkey") == F.col("l_orderkey")).agg(F.sum("count")).first()[0]
    return quality.verdict(ticks, ("open", "close", "l_orderkey"), ("l_orderkey", "l_linenumber"), stated, ("1992-01-01", "1998-12-31"))


GATED = ("turn", "pe_ttm", "momentum_5")
GATE_FLOORS = ((5, 0.95), (5, 0.99), (5, 0.999))
GATE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, days >= {d} AND share >= {c} AS publish, CASE WHEN days < {d} THEN 'too few days' WHEN share < {c} THEN 'too little coverage' ELSE 'passed' END AS reason "
    f"FROM (SELECT count({name}) / count(*) AS share, count(DISTINCT CASE WHEN {name} IS NOT NULL THEN date END) AS days FROM scored)"
    for name, (d, c) in zip(GATED, GATE_FLOORS, strict=True)
)


@REGISTRY.query("publish_gate", with_sql(BARS_SQL, SCORED_SQL, select=GATE_SQL))
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scored(spark, sf_dir).select("date", F.expr("stack(3, " + ", ".join(f"'{n}', cast({n} as double)" for n in GATED) + ") AS (name, v)"))
    summary = long.groupBy("name").agg((F.count("v") / F.count("*")).alias("coverage"), F.count_distinct(F.when(F.col("v").isNotNull(), F.col("date"))).alias("effective_days"))
    floors = spark.createDataFrame([(n, d, c) for n, (d, c) in zip(GATED, GATE_FLOORS, strict=True)], "name string, least_days int, least_coverage double")
    return quality.publish_gate(summary, floors)


CODED_SQL = """
coded AS (
  SELECT s_suppkey, lpad(((s_suppkey * 1009) % 1000)::VARCHAR, 3, '0') || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS symbol,
    CASE s_nationkey % 3 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' ELSE 'BJ' END AS exchange FROM supplier
)"""


@REGISTRY.query("code_rules", with_sql(CODED_SQL, select="SELECT symbol || '.' || exchange AS code, exchange || symbol AS prefixed, exchange IN ('SH', 'SZ') AS listed_here, exchange <> 'BJ' AND left(symbol, 3) IN ('600', '601', '603', '605', '000', '001', '002', '003', '300', '301') AS main_board, left(symbol, 3) = '688' AS star, left(symbol, 3) IN ('300', '301') AS growth FROM coded"))
def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of suppliers in both notations, with exchange and board rules."""
    key = F.col("s_suppkey")
    symbol = F.concat(F.lpad((key * 1009 % 1000).cast("string"), 3, "0"), F.lpad((key % 1000).cast("string"), 3, "0"))
    exchange = F.element_at(F.array(F.lit("SH"), F.lit("SZ"), F.lit("BJ")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    coded = table(spark, sf_dir, "supplier").select(F.concat_ws(".", symbol, exchange).alias("code"))
    both = coded.withColumn("prefixed", universe.to_prefixed("code")).withColumn("code", universe.to_suffixed("prefixed"))
    return both.select(
        "code", "prefixed", universe.on_exchanges("code", (".SH", ".SZ")).alias("listed_here"), universe.on_main_boards("code").alias("main_board"),
        universe.off_boards("code", "star").alias("star"), universe.off_boards("code", "growth").alias("growth"),
    )


@REGISTRY.query("normalised_rows", "SELECT o_orderkey AS instrument, o_orderdate::DATE AS date, o_orderstatus = 'F' AS suspended FROM orders")
def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in two notations and flags in two become dates and booleans under the usual names."""
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    flag = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 3 == 0, "1").otherwise("True")).when(F.col("o_orderkey") % 3 == 0, "0")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ts_code"), day.alias("trade_date"), flag.alias("is_suspended"))
    return trading.normalised(rows, {"ts_code": "instrument", "trade_date": "date", "vol_": "vol"})


@REGISTRY.query("approx_quantiles", with_sql(BARS_SQL, SCORED_SQL, "q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS mark)", select="SELECT mark::DOUBLE AS mark, round((SELECT quantile_disc(momentum_5, 0.05) FROM scored), 6) AS value FROM q WHERE mark = 0.05 UNION ALL SELECT 0.25, round((SELECT quantile_disc(momentum_5, 0.25) FROM scored), 6) UNION ALL SELECT 0.5, round((SELECT quantile_disc(momentum_5, 0.5) FROM scored), 6) UNION ALL SELECT 0.75, round((SELECT quantile_disc(momentum_5, 0.75) FROM scored), 6) UNION ALL SELECT 0.95, round((SELECT quantile_disc(momentum_5, 0.95) FROM scored), 6)"))
def approx_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off by at most a millionth of the rows, so exact on the small tables."""
    found = diagnostics.approximate_quantiles(scored(spark, sf_dir), "momentum_5", (0.05, 0.25, 0.5, 0.75, 0.95), 1_000_000)
    return found.select("mark", r(F.col("value")).alias("value"))


@REGISTRY.query("equal_bins", with_sql(BARS_SQL, "e AS (SELECT min(amount) AS a, max(amount) AS b FROM bars)", "c AS (SELECT least(greatest(ceil((amount - a) / ((b - a) / 10)) - 1, 0), 9)::INTEGER AS bin, count(*) AS n FROM bars, e GROUP BY 1)", select="SELECT k::INTEGER AS bin, round(CASE WHEN k = 0 THEN a - (b - a) / 1000 ELSE a + (b - a) / 10 * k END, 4) AS lower, round(a + (b - a) / 10 * (k + 1), 4) AS upper, coalesce(n, 0) AS count FROM (SELECT unnest(range(10)) AS k) CROSS JOIN e LEFT JOIN c ON c.bin = k"))
def equal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics.equal_bins(bars(spark, sf_dir), "amount")
    return found.select("bin", r(F.col("lower"), 4).alias("lower"), r(F.col("upper"), 4).alias("upper"), "count")


@REGISTRY.query("histogram_positive", with_sql(BARS_SQL, "x AS (SELECT amount - 7000 AS v FROM bars)", "p AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM x WHERE v > 0)", "c AS (SELECT CASE WHEN v < a THEN -1 WHEN v > b THEN 60 ELSE least(floor((ln(v) - ln(a)) / (ln(b) - ln(a)) * 60), 59) END::INTEGER AS bin, count(*) AS n FROM x, p GROUP BY 1)", select="SELECT k::INTEGER AS bin, coalesce(n, 0) AS count FROM (SELECT unnest(range(-1, 61)) AS k) LEFT JOIN c ON c.bin = k"))
def histogram_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mostly positive values take a logarithmic scale over the positive ones; the rest is below."""
    return diagnostics.histogram(bars(spark, sf_dir).select((F.col("amount") - 7000).alias("v")), "v").select("bin", "count")


NORMAL_SQL = """
told AS (SELECT avg(momentum_5) AS m, stddev_pop(momentum_5) AS s, count(momentum_5) AS n, quantile_cont(momentum_5, 0.01) AS a, quantile_cont(momentum_5, 0.99) AS b FROM scored),
edges AS (SELECT k, (a + (b - a) * k / 60 - m) / s AS z0, (a + (b - a) * (k + 1) / 60 - m) / s AS z1, n FROM (SELECT unnest(range(60)) AS k), told),
-- the error function by its power series, which converges for all z here
parts AS (
  SELECT k, n, list_sum(list_transform(range(0, 120), lambda i: pow(-1, i) * pow(z0 / sqrt(2), 2 * i + 1) / gamma(i + 1) / (2 * i + 1))) / sqrt(pi()) AS f0,
    list_sum(list_transform(range(0, 120), lambda i: pow(-1, i) * pow(z1 / sqrt(2), 2 * i + 1) / gamma(i + 1) / (2 * i + 1))) / sqrt(pi()) AS f1 FROM edges
)"""


@REGISTRY.query("histogram_expected", with_sql(BARS_SQL, SCORED_SQL, NORMAL_SQL, select="SELECT k::INTEGER AS bin, round((f1 - f0) * n, 1) + 0.0 AS expected FROM parts"))
def histogram_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a normal distribution would put into each bin between the first and the last percentile."""
    panel = scored(spark, sf_dir)
    found = diagnostics.normal_expected(diagnostics.histogram(panel, "momentum_5"), panel, "momentum_5")
    return found.where(F.col("bin").between(0, 59)).select("bin", r(F.col("expected"), 1).alias("expected"))


@REGISTRY.query("benchmark_curve", with_sql(BARS_SQL, CALENDAR_SQL, INDEX_SQL, "asia AS (SELECT date, max(close) AS close FROM index_daily WHERE ts_code = 'ASIA' AND close > 0 AND month(date) <> 5 GROUP BY 1)", "carried AS (SELECT c.date, last_value(a.close IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS close FROM calendar c LEFT JOIN asia a USING (date))", select="SELECT date, round(1e6 * close / (SELECT arg_min(close, date) FROM asia), 4) AS equity FROM carried WHERE close IS NOT NULL"))
def benchmark_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regional index, without its Mays, carried forward over all sessions."""
    panel = bars(spark, sf_dir)
    prices = books.one_price_a_date(index_daily(spark, sf_dir, panel), "ASIA").where(F.month("date") != 5)
    return books.benchmark_curve(prices, calendar(panel), 1e6).select("date", r(F.col("equity"), 4).alias("equity"))


LEDGER_CURVE_SQL = "equity AS (SELECT date, invested, 1e9 + sum(flow) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) + invested AS equity FROM daily)"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return books.ledger_curve(trades(spark, sf_dir), calendar(panel), panel, 1e9)


@REGISTRY.query("curve_metrics", with_sql(BARS_SQL, CALENDAR_SQL, TRADES_SQL, LEDGER_SQL, LEDGER_CURVE_SQL, "d AS (SELECT *, coalesce(equity / nullif(lag(equity) OVER (ORDER BY date), 0) - 1, 0) AS ret, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM equity)", select="SELECT count(*) AS days, round(arg_max(equity, date) / arg_min(equity, date) - 1, 6) + 0.0 AS total_return, round(pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 6) + 0.0 AS annual_return, round(avg(ret) / stddev_samp(ret) * sqrt(252), 4) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown, round(avg((ret > 0)::INTEGER), 6) AS win_rate, round(avg(invested / equity), 6) AS capital_usage FROM d"))
def curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = books.curve_metrics(_ledger(spark, sf_dir))
    digits = {"sharpe": 4}
    return found.select("days", *[r(F.col(c), digits.get(c, 6)).alias(c) for c in found.columns if c != "days"])


@REGISTRY.query("curve_by_year", with_sql(BARS_SQL, CALENDAR_SQL, TRADES_SQL, LEDGER_SQL, LEDGER_CURVE_SQL, "d AS (SELECT *, equity / max(equity) OVER (PARTITION BY year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM equity)", select="SELECT year(date)::INTEGER AS year, round(arg_max(equity, date) / arg_min(equity, date) - 1, 6) + 0.0 AS ret, round(min(dd), 6) + 0.0 AS max_drawdown FROM d GROUP BY 1"))
def curve_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(books.by_year(_ledger(spark, sf_dir)), ("year",))


@REGISTRY.query("returns_of_equity", with_sql(BARS_SQL, CALENDAR_SQL, TRADES_SQL, LEDGER_SQL, LEDGER_CURVE_SQL, select="SELECT date, round(coalesce(equity / nullif(lag(equity) OVER (ORDER BY date), 0) - 1, 0), 8) + 0.0 AS ret FROM equity"))
def returns_of_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(books.curve_returns(_ledger(spark, sf_dir)), ("date",), 8)


HOLD_SQL = """
before AS (SELECT date, coalesce(lag(wealth) OVER (ORDER BY date), 1) AS w FROM curve),
n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM top)),
g AS (SELECT t.*, i - row_number() OVER (PARTITION BY instrument ORDER BY date) AS island FROM top t JOIN n USING (date))"""


@REGISTRY.query("holding_profit", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, CURVE_SQL, HOLD_SQL, select="SELECT instrument, min(date) AS start, max(date) AS \"end\", count(*) AS sessions, round(sum(weight * label * w) / max(w), 4) + 0.0 AS profit FROM g JOIN before USING (date) GROUP BY instrument, island"))
def holding_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profit of each holding in units of its largest wealth (wealth grows beyond what digits can be compared at)."""
    panel = scored(spark, sf_dir).where(F.col("momentum_5").isNotNull() & F.col("label").isNotNull())
    weights = books.top_n(panel, "momentum_5", 10).select("date", "instrument", F.lit(0.095).alias("weight"))
    curve = books.wealth(books.top_k_book(panel, "momentum_5", "label", 10))
    found = books.holding_profit(weights, panel, "label", curve)
    before = curve.select("date", F.lag("wealth", 1, 1.0).over(w.Window.orderBy("date")).alias("w"))
    most = found.join(F.broadcast(before), before["date"].between(found["start"], found["end"])).groupBy("instrument", "start", "end", "sessions", "profit").agg(F.max("w").alias("w"))
    return most.select("instrument", "start", "end", "sessions", r(F.col("profit") / F.col("w"), 4).alias("profit"))


@REGISTRY.query("test_window_usage", with_sql(RUNS_SQL, select="SELECT year::VARCHAR || '-01-01' AS date_from, year::VARCHAR || '-12-31' AS date_to, count(*) FILTER (WHERE status = 'completed') AS used FROM runs GROUP BY year"))
def test_window_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.window_usage(runs(spark, sf_dir))


@REGISTRY.query("factor_names_of_runs", with_sql(RUNS_SQL, select="SELECT run_id, c_mktsegment AS owner, array_to_string(list_sort(list_transform(factors, lambda f: 'name_' || f)), ', ') AS names FROM runs JOIN orders ON o_orderkey = run_id JOIN customer ON c_custkey = o_custkey"))
def factor_names_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their owner and the names of their factors: two dimension joins and a list."""
    names = spark.createDataFrame([(f"f{i}", f"name_f{i}") for i in range(3)], "factor string, name string")
    owners = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("run_id"), F.col("c_mktsegment").alias("owner"))
    return archive.with_names(runs(spark, sf_dir), names).join(owners, "run_id").select("run_id", "owner", "names")


@REGISTRY.query("archive_page", with_sql(RUNS_SQL, "f AS (SELECT *, count(*) OVER () AS total FROM runs WHERE status = 'completed' AND year IN (1994, 1995))", select="SELECT run_id, sharpe, total FROM f ORDER BY sharpe DESC NULLS LAST, run_id LIMIT 15 OFFSET 30"))
def archive_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the runs whose test window overlaps a span, with the number of all of them."""
    return archive.overlapping(runs(spark, sf_dir), "1994-11-01", "1995-02-01", status="completed", number=3, size=15)


@REGISTRY.query("overview_alerts", with_sql(RUNS_SQL, select="SELECT run_id, finished, status FROM runs WHERE status <> 'completed' ORDER BY finished DESC, run_id DESC LIMIT 10"))
def overview_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest runs that are not done."""
    return archive.latest_runs(runs(spark, sf_dir).where(F.col("status") != "completed"), 10).select("run_id", "finished", "status")


@REGISTRY.query("partitioned_scan", with_sql(BARS_SQL, select="SELECT instrument, date, close, vol FROM bars WHERE year(date) IN (1994, 1995)"))
def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written by year, of which two years are read; the other folders are not opened."""
    folder = files.shared(spark, "snapshot")
    files.write_by_year(bars(spark, sf_dir).select(*KEYS, "close", "vol"), folder)
    return files.read_years(spark, folder, (1994, 1995)).select(*KEYS, "close", "vol")


@REGISTRY.query("sidecar_columns", with_sql(BARS_SQL, SCORED_SQL, select="SELECT instrument, date, turn, round(momentum_5, 6) + 0.0 AS momentum_5 FROM scored"))
def sidecar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor table, written, read again and completed by a column that it lacks."""
    folder, panel = files.shared(spark, "sidecar"), scored(spark, sf_dir)
    files.write_sidecar(panel.select(*KEYS, "turn"), folder)
    whole = files.append_factors(spark.read.parquet(folder), panel.select(*KEYS, "turn", r(F.col("momentum_5")).alias("momentum_5")))
    return whole.select(*KEYS, "turn", "momentum_5")


@REGISTRY.query("friday_weeks", "SELECT l_suppkey AS instrument, (date_trunc('week', l_shipdate + INTERVAL 2 DAY) + INTERVAL 4 DAY)::DATE AS week, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2")
def friday_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of weeks that end on Friday."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    return lines.groupBy("instrument", labels.friday_week().alias("week")).agg(F.sum("l_quantity").alias("vol"))


@REGISTRY.query("landing_cutoff", with_sql(BARS_SQL, CALENDAR_SQL, select="SELECT max(date) AS date FROM calendar WHERE date <= DATE '1996-07-01' - INTERVAL 1 DAY"))
def landing_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before 16:00 local time the session of the day is not complete."""
    return labels.last_session(calendar(bars(spark, sf_dir)), F.lit("1996-07-01 07:30:00").cast("timestamp"))


@REGISTRY.query("rows_by_section", with_sql(BARS_SQL, select="SELECT instrument, date, close FROM bars WHERE CASE WHEN date < DATE '1996-01-01' THEN st_status = 0 ELSE turn < 30 END"))
def rows_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.by_section(bars(spark, sf_dir), "1996-01-01", F.col("st_status") == 0, F.col("turn") < 30).select(*KEYS, "close")


@REGISTRY.query("ml_boosted_ranking")
def ml_boosted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the 20-bin label; validation rows stop them early."""
    features = ("momentum_5", "turn", "pe_ttm", "dividend_yield_ratio")
    panel = models.computed_once(scored(spark, sf_dir), *KEYS, *features, "label")
    split = trading.three_way(panel, "1992-01-01", "1995-12-31", "1996-12-31", "1998-12-31")
    part = {name: split.where(F.col("split") == name).drop("split") for name in ("train", "validation", "test")}
    return models.boosted_ranking(part["train"], part["validation"], part["test"], features, "label")
