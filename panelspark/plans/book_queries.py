"""Books, ledgers, curves, archives, signals, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import sqltext as q
from panelspark.operators import archive, books, experts, labels, models, signals
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.plans.diagnostic_queries import SCORED_SQL, scored
from panelspark.sources.panel import BARS_SQL, CALENDAR_SQL, RUNS_SQL, TRADES_SQL, bars, calendar, runs, trades, with_sql
from panelspark.streaming import jobs

BOOK_SQL = """
held AS (SELECT * FROM scored WHERE momentum_5 IS NOT NULL AND label IS NOT NULL),
top AS (SELECT date, instrument, label, 0.095 AS weight FROM held QUALIFY row_number() OVER (PARTITION BY date ORDER BY momentum_5 DESC, instrument) <= 10),
steps AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_ FROM (SELECT DISTINCT date FROM top)),
gone AS (SELECT next_ AS date, instrument, weight AS before FROM top JOIN steps USING (date) WHERE next_ IS NOT NULL),
moves AS (SELECT date, instrument, coalesce(t.weight, 0) - coalesce(g.before, 0) AS change FROM top t FULL JOIN gone g USING (date, instrument)),
summed AS (SELECT date, sum(greatest(change, 0)) AS turnover, sum(greatest(-change, 0)) AS sold FROM moves GROUP BY 1),
book AS (
  SELECT g.date, turnover, gross - 0.0005 * turnover - 0.0015 * sold AS ret, bench, gross - 0.0005 * turnover - 0.0015 * sold - bench AS excess
  FROM (SELECT date, sum(weight * label) AS gross FROM top GROUP BY 1) g JOIN summed USING (date) JOIN (SELECT date, avg(label) AS bench FROM held GROUP BY 1) USING (date)
)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.top_k_book(scored(spark, sf_dir), "momentum_5", "label", 10)


def _rounded(df: DataFrame, keys: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r(F.col(c), digits).alias(c) for c in df.columns if c not in keys])


@REGISTRY.query("topk_book", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, select="SELECT date, round(turnover, 6) + 0.0 AS turnover, round(ret, 6) + 0.0 AS ret, round(bench, 6) + 0.0 AS bench, round(excess, 6) + 0.0 AS excess FROM book"))
def topk_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_book(spark, sf_dir), ("date",))


#: Weekly outcomes of these tables are in the hundreds of per cent; measures are taken of a book with a hundredth of its capital at stake.
STAKE = 0.01
CALM_SQL = f"calm AS (SELECT date, turnover, {STAKE} * ret AS ret, {STAKE} * bench AS bench, {STAKE} * excess AS excess FROM book)"


def _calm(book: DataFrame) -> DataFrame:
    return book.withColumns({c: STAKE * F.col(c) for c in ("ret", "bench", "excess")})


CURVE_SQL = """
curve AS (SELECT *, exp(sum(ln(1 + greatest(ret, -0.999999))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM book),
drawn AS (SELECT *, wealth / greatest(max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM curve)"""


@REGISTRY.query("book_metrics", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, CALM_SQL, CURVE_SQL.replace("FROM book", "FROM calm"), select="""
SELECT count(*) AS days, round(ln(arg_max(wealth, date)), 4) AS log_wealth, round(arg_max(wealth, date) ** (52.0 / count(*)) - 1, 5) AS annual_return,
  round((arg_max(wealth, date) ** (52.0 / count(*)) - 1) / -min(drawdown), 4) AS calmar, round(min(drawdown), 6) AS max_drawdown, round(avg(ret) / stddev_samp(ret) * sqrt(52), 5) AS sharpe,
  round(avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(52), 4) AS sortino, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  round(avg(turnover), 6) AS turnover, round(avg(excess) / stddev_samp(excess) * sqrt(52), 5) AS information_ratio FROM drawn"""))  # fmt: skip
def book_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = books.book_metrics(_calm(_book(spark, sf_dir)))
    return found.select(
        "days", r(F.ln(F.col("total_return") + 1), 4).alias("log_wealth"), r(F.col("annual_return"), 5).alias("annual_return"), r(F.col("calmar"), 4).alias("calmar"), r(F.col("max_drawdown")).alias("max_drawdown"), r(F.col("sharpe"), 5).alias("sharpe"), r(F.col("sortino"), 4).alias("sortino"),
        r(F.col("win_rate")).alias("win_rate"), r(F.col("turnover")).alias("turnover"), r(F.col("information_ratio"), 5).alias("information_ratio"),
    )


@REGISTRY.query("weight_changes", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, select="SELECT date, instrument, round(change, 6) + 0.0 AS change FROM moves WHERE abs(change) > 1e-12"))
def weight_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scored(spark, sf_dir).where(F.col("momentum_5").isNotNull() & F.col("label").isNotNull())
    weights = books.top_n(held, "momentum_5", 10).select("date", "instrument", F.lit(0.095).alias("weight"))
    return books.weight_changes(weights).select("date", "instrument", r(F.col("change")).alias("change"))


@REGISTRY.query("holding_episodes", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, "n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM top))", "g AS (SELECT instrument, date, i - row_number() OVER (PARTITION BY instrument ORDER BY date) AS island FROM top JOIN n USING (date))", select="SELECT instrument, min(date) AS start, max(date) AS \"end\", count(*) AS sessions FROM g GROUP BY instrument, island"))
def holding_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scored(spark, sf_dir).where(F.col("momentum_5").isNotNull() & F.col("label").isNotNull())
    return books.episodes(books.top_n(held, "momentum_5", 10).select("date", "instrument"))


@REGISTRY.query("target_weights", with_sql(BARS_SQL, SCORED_SQL, "top AS (SELECT date, instrument, greatest(momentum_5, 0) AS s FROM scored WHERE momentum_5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY momentum_5 DESC, instrument) <= 8)", select="SELECT date, instrument, round(s / nullif(sum(s) OVER (PARTITION BY date), 0), 6) + 0.0 AS weight FROM top"))
def target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(books.target_weights(scored(spark, sf_dir), "momentum_5", 8, by_score=True), ("date", "instrument"))


SEGMENT_SQL = """
long AS (SELECT date, instrument, momentum_5, label, 'float_market_cap' AS dimension, float_market_cap AS level FROM scored UNION ALL SELECT date, instrument, momentum_5, label, 'turn', turn FROM scored),
cuts AS (SELECT dimension, date, list_sort(list_distinct(quantile_cont(level, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM long GROUP BY 1, 2 HAVING count(level) >= 5),
inside AS (SELECT l.*, (greatest(len(list_filter(e, lambda v: v < level)) - 1, 0) + 1)::INTEGER AS bucket FROM long l JOIN cuts USING (dimension, date) WHERE len(e) > 1 AND momentum_5 IS NOT NULL AND label IS NOT NULL),
top AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY dimension, bucket, date ORDER BY momentum_5 DESC, instrument) <= 3),
gross AS (SELECT dimension, bucket, date, sum(0.95 / 3 * label) AS gross FROM top GROUP BY 1, 2, 3),
bench AS (SELECT dimension, bucket, date, avg(label) AS bench FROM inside GROUP BY 1, 2, 3)"""


SEGMENT_BOOK_SQL = """
seats AS (SELECT dimension, bucket, date, lead(date) OVER (PARTITION BY dimension, bucket ORDER BY date) AS next_ FROM (SELECT DISTINCT dimension, bucket, date FROM top)),
had AS (SELECT t.dimension, t.bucket, next_ AS date, instrument FROM top t JOIN seats USING (dimension, bucket, date) WHERE next_ IS NOT NULL),
shifts AS (SELECT dimension, bucket, date, (t.instrument IS NOT NULL)::INTEGER - (h.instrument IS NOT NULL)::INTEGER AS way FROM top t FULL JOIN had h USING (dimension, bucket, date, instrument)),
traded AS (SELECT dimension, bucket, date, 0.95 / 3 * count(*) FILTER (WHERE way = 1) AS turnover, 0.95 / 3 * count(*) FILTER (WHERE way = -1) AS sold FROM shifts GROUP BY 1, 2, 3),
segment AS (SELECT dimension, bucket, date, turnover, 0.01 * (gross - 0.0005 * turnover - 0.0015 * sold) AS ret, 0.01 * bench AS bench FROM gross JOIN traded USING (dimension, bucket, date) JOIN bench USING (dimension, bucket, date)),
risen AS (SELECT *, exp(sum(ln(1 + greatest(ret, -0.999999))) OVER s) AS wealth FROM segment WINDOW s AS (PARTITION BY dimension, bucket ORDER BY date ROWS UNBOUNDED PRECEDING)),
fallen AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY dimension, bucket ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM risen)"""
SEGMENT_SELECT = """
SELECT dimension, bucket, count(*) AS days, round(avg(ret), 6) + 0.0 AS ret, round(avg(bench), 6) + 0.0 AS bench, round(avg(ret - bench), 6) + 0.0 AS excess, round(avg(turnover), 6) + 0.0 AS turnover,
  round(arg_max(wealth, date) ** (52.0 / count(*)) - 1, 5) + 0.0 AS annual_return, round(min(drawdown), 6) + 0.0 AS max_drawdown, round(avg(ret) / stddev_samp(ret) * sqrt(52), 5) + 0.0 AS sharpe,
  round(avg(ret - bench) / stddev_samp(ret - bench) * sqrt(52), 5) + 0.0 AS information_ratio FROM fallen GROUP BY 1, 2"""


@REGISTRY.query("segment_books", with_sql(BARS_SQL, SCORED_SQL, SEGMENT_SQL, SEGMENT_BOOK_SQL, select=SEGMENT_SELECT))
def segment_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("dimension", "bucket")
    daily = _calm(books.segment_books(scored(spark, sf_dir), "momentum_5", "label", ("float_market_cap", "turn"), 3))
    means = daily.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("ret", "bench", "excess")])
    found = books.book_metrics(daily, by).join(means, list(by))
    measures = {"ret": 6, "bench": 6, "excess": 6, "turnover": 6, "annual_return": 5, "max_drawdown": 6, "sharpe": 5, "information_ratio": 5}
    return found.select(*by, "days", *[r(F.col(c), digits).alias(c) for c, digits in measures.items()])


@REGISTRY.query("drawdown_streak", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, "n AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM book)", "g AS (SELECT i - row_number() OVER (ORDER BY date) AS island FROM n WHERE ret < 0)", select="SELECT max(n) AS streak FROM (SELECT count(*) AS n FROM g GROUP BY island)"))
def drawdown_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.longest_loss(_book(spark, sf_dir))


@REGISTRY.query("month_returns", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, select="SELECT date_trunc('month', date)::DATE AS period, round(exp(sum(ln(1 + ret))) - 1, 5) + 0.0 AS ret FROM book GROUP BY 1"))
def month_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(books.by_period(_book(spark, sf_dir), "month"), ("period",), 5)


@REGISTRY.query("active_pearson_mar", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, select="SELECT count(*) AS days, round(covar_pop(ret, bench) / nullif(stddev_pop(ret) * stddev_pop(bench), 0), 4) AS corr FROM book WHERE ret <> 0 OR bench <> 0 HAVING count(*) >= 20"))
def active_pearson_mar(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    return books.active_correlation(book, book.select("date", F.col("bench").alias("ret"))).select("days", r(F.col("corr"), 4).alias("corr"))


MAR_SQL = """
series AS (SELECT 'own' AS series, date, ret FROM calm UNION ALL SELECT 'bench', date, bench FROM calm UNION ALL SELECT 'blend', date, 0.5 * ret + 0.5 * bench FROM calm),
grown AS (SELECT *, exp(sum(ln(1 + greatest(ret, -0.999999))) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM series),
sunk AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM grown),
measured AS (SELECT series, arg_max(wealth, date) ** (52.0 / count(*)) - 1 AS cagr, min(drawdown) AS worst FROM sunk GROUP BY 1),
told AS (SELECT *, cagr / nullif(-worst, 0) AS mar FROM measured)"""


@REGISTRY.query("incremental_mar", with_sql(BARS_SQL, SCORED_SQL, BOOK_SQL, CALM_SQL, MAR_SQL, select="SELECT t.series, round(t.cagr, 5) + 0.0 AS cagr, round(t.worst, 6) + 0.0 AS max_drawdown, round(t.mar, 4) + 0.0 AS mar, round(t.mar - b.mar, 4) + 0.0 AS gain FROM told t, told b WHERE b.series = 'bench'"))
def incremental_mar(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _calm(_book(spark, sf_dir))
    found = books.incremental_mar(book, book.select("date", F.col("bench").alias("ret")))
    return found.select("series", r(F.col("cagr"), 5).alias("cagr"), r(F.col("max_drawdown")).alias("max_drawdown"), r(F.col("mar"), 4).alias("mar"), r(F.col("gain"), 4).alias("gain"))


@REGISTRY.query("holdings_interval", with_sql(BARS_SQL, CALENDAR_SQL, TRADES_SQL, select="SELECT date, instrument, trade_id FROM trades JOIN calendar ON buy_date <= date AND (sell_date IS NULL OR date < sell_date)"))
def holdings_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.daily_holdings(trades(spark, sf_dir), calendar(bars(spark, sf_dir)))


LEDGER_SQL = """
flows AS (
  SELECT instrument, buy_date AS day, quantity AS q, -buy_price * quantity AS cash FROM trades UNION ALL
  SELECT instrument, sell_date, -quantity, sell_price * quantity FROM trades WHERE sell_date IS NOT NULL
),
placed AS (SELECT instrument, min(c.date) AS date, q, cash FROM (SELECT *, row_number() OVER () AS k FROM flows) f JOIN calendar c ON c.date >= f.day GROUP BY k, instrument, q, cash),
summed AS (SELECT instrument, date, sum(q) AS q, sum(cash) AS cash FROM placed GROUP BY 1, 2),
grid AS (SELECT i.instrument, c.date FROM (SELECT DISTINCT instrument FROM summed) i CROSS JOIN calendar c),
held AS (
  SELECT date, coalesce(s.cash, 0) AS cash, coalesce(sum(s.q) OVER w, 0) * coalesce(last_value(b.close IGNORE NULLS) OVER w, 0) AS value
  FROM grid LEFT JOIN summed s USING (instrument, date) LEFT JOIN bars b USING (instrument, date) WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING)
),
daily AS (SELECT date, sum(cash) AS flow, sum(value) AS invested FROM held GROUP BY 1)"""


@REGISTRY.query("ledger_equity_curve", with_sql(BARS_SQL, CALENDAR_SQL, TRADES_SQL, LEDGER_SQL, select="SELECT date, round(1e9 + sum(flow) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 2) AS cash, round(invested, 2) AS invested FROM daily"))
def ledger_equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    curve = books.ledger_curve(trades(spark, sf_dir), calendar(panel), panel, 1e9)
    return curve.select("date", r(F.col("cash"), 2).alias("cash"), r(F.col("invested"), 2).alias("invested"))


@REGISTRY.query("name_pnl_share", with_sql(TRADES_SQL, "g AS (SELECT instrument, sum(greatest(coalesce(pnl, 0), 0)) AS gain FROM trades GROUP BY 1)", select="SELECT instrument, round(gain / (SELECT sum(gain) FROM g), 6) AS share FROM g ORDER BY gain DESC, instrument LIMIT 1"))
def name_pnl_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(books.top_name_share(trades(spark, sf_dir)), ("instrument",))


BLEND_SQL = f"ranks AS (SELECT instrument, date, {q.cs_rank('momentum_5')} AS a, 1 - {q.cs_rank('pe_ttm')} AS b, {q.cs_rank('turn')} AS c FROM scored)"


@REGISTRY.query("factor_blend_score", with_sql(BARS_SQL, SCORED_SQL, BLEND_SQL, select="SELECT instrument, date, round((a + b + c) / 3 + (a + b + c) * 1e-9, 6) + 0.0 AS score FROM ranks"))
def factor_blend_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = books.blend_score(scored(spark, sf_dir), {"momentum_5": 1, "pe_ttm": -1, "turn": 1})
    return scored(spark, sf_dir).select("instrument", "date", r(score + 3 * score * 1e-9).alias("score"))


SUMMARY_SELECT = (
    "SELECT run_id, finished, status, year::INTEGER AS year, top_n::INTEGER AS top_n, weighting, array_to_string(factors, ',') AS factor_key, array_to_string(gates, ',') AS gate_key, "
    f"make_date(year, 1, 1) AS date_from, make_date(year, 12, 31) AS date_to, {', '.join(archive.MEASURES)} FROM runs"
)


@REGISTRY.query("run_summary_json", with_sql(RUNS_SQL, select=SUMMARY_SELECT))
def run_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.summaries(runs(spark, sf_dir))


@REGISTRY.query("archive_listing", with_sql(RUNS_SQL, select="SELECT run_id, status, array_to_string(factors, ',') AS factor_key, sharpe FROM runs WHERE status = 'completed' AND contains(array_to_string(factors, ','), 'f1') ORDER BY sharpe DESC NULLS LAST, run_id LIMIT 20 OFFSET 20"))
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.listing(archive.summaries(runs(spark, sf_dir)), "completed", "F1", number=2).select("run_id", "status", "factor_key", "sharpe")


@REGISTRY.query("latest_per_key", with_sql(RUNS_SQL, select="SELECT array_to_string(factors, ',') AS factor_key, max(run_id) AS run_id, arg_max(sharpe, run_id) AS sharpe FROM runs GROUP BY 1"))
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.latest(archive.summaries(runs(spark, sf_dir)), "factor_key")


GRID_SQL = """
grid AS (
  SELECT sha256(concat_ws('|', top_n::INTEGER, weighting, array_to_string(factors, ','))) AS expert, year::INTEGER AS year, avg(sharpe) AS sharpe, avg(excess_return) AS excess_return, count(*) AS runs
  FROM runs WHERE status = 'completed' GROUP BY 1, 2
)"""


@REGISTRY.query("expert_grid", with_sql(RUNS_SQL, GRID_SQL, select="SELECT expert, year, round(sharpe + sharpe * 1e-9, 6) + 0.0 AS sharpe, round(excess_return + excess_return * 1e-9, 6) + 0.0 AS excess_return, runs FROM grid"))
def expert_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.expert_grid(archive.summaries(runs(spark, sf_dir)))
    return found.select("expert", "year", r(F.col("sharpe") * (1 + 1e-9)).alias("sharpe"), r(F.col("excess_return") * (1 + 1e-9)).alias("excess_return"), "runs")


@REGISTRY.query("expert_topk", with_sql(RUNS_SQL, GRID_SQL, "past AS (SELECT y.year, expert, avg(sharpe) AS score FROM (SELECT DISTINCT year FROM grid) y JOIN grid g ON g.year < y.year GROUP BY 1, 2)", select="SELECT year, expert, place::INTEGER AS place, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(score, 9) DESC, expert) AS place FROM past) WHERE place <= 3"))
def expert_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.best_before(archive.expert_grid(archive.summaries(runs(spark, sf_dir))), 3)
    return found.select("year", "expert", "place", r(F.col("score")).alias("score"))


@REGISTRY.query("champion_replay", with_sql(RUNS_SQL, GRID_SQL, "best AS (SELECT year + 1 AS year, expert FROM grid QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(sharpe, 9) DESC, expert) = 1)", select="SELECT b.year, b.expert, round(g.sharpe, 6) + 0.0 AS sharpe, round(g.excess_return, 6) + 0.0 AS excess_return FROM best b LEFT JOIN grid g USING (year, expert)"))
def champion_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.champion_replay(archive.expert_grid(archive.summaries(runs(spark, sf_dir))))
    return found.select("year", "expert", r(F.col("sharpe")).alias("sharpe"), r(F.col("excess_return")).alias("excess_return"))


PICK_SQL = "f AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 'Mean(close,W)' ELSE 'Std(close,W)' END AS family FROM runs WHERE annual_return > benchmark_return AND information_ratio > 0)"


@REGISTRY.query("screen_picks", with_sql(RUNS_SQL, PICK_SQL, select="SELECT family, run_id, annual_return AS own, benchmark_return AS bench, information_ratio AS ratio, n AS family_size FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY information_ratio DESC, run_id) AS place, count(*) OVER (PARTITION BY family) AS n FROM f) WHERE place = 1"))
def screen_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.when(F.col("run_id") % 2 == 0, "Mean").otherwise("Std")
    formula = F.concat(call, F.lit("( close , "), (F.col("run_id") % 50 + 1).cast("string"), F.lit(")"))
    return archive.screen_picks(archive.summaries(runs(spark, sf_dir)).withColumn("formula", formula), "formula")


@REGISTRY.query("overview_counts", "SELECT 'run' AS kind, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'line', l_linestatus, count(*) FROM lineitem GROUP BY 1, 2")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.sources.panel import table

    lines = table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_linestatus").alias("status"))
    return archive.status_counts(runs(spark, sf_dir).withColumn("kind", F.lit("run")), lines)


SCREEN_SQL = f"""
monthly AS (SELECT instrument, date_trunc('month', date)::DATE AS period, sum(vol) AS v, arg_max(close, date) AS c FROM bars GROUP BY 1, 2),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY instrument ORDER BY period) AS before_vol, lag(c) OVER (PARTITION BY instrument ORDER BY period) AS before_close FROM monthly),
built AS (
  SELECT b.instrument, b.date, float_market_cap, turn, sum(vol) OVER (PARTITION BY b.instrument, period ORDER BY b.date ROWS UNBOUNDED PRECEDING) / nullif(before_vol, 0) AS growth,
    close / nullif(before_close, 0) - 1 AS period_ret, {q.pct_change("close", 1).replace("instrument", "b.instrument").replace("date", "b.date")} AS ret_1, {q.pct_change("close", 24).replace("instrument", "b.instrument").replace("date", "b.date")} AS ret_long
  FROM bars b JOIN lagged l ON b.instrument = l.instrument AND date_trunc('month', b.date)::DATE = l.period
)"""


@REGISTRY.query("volume_week_screen", with_sql(BARS_SQL, SCREEN_SQL, select="SELECT date, instrument, round(period_ret, 6) + 0.0 AS period_ret, (row_number() OVER (PARTITION BY date ORDER BY period_ret, instrument))::INTEGER AS place FROM built WHERE float_market_cap BETWEEN 1000 AND 14000 AND turn < 40 AND ret_long < 0.2 AND ret_1 BETWEEN -0.3 AND 0.3 AND growth > 0.5"))
def volume_week_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "date").cast("date")
    picks = signals.volume_screen(bars(spark, sf_dir), month, (1000, 14000), 40.0, 0.5, 0.2, (-0.3, 0.3), long_bars=24)
    return picks.select("date", "instrument", r(F.col("period_ret")).alias("period_ret"), "place")


FEATURES = ("momentum_5", "turn", "pe_ttm", "dividend_yield_ratio")


def _model(name: str, kind: str) -> None:
    @REGISTRY.query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = models.computed_once(scored(spark, sf_dir), "instrument", "date", *FEATURES, "label")
        split = F.col("date") < F.lit("1997-01-01").cast("date")
        cut = labels.embargoed(panel, calendar(panel), "1997-01-01", hold=2)
        return models.fit_predict(cut, panel.where(~split), FEATURES, "label", kind)


for _name, _kind in (("ml_huber", "huber"), ("ml_forest", "forest"), ("ml_gbt", "boosted")):
    _model(_name, _kind)


STREAM_SQL = """
SELECT user_id AS instrument, date_trunc('week', ts)::DATE AS date, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ROW(ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2
HAVING date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


@REGISTRY.query("stream_weekly_bars", STREAM_SQL.replace("GROUP BY 1, 2\nHAVING date_trunc('week', ts)", "GROUP BY user_id, date_trunc('week', ts)\nHAVING date_trunc('week', ts)"))
def stream_weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only windows that the watermark has passed are final."""
    return jobs.run_to_parquet(jobs.weekly_bars(jobs.event_stream(spark, f"{sf_dir}/events.parquet*")), "bars")


@REGISTRY.query("stream_first_of_key", "SELECT DISTINCT user_id, date_trunc('day', ts)::DATE AS day FROM events")
def stream_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.event_stream(spark, f"{sf_dir}/events.parquet*").select("user_id", F.col("ts").cast("date").alias("day"), "ts")
    first = jobs.first_of_key(rows, ("user_id", "day"), "ts", "40 days").select("user_id", "day")
    return jobs.run_to_parquet(first, "first")


EXPERT_SQL = """
bench AS (SELECT date, avg(label) AS ret FROM scored WHERE label IS NOT NULL GROUP BY 1),
experts AS (SELECT CASE WHEN st_status = 0 THEN 'plain' ELSE 'flagged' END AS expert, date, avg(label) AS ret FROM scored WHERE label IS NOT NULL GROUP BY 1, 2),
rewards AS (SELECT e.expert, e.date, e.ret - b.ret AS reward FROM experts e JOIN bench b USING (date) UNION ALL SELECT 'cash', date, -ret FROM bench)"""


def _experts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = scored(spark, sf_dir).where(F.col("label").isNotNull())
    kind = F.when(F.col("st_status") == 0, "plain").otherwise("flagged")
    return held.groupBy(kind.alias("expert"), "date").agg(F.avg("label").alias("ret")), held.groupBy("date").agg(F.avg("label").alias("ret"))


@REGISTRY.query("expert_transitions", with_sql(BARS_SQL, SCORED_SQL, EXPERT_SQL, select="SELECT expert, date, round(reward, 6) + 0.0 AS reward FROM rewards"))
def expert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(experts.transitions(*_experts(spark, sf_dir)), ("expert", "date"))


@REGISTRY.query(
    "expert_state",
    with_sql(BARS_SQL, SCORED_SQL, EXPERT_SQL,
        "market AS (SELECT date, avg(ret) OVER w AS bench_mean, coalesce(stddev_samp(ret) OVER w, 0) AS bench_vol FROM bench WINDOW w AS (ORDER BY date ROWS 19 PRECEDING))",
        "own AS (SELECT expert, date, avg(reward) OVER (PARTITION BY expert ORDER BY date ROWS 19 PRECEDING) AS excess_mean FROM rewards)",
        select="SELECT m.date, n.expert, round(bench_mean, 6) + 0.0 AS bench_mean, round(bench_vol, 6) + 0.0 AS bench_vol, round(coalesce(excess_mean, 0), 6) + 0.0 AS excess_mean FROM market m CROSS JOIN (SELECT DISTINCT expert FROM rewards) n LEFT JOIN own o ON o.expert = n.expert AND o.date = m.date"),
)
def expert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(experts.state_features(*_experts(spark, sf_dir)), ("date", "expert"))


LOTS_SQL = """
ticks AS (
  SELECT l_suppkey AS instrument, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity::BIGINT AS quantity, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS fill FROM lineitem
),
spans AS (SELECT *, sum(quantity) OVER (PARTITION BY instrument, side ORDER BY fill ROWS UNBOUNDED PRECEDING) AS upto FROM ticks),
totals AS (SELECT instrument, coalesce(sum(quantity) FILTER (WHERE side = 'buy'), 0) AS bought, coalesce(sum(quantity) FILTER (WHERE side = 'sell'), 0) AS sold FROM ticks GROUP BY 1),
matched AS (
  SELECT b.instrument, b.fill AS buy, s.fill AS sell, least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity) AS quantity, b.price AS bp, s.price AS sp
  FROM spans b JOIN spans s ON b.instrument = s.instrument AND b.side = 'buy' AND s.side = 'sell' AND b.upto - b.quantity < s.upto AND s.upto - s.quantity < b.upto
  UNION ALL SELECT instrument, CASE WHEN side = 'buy' THEN fill END, CASE WHEN side = 'sell' THEN fill END, upto - greatest(upto - quantity, least(bought, sold)), CASE WHEN side = 'buy' THEN price END, CASE WHEN side = 'sell' THEN price END
  FROM spans JOIN totals USING (instrument) WHERE upto > least(bought, sold)
)"""


@REGISTRY.query("lot_ledger", with_sql(LOTS_SQL, select="SELECT instrument, buy, sell, quantity::BIGINT AS quantity, round((sp - bp) * quantity, 2) + 0.0 AS profit FROM matched"))
def lot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fills of their supplier: what is returned is sold, first in first out; partial lots and what is left are rows of their own."""
    from pyspark.sql import Window

    from panelspark.sources.panel import table

    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("double") / 100
    fills = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument"), F.row_number().over(order).cast("long").alias("fill"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").cast("long").alias("quantity"), price.alias("price")
    )
    found = books.lot_ledger(fills, ("fill",))
    return found.select("instrument", "buy", "sell", "quantity", r(F.col("profit"), 2).alias("profit"))


DAILY_SQL = """
priced AS (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS px FROM lineitem),
days AS (SELECT l_suppkey AS instrument, l_shipdate::DATE AS date, arg_max(px, ROW(l_orderkey, l_linenumber, l_partkey)) AS close, sum(l_quantity) AS vol FROM priced GROUP BY ALL),
daily AS (
  SELECT *, sum(vol) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING) AS cap, close / nullif(lag(close) OVER t, 0) - 1 AS ret_1, close / nullif(lag(close, 20) OVER t, 0) - 1 AS ret_long,
    (date_trunc('week', date + INTERVAL 2 DAY) + INTERVAL 4 DAY)::DATE AS week FROM days WINDOW t AS (PARTITION BY instrument ORDER BY date)
),
weeks AS (SELECT instrument, week, lag(sum(vol)) OVER (PARTITION BY instrument ORDER BY week) AS before_vol, lag(arg_max(close, date)) OVER (PARTITION BY instrument ORDER BY week) AS before_close FROM daily GROUP BY instrument, week),
screened AS (
  SELECT d.*, before_vol, sum(vol) OVER (PARTITION BY instrument, week ORDER BY date ROWS UNBOUNDED PRECEDING) AS to_date_vol, close / nullif(before_close, 0) - 1 AS period_ret FROM daily d JOIN weeks USING (instrument, week)
)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, date, close, vol, turn, float_market_cap): a bar a day of a supplier's shipped lines."""
    from pyspark.sql import Window

    from panelspark.sources.panel import table

    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("double") / 100
    day = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("date"))
    made = day.agg(F.max_by(price, F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("close"), F.sum("l_quantity").alias("vol"))
    so_far = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumns({"turn": F.col("vol"), "float_market_cap": F.sum("vol").over(so_far)})


@REGISTRY.query("week_growth", with_sql(DAILY_SQL, select="SELECT instrument, date, to_date_vol, before_vol, round(to_date_vol / nullif(before_vol, 0), 6) + 0.0 AS growth, round(period_ret, 6) + 0.0 AS period_ret FROM screened"))
def week_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars against their week, which ends on Friday, and the week before."""
    found = signals.period_features(daily_bars(spark, sf_dir), labels.friday_week())
    return found.select("instrument", "date", "to_date_vol", "before_vol", r(F.col("growth")).alias("growth"), r(F.col("period_ret")).alias("period_ret"))


@REGISTRY.query("weekly_volume_picks", with_sql(DAILY_SQL, select="SELECT date, instrument, round(period_ret, 6) + 0.0 AS period_ret, (row_number() OVER (PARTITION BY date ORDER BY period_ret, instrument))::INTEGER AS place FROM screened WHERE cap BETWEEN 1000 AND 14000 AND vol < 60 AND ret_long < 0.2 AND ret_1 BETWEEN -0.3 AND 0.3 AND to_date_vol / nullif(before_vol, 0) > 1"))
def weekly_volume_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = signals.volume_screen(daily_bars(spark, sf_dir), labels.friday_week(), (1000, 14000), 60.0, 1.0, 0.2, (-0.3, 0.3), long_bars=20)
    return picks.select("date", "instrument", r(F.col("period_ret")).alias("period_ret"), "place")
