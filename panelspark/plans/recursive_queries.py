"""Exponential indicators against recursive SQL, and parts of the catalogues against SQL that is written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import sqltext as q
from panelspark.functions import window as w
from panelspark.functions.catalog import alpha158, alpha191, pack
from panelspark.functions.series import Stages
from panelspark.operators import models, signals, universe
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.plans.diagnostic_queries import SCORED_SQL, scored
from panelspark.plans.factor_queries import base_sleeves
from panelspark.sources.panel import BARS_SQL, MEMBERSHIP_SQL, bars, calendar, membership, with_sql

EWM_SQL = """
seq AS (SELECT instrument, date, close, row_number() OVER (PARTITION BY instrument ORDER BY date) AS n FROM bars),
run(instrument, n, date, close, e20, e60, e12, e26, dea, gain, loss) AS (
  SELECT instrument, n, date, close, close, close, close, close, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM seq WHERE n = 1
  UNION ALL
  SELECT s.instrument, s.n, s.date, s.close, e20 * 19 / 21 + s.close * 2 / 21, e60 * 59 / 61 + s.close * 2 / 61, e12 * 11 / 13 + s.close * 2 / 13, e26 * 25 / 27 + s.close * 2 / 27,
    dea * 0.8 + 0.2 * ((e12 * 11 / 13 + s.close * 2 / 13) - (e26 * 25 / 27 + s.close * 2 / 27)),
    CASE WHEN gain IS NULL THEN greatest(s.close - r.close, 0) ELSE gain * 13 / 14 + greatest(s.close - r.close, 0) / 14 END,
    CASE WHEN loss IS NULL THEN greatest(r.close - s.close, 0) ELSE loss * 13 / 14 + greatest(r.close - s.close, 0) / 14 END
  FROM run r JOIN seq s ON s.instrument = r.instrument AND s.n = r.n + 1
),
ewm AS (
  SELECT instrument, date, n, close, e20 AS ema_20, e60 AS ema_60, e12 - e26 AS dif, dea, 2 * (e12 - e26 - dea) AS macd_hist,
    CASE WHEN gain IS NULL THEN NULL WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14 FROM run
)"""
INDICATORS = ("ema_20", "ema_60", "dif", "dea", "macd_hist", "rsi_14")


def _recursive(*parts: str, select: str) -> str:
    return with_sql(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


@REGISTRY.query("ewm_indicators", _recursive(BARS_SQL, EWM_SQL, select="SELECT instrument, date, " + ", ".join(f"round({x}, 4) + 0.0 AS {x}" for x in INDICATORS) + " FROM ewm"))
def ewm_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.exponential_indicators(bars(spark, sf_dir))
    return found.select("instrument", "date", *[r(F.col(x), 4).alias(x) for x in INDICATORS])


@REGISTRY.query("ewm_mean", _recursive(BARS_SQL, EWM_SQL, select="SELECT instrument, date, CASE WHEN n >= 20 THEN round(ema_20, 5) END AS ewm_20 FROM ewm"))
def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.ewm_mean(bars(spark, sf_dir), "close", 20, "ewm_20").select("instrument", "date", r(F.col("ewm_20"), 5).alias("ewm_20"))


TREND_SQL = f"""
built AS (
  SELECT e.*, b.st_status, avg(e.close) OVER w AS mid, count(*) OVER w AS seen, e.close / nullif(lag(e.close, 20) OVER (PARTITION BY instrument ORDER BY date), 0) - 1 AS mom_20
  FROM ewm e JOIN bars b USING (instrument, date) WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS 19 PRECEDING)
),
passed AS (SELECT * FROM built WHERE st_status = 0 AND n > 60 AND ema_20 > ema_60 AND dif > dea AND macd_hist > 0 AND rsi_14 BETWEEN 40 AND 72 AND close > mid AND seen = 20),
ranked AS (SELECT *, 0.40 * {q.cs_rank("macd_hist")} + 0.35 * {q.cs_rank("mom_20")} + 0.25 * {q.cs_rank("rsi_14")} AS rank_score FROM passed)"""


@REGISTRY.query("trend_signal", _recursive(BARS_SQL, EWM_SQL, TREND_SQL, select="SELECT date, instrument, round(rank_score, 6) AS rank_score, 0.1::DOUBLE AS weight FROM ranked QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(rank_score, 9) DESC, instrument) <= 10"))
def trend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.trend_signal(bars(spark, sf_dir)).select("date", "instrument", r(F.col("rank_score")).alias("rank_score"), "weight")


MEMBER_TREND_SQL = TREND_SQL.replace(
    "passed AS (SELECT * FROM built WHERE",
    "chosen AS (SELECT c.date, m.con_code AS instrument FROM (SELECT d.date, max(m.snapshot) AS snapshot FROM (SELECT DISTINCT date FROM bars) d JOIN (SELECT DISTINCT snapshot FROM membership) m ON m.snapshot <= d.date GROUP BY 1) c JOIN membership m USING (snapshot)),\n"
    "passed AS (SELECT * FROM built WHERE (date, instrument) IN (SELECT (date, instrument) FROM chosen) AND instrument % 10 <> 3 AND amount >= 60000 AND",
).replace("b.st_status,", "b.st_status, b.amount,")


@REGISTRY.query("trend_signal_members", _recursive(BARS_SQL, EWM_SQL, MEMBERSHIP_SQL, MEMBER_TREND_SQL, select="SELECT date, instrument, round(rank_score, 6) AS rank_score, 0.1::DOUBLE AS weight FROM ranked QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(rank_score, 9) DESC, instrument) <= 10"))
def trend_signal_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend rules among the members as of each date, without one board, from an amount on."""
    panel = bars(spark, sf_dir)
    members = universe.members_pooled(panel, calendar(panel), membership(spark, sf_dir))
    picks = signals.trend_signal(panel, members=members, board=F.col("instrument") % 10 != 3, least_amount=60_000.0)
    return picks.select("date", "instrument", r(F.col("rank_score")).alias("rank_score"), "weight")


OLS_SQL = """
held AS (SELECT momentum_5 AS x, label AS y FROM scored WHERE momentum_5 IS NOT NULL AND label IS NOT NULL AND date < DATE '1996-01-01'),
told AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx FROM held)"""


def _line(name: str, kind: str, slope: str, **settings) -> None:
    @REGISTRY.query(name, with_sql(BARS_SQL, SCORED_SQL, OLS_SQL, select=f"SELECT 'momentum_5' AS feature, round({slope}, 6) + 0.0 AS value FROM told UNION ALL SELECT 'intercept', round(my - mx * ({slope}), 6) + 0.0 FROM told"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = scored(spark, sf_dir).where(F.col("date") < F.lit("1996-01-01").cast("date"))
        found = models.coefficients(panel, ("momentum_5",), "label", kind, **settings)
        return found.select("feature", r(F.col("value")).alias("value"))


# One feature has a closed form: least squares, with a penalty of alpha over all rows (ridge), and with a soft threshold (lasso).
_line("ols_line", "ols", "cxy / vx")
_line("ridge_line", "ridge", "n * cxy / (n * vx + 500000)", alpha=500_000.0)
_line("lasso_line", "lasso", "sign(cxy) * greatest(abs(cxy) - 0.3, 0) / vx", alpha=0.3)
_line("elastic_net_line", "elastic_net", "sign(cxy) * greatest(abs(cxy) - 0.3 * 0.4, 0) / (vx + 0.3 * 0.6)", alpha=0.3, l1_share=0.4)


def _by_hand(name: str, formulas, columns: dict[str, str], *parts: str, source: str, digits: int = 4, timed: bool = False) -> None:
    """Some columns of a catalogue against SQL that does not come from its formulas."""
    chosen = ", ".join(f"(round(({x}) + ({x}) * 1e-9, {digits}) + 0.0) AS {c}" for c, x in columns.items())

    @REGISTRY.query(name, with_sql(BARS_SQL, *parts, select=f"SELECT instrument, date, {chosen} FROM {source}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stages = Stages()
        found = formulas(stages)
        panel = bars(spark, sf_dir)
        if timed:
            panel = panel.withColumn("t", F.row_number().over(w.by_time()).cast("double"))
        return stages.frame(panel, {c: found[c] for c in columns}, digits=digits)


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER (PARTITION BY instrument ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN {value} END"


def _over(function: str, n: int) -> str:
    return f"{function} OVER (PARTITION BY instrument ORDER BY date ROWS {n - 1} PRECEDING)"


LAGGED_SQL = """
lagged AS (
  SELECT *, lag(close) OVER t AS c1, lag(vol) OVER t AS v1, lag(close, 5) OVER t AS c5, lag(close, 10) OVER t AS c10, lag(close, 20) OVER t AS c20, lag(close, 60) OVER t AS c60,
    lag(open) OVER t AS o1, lag(high) OVER t AS h1, lag(low) OVER t AS l1, row_number() OVER t AS n_ FROM bars WINDOW t AS (PARTITION BY instrument ORDER BY date)
),
moved AS (
  SELECT *, close - c1 AS dc, vol - v1 AS dv, CASE WHEN c1 IS NOT NULL THEN CASE WHEN close > c1 THEN 1.0 ELSE 0.0 END END AS up_, CASE WHEN c1 IS NOT NULL THEN CASE WHEN close < c1 THEN 1.0 ELSE 0.0 END END AS down_,
    abs(close / nullif(c1, 0) - 1) * vol AS weighted, close / nullif(c1, 0) - 1 AS ret FROM lagged
)"""
FLOW_COLUMNS: dict[str, str] = {}
for _n in alpha158.WINDOWS:
    FLOW_COLUMNS |= {
        f"CNTP{_n}": _full("up_", _n, _over("avg(up_)", _n)), f"CNTN{_n}": _full("down_", _n, _over("avg(down_)", _n)),
        f"CNTD{_n}": _full("up_", _n, f"{_over('avg(up_)', _n)} - {_over('avg(down_)', _n)}"),
        f"SUMP{_n}": _full("dc", _n, f"{_over('sum(greatest(dc, 0))', _n)} / ({_over('sum(abs(dc))', _n)} + 1e-12)"),
        f"SUMN{_n}": _full("dc", _n, f"{_over('sum(greatest(-dc, 0))', _n)} / ({_over('sum(abs(dc))', _n)} + 1e-12)"),
        f"VSUMP{_n}": _full("dv", _n, f"{_over('sum(greatest(dv, 0))', _n)} / ({_over('sum(abs(dv))', _n)} + 1e-12)"),
        f"VMA{_n}": _full("vol", _n, f"{_over('avg(vol)', _n)} / (vol + 1e-12)"), f"VSTD{_n}": _full("vol", _n, f"{_over('stddev_samp(vol)', _n)} / (vol + 1e-12)"),
        f"WVMA{_n}": _full("weighted", _n, f"{_over('stddev_samp(weighted)', _n)} / ({_over('avg(weighted)', _n)} + 1e-12)"),
    }
_by_hand("alpha158_by_hand", lambda s: {k: x for n in alpha158.WINDOWS for k, x in alpha158.flow(s, n).items()}, FLOW_COLUMNS, LAGGED_SQL, source="moved")

TREND_COLUMNS: dict[str, str] = {}
for _n in (5, 20):
    TREND_COLUMNS |= {
        f"MA{_n}": _full("close", _n, f"{_over('avg(close)', _n)} / close"), f"STD{_n}": _full("close", _n, f"{_over('stddev_samp(close)', _n)} / close"), f"ROC{_n}": f"c{_n} / close",
        f"MAX{_n}": _full("high", _n, f"{_over('max(high)', _n)} / close"), f"MIN{_n}": _full("low", _n, f"{_over('min(low)', _n)} / close"),
        f"RSV{_n}": _full("high", _n, f"(close - {_over('min(low)', _n)}) / ({_over('max(high)', _n)} - {_over('min(low)', _n)} + 1e-12)"),
        f"BETA{_n}": _full("close", _n, f"{_over('covar_samp(close, n_)', _n)} / ({_n} * ({_n} + 1) / 12.0) / close"),
        f"QTLU{_n}": _full("close", _n, f"{_over('quantile_cont(close, 0.8)', _n)} / close"),
    }
_by_hand("alpha158_trend_by_hand", lambda s: {k: x for n in alpha158.WINDOWS for k, x in alpha158.trend(s, n).items()}, TREND_COLUMNS, LAGGED_SQL, source="moved", timed=True)

PACK_COLUMNS = {
    "momentum_1": "close / nullif(c1, 0) - 1", "reversal_5": "1 - close / nullif(c5, 0)", "momentum_10": "close / nullif(c10, 0) - 1", "momentum_20": "close / nullif(c20, 0) - 1",
    "momentum_60": "close / nullif(c60, 0) - 1", "close_bias_20": _full("close", 20, f"close / {_over('avg(close)', 20)} - 1"), "close_bias_60": _full("close", 60, f"close / {_over('avg(close)', 60)} - 1"),
    "ma_ratio_20_60": _full("close", 60, f"{_over('avg(close)', 20)} / {_over('avg(close)', 60)} - 1"), "close_zscore_20": _full("close", 20, f"(close - {_over('avg(close)', 20)}) / nullif({_over('stddev_samp(close)', 20)}, 0)"),
    "dist_high_60": _full("high", 60, f"close / {_over('max(high)', 60)} - 1"), "amount_ratio_5": _full("amount", 5, f"amount / {_over('avg(amount)', 5)}"), "vol_mean_20": _full("vol", 20, _over("avg(vol)", 20)),
    "volatility_10": _full("ret", 10, _over("stddev_samp(ret)", 10)), "volatility_20": _full("ret", 20, _over("stddev_samp(ret)", 20)), "intraday_range": "(high - low) / close", "overnight_ret": "open / nullif(c1, 0) - 1",
    "close_location": "(close - low) / nullif(high - low, 0)", "trade_vwap": "amount / nullif(vol, 0)",
}
_by_hand("pack_by_hand", pack.canonical, PACK_COLUMNS, LAGGED_SQL, source="moved")

ALPHA191_COLUMNS = {
    "alpha191_014": "close - c5", "alpha191_015": "open / nullif(c1, 0) - 1", "alpha191_018": "close / nullif(c5, 0)", "alpha191_031": _full("close", 12, f"(close - {_over('avg(close)', 12)}) / {_over('avg(close)', 12)} * 100"),
    "alpha191_034": _full("close", 12, f"{_over('avg(close)', 12)} / close"), "alpha191_046": _full("close", 24, f"({_over('avg(close)', 3)} + {_over('avg(close)', 6)} + {_over('avg(close)', 12)} + {_over('avg(close)', 24)}) / (4 * close)"),
    "alpha191_065": _full("close", 6, f"{_over('avg(close)', 6)} / close"), "alpha191_070": _full("amount", 6, _over("stddev_samp(amount)", 6)), "alpha191_088": "(close - c20) / nullif(c20, 0) * 100",
    "alpha191_097": _full("vol", 10, _over("stddev_samp(vol)", 10)), "alpha191_106": "close - c20", "alpha191_118": _full("high", 20, f"{_over('sum(high - open)', 20)} / nullif({_over('sum(open - low)', 20)}, 0) * 100"),
    "alpha191_126": "(close + high + low) / 3", "alpha191_145": _full("vol", 26, f"({_over('avg(vol)', 9)} - {_over('avg(vol)', 26)}) / {_over('avg(vol)', 12)} * 100"), "alpha191_150": "(close + high + low) / 3 * vol",
    "alpha191_168": _full("vol", 20, f"-vol / {_over('avg(vol)', 20)}"), "alpha191_178": "(close - c1) / nullif(c1, 0) * vol",
}
_by_hand("alpha191_by_hand", alpha191.price_alphas, ALPHA191_COLUMNS, LAGGED_SQL, source="moved")

def _ranked(x: str) -> str:
    """The average rank within a date over the count: the mean of the ranks from below and from above."""
    up, down, count = (f"{f} OVER (PARTITION BY date{order})" for f, order in (("rank()", f" ORDER BY {x} NULLS LAST"), ("rank()", f" ORDER BY {x} DESC NULLS LAST"), (f"count({x})", "")))
    return f"CASE WHEN {x} IS NOT NULL THEN ({up} + {count} + 1 - {down}) / 2 / {count} END"


SLEEVE_LEGS = {"size": "total_market_cap", "yield_": "dividend_yield_ratio", "move20": "move_", "turn_": "turn", "span": "span_"}
SLEEVE_SQL = f"legs AS (SELECT instrument, date, high60, {', '.join(f'{_ranked(x)} AS {name}' for name, x in SLEEVE_LEGS.items())} FROM (SELECT *, close / nullif(c20, 0) - 1 AS move_, (high - low) / close AS span_, h60.high60 FROM moved LEFT JOIN h60 USING (instrument, date)))"
#: The rank of a close among its last 60, by a join with them.
HIGH_SQL = """h60 AS (
  SELECT a.instrument, a.date, CASE WHEN count(*) = 60 THEN (sum((b.close < a.close)::INTEGER) + (sum((b.close = a.close)::INTEGER) + 1) / 2.0) / 60 END AS high60
  FROM moved a JOIN moved b ON a.instrument = b.instrument AND b.n_ BETWEEN a.n_ - 59 AND a.n_ GROUP BY ALL
)"""
SLEEVE_COLUMNS = {
    "sum_size_yield": "size + yield_", "sum_yield_move20": "yield_ + move20", "sum_size_move20_turn": "size + move20 + turn_", "sum_size_high60": "size + high60", "sum_yield_high60_turn": "yield_ + high60 + turn_",
}
_by_hand("sleeves_by_hand", base_sleeves, SLEEVE_COLUMNS, LAGGED_SQL, HIGH_SQL, SLEEVE_SQL, source="legs")


def _pearson(x: str, y: str, n: int) -> str:
    """By sums of products over the frame, known where all pairs are and neither side is constant up to rounding."""
    both = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    steady = " OR ".join(f"{_over(f'stddev_samp({z})', n)} <= 1e-9 * abs({_over(f'avg({z})', n)})" for z in (x, y))
    return f"CASE WHEN {_over(f'count({both})', n)} < {n} OR {steady} THEN NULL ELSE {_over(f'covar_pop({x}, {y})', n)} / ({_over(f'stddev_pop({x})', n)} * {_over(f'stddev_pop({y})', n)}) END"


_PLACE = f"(close - {_over('min(low)', 12)}) / nullif({_over('max(high)', 12)} - {_over('min(low)', 12)}, 0)"
#: Parts first, then ranks of them, then correlations of ranks: each a projection of its own.
CORR_PARTS_SQL = f"""
parts AS (
  SELECT *, amount / nullif(vol, 0) AS vwap, {_full('vol', 20, _over('avg(vol)', 20))} AS v20, {_full('close', 7, _over('avg(close)', 7))} AS c7, {_full('high', 12, _PLACE)} AS place,
    {_full('high', 10, _over('stddev_samp(high)', 10))} AS sd_high, {_full('close', 20, _over('stddev_samp(close)', 20))} AS sd_close, ret - lag(ret, 3) OVER (PARTITION BY instrument ORDER BY date) AS ret_3 FROM moved
),
ranks AS (SELECT *, {', '.join(f'{_ranked(x)} AS r_{name}' for name, x in (('open', 'open'), ('vol', 'vol'), ('place', 'place'), ('sd_high', 'sd_high'), ('sd_close', 'sd_close'), ('ret_3', 'ret_3')))} FROM parts),
tied AS (SELECT *, {_pearson('high', 'vol', 5)} AS hv, {_pearson('open', 'vol', 10)} AS ov, {_pearson('high', 'vol', 10)} AS hv10 FROM ranks)"""
CORR_COLUMNS = {
    "alpha191_026": f"(c7 - close) + {_pearson('vwap', 'c5', 230)}", "alpha191_042": "-r_sd_high * hv10", "alpha191_062": f"-({_pearson('high', 'r_vol', 5)})",
    "alpha191_104": "-(hv - lag(hv, 5) OVER (PARTITION BY instrument ORDER BY date)) * r_sd_close", "alpha191_105": f"-({_pearson('r_open', 'r_vol', 10)})", "alpha191_136": "-r_ret_3 * ov",
    "alpha191_139": "-ov", "alpha191_176": _pearson("r_place", "r_vol", 6), "alpha191_191": f"{_pearson('v20', 'low', 5)} + (high + low) / 2 - close",
}
_by_hand("alpha191_corr_by_hand", alpha191.correlation_alphas, CORR_COLUMNS, LAGGED_SQL, CORR_PARTS_SQL, source="tied")

REST_COLUMNS = {f"{name}{n}": x for n in (5, 60) for name, x in {
    "SUMD": _full("dc", n, f"({_over('sum(greatest(dc, 0))', n)} - {_over('sum(greatest(-dc, 0))', n)}) / ({_over('sum(abs(dc))', n)} + 1e-12)"),
    "VSUMN": _full("dv", n, f"{_over('sum(greatest(-dv, 0))', n)} / ({_over('sum(abs(dv))', n)} + 1e-12)"),
    "VSUMD": _full("dv", n, f"({_over('sum(greatest(dv, 0))', n)} - {_over('sum(greatest(-dv, 0))', n)}) / ({_over('sum(abs(dv))', n)} + 1e-12)"),
    "CORR": f"CASE WHEN {_over('count(close)', n)} = {n} THEN coalesce({_pearson('close', 'log_vol', n)}, 0.0) END",
    "CORD": f"CASE WHEN {_over('count(c_step)', n)} = {n} THEN coalesce({_pearson('c_step', 'v_step', n)}, 0.0) END",
}.items()}
STEPS_SQL = "steps AS (SELECT *, ln(vol + 1) AS log_vol, close / nullif(c1, 0) AS c_step, ln(vol / nullif(v1, 0) + 1) AS v_step FROM moved)"
_by_hand("alpha158_flow_by_hand", lambda s: {k: x for n in (5, 60) for k, x in alpha158.flow(s, n).items()}, REST_COLUMNS, LAGGED_SQL, STEPS_SQL, source="steps")
