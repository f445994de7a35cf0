"""Rolling, time-series-rank and cross-section functions on the bar panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.operators.buckets import daily_quintile, label_bins
from panelspark.functions import sqltext as q
from panelspark.operators.rolling import Rolling, with_rolling
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import bars_sql, r, rounded
from panelspark.sources.panel import BARS_SQL, bars, with_sql



class Named:
    """Columns by name, made when asked for: a Column needs a running session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = Named()


def _simple(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], digits: int = 6) -> None:
    @REGISTRY.query(name, bars_sql(sql, digits=digits))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(bars(spark, sf_dir), columns(), digits=digits)


def _passed(name: str, calls, sql: dict[str, str], digits: int = 6) -> None:
    @REGISTRY.query(name, bars_sql(sql, digits=digits))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_rolling(bars(spark, sf_dir), calls())
        return rounded(found, {c: F.col(c) for c in sql}, digits=digits)


REGISTRY.query("ohlcv_bars", bars_sql({c: c for c in ("open", "high", "low", "close", "vol", "amount", "turn", "pe_ttm", "dividend_yield_ratio", "total_market_cap", "float_market_cap")}, keys=("instrument", "date", "st_status")))(
    lambda spark, sf_dir: rounded(bars(spark, sf_dir), {c: F.col(c) for c in ("open", "high", "low", "close", "vol", "amount", "turn", "pe_ttm", "dividend_yield_ratio", "total_market_cap", "float_market_cap")}, ("instrument", "date", "st_status"))
)
_simple("shift_diff", lambda: {"shift_3": w.shift(c.close, 3), "lead_2": w.shift(c.close, -2), "diff_5": w.diff(c.close, 5)}, {"shift_3": q.shift("close", 3), "lead_2": q.shift("close", -2), "diff_5": f"close - {q.shift('close', 5)}"})
_simple("pct_change", lambda: {"pct_1": w.pct_change(c.close, 1), "pct_20": w.pct_change(c.close, 20), "pct_pe": w.pct_change(c.pe_ttm, 1)}, {"pct_1": q.pct_change("close", 1), "pct_20": q.pct_change("close", 20), "pct_pe": q.pct_change("pe_ttm", 1)})
_simple("rolling_mean_std", lambda: {"mean_5": w.rolling_mean(c.close, 5), "mean_20_pe": w.rolling_mean(c.pe_ttm, 20), "std_10": w.rolling_std(c.close, 10)}, {"mean_5": q.mean("close", 5), "mean_20_pe": q.mean("pe_ttm", 20), "std_10": q.std("close", 10)})
_simple("rolling_max_min_sum", lambda: {"max_10": w.rolling_max(c.close, 10), "min_10": w.rolling_min(c.close, 10), "sum_5": w.rolling_sum(c.vol, 5)}, {"max_10": q.most("close", 10), "min_10": q.least("close", 10), "sum_5": q.total("vol", 5)})
_passed("ts_rank", lambda: {"rank_10": Rolling("ts_rank", c.close, 10), "rank_5_pe": Rolling("ts_rank", c.pe_ttm, 5), "rank_5_st": Rolling("ts_rank", c.st_status, 5)}, {"rank_10": q.ts_rank("close", 10), "rank_5_pe": q.ts_rank("pe_ttm", 5), "rank_5_st": q.ts_rank("st_status", 5)})
_simple("ts_zscore_bias", lambda: {"zscore_20": w.ts_zscore(c.close, 20), "bias_20": w.rolling_bias(c.close, 20)}, {"zscore_20": q.zscore("close", 20), "bias_20": q.bias("close", 20)}, 5)
_simple("rolling_corr_cov", lambda: {"corr_10": w.rolling_corr(c.close, c.vol, 10), "cov_10": w.rolling_cov(c.close, c.vol, 10), "corr_zero_10": w.rolling_corr_zero(c.close, c.st_status, 10)}, {"corr_10": q.corr("close", "vol", 10), "cov_10": q.cov("close", "vol", 10), "corr_zero_10": q.corr_zero("close", "st_status", 10)}, 4)
_passed("rolling_quantiles", lambda: {"q80_20": Rolling("rolling_quantile", c.close, 20, q=0.8), "q20_10": Rolling("rolling_quantile", c.close, 10, q=0.2), "share_10": Rolling("rolling_rank_share", c.close, 10)}, {"q80_20": q.quantile("close", 20, 0.8), "q20_10": q.quantile("close", 10, 0.2), "share_10": q.rank_share("close", 10)})
_passed("bars_since_extreme", lambda: {"since_max": Rolling("bars_since_max", c.close, 20), "since_min": Rolling("bars_since_min", c.close, 20), "since_max_st": Rolling("bars_since_max", c.st_status, 5)}, {"since_max": q.since("close", 20, "max"), "since_min": q.since("close", 20, "min"), "since_max_st": q.since("st_status", 5, "max")})
_simple("cs_rank", lambda: {"rank_close": w.cs_rank(c.close), "rank_pe": w.cs_rank(c.pe_ttm), "rank_st": w.cs_rank(c.st_status)}, {"rank_close": q.cs_rank("close"), "rank_pe": q.cs_rank("pe_ttm"), "rank_st": q.cs_rank("st_status")})
_simple("daily_zscore", lambda: {"z_close": w.cs_zscore(c.close), "z_pe": w.cs_zscore(c.pe_ttm)}, {"z_close": q.div("close - avg(close) OVER (PARTITION BY date)", "stddev_samp(close) OVER (PARTITION BY date)"), "z_pe": q.div("pe_ttm - avg(pe_ttm) OVER (PARTITION BY date)", "stddev_samp(pe_ttm) OVER (PARTITION BY date)")}, 5)

T_SQL = f"timed AS (SELECT *, (row_number() OVER ({q.BY_TIME}))::DOUBLE AS t FROM bars)"


@REGISTRY.query("rolling_ols", bars_sql({"slope_10": q.slope("close", 10), "r2_10": q.rsquare("close", 10), "resi_10": q.residual("close", 10), "r2_st": q.rsquare("st_status", 5)}, T_SQL, source="timed", digits=4))
def rolling_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = {"slope_10": Rolling("ols_slope", c.close, 10), "r2_10": Rolling("ols_rsquare", c.close, 10), "resi_10": Rolling("ols_residual", c.close, 10), "r2_st": Rolling("ols_rsquare", c.st_status, 5)}
    return rounded(with_rolling(bars(spark, sf_dir), calls), {name: F.col(name) for name in calls}, digits=4)


_passed("rolling_long", lambda: {
    "rank_252": Rolling("ts_rank", c.close, 252), "q80_252": Rolling("rolling_quantile", c.close, 252, q=0.8), "since_252": Rolling("bars_since_max", c.high, 252), "mean_252": Rolling("rolling_mean", c.close, 252),
    "std_252": Rolling("rolling_std", c.close, 252), "max_252": Rolling("rolling_max", c.high, 252), "min_120": Rolling("rolling_min", c.low, 120), "sum_120": Rolling("rolling_sum", c.vol, 120),
    "corr_120": Rolling("rolling_corr", c.close, 120, c.vol), "cov_120": Rolling("rolling_cov", c.close / 1000, 120, c.vol), "corr_pe": Rolling("rolling_corr_zero", c.close, 120, c.st_status),
}, {
    "rank_252": q.ts_rank("close", 252), "q80_252": q.quantile("close", 252, 0.8), "since_252": q.since("high", 252, "max"), "mean_252": q.mean("close", 252), "std_252": q.std("close", 252), "max_252": q.most("high", 252),
    "min_120": q.least("low", 120), "sum_120": q.total("vol", 120), "corr_120": q.corr("close", "vol", 120), "cov_120": q.cov("(close / 1000)", "vol", 120), "corr_pe": q.corr_zero("close", "st_status", 120),
}, 4)


@REGISTRY.query("masked_cs_rank", bars_sql({"rank_in_pool": q.cs_rank("pooled"), "median_in_pool": "quantile_cont(pooled, 0.5) OVER (PARTITION BY date)"}, "masked AS (SELECT *, CASE WHEN st_status = 0 THEN close END AS pooled FROM bars)", source="masked"))
def masked_cs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = c.st_status == 0
    panel = bars(spark, sf_dir)
    middle = panel.groupBy("date").agg(F.percentile(F.when(pool, c.close), F.lit(0.5)).alias("middle"))
    return rounded(panel.join(middle, "date"), {"rank_in_pool": w.cs_rank(c.close, pool), "median_in_pool": F.col("middle")})


QUINTILE_SQL = """
edges AS (
  SELECT date, list_sort(list_distinct(quantile_cont(close, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM bars GROUP BY 1 HAVING count(close) >= 5
),
bucketed AS (
  SELECT b.*, CASE WHEN len(e) > 1 THEN greatest(len(list_filter(e, lambda v: v < close)) - 1, 0) + 1 END AS bucket FROM bars b LEFT JOIN edges USING (date)
)"""


@REGISTRY.query("daily_quintile", with_sql(BARS_SQL, QUINTILE_SQL, select="SELECT instrument, date, bucket::INTEGER AS bucket FROM bucketed"))
def daily_quintile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_quintile(bars(spark, sf_dir), "close").select("instrument", "date", "bucket")


LABEL_SQL = f"labelled AS (SELECT *, {q.div(q.shift('close', -2), q.shift('open', -1))} - 1 AS label FROM bars)"


@REGISTRY.query("forward_label", bars_sql({"label": q.div(q.shift("close", -2), q.shift("open", -1)) + " - 1", "next_close": q.div(q.shift("close", -1), "close") + " - 1", "masked": f"CASE WHEN {q.shift('high', -1)} <> {q.shift('low', -1)} THEN {q.div(q.shift('close', -2), q.shift('open', -1))} - 1 END"}))
def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = w.div(w.shift(c.close, -2), w.shift(c.open, -1)) - 1
    one_price = w.shift(c.high, -1) != w.shift(c.low, -1)
    return rounded(bars(spark, sf_dir), {"label": label, "next_close": w.div(w.shift(c.close, -1), c.close) - 1, "masked": F.when(one_price, label)})


BINS_SQL = """
label_edges AS (
  SELECT date, quantile_cont(label, 0.01) AS lowest, quantile_cont(label, 0.99) AS highest FROM labelled GROUP BY 1
),
clipped AS (SELECT l.*, CASE WHEN label IS NOT NULL THEN least(greatest(label, lowest), highest) END AS kept FROM labelled l JOIN label_edges USING (date)),
bin_edges AS (SELECT date, quantile_cont(kept, [0.05 * i for i in range(1, 20)]) AS e FROM clipped GROUP BY 1)
"""


@REGISTRY.query("label_bins20", with_sql(BARS_SQL, LABEL_SQL, BINS_SQL, select="SELECT instrument, date, len(list_filter(e, lambda v: v < kept))::INTEGER AS bin FROM clipped JOIN bin_edges USING (date) WHERE kept IS NOT NULL"))
def label_bins20(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = w.div(w.shift(c.close, -2), w.shift(c.open, -1)) - 1
    return label_bins(bars(spark, sf_dir).withColumn("label", label), "label").select("instrument", "date", "bin")


WEEK_SQL = f"""
monthly AS (
  SELECT instrument, date_trunc('month', date)::DATE AS period, sum(vol) AS period_vol, arg_max(close, date) AS period_close FROM bars GROUP BY 1, 2
),
lagged AS (
  SELECT *, lag(period_vol) OVER (PARTITION BY instrument ORDER BY period) AS before_vol, lag(period_close) OVER (PARTITION BY instrument ORDER BY period) AS before_close FROM monthly
)"""


@REGISTRY.query(
    "week_features",
    with_sql(BARS_SQL, WEEK_SQL, select="""
SELECT b.instrument, b.date, sum(vol) OVER (PARTITION BY b.instrument, period ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS to_date_vol, before_vol,
  round(sum(vol) OVER (PARTITION BY b.instrument, period ORDER BY b.date ROWS UNBOUNDED PRECEDING) / nullif(before_vol, 0), 6) + 0.0 AS growth,
  round(close / nullif(before_close, 0) - 1, 6) + 0.0 AS period_ret
FROM bars b JOIN lagged l ON b.instrument = l.instrument AND date_trunc('month', b.date)::DATE = l.period"""),
)
def week_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period-to-date volume, the previous period's volume and close, growth and return (periods of the weekly panel are months)."""
    from panelspark.operators.signals import period_features

    return period_features(bars(spark, sf_dir), F.date_trunc("month", "date").cast("date")).select("instrument", "date", "to_date_vol", "before_vol", r(F.col("growth")).alias("growth"), r(F.col("period_ret")).alias("period_ret"))
