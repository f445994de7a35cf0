"""Diagnostics of five-bar momentum against the forward label, on the bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.operators import diagnostics as d
from panelspark.functions import sqltext as q
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.sources.panel import BARS_SQL, bars, with_sql


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with momentum_5 and label."""
    label = w.div(w.shift(F.col("close"), -2), w.shift(F.col("open"), -1)) - 1
    return bars(spark, sf_dir).withColumns({"momentum_5": w.pct_change(F.col("close"), 5), "label": label})


SCORED_SQL = f"""
scored AS (
  SELECT *, {q.pct_change("close", 5)} AS momentum_5, {q.div(q.shift("close", -2), q.shift("open", -1))} - 1 AS label FROM bars
)"""
IC_SQL = """
pairs AS (SELECT * FROM scored WHERE momentum_5 IS NOT NULL AND label IS NOT NULL),
ranked AS (
  SELECT date, rank() OVER (PARTITION BY date ORDER BY momentum_5) + (count(*) OVER (PARTITION BY date, momentum_5) - 1) / 2 AS f,
    rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2 AS o FROM pairs
),
daily AS (SELECT date, count(*) AS names, covar_pop(f, o) / nullif(stddev_pop(f) * stddev_pop(o), 0) AS ic FROM ranked GROUP BY 1 HAVING count(*) >= 3),
ic AS (SELECT * FROM daily WHERE ic IS NOT NULL)"""
SUMMARY_SQL = """round(avg(ic), 6) + 0.0 AS ic_mean, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS ic_positive,
  CASE WHEN count(*) > 1 THEN round(stddev_pop(ic), 6) END AS ic_std, CASE WHEN count(*) > 1 THEN round(avg(ic) / nullif(stddev_pop(ic), 0), 5) + 0.0 END AS icir, count(*) AS days"""


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r(F.col("ic_mean")).alias("ic_mean"), r(F.col("ic_positive")).alias("ic_positive"), r(F.col("ic_std")).alias("ic_std"), r(F.col("icir"), 5).alias("icir"), "days")


@REGISTRY.query("ic_summary", with_sql(BARS_SQL, SCORED_SQL, IC_SQL, select=f"SELECT {SUMMARY_SQL} FROM ic"))
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(d.ic_summary(d.daily_ic(scored(spark, sf_dir), "momentum_5", "label")))


@REGISTRY.query("daily_rank_ic", with_sql(BARS_SQL, SCORED_SQL, IC_SQL, select="SELECT date, names, round(ic, 6) + 0.0 AS ic FROM ic"))
def daily_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.daily_ic(scored(spark, sf_dir), "momentum_5", "label").select("date", "names", r(F.col("ic")).alias("ic"))


STATS_SQL = """
SELECT count(*) AS rows, count(x) AS values, round(count(x) / count(*), 6) AS coverage, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max,
  round(skewness(x), 4) AS skew, round(kurtosis(x), 3) AS kurtosis, round(quantile_cont(x, 0.01), 6) + 0.0 AS p1, round(quantile_cont(x, 0.05), 6) + 0.0 AS p5, round(quantile_cont(x, 0.25), 6) + 0.0 AS p25,
  round(quantile_cont(x, 0.5), 6) + 0.0 AS p50, round(quantile_cont(x, 0.75), 6) + 0.0 AS p75, round(quantile_cont(x, 0.95), 6) + 0.0 AS p95, round(quantile_cont(x, 0.99), 6) + 0.0 AS p99
FROM (SELECT momentum_5 AS x FROM scored)"""


@REGISTRY.query("factor_stats", with_sql(BARS_SQL, SCORED_SQL, select=STATS_SQL))
def factor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = d.distribution(scored(spark, sf_dir), "momentum_5")
    digits = {"skew": 4, "kurtosis": 3}
    return stats.select("rows", "values", *[r(F.col(c), digits.get(c, 6)).alias(c) for c in stats.columns if c not in ("rows", "values")])


@REGISTRY.query("factor_signs", with_sql(BARS_SQL, SCORED_SQL, select="SELECT count(*) FILTER (WHERE momentum_5 IS NULL) AS missing, count(*) FILTER (WHERE momentum_5 = 0) AS zero, count(*) FILTER (WHERE momentum_5 < 0) AS negative, count(*) FILTER (WHERE momentum_5 > 0) AS positive, round(min(momentum_5), 6) AS min, round(max(momentum_5), 6) AS max FROM scored"))
def factor_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.signs(scored(spark, sf_dir), "momentum_5").withColumns({"min": r(F.col("min")), "max": r(F.col("max"))})


@REGISTRY.query("cross_section_counts", with_sql(BARS_SQL, SCORED_SQL, select="SELECT date, count(*) AS rows, count(momentum_5) AS values FROM scored GROUP BY 1"))
def cross_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("date").agg(F.count("*").alias("rows"), F.count("momentum_5").alias("values"))


HIST_SQL = """
ends AS (SELECT quantile_cont(amount, 0.01) AS a, quantile_cont(amount, 0.99) AS b FROM bars),
counted AS (
  SELECT CASE WHEN amount < a THEN -1 WHEN amount > b THEN 60 ELSE least(floor((ln(amount) - ln(a)) / (ln(b) - ln(a)) * 60), 59) END::INTEGER AS bin, count(*) AS n FROM bars, ends GROUP BY 1
)"""


@REGISTRY.query("histogram_p1_p99", with_sql(BARS_SQL, HIST_SQL, select="SELECT e.bin::INTEGER AS bin, CASE WHEN e.bin BETWEEN 0 AND 59 THEN round(exp(ln(a) + (ln(b) - ln(a)) * e.bin / 60), 4) END AS lower, CASE WHEN e.bin BETWEEN 0 AND 59 THEN round(exp(ln(a) + (ln(b) - ln(a)) * (e.bin + 1) / 60), 4) END AS upper, coalesce(n, 0) AS count FROM (SELECT unnest(range(-1, 61)) AS bin) e CROSS JOIN ends LEFT JOIN counted USING (bin)"))
def histogram_p1_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.histogram(bars(spark, sf_dir), "amount")
    return found.select("bin", r(F.col("lower"), 4).alias("lower"), r(F.col("upper"), 4).alias("upper"), "count")


@REGISTRY.query("fixed_bins", with_sql(BARS_SQL, SCORED_SQL, select="SELECT b::INTEGER AS bin, count(momentum_5) AS count FROM (SELECT unnest(range(20)) AS b) LEFT JOIN scored ON greatest(0, least(19, floor((momentum_5 + 1) / 2 * 20))) = b GROUP BY 1"))
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.fixed_bins(scored(spark, sf_dir), "momentum_5", -1.0, 1.0, 20)


def _edges(table: str, value: str, keys: str = "date") -> str:
    return f"(SELECT {keys}, list_sort(list_distinct(quantile_cont({value}, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM {table} GROUP BY {keys} HAVING count({value}) >= 5)"


QUINTILE_SQL = f"""
held AS (SELECT * FROM scored WHERE momentum_5 IS NOT NULL AND label IS NOT NULL),
bucketed AS (
  SELECT h.*, greatest(len(list_filter(e, lambda v: v < momentum_5)) - 1, 0) + 1 AS bucket FROM held h JOIN {_edges("held", "momentum_5")} USING (date) WHERE len(e) > 1
),
returns AS (SELECT date, bucket::INTEGER AS bucket, count(*) AS names, avg(label) AS ret FROM bucketed GROUP BY 1, 2)"""


@REGISTRY.query("quintile_returns", with_sql(BARS_SQL, SCORED_SQL, QUINTILE_SQL, select="SELECT date, bucket, names, round(ret, 6) + 0.0 AS ret FROM returns"))
def quintile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.quintile_returns(scored(spark, sf_dir), "momentum_5", "label").select("date", "bucket", "names", r(F.col("ret")).alias("ret"))


@REGISTRY.query("quintile_spread", with_sql(BARS_SQL, SCORED_SQL, QUINTILE_SQL, select="SELECT date, round(arg_max(ret, bucket) - arg_min(ret, bucket), 6) + 0.0 AS spread, CASE WHEN count(*) >= 3 THEN round(covar_pop(bucket, ret) / nullif(stddev_pop(bucket) * stddev_pop(ret), 0), 4) + 0.0 END AS monotonicity FROM returns GROUP BY 1"))
def quintile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.quintile_spread(d.quintile_returns(scored(spark, sf_dir), "momentum_5", "label"))
    return found.select("date", r(F.col("spread")).alias("spread"), r(F.col("monotonicity"), 4).alias("monotonicity"))


TURNOVER_SQL = f"""
b AS (SELECT s.date, s.instrument, greatest(len(list_filter(e, lambda v: v < momentum_5)) - 1, 0) AS bucket FROM scored s JOIN {_edges("scored", "momentum_5")} USING (date) WHERE momentum_5 IS NOT NULL AND len(e) > 1),
top AS (SELECT date, instrument FROM b JOIN (SELECT date, max(bucket) AS bucket FROM b GROUP BY 1) USING (date, bucket)),
days AS (SELECT date, count(*) AS n, lag(date) OVER (ORDER BY date) AS before, lag(count(*)) OVER (ORDER BY date) AS n_before FROM top GROUP BY 1),
stayed AS (SELECT d.date, count(*) AS both_ FROM days d JOIN top t USING (date) JOIN top u ON u.date = d.before AND u.instrument = t.instrument GROUP BY 1)"""


@REGISTRY.query("top_turnover", with_sql(BARS_SQL, SCORED_SQL, TURNOVER_SQL, select="SELECT date, round(1 - coalesce(both_, 0) / greatest(n_before, 1), 6) + 0.0 AS turnover FROM days LEFT JOIN stayed USING (date) WHERE before IS NOT NULL"))
def top_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.top_turnover(scored(spark, sf_dir), "momentum_5").select("date", r(F.col("turnover")).alias("turnover"))


CONDITIONAL_SQL = f"""
long AS (SELECT date, momentum_5, label, 'float_market_cap' AS dimension, float_market_cap AS level FROM scored UNION ALL SELECT date, momentum_5, label, 'turn', turn FROM scored),
inside AS (
  SELECT l.*, (greatest(len(list_filter(e, lambda v: v < level)) - 1, 0) + 1)::INTEGER AS bucket FROM long l JOIN {_edges("long", "level", "dimension, date")} USING (dimension, date) WHERE level IS NOT NULL AND len(e) > 1
),
pairs AS (SELECT * FROM inside WHERE momentum_5 IS NOT NULL AND label IS NOT NULL),
ranked AS (
  SELECT dimension, bucket, date, rank() OVER (PARTITION BY dimension, bucket, date ORDER BY momentum_5) + (count(*) OVER (PARTITION BY dimension, bucket, date, momentum_5) - 1) / 2 AS f,
    rank() OVER (PARTITION BY dimension, bucket, date ORDER BY label) + (count(*) OVER (PARTITION BY dimension, bucket, date, label) - 1) / 2 AS o FROM pairs
),
ic AS (SELECT dimension, bucket, date, covar_pop(f, o) / nullif(stddev_pop(f) * stddev_pop(o), 0) AS ic FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@REGISTRY.query("conditional_ic", with_sql(BARS_SQL, SCORED_SQL, CONDITIONAL_SQL, select=f"SELECT dimension, bucket, {SUMMARY_SQL} FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2"))
def conditional_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(d.conditional_ic(scored(spark, sf_dir), "momentum_5", "label", ("float_market_cap", "turn")), "dimension", "bucket")


@REGISTRY.query("decile_spread", with_sql(BARS_SQL, SCORED_SQL, "held AS (SELECT * FROM scored WHERE momentum_5 IS NOT NULL AND label IS NOT NULL)", "ends AS (SELECT date, quantile_cont(momentum_5, 0.1) AS low_, quantile_cont(momentum_5, 0.9) AS high_ FROM held GROUP BY 1)", select="SELECT date, round(avg(label) FILTER (WHERE momentum_5 >= high_) - avg(label) FILTER (WHERE momentum_5 <= low_), 6) + 0.0 AS spread FROM held JOIN ends USING (date) GROUP BY 1"))
def decile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.decile_spread(scored(spark, sf_dir), "momentum_5", "label").select("date", r(F.col("spread")).alias("spread"))


def _corr_sql(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


PAIRS = (("momentum_5", "turn"), ("momentum_5", "pe_ttm"), ("turn", "pe_ttm"))


@REGISTRY.query("pair_correlation", with_sql(BARS_SQL, SCORED_SQL, select=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_corr_sql(a, b)}, 4) + 0.0 AS corr FROM scored" for a, b in PAIRS)))
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pair_correlations(scored(spark, sf_dir), ("momentum_5", "turn", "pe_ttm")).select("a", "b", r(F.col("corr"), 4).alias("corr"))


LIBRARY = ("turn", "pe_ttm", "vol")
LIBRARY_SQL = " UNION ALL ".join(f"SELECT date, '{c}' AS \"column\", count({c}) AS n, abs({_corr_sql('momentum_5', c)}) AS r FROM scored WHERE momentum_5 IS NOT NULL GROUP BY 1 HAVING stddev_pop(momentum_5) > 0" for c in LIBRARY)


@REGISTRY.query("library_max_corr", with_sql(BARS_SQL, SCORED_SQL, f"daily AS ({LIBRARY_SQL})", select="SELECT \"column\", round(m, 4) AS mean_abs_corr, round(max(m) OVER (), 4) AS most, m = max(m) OVER () AS closest FROM (SELECT \"column\", avg(coalesce(r, 0)) AS m FROM daily WHERE n >= 8 GROUP BY 1)"))
def library_max_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.library_max_corr(scored(spark, sf_dir), "momentum_5", LIBRARY)
    return found.select("column", r(F.col("mean_abs_corr"), 4).alias("mean_abs_corr"), r(F.col("most"), 4).alias("most"), "closest")


NDCG_SQL = """
rel AS (SELECT date, instrument, momentum_5, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2 AS rel FROM pairs),
placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum_5 DESC, instrument) AS own, row_number() OVER (PARTITION BY date ORDER BY rel DESC, instrument) AS ideal FROM rel),
ndcg AS (SELECT date, sum(rel / log2(own + 1)) FILTER (WHERE own <= 10) / nullif(sum(rel / log2(ideal + 1)) FILTER (WHERE ideal <= 10), 0) AS ndcg FROM placed GROUP BY 1)"""


@REGISTRY.query("monthly_rank_ndcg", with_sql(BARS_SQL, SCORED_SQL, IC_SQL, NDCG_SQL, select="SELECT date_trunc('month', date)::DATE AS month, round(avg(ic), 6) + 0.0 AS rank_ic, round(avg(ndcg), 6) AS ndcg FROM ndcg LEFT JOIN ic USING (date) GROUP BY 1"))
def monthly_rank_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.monthly_ranking(scored(spark, sf_dir), "momentum_5", "label")
    return found.select("month", r(F.col("rank_ic")).alias("rank_ic"), r(F.col("ndcg")).alias("ndcg"))


CANDIDATES = (("momentum", 5), ("momentum", 10), ("bias", 10), ("zscore", 10))


def _candidate(kind: str, n: int):
    x = F.col("close")
    return {"momentum": w.pct_change, "bias": w.rolling_bias, "zscore": w.ts_zscore}[kind](x, n)


def _candidate_sql(kind: str, n: int) -> str:
    return {"momentum": q.pct_change, "bias": q.bias, "zscore": q.zscore}[kind]("close", n)


CANDIDATE_SQL = "wide AS (SELECT date, instrument, label, " + ", ".join(f"{q.r(_candidate_sql(k, n), 5)} AS {k}_{n}" for k, n in CANDIDATES) + " FROM scored)"
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT '{k}_{n}' AS candidate, date, {k}_{n} AS f, label FROM wide" for k, n in CANDIDATES) + ")"
CANDIDATE_IC_SQL = """
pairs AS (SELECT *, CASE WHEN date < DATE '1996-01-01' THEN 'train' ELSE 'test' END AS split FROM long WHERE f IS NOT NULL AND label IS NOT NULL),
ranked AS (
  SELECT candidate, split, date, rank() OVER (PARTITION BY candidate, date ORDER BY f) + (count(*) OVER (PARTITION BY candidate, date, f) - 1) / 2 AS f,
    rank() OVER (PARTITION BY candidate, date ORDER BY label) + (count(*) OVER (PARTITION BY candidate, date, label) - 1) / 2 AS o FROM pairs
),
ic AS (SELECT candidate, split, date, covar_pop(f, o) / nullif(stddev_pop(f) * stddev_pop(o), 0) AS ic FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@REGISTRY.query("candidate_metrics", with_sql(BARS_SQL, SCORED_SQL, CANDIDATE_SQL, LONG_SQL, CANDIDATE_IC_SQL, select=f"SELECT candidate, split, {SUMMARY_SQL} FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2"))
def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate factors in one wide projection, then long: diagnostics grouped by candidate and split."""
    wide = scored(spark, sf_dir).select("date", "instrument", "label", *[r(_candidate(k, n), 5).alias(f"{k}_{n}") for k, n in CANDIDATES])
    stacked = ", ".join(f"'{k}_{n}', {k}_{n}" for k, n in CANDIDATES)
    long = wide.select("date", "instrument", "label", F.expr(f"stack({len(CANDIDATES)}, {stacked}) AS (candidate, f)"))
    split = F.when(F.col("date") < F.lit("1996-01-01").cast("date"), "train").otherwise("test")
    return _summary(d.ic_summary(d.daily_ic(long.withColumn("split", split), "f", "label", 3, ("candidate", "split")), ("candidate", "split")), "candidate", "split")
