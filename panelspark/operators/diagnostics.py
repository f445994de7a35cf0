"""Diagnostics of factors against outcomes, by date and in summary.

Cross-sections are aggregated by date first (partial sums before the shuffle),
so summaries read one row a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.window import average_rank, div
from panelspark.operators.buckets import daily_quintile
from panelspark.operators.quantiles import exact_quantiles


#: A correlation up to this is rounding noise around zero.
NOISE = 1e-12


def guarded_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate over complete pairs; NULL where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def distribution(panel: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, coverage, mean, population deviation, extremes, bias-corrected skew and excess kurtosis, and quantiles."""
    x = F.col(value)
    n = F.count(x)
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * F.skewness(x))
    kurt = F.when(n > 3, F.try_divide((n - 1).cast("double"), (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
    marks = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    if by:
        quantile = F.percentile(x, F.array(*map(F.lit, marks)))
    else:  # of the whole table: not all in one task
        known = exact_quantiles(panel, {"x": x}, marks)["x"]
        quantile = F.array(*[F.lit(v).cast("double") for v in known])
    stats = panel.groupBy(*by).agg(
        F.count("*").alias("rows"), n.alias("values"), (n / F.count("*")).alias("coverage"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), skew.alias("skew"), kurt.alias("kurtosis"), *([quantile.alias("q_")] if by else []),
    )
    if not by:
        stats = stats.withColumn("q_", quantile)
    return stats.select("*", *[F.element_at("q_", i + 1).alias(f"p{round(m * 100)}") for i, m in enumerate(marks)]).drop("q_")


def signs(panel: DataFrame, value: str) -> DataFrame:
    x = F.col(value)
    return panel.agg(
        F.count_if(x.isNull()).alias("missing"), F.count_if(x == 0).alias("zero"), F.count_if(x < 0).alias("negative"), F.count_if(x > 0).alias("positive"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )


def approximate_quantiles(panel: DataFrame, value: str, marks: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(mark, value): quantiles off by at most 1 / accuracy of the rows, in bounded memory; an element of the column each."""
    wide = panel.agg(F.percentile_approx(value, F.array(*map(F.lit, marks)), accuracy).alias("q"))
    return wide.select(F.explode(F.arrays_zip(F.array(*map(F.lit, marks)).alias("mark"), F.col("q").alias("value"))).alias("z")).select("z.mark", "z.value")


def equal_bins(panel: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, count) of equal bins over the whole range, closed to the right, from 0; empty ones as 0.

    The first bin takes the minimum in: its lower edge lies a thousandth of the
    range below it. A constant column is one bin.
    """
    x = F.col(value)
    ends = panel.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b")).where(F.col("a").isNotNull())
    at = F.when(F.col("a") == F.col("b"), 0).otherwise(F.greatest(F.ceil((x - F.col("a")) / ((F.col("b") - F.col("a")) / bins)) - 1, F.lit(0)))
    counted = panel.where(x.isNotNull()).join(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))  # ends: one row
    upto = F.when(F.col("a") == F.col("b"), 0).otherwise(bins - 1)
    every = ends.select("a", "b", F.explode(F.sequence(F.lit(0), upto)).alias("bin"))
    step = (F.col("b") - F.col("a")) / bins
    lower = F.when(F.col("bin") == 0, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") - (F.col("b") - F.col("a")) / 1000)).otherwise(F.col("a") + step * F.col("bin"))
    upper = F.when(F.col("a") == F.col("b"), F.col("b")).otherwise(F.col("a") + step * (F.col("bin") + 1))
    return every.join(counted, "bin", "left").select("bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram(panel: DataFrame, value: str, bins: int = 60, low: float = 0.01, high: float = 0.99, positive: float = 0.9) -> DataFrame:
    """(bin, lower, upper, count) between two quantiles, and below and above as bins -1 and `bins`; the last bin is closed.

    The scale is logarithmic if the low quantile is positive and the high one at
    least ten times as large, or if at least `positive` of the values are above
    zero and that holds for the quantiles of those: the bins then span them, and
    what is not positive is below. The quantiles are exact and come first, then counts.
    """
    x, plus = F.col(value), F.when(F.col(value) > 0, F.col(value))
    known = exact_quantiles(panel, {"x": x, "plus": plus}, (low, high))
    fixed = lambda name: F.array(*[F.lit(v).cast("double") for v in known[name]])
    ends = panel.agg(F.try_divide(F.count(plus), F.count(x)).alias("share")).select(fixed("x").alias("e"), fixed("plus").alias("p"), "share")
    wide = lambda e: F.coalesce((F.element_at(e, 1) > 0) & (F.element_at(e, 2) >= 10 * F.element_at(e, 1)), F.lit(False))
    mostly = ~wide("e") & F.coalesce(F.col("share") >= positive, F.lit(False)) & wide("p")
    ends = ends.select(F.when(mostly, F.col("p")).otherwise(F.col("e")).alias("e"), (wide("e") | mostly).alias("log_"))
    ends = ends.select(F.element_at("e", 1).alias("a"), F.element_at("e", 2).alias("b"), "log_")
    a, b = (F.when(F.col("log_"), F.ln(c)).otherwise(c) for c in (F.col("a"), F.col("b")))
    scaled = F.when(F.col("log_"), F.ln(F.when(x > 0, x))).otherwise(x)
    at = F.least(F.floor(div(scaled - a, b - a) * bins), F.lit(bins - 1))
    place = F.when(x < F.col("a"), -1).when(x > F.col("b"), bins).otherwise(F.coalesce(at, F.lit(0)))
    counted = panel.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))  # ends: one row
    every = ends.select("a", "b", "log_", F.explode(F.sequence(F.lit(-1), F.lit(bins))).alias("bin"))
    edge = lambda i: F.when(F.col("log_"), F.exp(a + (b - a) * i / bins)).otherwise(a + (b - a) * i / bins)
    inner = F.col("bin").between(0, bins - 1)
    return every.join(counted, "bin", "left").select("bin", F.when(inner, edge(F.col("bin"))).alias("lower"), F.when(inner, edge(F.col("bin") + 1)).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 1e-7, by a rational approximation."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # Fixed values of the approximation.
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    tail = F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_expected(bins: DataFrame, panel: DataFrame, value: str) -> DataFrame:
    """Add the count that a normal distribution with the column's mean and deviation would put into each bin; NULL for the tails."""
    told = panel.agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"), F.count(value).alias("n_"))
    z = lambda c: div(F.col(c) - F.col("m_"), F.col("s_"))
    joined = bins.join(F.broadcast(told))  # one row
    return joined.withColumn("expected", (normal_cdf(z("upper")) - normal_cdf(z("lower"))) * F.col("n_")).drop("m_", "s_", "n_")


def fixed_bins(panel: DataFrame, value: str, start: float, end: float, bins: int) -> DataFrame:
    """(bin, count) of equal bins over a fixed range; values outside count in the end bins, empty bins as 0."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - start) / (end - start) * bins)))
    counted = panel.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = panel.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def daily_ic(panel: DataFrame, factor: str, outcome: str, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, names, ic): correlation of average ranks by date; dates with fewer than `least` complete pairs go."""
    keys = [*by, "date"]
    pairs = panel.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())

    ranked = pairs.select(*keys, average_rank(F.col(factor), *keys).alias("f_"), average_rank(F.col(outcome), *keys).alias("o_"))
    found = ranked.groupBy(*keys).agg(F.count("*").alias("names"), guarded_corr(F.col("f_"), F.col("o_")).alias("ic"))
    return found.where((F.col("names") >= least) & F.col("ic").isNotNull())


def ic_summary(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, share of positive days, population deviation (over more than one day), their ratio, and days."""
    std = F.when(F.count("ic") > 1, F.stddev_pop("ic"))
    return daily.groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), F.avg((F.col("ic") > NOISE).cast("double")).alias("ic_positive"), std.alias("ic_std"),
        div(F.avg("ic"), std).alias("icir"), F.count("ic").alias("days"),
    )


def quintile_returns(panel: DataFrame, factor: str, outcome: str, groups: int = 5) -> DataFrame:
    """(date, bucket, names, ret): mean outcome of each daily bucket of the factor."""
    pairs = panel.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    return daily_quintile(pairs, factor, groups=groups).where(F.col("bucket").isNotNull()).groupBy("date", "bucket").agg(F.count("*").alias("names"), F.avg(outcome).alias("ret"))


def quintile_spread(returns: DataFrame) -> DataFrame:
    """(date, spread, monotonicity): top less bottom bucket, and correlation of bucket number and return (3 buckets or more)."""
    found = returns.groupBy("date").agg(
        F.max_by("ret", "bucket").alias("top"), F.min_by("ret", "bucket").alias("bottom"), F.count("*").alias("buckets"),
        guarded_corr(F.col("bucket").cast("double"), F.col("ret")).alias("trend"),
    )
    return found.select("date", (F.col("top") - F.col("bottom")).alias("spread"), F.when(F.col("buckets") >= 3, F.col("trend")).alias("monotonicity"))


def top_turnover(panel: DataFrame, factor: str, groups: int = 5) -> DataFrame:
    """(date, turnover): share of the last qualifying date's top bucket that is no longer in it."""
    bucketed = daily_quintile(panel, factor, groups=groups).where(F.col("bucket").isNotNull())
    highest = bucketed.groupBy("date").agg(F.max("bucket").alias("bucket"))
    top = bucketed.join(highest, ["date", "bucket"]).select("date", "instrument")
    days = top.groupBy("date").agg(F.count("*").alias("held")).withColumns(
        {"before": F.lag("date").over(Window.orderBy("date")), "held_before": F.lag("held").over(Window.orderBy("date"))}
    )
    stayed = top.join(days.select("date", "before"), "date").join(top.select(F.col("date").alias("before"), "instrument"), ["before", "instrument"]).groupBy("date").agg(F.count("*").alias("both"))
    out = days.where(F.col("before").isNotNull()).join(stayed, "date", "left")
    return out.select("date", (1 - F.coalesce("both", F.lit(0)) / F.greatest("held_before", F.lit(1))).alias("turnover"))


def conditional_ic(panel: DataFrame, factor: str, outcome: str, dimensions: tuple[str, ...], least: int = 3) -> DataFrame:
    """IC summary inside the daily quintiles of each dimension: (dimension, bucket, ...)."""
    stacked = ", ".join(f"'{d}', {d}" for d in dimensions)
    long = panel.select("date", "instrument", factor, outcome, F.expr(f"stack({len(dimensions)}, {stacked}) AS (dimension, level)"))
    inside = daily_quintile(long, "level", keys=("dimension", "date")).where(F.col("bucket").isNotNull())
    return ic_summary(daily_ic(inside, factor, outcome, least, ("dimension", "bucket")), ("dimension", "bucket"))


def decile_spread(panel: DataFrame, factor: str, outcome: str, by: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(by, date, spread): mean outcome at or above the factor's p90 less that at or below its p10; dates with fewer than `least` pairs go."""
    keys = [*by, "date"]
    pairs = panel.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    ends = pairs.groupBy(*keys).agg(F.percentile(factor, F.array(F.lit(0.1), F.lit(0.9))).alias("e"), F.count("*").alias("n_")).where(F.col("n_") >= least)
    x, low, high = F.col(factor), F.element_at("e", 1), F.element_at("e", 2)
    return pairs.join(ends, keys).groupBy(*keys).agg((F.avg(F.when(x >= high, F.col(outcome))) - F.avg(F.when(x <= low, F.col(outcome)))).alias("spread"))


def pair_correlations(panel: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """(a, b, corr) of every pair of columns over complete pairs, by one aggregation."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    wide = panel.agg(*[guarded_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("p")).select("p.*")


def accepted(correlations: DataFrame, factors: tuple[str, ...], limit: float) -> list[str]:
    """Greedy choice in the given order: a factor goes in unless it correlates beyond the limit with one that is in."""
    found = {(r["a"], r["b"]): abs(r["corr"] or 0.0) for r in correlations.collect()}  # a row for each pair of the given list
    kept: list[str] = []
    for f in factors:
        if all(found.get((k, f), found.get((f, k), 0.0)) < limit for k in kept):
            kept.append(f)
    return kept


def library_max_corr(panel: DataFrame, factor: str, library: tuple[str, ...], least: int = 8) -> DataFrame:
    """(column, mean_abs_corr, most, closest): mean of absolute daily correlations with each library column; a constant column counts 0.

    most: the greatest of these means, by which a factor is judged; closest: whether it is this column's.
    """
    f = F.col(factor)
    daily = panel.where(f.isNotNull()).groupBy("date").agg(
        F.stddev_pop(f).alias("sd_"), *[F.struct(F.count(F.col(c)).alias("n"), F.abs(guarded_corr(f, F.col(c))).alias("r")).alias(c) for c in library]
    )
    long = daily.where(F.col("sd_") > 0).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in library])).alias("p"))
    means = long.where(F.col("p.v.n") >= least).groupBy(F.col("p.column").alias("column")).agg(F.avg(F.coalesce("p.v.r", F.lit(0.0))).alias("mean_abs_corr"))
    most = F.max("mean_abs_corr").over(Window.partitionBy())  # a row a library column
    return means.withColumn("most", most).withColumn("closest", F.col("mean_abs_corr") == F.col("most"))


def monthly_ranking(scores: DataFrame, score: str, outcome: str, k: int = 10) -> DataFrame:
    """(month, rank_ic, ndcg): means over a month's dates of the rank IC and NDCG@k; relevance is the average rank of the outcome."""
    ic = daily_ic(scores, score, outcome).select("date", "ic")
    held = scores.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    by_date = Window.partitionBy("date")
    placed = held.withColumn("rel_", average_rank(F.col(outcome), "date")).withColumns(
        {"own_": F.row_number().over(by_date.orderBy(F.desc(score), "instrument")), "ideal_": F.row_number().over(by_date.orderBy(F.desc("rel_"), "instrument"))}
    )
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col("rel_") / F.log2(F.col(place) + 1)))
    ndcg = placed.groupBy("date").agg(div(gain("own_"), gain("ideal_")).alias("ndcg"))
    return ndcg.join(ic, "date", "left").groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.avg("ic").alias("rank_ic"), F.avg("ndcg").alias("ndcg"))
