"""Column functions over an instrument's own observations, and over a date's cross-section.

A window function is over `instrument` by `date` and complete: unless said
otherwise the result is NULL where one of the last n values is NULL or missing.
A window over a window needs a projection in between.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def last_n(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int) -> Column:
    """Whether the last n values are all there."""
    return F.count(x).over(last_n(n)) == n


def _when_full(x: Column, n: int, value: Column) -> Column:
    return F.when(full(x, n), value)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero divisor."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def shift(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by_time()) if n >= 0 else F.lead(x, -n).over(by_time())


def diff(x: Column, n: int) -> Column:
    return x - shift(x, n)


def pct_change(x: Column, n: int) -> Column:
    return div(x, shift(x, n)) - 1


def rolling_mean(x: Column, n: int) -> Column:
    return _when_full(x, n, F.avg(x).over(last_n(n)))


def rolling_std(x: Column, n: int) -> Column:
    """Sample standard deviation."""
    return _when_full(x, n, F.stddev_samp(x).over(last_n(n)))


def rolling_max(x: Column, n: int) -> Column:
    return _when_full(x, n, F.max(x).over(last_n(n)))


def rolling_min(x: Column, n: int) -> Column:
    return _when_full(x, n, F.min(x).over(last_n(n)))


def rolling_sum(x: Column, n: int) -> Column:
    return _when_full(x, n, F.sum(x).over(last_n(n)))


def ts_rank(x: Column, n: int) -> Column:
    """Average rank of the last value among the window's values, over n. Missing values are not counted; NULL if the last is."""
    held = F.collect_list(x).over(last_n(n))
    below = F.aggregate(held, F.lit(0.5), lambda total, v: total + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
    return F.when(x.isNotNull() & (F.count(F.lit(1)).over(last_n(n)) == n), below / n)


def ts_zscore(x: Column, n: int) -> Column:
    return div(x - rolling_mean(x, n), rolling_std(x, n))


def rolling_bias(x: Column, n: int) -> Column:
    return div(x, rolling_mean(x, n)) - 1


def rolling_cov(x: Column, y: Column, n: int) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    return F.when(F.count(both).over(last_n(n)) == n, F.covar_samp(x, y).over(last_n(n)))


def _spread(x: Column, n: int, noise: float) -> Column:
    """rolling_std, NULL where it is but the rounding error of equal values: up to `noise` of the mean."""
    std = rolling_std(x, n)
    return F.when(std > noise * F.abs(F.avg(x).over(last_n(n))), std)


def rolling_corr(x: Column, y: Column, n: int, noise: float = 1e-9) -> Column:
    """NULL for a window whose deviation is no more than `noise` of its mean: it is constant up to rounding."""
    return div(rolling_cov(x, y, n), _spread(x, n, noise) * _spread(y, n, noise))


def rolling_corr_zero(x: Column, y: Column, n: int, noise: float = 1e-9) -> Column:
    """As rolling_corr, but 0 for a constant full window."""
    return F.when(full(x, n) & full(y, n), F.coalesce(rolling_corr(x, y, n, noise), F.lit(0.0)))


def rolling_quantile(x: Column, n: int, q: float) -> Column:
    """Linear quantile of a full window."""
    held = F.sort_array(F.collect_list(x).over(last_n(n)))
    at = q * (n - 1)
    low = int(at)
    a, b = F.element_at(held, low + 1), F.element_at(held, min(low + 2, n))
    return _when_full(x, n, a + (b - a) * (at - low))


def rolling_rank_share(x: Column, n: int) -> Column:
    """Share of the window's values at or below the last."""
    held = F.collect_list(x).over(last_n(n))
    return _when_full(x, n, F.size(F.filter(held, lambda v: v <= x)) / n)


def bars_since_max(x: Column, n: int) -> Column:
    """Observations since the latest maximum of a full window, 0 for now."""
    held = F.reverse(F.collect_list(x).over(last_n(n)))
    return _when_full(x, n, F.array_position(held, F.array_max(held)) - 1)


def bars_since_min(x: Column, n: int) -> Column:
    held = F.reverse(F.collect_list(x).over(last_n(n)))
    return _when_full(x, n, F.array_position(held, F.array_min(held)) - 1)


def ols_slope(x: Column, n: int, time: str = "t") -> Column:
    """Slope of x on the observation number `time` over a full window."""
    return _when_full(x, n, F.regr_slope(x, F.col(time)).over(last_n(n)))


def ols_rsquare(x: Column, n: int, time: str = "t") -> Column:
    """R squared; 0 for a constant window."""
    constant = F.max(x).over(last_n(n)) == F.min(x).over(last_n(n))
    return _when_full(x, n, F.when(constant, 0.0).otherwise(F.regr_r2(x, F.col(time)).over(last_n(n))))


def ols_residual(x: Column, n: int, time: str = "t") -> Column:
    """The last value less what the line through the window says."""
    line = F.regr_intercept(x, F.col(time)).over(last_n(n)) + F.regr_slope(x, F.col(time)).over(last_n(n)) * F.col(time)
    return _when_full(x, n, x - line)


def cs_rank(x: Column, where: Column | None = None) -> Column:
    """Average rank within the date, over the non-null count; NULL where x is. where: rank within a pool only."""
    x = x if where is None else F.when(where, x)
    return F.when(x.isNotNull(), average_rank(x, "date") / F.count(x).over(by_date()))


def average_rank(x: Column, *keys: str) -> Column:
    """The rank of x within the keys, that of the middle for ties; ranks and ties are read off one order."""
    order = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(order) + (ties - 1) / 2


def cs_quantile(x: Column, q: float) -> Column:
    """Linear quantile of the date's known values."""
    return F.percentile(x, F.lit(q)).over(by_date())


def cs_zscore(x: Column) -> Column:
    return div(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date()))


def two_valued(comparison: Column) -> Column:
    """A comparison in which NULL counts as false, so that its negation is true."""
    return F.coalesce(comparison, F.lit(False))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
