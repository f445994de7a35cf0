"""SQL text of the window functions, for the equivalent statements of the queries."""

from __future__ import annotations

BY_TIME = "PARTITION BY instrument ORDER BY date"


def last_n(n: int) -> str:
    return f"({BY_TIME} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, value: str) -> str:
    return f"(CASE WHEN count({x}) OVER {last_n(n)} = {n} THEN {value} END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0.0))"


def shift(x: str, n: int) -> str:
    return f"(lag({x}, {n}) OVER ({BY_TIME}))" if n >= 0 else f"(lead({x}, {-n}) OVER ({BY_TIME}))"


def pct_change(x: str, n: int) -> str:
    return f"({div(x, shift(x, n))} - 1)"


def mean(x: str, n: int) -> str:
    return full(x, n, f"avg({x}) OVER {last_n(n)}")


def std(x: str, n: int) -> str:
    return full(x, n, f"stddev_samp({x}) OVER {last_n(n)}")


def most(x: str, n: int) -> str:
    return full(x, n, f"max({x}) OVER {last_n(n)}")


def least(x: str, n: int) -> str:
    return full(x, n, f"min({x}) OVER {last_n(n)}")


def total(x: str, n: int) -> str:
    return full(x, n, f"sum({x}) OVER {last_n(n)}")


def held(x: str, n: int) -> str:
    return f"list({x}) OVER {last_n(n)}"


def ts_rank(x: str, n: int) -> str:
    lists = f"list_filter({held(x, n)}, lambda v: v IS NOT NULL)"
    return (
        f"(CASE WHEN {x} IS NOT NULL AND count(*) OVER {last_n(n)} = {n} THEN (len(list_filter({lists}, lambda v: v < {x})) "
        f"+ (len(list_filter({lists}, lambda v: v = {x})) + 1) / 2) / {n} END)"
    )


def zscore(x: str, n: int) -> str:
    return div(f"{x} - {mean(x, n)}", std(x, n))


def bias(x: str, n: int) -> str:
    return f"({div(x, mean(x, n))} - 1)"


def cov(x: str, y: str, n: int) -> str:
    both = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    return f"(CASE WHEN count({both}) OVER {last_n(n)} = {n} THEN covar_samp({x}, {y}) OVER {last_n(n)} END)"


def spread(x: str, n: int) -> str:
    return f"(CASE WHEN {std(x, n)} > 1e-9 * abs(avg({x}) OVER {last_n(n)}) THEN {std(x, n)} END)"


def corr(x: str, y: str, n: int) -> str:
    return div(cov(x, y, n), f"({spread(x, n)} * {spread(y, n)})")


def corr_zero(x: str, y: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {last_n(n)} = {n} AND count({y}) OVER {last_n(n)} = {n} THEN coalesce({corr(x, y, n)}, 0.0) END)"


def quantile(x: str, n: int, q: float) -> str:
    return full(x, n, f"quantile_cont({x}, {q}) OVER {last_n(n)}")


def rank_share(x: str, n: int) -> str:
    return full(x, n, f"len(list_filter({held(x, n)}, lambda v: v <= {x})) / {n}")


def since(x: str, n: int, pick: str) -> str:
    lists = f"list_reverse({held(x, n)})"
    return full(x, n, f"list_position({lists}, list_{pick}({lists})) - 1")


def slope(x: str, n: int) -> str:
    return full(x, n, f"regr_slope({x}, t) OVER {last_n(n)}")


def rsquare(x: str, n: int) -> str:
    return full(x, n, f"CASE WHEN max({x}) OVER {last_n(n)} = min({x}) OVER {last_n(n)} THEN 0.0 ELSE regr_r2({x}, t) OVER {last_n(n)} END")


def residual(x: str, n: int) -> str:
    return full(x, n, f"{x} - (regr_intercept({x}, t) OVER {last_n(n)} + regr_slope({x}, t) OVER {last_n(n)} * t)")


def cs_rank(x: str) -> str:
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2) "
        f"/ count({x}) OVER (PARTITION BY date) END)"
    )


def r(value: str, digits: int = 6) -> str:
    return f"(round({value}, {digits}) + 0.0)"
