"""Candidate factors: generation, metrics by period, decisions, own books and batch scoring, as grouped jobs."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.series import Series, Stages
from panelspark.operators import books
from panelspark.operators import diagnostics as d

#: Operators of a field alone, and over a window.
PLAIN = ("identity", "cs_rank")
WINDOWED = ("shift", "diff", "pct_change", "rolling_mean", "rolling_std", "ts_rank", "ts_zscore", "rolling_bias")
#: Columns that only a label may read.
TARGETS = frozenset({"label", "next_close", "future_return"})


def formulas(fields: list[str], operators: list[str], windows: list[int], seed: int = 0, most: int = 20) -> list[tuple[str, str, int]]:
    """(field, operator, window) of at most `most` candidates, in an order by hash of the seed; window 0 for none."""
    wrong = sorted(set(fields) & TARGETS) + sorted(set(operators) - set(PLAIN) - set(WINDOWED))
    if wrong:
        raise ValueError(f"not allowed: {', '.join(wrong)}")
    every = [(f, o, n) for f in sorted(set(fields)) for o in dict.fromkeys(operators) for n in ((0,) if o in PLAIN else sorted({w for w in windows if w > 0}))]
    return sorted(every, key=lambda c: hashlib.sha256(f"{seed}|{name_of(c)}".encode()).hexdigest())[:most]


def name_of(candidate: tuple[str, str, int]) -> str:
    field, operator, window = candidate
    return field if operator == "identity" else f"{field}_{operator}" + (f"_{window}" if window else "")


def columns(stages: Stages, candidates: list[tuple[str, str, int]]) -> dict[str, Series]:
    """The candidates as columns of a staged projection."""
    out = {}
    for candidate in candidates:
        field, operator, window = candidate
        x = stages.column(field)
        out[name_of(candidate)] = x if operator == "identity" else getattr(x, operator)(*([window] if window else []))
    return out


def stacked(wide: DataFrame, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    """(keep, candidate, f): one row for each candidate column."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return wide.select(*keep, F.expr(f"stack({len(names)}, {pairs}) AS (candidate, f)"))


def period_metrics(long: DataFrame, outcome: str, by: tuple[str, ...] = ("candidate", "split"), least: int = 2) -> DataFrame:
    """(by, rows, finite_rows, coverage, rank_ic, rank_ic_days, group_spread, positive_spread_ratio): one job for all candidates."""
    rows = long.groupBy(*by).agg(F.count("*").alias("rows"), F.count("f").alias("finite_rows"), (F.count("f") / F.count("*")).alias("coverage"))
    ic = d.daily_ic(long, "f", outcome, least, by).groupBy(*by).agg(F.avg("ic").alias("rank_ic"), F.count("ic").alias("rank_ic_days"))
    spread = d.decile_spread(long, "f", outcome, by, least).where(F.col("spread").isNotNull())
    spread = spread.groupBy(*by).agg(F.avg("spread").alias("group_spread"), F.avg((F.col("spread") > 0).cast("double")).alias("positive_spread_ratio"))
    return rows.join(ic, list(by), "left").join(spread, list(by), "left").fillna(0, ["rank_ic_days"])


def decisions(wide: DataFrame, names: list[str], outcome: str, coverage: float, rank_ic: float, limit: float = 0.95) -> DataFrame:
    """(candidate, decision, reason): in the order of `names`; wide has split.

    Rejected are candidates that correlate at `limit` or more, on the training
    rows, with one before them that was not itself rejected for that, and those
    below either bound on validation. Test rows are never read.
    """
    used = wide.where(F.col("split").isin("train", "validation"))
    own = set(d.accepted(d.pair_correlations(used.where(F.col("split") == "train"), tuple(names)), tuple(names), limit))
    long = stacked(used.where(F.col("split") == "validation"), names, ("date", "instrument", outcome, "split"))
    told = period_metrics(long, outcome)
    passes = F.coalesce((F.col("coverage") >= coverage) & (F.col("rank_ic") >= rank_ic), F.lit(False))
    alone = F.col("candidate").isin(*own)
    reason = F.when(~alone, "correlated_with_existing_candidate").when(passes, "validation_thresholds_passed").otherwise("validation_thresholds_failed")
    return told.select("candidate", F.when(alone & passes, "accepted").otherwise("rejected").alias("decision"), reason.alias("reason"))


def unknown_formulas(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed rows (name, formula) that no known row has, by formula without white space and by name in lower case."""
    key = F.regexp_replace("formula", "\\s+", "")
    name = F.lower(F.trim("name"))
    left = proposed.withColumns({"key_": key, "name_": name})
    left = left.join(known.select(key.alias("key_")).distinct(), "key_", "left_anti")
    return left.join(known.select(name.alias("name_")).distinct(), "name_", "left_anti").drop("key_", "name_")


def own_books(long: DataFrame, outcome: str, k: int, by: tuple[str, ...] = ("candidate", "split"), per_year: int = 52) -> DataFrame:
    """(by, days, log_wealth, bench_log_wealth, annual_return, bench_annual_return, information_ratio) of each candidate's top-k book in each split."""
    daily = books.top_k_book(long, "f", outcome, k, by)
    grown = lambda c: F.sum(F.log1p(F.greatest(F.col(c), F.lit(-0.999999))))
    found = daily.groupBy(*by).agg(
        F.count("*").alias("days"), grown("ret").alias("log_wealth"), grown("bench").alias("bench_log_wealth"),
        (d.div(F.avg("excess"), F.stddev_samp("excess")) * per_year**0.5).alias("information_ratio"),
    )
    annual = lambda c: F.exp(F.col(c) * per_year / F.col("days")) - 1
    return found.withColumns({"annual_return": annual("log_wealth"), "bench_annual_return": annual("bench_log_wealth")})


def passes(annual: Column, bench: Column, ratio: Column) -> Column:
    """Accepted: a book that earns more than its benchmark, at a positive information ratio."""
    return F.coalesce((annual > bench) & (ratio > 0), F.lit(False))


def batch_scores(long: DataFrame, outcome: str, k: int, books_of: str = "validation") -> DataFrame:
    """(candidate, split, rank_ic, days, log_wealth, bench_log_wealth, information_ratio, accepted): accepted by the book of one split."""
    ic = period_metrics(long, outcome).select("candidate", "split", "rank_ic")
    own = own_books(long, outcome, k)
    told = own.where(F.col("split") == books_of)
    told = told.select("candidate", passes(F.col("annual_return"), F.col("bench_annual_return"), F.col("information_ratio")).alias("accepted"))
    joined = ic.join(own, ["candidate", "split"], "left").join(told, "candidate", "left").fillna(False, ["accepted"])
    return joined.select("candidate", "split", "rank_ic", "days", "log_wealth", "bench_log_wealth", "information_ratio", "accepted")


def family(formula: str = "formula") -> Column:
    """The window-family of a formula: windows as W, without white space."""
    rules = ((r"\s+", ""), (r"\((\d+)\)", "(W)"), (r",\d+\)", ",W)"))
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, F.col(formula))
