"""Price basis, limits, splits, candidates and curves on small fixtures: ties, nulls, constants and errors."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.catalog import alpha158, sleeves
from panelspark.functions.series import Stages
from panelspark.operators import books, candidates, diagnostics, labels, models, quality, signals, trading, universe
from panelspark.plans import factor_queries

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        (1, day(i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 100.0 + i, 11.0 if i else None, 9.0, "1" if i == 2 else None, None if i == 3 else 22.0 + i) for i in range(6)
    ]
    return spark.createDataFrame(rows, "instrument long, date date, open double, high double, low double, close double, vol double, up_limit double, down_limit double, is_suspended string, hfq_close double").cache()


def test_rising_bars_count_from_the_second_on(spark, panel):
    """The first bar has no bar before it: it is not known whether it rose."""
    stages = Stages()
    found = alpha158.flow(stages, 3)
    rows = stages.frame(panel, {"p": found["CNTP3"], "n": found["CNTN3"]}).orderBy("date").collect()
    assert [r["p"] for r in rows] == [None, None, None, 1.0, 1.0, 1.0] and [r["n"] for r in rows] == [None, None, None, 0.0, 0.0, 0.0]


def test_logic_of_comparisons(spark):
    frame = spark.createDataFrame([(1, DAY, 1.0, None), (2, DAY, 4.0, 3.0), (3, DAY, -8.0, 3.0)], "instrument long, date date, a double, b double")
    s = Stages()
    a, b = s.column("a"), s.column("b")
    made = {"and": (a > 0).both(b > 0), "or": (a > 0).either(b > 0), "not": (a > b).not_(), "in": a.between(1.0, 4.0), "eq": a.equals(4.0), "root": a.sqrt(), "cube": a.pow(3), "half": a.pow(0.5), "bits": a.log2(), "clip": a.clip(-1.0, 2.0)}
    rows = {r["instrument"]: r.asDict() for r in s.frame(frame, made).collect()}
    assert [rows[1][k] for k in made] == [0, 1, 1, 1, 0, 1, 1, 1, 0, 1]  # a comparison with NULL is false
    assert [rows[2][k] for k in made] == [1, 1, 0, 1, 1, 2, 64, 2, 2, 2]
    assert [rows[3][k] for k in made] == [0, 1, 1, 0, 0, None, -512, None, None, -1]


def test_price_basis_and_halts(panel):
    factor = trading.adjust_factor(F.col("hfq_close"), F.col("close"))
    rows = panel.withColumn("f", factor).orderBy("date").collect()
    assert [r["f"] for r in rows] == [2.0 if i == 0 else 1.0 if i == 3 else (22.0 + i) / (11.0 + i) for i in range(6)]
    halted = trading.without_halts(panel, F.col("is_suspended") == "1").orderBy("date").collect()
    assert [r["close"] is None and r["vol"] is None for r in halted] == [i == 2 for i in range(6)]
    assert trading.on_basis(panel, "adjusted", ("close", "vol")).columns == ["instrument", "date", "close", "vol"]
    for wrong in (("adjusted", ("open",)), ("raw", ("nothing",)), ("both", ("open",))):
        with pytest.raises(ValueError):
            trading.on_basis(panel, *wrong)


def test_opening_needs_the_next_bar(panel):
    filters = [trading.OpenFilter(frozenset({"open", "up_limit", "down_limit"}), trading.open_inside_limits()), trading.OpenFilter(frozenset({"close", "vol"}), F.col("vol") > 100)]
    assert [f.at_fill for f in filters] == [True, False]
    rows = trading.may_open(panel, filters).orderBy("date").collect()
    # opened below 11 only on the first two days, and the first has no upper limit; a signal is filled on the next day
    assert [r["may_open"] for r in rows] == [False] * 6
    loose = [trading.OpenFilter(frozenset({"open", "up_limit"}), F.col("open") <= F.col("up_limit"))]
    assert [r["may_open"] for r in trading.may_open(panel, loose).orderBy("date").collect()] == [True, False, False, False, False, False]
    assert all(r["may_open"] for r in trading.may_open(panel, []).collect())
    assert trading.verifiable(panel).count() == 5 and trading.verifiable(panel.drop("up_limit")).count() == 0
    assert trading.verifiable(panel.drop("is_suspended"), limits=False, suspension=True).count() == 0


def test_splits_and_segments(spark, panel):
    ends = ("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05")
    assert [r["split"] for r in trading.three_way(panel, *ends).orderBy("date").collect()] == ["train", "train", "validation", "validation", "test"]
    with pytest.raises(ValueError):
        trading.three_way(panel, "2024-01-01", "2024-01-04", "2024-01-04", "2024-01-05")
    masks = trading.score_parts(panel, "2024-01-02", "2024-01-04", "2024-01-03").orderBy("date").collect()
    assert [(r["is_train"], r["is_valid"], r["is_score"]) for r in masks] == [(True, False, False)] * 2 + [(False, True, False), (False, True, True)] + [(False, False, True)] * 2
    many = spark.createDataFrame([(i, DAY, float(i)) for i in range(10)] + [(20, DAY, None)], "instrument long, date date, turn double")
    assert sorted(r["instrument"] for r in trading.in_segment(many, many, "turn", 5).collect()) == [8, 9]
    with pytest.raises(ValueError):
        trading.in_segment(many, many, "turn", 6)


def test_codes_and_dates(spark):
    frame = spark.createDataFrame([("600001.SH",), ("688001.SH",), ("689009.SH",), ("301001.SZ",), ("430001.BJ",), (None,)], "code string")
    assert [r[0] for r in frame.select(universe.on_main_boards("code")).collect()] == [True, False, False, True, False, None]
    assert [r[0] for r in frame.select(universe.off_boards("code")).collect()] == [False, True, False, True, False, None]
    both = frame.withColumn("p", universe.to_prefixed("code")).select("code", universe.to_suffixed("p").alias("s")).where("code is not null")
    assert all(r["code"] == r["s"] for r in both.collect())
    dates = spark.createDataFrame([("2024-02-29",), ("20240229",), ("2024/02/30",), ("x",), (None,)], "d string")
    assert [r[0] for r in dates.select(universe.iso_date("d")).collect()] == ["2024-02-29", "2024-02-29", None, None, None]


def test_bins_of_constants_and_empty_columns(spark):
    frame = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [tuple(r) for r in diagnostics.equal_bins(frame, "v").collect()] == [(0, 1.0, 1.0, 2)]
    assert diagnostics.equal_bins(frame.where("v is null"), "v").count() == 0
    edge = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert [r["count"] for r in diagnostics.equal_bins(edge, "v").orderBy("bin").collect()] == [2] + [1] * 9  # closed to the right


def test_benchmark_curves(spark):
    calendar = spark.createDataFrame([(day(i), i + 1) for i in range(5)], "date date, session int")
    prices = spark.createDataFrame([(day(1), 50.0), (day(2), None), (day(3), 0.0), (day(4), 75.0)], "date date, close double")
    assert [(r["date"], r["equity"]) for r in books.benchmark_curve(prices, calendar, 100.0).orderBy("date").collect()] == [(day(1), 100.0), (day(2), 100.0), (day(3), 100.0), (day(4), 150.0)]
    assert books.benchmark_curve(prices.limit(0), calendar, 100.0).count() == 0


def test_ledger_carries_prices_from_before_the_first_trade(spark):
    calendar = spark.createDataFrame([(day(i), i + 1) for i in range(5)], "date date, session int")
    prices = spark.createDataFrame([(1, day(0), 10.0), (1, day(3), 12.0), (2, day(1), 5.0)], "instrument long, date date, close double")
    trades = spark.createDataFrame([(1, day(1), None, 2, 10.0, None), (2, day(1), day(2), 3, 5.0, 6.0)], "instrument long, buy_date date, sell_date date, quantity int, buy_price double, sell_price double")
    rows = books.ledger_curve(trades, calendar, prices, 100.0).orderBy("date").collect()
    assert [(r["cash"], r["invested"]) for r in rows] == [(100.0, 0.0), (65.0, 35.0), (83.0, 20.0), (83.0, 24.0), (83.0, 24.0)]


def test_candidates(spark):
    made = candidates.formulas(["close", "turn"], ["identity", "pct_change"], [5, 10, 0], seed=1)
    assert len(made) == 6 and made == candidates.formulas(["turn", "close"], ["identity", "pct_change"], [10, 5], seed=1)
    assert {candidates.name_of(c) for c in made} == {"close", "turn", "close_pct_change_5", "close_pct_change_10", "turn_pct_change_5", "turn_pct_change_10"}
    for wrong in ((["label"], ["identity"]), (["close"], ["future"])):
        with pytest.raises(ValueError):
            candidates.formulas(*wrong, [5])
    frame = spark.createDataFrame([("pct( close , 5 )",), ("pct(close,20)",), ("close.mean(10)",)], "formula string")
    assert [r[0] for r in frame.select(candidates.family()).collect()] == ["pct(close,W)", "pct(close,W)", "close.mean(W)"]


def test_sleeve_families_are_many_and_distinct(spark):
    stages, own = Stages(), factor_queries
    families = (own.base_sleeves, own.swept_sleeves, own.weighted_sleeves, own.blended_sleeves, own.masked_sleeves, own.index_sleeves, own.pool_sleeves)
    names = [name for family in families for name in family(stages)]
    assert len(names) == len(set(names)) >= 190
    parts = {"a": stages.column("a"), "b": stages.column("b"), "c": stages.column("c")}
    assert list(sleeves.sums(parts, "abc", (2, 3))) == ["sum_a_b", "sum_a_c", "sum_b_c", "sum_a_b_c"]
    frame = spark.createDataFrame([(0.25, 0.5, 1.0), (None, 0.5, 1.0)], "a double, b double, c double")
    made = sleeves.swept(parts, {"a": 1.0, "b": -2.0}, (0.0, 1.0)) | sleeves.swept_pairs(parts, {"a": 1.0, "c": 1.0}, 0.5, 2.0) | sleeves.replaced(parts, {"a": 1.0, "b": 1.0}, "b", ("c",))
    got = frame.select(*[x.form.alias(name) for name, x in made.items()]).collect()
    want = {"sweep_a_0000": 1.0, "sweep_b_0000": 0.25, "sweep_b_1000": 0.75, "pair_a_0500_c_2000": 2.125, "pair_c_0500_a_2000": 1.0, "for_b_c": 1.25}
    assert got[0].asDict() == want and [k for k, v in got[1].asDict().items() if v is not None] == ["sweep_a_0000"]


def test_masked_sleeves_hold_masks_tilts_and_a_cut(spark):
    rng = np.random.default_rng(9)
    closes = 100 + rng.normal(size=(10, 70)).cumsum(axis=1)
    opens = closes + rng.normal(size=(10, 70))
    rows = [
        (i, day(d), float(opens[i, d]), float(closes[i, d] + 3), float(closes[i, d] - 3), float(closes[i, d]), *[float(x) for x in rng.uniform(1, 9, 7)], int(i % 3 == 0))
        for i in range(10) for d in range(70)
    ]
    columns = ["open", "high", "low", "close", "vol", "amount", "turn", "pe_ttm", "dividend_yield_ratio", "total_market_cap", "float_market_cap"]
    stages = Stages()
    frame = spark.createDataFrame(rows, f"instrument long, date date, {', '.join(f'{c} double' for c in columns)}, st_status int")
    got = stages.frame(frame, factor_queries.masked_sleeves(stages)).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)
    panel = pd.DataFrame(rows, columns=["instrument", "date", *columns, "st_status"])
    rank = lambda x: x.groupby(panel["date"]).rank(pct=True)
    close = panel.groupby("instrument")["close"]
    high60 = close.transform(lambda x: x.rolling(60).rank(pct=True))
    base = high60 + rank(panel["total_market_cap"]) + rank(panel["dividend_yield_ratio"]) + 1.2 * (1 - rank(panel["pe_ttm"]))
    amount, flagged = panel.groupby("instrument")["amount"], panel["st_status"] == 1
    above = {n: panel["close"] > close.transform(lambda x, n=n: x.rolling(n).mean()) for n in (20, 60)}
    want = {
        "mask_busy": base.where(panel["amount"] > amount.transform(lambda x: x.rolling(20).mean())), "mask_above20": base.where(above[20]), "mask_above60": base.where(above[60]), "mask_unflagged": base.where(~flagged),
        "mask_quiet": base.where(1 - rank(panel["turn"]) - 0.2 > 0), "tilt_move10_n0500": base + 0.5 * (1 - rank(panel["close"] / close.shift(10))), "tilt_gap_n0500": base + 0.5 * (1 - rank(panel["open"] / close.shift(1))),
        "again_unflagged": rank(base.where(~flagged)),
    }
    assert set(want) == set(got.columns) - {"instrument", "date"}
    for name, x in want.items():
        assert x.notna().any() and np.allclose(got[name].astype(float), x, atol=1e-9, equal_nan=True), name


def test_walk_forward_without_folds(spark):
    panel = spark.createDataFrame([(1, day(i), float(i), float(i % 3)) for i in range(5)], "instrument long, date date, x double, label double")
    calendar = panel.select("date").withColumn("session", F.dayofmonth("date"))
    folds = labels.walk_forward_folds(calendar, 24, 6, 2)
    assert folds.count() == 0 and models.walk_forward(panel, folds, ("x",), "label", "ols").count() == 0


def test_gates(spark, panel):
    summary = spark.createDataFrame([("a", 0.99, 10), ("b", 0.5, 10), ("c", 0.99, 2), ("d", None, 9), ("e", 0.9, 9)], "name string, coverage double, effective_days int")
    floors = spark.createDataFrame([(n, 5, 0.95) for n in "abcd"], "name string, least_days int, least_coverage double")
    told = {r["name"]: (r["publish"], r["reason"]) for r in quality.publish_gate(summary, floors).collect()}
    assert told == {"a": (True, "passed"), "b": (False, "too little coverage"), "c": (False, "too few days"), "d": (False, "too little coverage"), "e": (False, "too few days")}
    row = quality.verdict(panel, ("open", "close"), ("instrument", "date"), 6, ("2024-01-01", "2024-01-06")).first()
    assert row["status"] == "passed" and quality.verdict(panel, ("missing",), ("instrument", "date"), 6, ("a", "b")).first()["status"] == "needs_review"


def test_suspensions_are_counted(spark, panel):
    marked = panel.withColumn("eligible", F.col("instrument") == 1)
    stopped = spark.createDataFrame([(1, day(1), "S"), (1, day(2), "R")], "instrument long, date date, suspend_type string")
    row = universe.suspension_counts(marked, universe.apply_suspensions(marked, stopped)).first()
    assert (row["marked"], row["cleared"]) == (1, 1)


def test_trend_scores_that_are_equal_but_for_rounding_are_ties(spark, monkeypatch):
    ranks = {1: (1, 3, 4), 2: (4, 1, 2), 3: (5, 5, 5), 4: (3, 4, 3), 5: (2, 2, 1)}  # of histogram, momentum and RSI; 1 and 2 have 0.49
    one, two = (0.40 * (a / 5) + 0.35 * (b / 5) + 0.25 * (c / 5) for a, b, c in (ranks[1], ranks[2]))
    assert one < two and round(one, 9) == round(two, 9)
    rows = [(i, day(d), 100.0 + (m if d == 20 else 0), 0, 2.0, 1.0, 2.0, 1.0, float(h), 50.0 + s) for i, (h, m, s) in ranks.items() for d in range(21)]
    panel = spark.createDataFrame(rows, "instrument long, date date, close double, st_status int, ema_20 double, ema_60 double, dif double, dea double, macd_hist double, rsi_14 double")
    monkeypatch.setattr(signals, "exponential_indicators", lambda found: found)
    picks = signals.trend_signal(panel, top=3, least_days=20).collect()
    assert sorted(p["instrument"] for p in picks) == [1, 3, 4]
    members = panel.select("date", "instrument")  # all of them, some twice
    picks = signals.trend_signal(panel, top=3, least_days=20, members=members.union(members.limit(30))).collect()
    assert sorted(p["instrument"] for p in picks) == [1, 3, 4]
