"""Panel operators on small literal frames with hand-computed or pandas expectations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.functions.catalog import alpha158, alpha191, pack
from panelspark.functions.series import Stages
from panelspark.operators import archive, books, diagnostics, labels, models, quality, universe
from panelspark.operators.buckets import daily_quintile, label_bins
from panelspark.operators.signals import ewm_mean, exponential_indicators
from panelspark.plans import factor_queries

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def random_panel(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame([(i, day(d), rng.normal() if rng.random() > 0.1 else None, float(rng.integers(0, 4))) for i in range(4) for d in range(40)], columns=["instrument", "date", "x", "y"])
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "instrument long, date date, x double, y double").cache()


def _compare(spark_panel, column, pandas_series, frame, digits=9):
    got = spark_panel.select("instrument", "date", column.alias("v")).toPandas().sort_values(["instrument", "date"])["v"].astype(float).to_numpy()
    assert np.allclose(got, pandas_series.astype(float).to_numpy(), atol=10**-digits, equal_nan=True)


def test_rolling_functions_equal_pandas(random_panel):
    frame, panel = random_panel
    by = frame.groupby("instrument")["x"]
    x = F.col("x")
    _compare(panel, w.rolling_mean(x, 5), by.transform(lambda s: s.rolling(5).mean()), frame)
    _compare(panel, w.rolling_std(x, 5), by.transform(lambda s: s.rolling(5).std()), frame)
    _compare(panel, w.rolling_max(x, 3), by.transform(lambda s: s.rolling(3).max()), frame)
    _compare(panel, w.rolling_quantile(x, 5, 0.8), by.transform(lambda s: s.rolling(5).quantile(0.8)), frame)
    _compare(panel, w.ts_rank(F.col("y"), 6), frame.groupby("instrument")["y"].transform(lambda s: s.rolling(6).rank(pct=True)), frame)
    _compare(panel, w.cs_rank(x), frame.groupby("date")["x"].rank(pct=True), frame)
    want = frame.groupby("instrument", group_keys=False)[["x", "y"]].apply(lambda g: g["x"].rolling(5).corr(g["y"]))
    _compare(panel, w.rolling_corr(x, F.col("y"), 5), want.replace([np.inf, -np.inf], np.nan), frame, 6)


def test_constant_windows_have_no_correlation(spark):
    panel = spark.createDataFrame([(1, day(d), float(d), 5.0) for d in range(6)], "instrument long, date date, x double, y double")
    row = panel.select(w.rolling_corr(F.col("x"), F.col("y"), 3).alias("a"), w.rolling_corr_zero(F.col("x"), F.col("y"), 3).alias("b"), w.ts_zscore(F.col("y"), 3).alias("c")).collect()[-1]
    assert row["a"] is None and row["b"] == 0.0 and row["c"] is None


def test_long_correlations_are_rounded_as_short_ones(spark):
    rng = np.random.default_rng(8)
    panel = spark.createDataFrame([(i, day(d), float(rng.normal()), float(rng.normal())) for i in range(40) for d in range(103)], "instrument long, date date, x double, y double")

    def formulas(s):
        tied = {f"corr_{n}": s.column("x").rolling_corr(s.column("y"), n) for n in (5, 100)}
        return tied | {f"rank_{name}": x.cs_rank() for name, x in tied.items()}

    rounded, plain = Stages(corr_digits=1), Stages()
    got = rounded.frame(panel, formulas(rounded)).orderBy("instrument", "date").toPandas()
    free = plain.frame(panel, formulas(plain)).orderBy("instrument", "date").toPandas()
    for n in (5, 100):
        want = free[f"corr_{n}"].round(1)
        assert np.allclose(got[f"corr_{n}"], want, atol=1e-12, equal_nan=True) and want.notna().any()
        assert np.allclose(got[f"rank_corr_{n}"], want.groupby(got["date"]).rank(pct=True), atol=1e-12, equal_nan=True)
        assert free[f"corr_{n}"].dropna().nunique() > 10 * want.nunique()


def test_quintiles_equal_qcut(spark):
    rng = np.random.default_rng(1)
    values = [rng.normal(size=23), rng.integers(0, 3, 20).astype(float), np.ones(10), np.arange(4.0), np.arange(5.0)]
    rows = [(i, day(d), float(v)) for d, vs in enumerate(values) for i, v in enumerate(vs)]
    got = daily_quintile(spark.createDataFrame(rows, "instrument long, date date, x double"), "x").toPandas()
    for d, vs in enumerate(values):
        own = got[got["date"] == day(d)].sort_values("instrument")["bucket"]
        if len(vs) < 5 or len(set(vs)) == 1:
            assert own.isna().all()
        else:
            assert list(own.astype(int)) == list(pd.qcut(vs, 5, labels=False, duplicates="drop") + 1)


def test_label_bins_clip_and_count(spark):
    rows = [(i, day(0), float(i)) for i in range(100)] + [(200, day(0), None)]
    bins = {r["instrument"]: r["bin"] for r in label_bins(spark.createDataFrame(rows, "instrument long, date date, y double"), "y").collect()}
    assert len(bins) == 100 and bins[0] == 0 and bins[99] == 19 and bins[50] == 10


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, day(d), float(i), float(i if d % 2 else -i), float(i % 3)) for d in range(4) for i in range(10)]
    return spark.createDataFrame(rows, "instrument long, date date, f double, y double, cap double").cache()


def test_daily_ic_and_summary(scores):
    daily = diagnostics.daily_ic(scores, "f", "y")
    assert [round(r["ic"], 9) for r in daily.orderBy("date").collect()] == [-1.0, 1.0, -1.0, 1.0]
    row = diagnostics.ic_summary(daily).first()
    assert (row["ic_mean"], row["ic_positive"], row["ic_std"], row["days"]) == (0.0, 0.5, 1.0, 4)
    assert diagnostics.daily_ic(scores, "f", "y", least=11).count() == 0


def test_quintile_returns_and_turnover(scores):
    spread = {r["date"]: (r["spread"], r["monotonicity"]) for r in diagnostics.quintile_spread(diagnostics.quintile_returns(scores, "f", "y")).collect()}
    assert spread[day(1)] == (8.0, pytest.approx(1.0)) and spread[day(0)] == (-8.0, pytest.approx(-1.0))
    assert [r["turnover"] for r in diagnostics.top_turnover(scores, "y").orderBy("date").collect()] == [1.0, 1.0, 1.0]


def test_histogram_counts_all_rows(spark):
    rows = [(float(x),) for x in np.random.default_rng(2).lognormal(size=2000)]
    found = diagnostics.histogram(spark.createDataFrame(rows, "x double"), "x").toPandas()
    assert found["count"].sum() == 2000 and len(found) == 62 and found.set_index("bin").loc[-1, "count"] == 20
    cdf = spark.range(1).select(diagnostics.normal_cdf(F.lit(1.96)).alias("a"), diagnostics.normal_cdf(F.lit(-1.0)).alias("b")).first()
    assert cdf["a"] == pytest.approx(0.9750021, abs=1e-6) and cdf["b"] == pytest.approx(0.1586553, abs=1e-6)


def test_distribution_equals_pandas(spark):
    values = np.random.default_rng(3).normal(size=200)
    row = diagnostics.distribution(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double"), "x").first()
    s = pd.Series(values)
    assert (row["rows"], row["values"]) == (201, 200)
    assert row["skew"] == pytest.approx(s.skew()) and row["kurtosis"] == pytest.approx(s.kurt()) and row["std"] == pytest.approx(s.std(ddof=0)) and row["p95"] == pytest.approx(s.quantile(0.95))


def test_greedy_acceptance(scores):
    panel = scores.withColumn("g", F.col("f") * 2 + 1)
    factors = ("f", "g", "cap")
    assert diagnostics.accepted(diagnostics.pair_correlations(panel, factors), factors, 0.9) == ["f", "cap"]


@pytest.fixture(scope="module")
def members(spark):
    rows = [("A", day(0), 1, 0.5), ("A", day(0), 2, 0.5), ("B", day(2), 3, 1.0), ("A", day(4), 2, 1.0)]
    return spark.createDataFrame(rows, "index_code string, snapshot date, con_code long, weight double").cache()


def test_pooled_membership_drops_an_index_without_a_newest_row(spark, members):
    panel = spark.createDataFrame([(i, day(d)) for i in (1, 2, 3) for d in range(-1, 6)], "instrument long, date date")
    found = universe.members_pooled(panel, panel.select("date").distinct(), members).collect()
    held = {}
    for r in found:
        held.setdefault((r["date"] - DAY).days, set()).add(r["instrument"])
    assert held == {0: {1, 2}, 1: {1, 2}, 2: {3}, 3: {3}, 4: {2}, 5: {2}}


def test_membership_by_index_spans_and_tenure(spark, members):
    days = spark.createDataFrame([(day(d),) for d in range(6)], "date date")
    now = {(r["index_code"], r["instrument"]) for r in universe.members_by_index(days, members).where(F.col("date") == F.lit(day(3))).collect()}
    assert now == {("A", 1), ("A", 2), ("B", 3)}
    before = {(r["index_code"], r["instrument"]) for r in universe.members_before(days, members).where(F.col("date") == F.lit(day(5))).collect()}
    assert before == {("B", 3)}  # snapshot dates of all indexes are pooled
    assert {(r["con_code"], r["snapshots"]) for r in universe.spans(members).collect()} == {(1, 1), (2, 2), (3, 1)}
    assert {(r["con_code"], r["tenure"]) for r in universe.tenure(members).collect()} == {(1, 1), (2, 1), (2, 2), (3, 1)}


def test_first_matching_index_decides_the_gate(spark, members):
    panel = spark.createDataFrame([(1, day(0)), (3, day(2))], "instrument long, date date")
    named = spark.createDataFrame([("A", day(0), 1), ("B", day(0), 1), ("B", day(2), 3)], "index_code string, date date, instrument long")
    gates = spark.createDataFrame([("A", day(0), False), ("B", day(0), True), ("B", day(2), True)], "index_code string, date date, open boolean")
    assert [r["instrument"] for r in universe.priority_gate(panel, named, gates, ("A", "B")).collect()] == [3]


def test_filters_and_flags(spark):
    codes = spark.createDataFrame([("600000.SH", "1"), ("688001.SH", "true"), ("300001.SZ", None), ("830001.BJ", "no")], "code string, flag string")
    row = codes.select(universe.on_main_boards("code").alias("m"), universe.on_exchanges("code", (".SH",)).alias("s"), universe.truthy("flag").alias("t")).collect()
    assert [tuple(r) for r in row] == [(True, True, True), (False, True, True), (True, False, False), (False, False, False)]
    x = spark.createDataFrame([(None,), (2.0,)], "x double")
    assert x.where(~w.two_valued(F.col("x") > 1)).count() == 1
    when = spark.range(1).select(universe.listed(F.lit(day(1)), F.lit(None).cast("date"), F.lit(day(1))).alias("v")).first()
    assert when["v"] is False


def test_ledger_curve_and_holdings(spark):
    trades = spark.createDataFrame([(1, 7, day(0), day(2), 10, 5.0, 6.0, 10.0), (2, 7, day(1), None, 10, 5.0, None, None)], "trade_id long, instrument long, buy_date date, sell_date date, quantity int, buy_price double, sell_price double, pnl double")
    days = spark.createDataFrame([(day(d), d) for d in range(4)], "date date, session int")
    prices = spark.createDataFrame([(7, day(0), 5.0), (7, day(1), 5.5)], "instrument long, date date, close double")
    assert sorted((r["trade_id"], (r["date"] - DAY).days) for r in books.daily_holdings(trades, days).collect()) == [(1, 0), (1, 1), (2, 1), (2, 2), (2, 3)]
    curve = [(r["cash"], r["invested"], r["equity"]) for r in books.ledger_curve(trades, days, prices, 100.0).orderBy("date").collect()]
    assert curve == [(50.0, 50.0, 100.0), (0.0, 110.0, 110.0), (60.0, 55.0, 115.0), (60.0, 55.0, 115.0)]
    assert books.top_name_share(trades).first()["share"] == 1.0


def test_book_costs_and_drawdown(spark):
    rows = [(1, day(0), 2.0, 0.1), (2, day(0), 1.0, 0.0), (1, day(1), 1.0, -0.1), (2, day(1), 2.0, 0.2)]
    book = books.top_k_book(spark.createDataFrame(rows, "instrument long, date date, s double, y double"), "s", "y", 1).orderBy("date").collect()
    assert book[0]["ret"] == pytest.approx(0.95 * 0.1 - 0.0005 * 0.95) and book[1]["ret"] == pytest.approx(0.95 * 0.2 - 0.002 * 0.95)
    curve = books.wealth(spark.createDataFrame([(day(0), -0.5), (day(1), 1.0)], "date date, ret double")).orderBy("date").collect()
    assert [round(r["drawdown"], 9) for r in curve] == [-0.5, 0.0]
    losses = spark.createDataFrame([(day(d), r) for d, r in enumerate((-1.0, -1.0, 1.0, -1.0))], "date date, ret double")
    assert books.longest_loss(losses).first()["streak"] == 2


def test_folds_and_embargo(spark):
    days = spark.createDataFrame([(day(d), d + 1) for d in range(400)], "date date, session int")
    folds = labels.walk_forward_folds(days, train_months=6, test_months=3, hold=1).orderBy("fold").collect()
    assert [r["train_from"] for r in folds] == [dt.date(2024, 1, 1), dt.date(2024, 4, 1)]
    assert folds[0]["test_from"] == dt.date(2024, 7, 1) and folds[0]["label_cutoff"] == dt.date(2024, 6, 29)
    panel = days.withColumn("instrument", F.lit(1))
    assert labels.embargoed(panel, days, "2024-01-11", hold=1).agg(F.max("date")).first()[0] == dt.date(2024, 1, 9)


def test_models_learn_a_line(spark):
    rng = np.random.default_rng(4)
    rows = [(i, day(d), float(x), float(3 * x + 1)) for d in range(20) for i, x in enumerate(rng.normal(size=5))]
    panel = spark.createDataFrame(rows, "instrument long, date date, x double, y double")
    for kind in ("ols", "huber"):
        found = models.fit_predict(panel.where(F.col("date") < F.lit(day(15))), panel, ("x",), "y", kind).join(panel, ["instrument", "date"])
        assert found.select(F.max(F.abs(F.col("score") - F.col("y")))).first()[0] < 0.1
    assert models.fit_predict(panel.limit(3), panel, ("x",), "y", "ols").count() == 0


def test_exponential_indicators_equal_pandas(spark):
    closes = pd.Series(np.random.default_rng(5).normal(size=80).cumsum() + 100)
    panel = spark.createDataFrame([(1, day(d), float(c)) for d, c in enumerate(closes)], "instrument long, date date, close double")
    got = exponential_indicators(panel).orderBy("date").toPandas()
    assert np.allclose(got["ema_20"], closes.ewm(span=20, adjust=False).mean()) and got["rsi_14"].iloc[1:].between(0, 100).all()
    assert ewm_mean(panel, "close", 10, "e").where("e is null").count() == 9


def test_quality_helpers(spark):
    rows = spark.createDataFrame([(1, day(0), 1.0), (1, day(0), 2.0), (2, day(3), 3.0)], "instrument long, date date, v double")
    assert tuple(quality.duplicate_keys(rows, ("instrument", "date")).first()) == (3, 1)
    merged = quality.merge_rows(rows.limit(1), spark.createDataFrame([(1, day(0), 9.0, "new")], "instrument long, date date, v double, note string"), ("instrument", "date")).collect()
    assert len(merged) == 1 and merged[0]["v"] == 9.0 and merged[0]["note"] == "new"
    many = spark.createDataFrame([(1, day(d)) for d in range(100)], "instrument long, date date")
    assert [(r["date"] - DAY).days for r in quality.downsample(many, ("instrument",), "date", 5).orderBy("date").collect()] == [0, 25, 50, 74, 99]


def test_archive(spark):
    rows = [(k, DAY, "completed", '{"test": {"date_from": "%d-01-01", "date_to": "%d-12-31"}, "top_n": %d, "factor_versions": ["b", "a", "b"], "weighting": "eq"}' % (y, y, n), '{"sharpe": %f, "excess_return": 0.1}' % s) for k, (y, n, s) in enumerate([(2020, 1, 1.0), (2020, 2, 2.0), (2021, 1, 3.0), (2021, 2, 0.5)])]
    found = archive.summaries(spark.createDataFrame(rows, "run_id long, finished date, status string, config_json string, metrics_json string"))
    assert found.first()["factor_key"] == "a,b"
    replay = archive.champion_replay(archive.expert_grid(found)).orderBy("year").collect()
    assert [(r["year"], r["sharpe"]) for r in replay] == [(2021, 0.5), (2022, None)]


def test_catalogue_sizes():
    text = lambda formulas: formulas(Stages(sql=True))
    assert len(text(pack.canonical)) == 50 and len(text(pack.builtin)) == 7 and len(text(pack.moneyflow)) == 4
    assert len(text(alpha158.alpha158)) == 158
    assert len(text(alpha191.price_alphas)) + len(text(alpha191.correlation_alphas)) == 69
    assert len(text(factor_queries.base_sleeves)) == 20
