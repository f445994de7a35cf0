"""Rolling passes, models from sums, exact quantiles, scans and lots against plain computation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.functions.catalog import alpha158, alpha191, pack
from panelspark.functions.series import Stages
from panelspark.operators import gram, labels, models, rolling
from panelspark.operators.sections import Section, with_sections
from panelspark.plans import REGISTRY, factor_queries, recursive_queries

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def histories(spark):
    """A long history, short ones, one of constants, one with gaps; instrument may be NULL."""
    rng = np.random.default_rng(3)
    rows = []
    for name, size in ((1, 90), (2, 4), (3, 1), (4, 40), (None, 25)):
        for i in range(size):
            x = 5.0 if name == 4 and i > 10 else float(rng.integers(0, 6)) if name == 1 else float(rng.normal(1e4, 1))
            rows.append((name, day(i), None if rng.random() < 0.06 and name != 4 else x, float(rng.normal()), "kept"))
    frame = pd.DataFrame(rows, columns=["instrument", "date", "x", "y", "block_"])
    return frame, spark.createDataFrame(rows, "instrument long, date date, x double, y double, note string").repartition(3).cache()


def brute(values, others, kind, n, q):
    out = []
    for i in range(len(values)):
        w, v = values[max(0, i - n + 1) : i + 1], others[max(0, i - n + 1) : i + 1]
        if len(w) < n or np.isnan(w[-1]) or (kind != "ts_rank" and (np.isnan(w).any() or (kind in ("rolling_cov", "rolling_corr", "rolling_corr_zero") and np.isnan(v).any()))):
            out.append(np.nan)
            continue
        t, flat = np.arange(n), (w == w[0]).all()
        line = np.polyfit(t, w, 1) if not flat and n > 1 else (0.0, w[0])
        out.append(
            {
                "ts_rank": lambda: ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / n, "rolling_quantile": lambda: np.quantile(w, q or 0.5), "rolling_rank_share": lambda: (w <= w[-1]).mean(),
                "bars_since_max": lambda: n - 1 - np.flatnonzero(w == w.max())[-1], "bars_since_min": lambda: n - 1 - np.flatnonzero(w == w.min())[-1], "rolling_max": lambda: w.max(), "rolling_min": lambda: w.min(),
                "rolling_mean": lambda: w.mean(), "rolling_sum": lambda: w.sum(), "rolling_std": lambda: 0.0 if flat else w.std(ddof=1), "ols_slope": lambda: line[0],
                "ols_rsquare": lambda: 0.0 if flat else np.corrcoef(t, w)[0, 1] ** 2, "ols_residual": lambda: w[-1] - (line[0] * (n - 1) + line[1]), "rolling_cov": lambda: 0.0 if flat else np.cov(w, v)[0, 1],
                "rolling_corr": lambda: np.nan if flat else np.corrcoef(w, v)[0, 1], "rolling_corr_zero": lambda: 0.0 if flat else np.corrcoef(w, v)[0, 1],
            }[kind]()
        )
    return np.array(out, dtype=float)


@pytest.mark.parametrize(("n", "block"), [(2, 5), (7, 7), (7, 8), (13, 1000), (30, 11)])
def test_rolling_passes_equal_brute_force(histories, n, block):
    frame, panel = histories
    pairs = ("rolling_cov", "rolling_corr", "rolling_corr_zero")
    calls = {kind: rolling.Rolling(kind, F.col("x"), n, F.col("y") if kind in pairs else None, 0.3 if kind == "rolling_quantile" else None) for kind in rolling.KINDS}
    got = rolling.with_rolling(panel, calls, block_rows=block).toPandas()
    assert len(got) == len(frame) and set(got["note"]) == {"kept"}
    for name, own in frame.groupby("instrument", dropna=False):
        mine = got[got["instrument"].isna() if pd.isna(name) else got["instrument"] == name].sort_values("date")
        for kind in rolling.KINDS:
            want = brute(own["x"].to_numpy(float), own["y"].to_numpy(float), kind, n, 0.3)
            assert np.allclose(mine[kind].to_numpy(float), want, rtol=1e-7, atol=1e-7, equal_nan=True), (name, kind)


def test_a_long_history_is_spread_over_tasks(spark):
    panel = spark.range(5_000).select(F.lit(1).alias("instrument"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), F.sin("id").alias("x"))
    made = rolling.with_rolling(panel, {"m": rolling.Rolling("rolling_mean", F.col("x"), 50)}, block_rows=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows are read by one task
    try:
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.where("m is not null").count() == 4_951
    assert rolling.with_rolling(panel.limit(0), {"m": rolling.Rolling("rolling_max", F.col("x"), 5)}).count() == 0
    plan = made._jdf.queryExecution().toString()
    assert "collect_list" not in plan


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1.0]]) + [1000, 0, -5]
    y = x @ [0.5, -1.0, 0.0] + rng.normal(size=400) * 0.3
    rows = [(i % 20, day(i // 4), *map(float, v), float(t) if i % 31 else None) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "instrument long, date date, a double, b double, c double, label double").cache()


@pytest.mark.parametrize("kind", ["ols", "ridge", "lasso", "elastic_net"])
def test_models_from_sums_equal_fits_on_rows(training, kind):
    features = ("a", "b", "c")
    window = training.agg(F.lit(7).alias("fold"), F.min("date").alias("from_"), F.max("date").alias("to_"))
    found = gram.fold_models(training, window, features, "label", kind, alpha=0.05).first()
    want = {r["feature"]: r["value"] for r in models.coefficients(training, features, "label", kind, alpha=0.05).collect()}
    tight = 1e-6 if kind in ("ols", "ridge") else 1e-4  # the fit on rows stops at its own tolerance
    assert found["fold"] == 7 and np.allclose(found["coefficients"], [want[c] for c in features], atol=tight)
    assert abs(found["intercept"] - want["intercept"]) < 1000 * tight


def test_folds_are_fitted_in_one_job(spark, training):
    calendar = training.select("date").distinct().withColumn("session", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("date")))
    folds = labels.walk_forward_folds(calendar, train_months=1, test_months=1, hold=1)
    got = gram.walk_forward(training, folds, ("a", "b"), "label", "ridge")
    want = models.walk_forward(training, folds, ("a", "b"), "label", "ridge")
    a, b = ({(r["fold"], r["instrument"], r["date"], round(r["a_"], 3)): r["score"] for r in x.join(training.select("instrument", "date", F.col("a").alias("a_")), ["instrument", "date"]).collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) > 50 and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert gram.walk_forward(training, folds.limit(0), ("a", "b"), "label", "ridge").count() == 0


@pytest.mark.parametrize(("rows", "items"), [(10, 16), (40, 64), (100_000, 4096)])
def test_quantiles_by_sketch_and_selection_are_exact(spark, monkeypatch, rows, items):
    from panelspark.operators import quantiles

    monkeypatch.setattr(quantiles, "SELECTED_ROWS", rows)
    monkeypatch.setattr(quantiles, "SKETCH_ITEMS", items)
    rng = np.random.default_rng(1)
    x = rng.normal(size=3_000) ** 3
    tied = rng.integers(0, 4, 3_000).astype(float)  # few values, each of many rows
    data = [(float(a), float(b) if i % 5 else None, 7.0, None) for i, (a, b) in enumerate(zip(x, tied))] + [(float("nan"), None, None, None)]
    frame = spark.createDataFrame(data, "x double, tied double, one double, none double").repartition(5)
    marks = (0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0)
    got = quantiles.exact_quantiles(frame, {c: F.col(c) for c in frame.columns}, marks)
    assert got["x"] == pytest.approx(list(np.quantile(x, marks)), abs=1e-12)
    assert got["tied"] == list(np.quantile([b for i, b in enumerate(tied) if i % 5], marks)) and got["one"] == [7.0] * 7 and got["none"] == [None] * 7
    single = quantiles.exact_quantiles(frame.limit(1), {"x": F.col("x")}, marks)["x"]
    assert len(set(single)) == 1 and quantiles.exact_quantiles(frame.limit(0), {"x": F.col("x")}, marks)["x"] == [None] * 7


def test_lots_are_matched_first_in_first_out(spark):
    from panelspark.operators import books

    rng = np.random.default_rng(4)
    rows = [(name, i, "buy" if rng.random() < 0.6 else "sell", int(rng.integers(1, 6)), float(rng.integers(1, 9))) for name, size in ((1, 40), (2, 3), (3, 1), (None, 12)) for i in range(size)]
    frame = spark.createDataFrame(rows, "instrument long, fill long, side string, quantity long, price double").repartition(4)
    want = []
    for name in (1, 2, 3, None):
        own = [r for r in rows if r[0] == name]
        buys, sells = ([(r[1], r[4]) for r in own if r[2] == side for _ in range(r[3])] for side in ("buy", "sell"))  # unit by unit
        units = [(buys[k] if k < len(buys) else (None, None), sells[k] if k < len(sells) else (None, None)) for k in range(max(len(buys), len(sells)))]
        for (b, bp), (s, sp) in sorted(set(units), key=str):
            n = units.count(((b, bp), (s, sp)))
            want.append((name, b, s, n, None if b is None or s is None else (sp - bp) * n))
    got = [(r["instrument"], r["buy"], r["sell"], r["quantity"], r["profit"]) for r in books.lot_ledger(frame, ("fill",)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert books.lot_ledger(frame.limit(0), ("fill",)).count() == 0


def test_exponential_means_equal_pandas(spark):
    """Long histories over several blocks, gaps (also longer than a block), leading unknown values, decays that need two passes."""
    from panelspark.operators import signals

    rng = np.random.default_rng(5)
    rows = []
    for name, size in ((1, 900), (2, 5), (None, 40), (3, 1)):
        x = rng.normal(50, 30, size)
        x[rng.random(size) < 0.1] = np.nan
        if name == 1:
            x[:3], x[300:650] = np.nan, np.nan
        rows += [(name, day(i), None if np.isnan(v) else float(v), "kept") for i, v in enumerate(x)]
    frame = pd.DataFrame(rows, columns=["k", "date", "x", "block_"])
    panel = spark.createDataFrame(rows, "instrument long, date date, x double, note string").repartition(3)
    alphas = {"slow": 0.25, "fast": 0.5, "quick": 0.95, "long": 0.02}
    got = signals.exponential_means(panel, {name: (F.col("x"), a) for name, a in alphas.items()}).toPandas()
    assert len(got) == len(frame) and list(got.columns) == ["instrument", "date", "x", "note", *alphas]
    for name, own in frame.groupby("k", dropna=False):
        mine = got[got["instrument"].isna() if pd.isna(name) else got["instrument"] == name].sort_values("date")
        for column, a in alphas.items():
            assert np.allclose(mine[column].to_numpy(float), own["x"].astype(float).ewm(alpha=a, adjust=False).mean().to_numpy(), rtol=1e-9, atol=1e-12, equal_nan=True), (name, column)
    assert "Pandas" not in signals.exponential_means(panel, {"m": (F.col("x"), 0.1)})._jdf.queryExecution().toString()
    assert signals.exponential_means(panel.limit(0), {"m": (F.col("x"), 0.1)}).count() == 0


def test_correlations_of_many_columns_equal_pairwise_ones(spark):
    from panelspark.operators import pairwise

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 130)) + 1e6 * (np.arange(130) % 3)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8] = 3.5, np.nan
    x[5, 9] = np.inf
    names = tuple(f"c{i}" for i in range(130))
    frame = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in pairwise.correlations(frame, names, tile=32).collect()}
    assert len(got) == 130 * 129 // 2
    x[5, 9] = np.nan
    for i in range(0, 130, 3):
        for j in range(i + 1, 130, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = np.corrcoef(a, b)[0, 1] if both.sum() > 1 and a.std() > 0 and b.std() > 0 else None
            n, corr = got[names[i], names[j]]
            assert n == both.sum() and (corr is None) == (want is None) and (want is None or abs(corr - want) < 1e-7)
    none = pairwise.correlations(frame.limit(0), names[:3]).collect()
    assert all(r["n"] == 0 and r["corr"] is None for r in none)


def test_a_laid_out_panel_needs_no_shuffle(spark):
    from panelspark.functions import window as w
    from panelspark.plans import layout_queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = layout_queries.laid_out(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    made = found.withColumn("m", w.rolling_mean(F.col("close"), 5))
    assert "Window" in plan(made) and "Exchange" not in plan(made)
    # The join itself: as it is planned where part of the keys may do.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        tables = [t.name for t in spark.catalog.listTables() if t.name.startswith(("bars_", "flows_"))]
        bars, flows = (spark.table(next(t for t in tables if t.startswith(x))) for x in ("bars_", "flows_"))
        joined = plan(bars.join(flows.hint("merge"), ["instrument", "date"], "left"))
        assert "SortMergeJoin" in joined and "Exchange" not in joined
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")


def test_sections_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    values = [None, float("nan"), -0.0, 0.0, *rng.normal(size=6).tolist()]
    rows = [(i, None if d == 3 else d, values[rng.integers(len(values))], None if d == 2 else float(rng.integers(4))) for d in range(6) for i in range(1 if d == 4 else 50)]
    panel = spark.createDataFrame(rows, "instrument long, date long, x double, y double").repartition(3)
    calls = {"rx": Section("cs_rank", F.col("x")), "ry": Section("cs_rank", F.col("y")), "q": Section("cs_quantile", F.col("y"), 0.3), "again": Section("cs_rank", F.col("rx"))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = with_sections(panel, calls).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ranked = panel.withColumns({"rx": w.cs_rank(F.col("x")), "ry": w.cs_rank(F.col("y")), "q": w.cs_quantile(F.col("y"), 0.3)}).withColumn("again", w.cs_rank(F.col("rx")))
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, ranked.collect()))


#: Shuffles of a catalogue whose panel lies anywhere; a turn of calls over histories, of passes or of dates takes one.
TURNS = {
    "alpha191_price": (lambda s: alpha191.price_alphas(s), 3),
    "alpha191_corr": (alpha191.correlation_alphas, 7),
    "alpha191_corr_by_hand": (lambda s: {name: x for name, x in alpha191.correlation_alphas(s).items() if name in recursive_queries.CORR_COLUMNS}, 4),
    "pack_factors": (pack.canonical, 3),
    "sleeves_pool": (factor_queries.pool_sleeves, 4),
    "sleeves_blended": (factor_queries.blended_sleeves, 3),
    "sleeves_index": (factor_queries.index_sleeves, 4),
}


@pytest.mark.parametrize("name", TURNS)
def test_a_catalogue_shuffles_once_a_turn(spark, name):
    formulas, most = TURNS[name]
    columns = "open high low close vol amount turn pe_ttm dividend_yield_ratio total_market_cap float_market_cap index_weight tenure in_a in_b weight before weight_before star growth".split()
    panel = spark.createDataFrame([], "instrument long, date date, st_status int, " + ", ".join(f"{c} double" for c in columns))
    stages = Stages()
    plan = stages.frame(panel, formulas(stages), digits=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_flow_features_read_histories_in_a_pass(spark):
    """A sliding window function costs a step for each of its rows; the pass does not."""
    panel = spark.createDataFrame([(i, day(d), 10.0 + (7 * i + d * d) % 11, float(1 + (3 * i + d) % 5)) for i in range(2) for d in range(70)], "instrument long, date date, close double, vol double")
    made = []
    for long in (5, 100):
        stages = Stages(long=long)
        found = {k: x for n in (5, 60) for k, x in alpha158.flow(stages, n).items()}
        made.append(stages.frame(panel, found, digits=4).orderBy("instrument", "date"))
    slides = ["stddev_samp" in m._jdf.queryExecution().optimizedPlan().toString() for m in made]
    assert slides == [False, True]
    one, other = (m.toPandas().astype(float, errors="ignore") for m in made)
    assert list(one.columns) == list(other.columns)
    for name in one.columns[2:]:
        assert np.allclose(one[name], other[name], atol=1e-9, equal_nan=True), name


def test_legs_hand_on_fewer_columns_than_sleeves(spark):
    """What a shuffle carries: the keys, and of formulas and their parts the fewer."""
    columns = "open high low close vol amount turn pe_ttm dividend_yield_ratio total_market_cap float_market_cap index_weight tenure".split()
    panel = spark.createDataFrame([], "instrument long, date date, st_status int, " + ", ".join(f"{c} double" for c in columns))
    stages = Stages()
    plan = stages.frame(panel, factor_queries.index_sleeves(stages), digits=4)._jdf.queryExecution().optimizedPlan()
    passed = [node for node in plan.toString().splitlines() if "MapInArrow" in node]
    assert passed and not any("open#" in node or "vol#" in node for node in passed)


@pytest.mark.parametrize("name", ["ml_huber", "ml_boosted_ranking"])
def test_a_model_reads_its_panel_from_where_it_is_laid_down(spark, name):
    plan = REGISTRY.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
