"""Analytics on archived runs: settings and measures held as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIG = "test struct<date_from:string,date_to:string>, top_n int, factor_versions array<string>, weighting string, gates array<string>"
#: The measures of a run's summary.
MEASURES = (
    "total_return", "annual_return", "benchmark_return", "excess_return", "sharpe", "sortino", "calmar", "max_drawdown", "win_rate", "turnover", "capital_usage", "information_ratio", "trade_count", "losing_streak",
)
METRICS = ", ".join(f"{name} double" for name in MEASURES)


def summaries(runs: DataFrame) -> DataFrame:
    """A row for each run: settings and all measures of its JSON texts, test dates, and the sorted, distinct keys of factors and gates.

    Measures that a text lacks are NULL; the year is that of a test within one calendar year.
    """
    parsed = runs.withColumns({"c": F.from_json("config_json", CONFIG), "m": F.from_json("metrics_json", METRICS)})
    key = F.array_join(F.array_sort(F.array_distinct("c.factor_versions")), ",")
    year = F.when(F.substring("c.test.date_from", 1, 4) == F.substring("c.test.date_to", 1, 4), F.substring("c.test.date_from", 1, 4).cast("int"))
    return parsed.select(
        "run_id", "finished", "status", year.alias("year"), F.col("c.top_n").alias("top_n"), F.col("c.weighting").alias("weighting"), key.alias("factor_key"),
        F.array_join(F.array_sort(F.array_distinct("c.gates")), ",").alias("gate_key"), F.to_date("c.test.date_from").alias("date_from"), F.to_date("c.test.date_to").alias("date_to"), *[F.col(f"m.{name}").alias(name) for name in MEASURES],
    )


def listing(found: DataFrame, status: str | None = None, search: str | None = None, sort: str = "sharpe", number: int = 1, size: int = 20) -> DataFrame:
    """A page of summaries: filtered, searched in the factor key, best first and blanks last."""
    if status is not None:
        found = found.where(F.col("status") == status)
    if search is not None:
        found = found.where(F.lower("factor_key").contains(search.lower()))
    return found.orderBy(F.col(sort).desc_nulls_last(), "run_id").offset((number - 1) * size).limit(size)


def latest(found: DataFrame, key: str) -> DataFrame:
    """The run with the largest id of each key."""
    return found.groupBy(key).agg(F.max("run_id").alias("run_id"), F.max_by("sharpe", "run_id").alias("sharpe"))


def expert_grid(found: DataFrame) -> DataFrame:
    """(expert, year, sharpe, excess_return, runs): means over the completed runs of one natural year, by a hash of their settings."""
    expert = F.sha2(F.concat_ws("|", F.col("top_n").cast("string"), "weighting", "factor_key"), 256)
    done = found.where((F.col("status") == "completed") & F.col("year").isNotNull()).withColumn("expert", expert)
    return done.groupBy("expert", "year").agg(F.avg("sharpe").alias("sharpe"), F.avg("excess_return").alias("excess_return"), F.count("*").alias("runs"))


def best_before(grid: DataFrame, k: int) -> DataFrame:
    """(year, expert, place, score): the k experts with the best mean yearly Sharpe over the years before; ties by id."""
    years = grid.select(F.col("year").alias("of")).distinct()  # few rows
    past = grid.join(F.broadcast(years), F.col("year") < F.col("of")).groupBy("of", "expert").agg(F.avg("sharpe").alias("score"))
    order = Window.partitionBy("of").orderBy(F.desc(F.round("score", 9)), "expert")
    return past.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(F.col("of").alias("year"), "expert", "place", "score")


def champion_replay(grid: DataFrame) -> DataFrame:
    """(year, expert, sharpe, excess_return): last year's best expert in the year itself, where it ran."""
    order = Window.partitionBy("year").orderBy(F.desc(F.round("sharpe", 9)), "expert")
    best = grid.withColumn("place", F.row_number().over(order)).where(F.col("place") == 1).select((F.col("year") + 1).alias("year"), "expert")
    return best.join(grid, ["year", "expert"], "left").select("year", "expert", "sharpe", "excess_return")


def screen_picks(found: DataFrame, formula: str, own: str = "annual_return", bench: str = "benchmark_return", ratio: str = "information_ratio") -> DataFrame:
    """Of the runs whose own book earns more than its benchmark at a positive information ratio, one of each formula family.

    It is the one with the best ratio, earlier runs win ties; with the family's
    size. A run without a benchmark or ratio does not pass.
    """
    family = F.regexp_replace(F.regexp_replace(F.col(formula), "\\s+", ""), ",\\d+\\)", ",W)")
    passed = found.where((F.col(own) > F.col(bench)) & (F.col(ratio) > 0)).withColumn("family", family)
    order = Window.partitionBy("family").orderBy(F.desc(ratio), "run_id")
    ranked = passed.withColumns({"place_": F.row_number().over(order), "family_size": F.count("*").over(Window.partitionBy("family"))})
    return ranked.where(F.col("place_") == 1).select("family", "run_id", F.col(own).alias("own"), F.col(bench).alias("bench"), F.col(ratio).alias("ratio"), "family_size")


def window_usage(runs: DataFrame) -> DataFrame:
    """(date_from, date_to, used): how often completed runs used each test window."""
    test = F.from_json("config_json", CONFIG)["test"]
    return runs.groupBy(test["date_from"].alias("date_from"), test["date_to"].alias("date_to")).agg(F.count_if(F.col("status") == "completed").alias("used"))


def with_names(runs: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, names): the sorted, distinct names of a run's factors, joined from a table (factor, name); "" for none."""
    factors = runs.select("run_id", F.explode_outer(F.from_json("config_json", CONFIG)["factor_versions"]).alias("factor"))
    joined = factors.join(names, "factor", "left").groupBy("run_id")
    return joined.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def overlapping(runs: DataFrame, date_from: str, date_to: str, status: str, number: int = 1, size: int = 20) -> DataFrame:
    """(run_id, sharpe, total): a page of the runs whose test window overlaps a span, best first, with the number of all of them."""
    test = F.from_json("config_json", CONFIG)["test"]
    inside = runs.where((F.col("status") == status) & (test["date_from"] <= date_to) & (test["date_to"] >= date_from))
    found = inside.select("run_id", F.from_json("metrics_json", METRICS)["sharpe"].alias("sharpe"))
    page = found.orderBy(F.col("sharpe").desc_nulls_last(), "run_id").offset((number - 1) * size).limit(size)
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("finished"), F.desc("run_id")).limit(n)


def status_counts(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, status, n) over several tables of runs (kind, status), stacked."""
    return runs.select("kind", "status").unionByName(kinds.select("kind", "status")).groupBy("kind", "status").agg(F.count("*").alias("n"))
