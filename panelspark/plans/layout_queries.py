"""Panels laid out by instrument, correlations of many candidates, verdicts over years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import sqltext as q
from panelspark.functions import window as w
from panelspark.operators import archive, experts, pairwise
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import bars_sql, r
from panelspark.sources import files
from panelspark.sources.panel import BARS_SQL, MONEYFLOW_SQL, RUNS_SQL, bars, moneyflow, runs, with_sql

LAID_SQL = "laid AS (SELECT b.*, net_mf_amount FROM bars b LEFT JOIN moneyflow m ON m.instrument = b.instrument AND m.date = b.date)"


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and money flow as tables in buckets of the instrument, joined on their buckets."""
    home = files.shared(spark, "laid")
    mark = home.rsplit("-", 1)[-1]
    panel = files.write_buckets(bars(spark, sf_dir), f"bars_{mark}", f"{home}/bars")
    flows = files.write_buckets(moneyflow(spark, sf_dir), f"flows_{mark}", f"{home}/flows")
    return files.attach_on_buckets(panel, flows, ("instrument", "date"), f"laid_{mark}", f"{home}/laid")


@REGISTRY.query("bucketed_panel", bars_sql({"mean_20": q.mean("close", 20), "std_10": q.std("close", 10), "before": q.shift("net_mf_amount", 1), "flow": "net_mf_amount"}, MONEYFLOW_SQL, LAID_SQL, source="laid"))
def bucketed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling statistics and a sidecar join without a shuffle, once the tables are laid out."""
    found = laid_out(spark, sf_dir)
    columns = {"mean_20": w.rolling_mean(F.col("close"), 20), "std_10": w.rolling_std(F.col("close"), 10), "before": w.shift(F.col("net_mf_amount"), 1), "flow": F.col("net_mf_amount")}
    return found.select("instrument", "date", *[r(c).alias(name) for name, c in columns.items()])


CANDIDATES = {f"move_{n}": ("pct_change", n) for n in range(1, 16)} | {f"bias_{n}": ("rolling_bias", n) for n in range(2, 12)} | {f"spread_{n}": ("rolling_std", n) for n in range(3, 13)}
BUILT_SQL = "built AS (SELECT instrument, date, " + ", ".join(f"{ {'pct_change': q.pct_change, 'rolling_bias': q.bias, 'rolling_std': q.std}[kind]('close', n)} AS {name}" for name, (kind, n) in CANDIDATES.items()) + " FROM bars)"


@REGISTRY.query(
    "candidate_correlations",
    with_sql(BARS_SQL, BUILT_SQL, f"long AS (UNPIVOT built ON {', '.join(CANDIDATES)} INTO NAME name VALUE v)",
        "ordered AS (SELECT *, list_position(['" + "', '".join(CANDIDATES) + "'], name) AS place FROM long)",
        select="SELECT x.name AS a, y.name AS b, count(*) AS n, round(covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0), 5) + 0.0 AS corr FROM ordered x JOIN ordered y ON x.instrument = y.instrument AND x.date = y.date AND x.place < y.place GROUP BY 1, 2"),
)
def candidate_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two of 35 candidates, over the bars on which both are known."""
    columns = {name: getattr(w, kind)(F.col("close"), n) for name, (kind, n) in CANDIDATES.items()}
    found = pairwise.correlations(bars(spark, sf_dir).select(*[c.alias(name) for name, c in columns.items()]), tuple(CANDIDATES), tile=16)
    return found.select("a", "b", "n", r(F.col("corr"), 5).alias("corr"))


VERDICT_SQL = """
years AS (
  SELECT year::INTEGER AS year, avg(sharpe) FILTER (WHERE run_id % 2 = 0) AS policy_sharpe, avg(excess_return) FILTER (WHERE run_id % 2 = 0) AS policy_excess, avg(sharpe) FILTER (WHERE run_id % 2 = 1) AS replay_sharpe,
    avg(excess_return) FILTER (WHERE run_id % 2 = 1) AS replay_excess, avg(win_rate) AS copy_ratio FROM runs WHERE status = 'completed' GROUP BY 1
)"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of two halves of the runs, by year, as those of a policy and of the replayed champion."""
    found = archive.summaries(runs(spark, sf_dir)).where((F.col("status") == "completed") & F.col("year").isNotNull())
    half = lambda odd, c: F.avg(F.when(F.col("run_id") % 2 == odd, F.col(c)))
    return found.groupBy("year").agg(
        half(0, "sharpe").alias("policy_sharpe"), half(0, "excess_return").alias("policy_excess"), half(1, "sharpe").alias("replay_sharpe"), half(1, "excess_return").alias("replay_excess"), F.avg("win_rate").alias("copy_ratio")
    )


@REGISTRY.query(
    "policy_verdict",
    with_sql(RUNS_SQL, VERDICT_SQL,
        "m AS (SELECT avg(policy_sharpe) AS a, avg(policy_excess) AS b, avg(replay_sharpe) AS c, avg(replay_excess) AS d, avg(copy_ratio) AS e, count(*) AS years FROM years)",
        select="SELECT round(a, 6) + 0.0 AS policy_sharpe, round(b, 6) + 0.0 AS policy_excess, round(c, 6) + 0.0 AS replay_sharpe, round(d, 6) + 0.0 AS replay_excess, round(e, 6) + 0.0 AS copy_ratio, years, CASE WHEN a > c AND b > d THEN 'better' ELSE 'not better' END AS verdict, e >= 0.9 AS copies FROM m"),
)
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experts.verdict(_years(spark, sf_dir))
    return found.select(*[r(F.col(c)).alias(c) for c in ("policy_sharpe", "policy_excess", "replay_sharpe", "replay_excess", "copy_ratio")], "years", "verdict", "copies")
