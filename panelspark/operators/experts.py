"""Inputs and scores of expert selection: excess transitions, state features, the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(experts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(expert, date, reward): each expert's return over the benchmark on common dates, and cash as one more expert.

    experts: (expert, date, ret); benchmark: (date, ret), a row a session.
    """
    bench = F.broadcast(benchmark.select("date", F.col("ret").alias("bench_")))
    excess = experts.join(bench, "date").select("expert", "date", (F.col("ret") - F.col("bench_")).alias("reward"))
    cash = benchmark.select(F.lit("cash").alias("expert"), "date", (-F.col("ret")).alias("reward"))
    return excess.unionByName(cash)


def state_features(experts: DataFrame, benchmark: DataFrame, n: int = 20) -> DataFrame:
    """(date, expert, bench_mean, bench_vol, excess_mean): over the last n sessions; an expert without any has 0."""
    last = Window.orderBy("date").rowsBetween(-(n - 1), 0)  # one row a session
    market = benchmark.select("date", F.avg("ret").over(last).alias("bench_mean"), F.coalesce(F.stddev_samp("ret").over(last), F.lit(0.0)).alias("bench_vol"))
    own = Window.partitionBy("expert").orderBy("date").rowsBetween(-(n - 1), 0)
    excess = transitions(experts, benchmark).withColumn("excess_mean", F.avg("reward").over(own))
    names = excess.select("expert").distinct()  # a handful
    every = market.crossJoin(F.broadcast(names))
    return every.join(excess.select("expert", "date", "excess_mean"), ["expert", "date"], "left").fillna(0.0, ["excess_mean"]).select("date", "expert", "bench_mean", "bench_vol", "excess_mean")


def verdict(years: DataFrame, copy_limit: float = 0.9) -> DataFrame:
    """One row: does a policy beat the replayed champion on average, and does it merely copy it?

    years: (year, policy_sharpe, policy_excess, replay_sharpe, replay_excess, copy_ratio).
    """
    means = years.agg(*[F.avg(c).alias(c) for c in ("policy_sharpe", "policy_excess", "replay_sharpe", "replay_excess", "copy_ratio")], F.count("*").alias("years"))
    better = (F.col("policy_sharpe") > F.col("replay_sharpe")) & (F.col("policy_excess") > F.col("replay_excess"))
    return means.withColumns({"verdict": F.when(better, "better").otherwise("not better"), "copies": F.coalesce(F.col("copy_ratio") >= copy_limit, F.lit(False))})
