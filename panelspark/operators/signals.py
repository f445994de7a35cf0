"""Rule signals: period features, indicators and the two screens built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import window as w


def period_features(panel: DataFrame, period: Column) -> DataFrame:
    """Add to_date_vol, before_vol, before_close, growth and period_ret; a period is a week or month key."""
    keyed = panel.withColumn("period_", period)
    whole = keyed.groupBy("instrument", "period_").agg(F.sum("vol").alias("own_vol_"), F.max_by("close", "date").alias("own_close_"))
    order = Window.partitionBy("instrument").orderBy("period_")
    before = whole.select("instrument", "period_", F.lag("own_vol_").over(order).alias("before_vol"), F.lag("own_close_").over(order).alias("before_close"))
    so_far = Window.partitionBy("instrument", "period_").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("to_date_vol", F.sum("vol").over(so_far)).join(before, ["instrument", "period_"])
    return out.withColumns({"growth": w.div(F.col("to_date_vol"), F.col("before_vol")), "period_ret": w.div(F.col("close"), F.col("before_close")) - 1})


#: What lies further back than this (in logarithms of the decay) weighs less than the rounding of doubles.
REACH = 41.5
#: Decays of one pass may differ by so much that weights of a block stay within doubles.
WIDEST = 550.0


def exponential_means(panel: DataFrame, calls: dict[str, tuple[Column, float]], key: str = "instrument", order: str = "date") -> DataFrame:
    """Add exponential means without adjustment, each of a value with its alpha, over a key's rows in an order without ties.

    The recurrence y = a y' + b x is composed of pairs (a product of decays, a
    weighted sum), so it is summed up within blocks of a history, from one running
    sum each, and what the block before hands on is added, weighted by the decays
    since. A block spans so many rows that what lies two blocks back has no weight
    left, so blocks are independent but for their neighbour, and a long history is
    spread over tasks. After unknown values the next one weighs more, as its
    predecessor has decayed; in between the mean stays as it was.
    """
    alphas = sorted({alpha for _, alpha in calls.values()})
    if not all(0 < a < 1 for a in alphas):
        raise ValueError("alpha must lie between 0 and 1")
    slow, fast = -math.log1p(-alphas[0]), -math.log1p(-alphas[-1])
    if REACH / slow * fast > WIDEST:  # rows of a block times the fastest decay: too wide for one pass
        half = {name: c for name, c in calls.items() if c[1] <= math.sqrt(alphas[0] * alphas[-1])}
        rest = {name: c for name, c in calls.items() if name not in half}
        return exponential_means(exponential_means(panel, half, key, order), rest, key, order).select(*panel.columns, *calls)
    names, line = panel.columns, Window.partitionBy(key).orderBy(order)
    at = panel.withColumn("at_", F.row_number().over(line))
    at = at.withColumns({f"x_{name}": x.cast("double") for name, (x, _) in calls.items()})
    known = {name: F.last(F.when(F.col(f"x_{name}").isNotNull(), F.col("at_")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)) for name in calls}
    at = at.withColumns({f"k_{name}": c for name, c in known.items()})
    made = {}
    for name, (_, alpha) in calls.items():
        gap, first, there = F.col("at_") - F.col(f"k_{name}"), F.col(f"k_{name}").isNull(), F.col(f"x_{name}").isNotNull()
        decay = F.pow(F.lit(1 - alpha), F.when(first, 1).otherwise(gap))
        log_a = F.greatest(gap * math.log1p(-alpha) - F.log(decay + alpha), F.lit(-REACH))  # beyond that the past has no weight
        made[f"a_{name}"] = F.when(~there, 0.0).when(first, math.log1p(-alpha)).otherwise(log_a)
        made[f"b_{name}"] = F.when(there, F.when(first, F.col(f"x_{name}")).otherwise(F.col(f"x_{name}") * alpha / (decay + alpha)))
    # Rows of a block: until the slowest mean has decayed by REACH. Gaps only make means decay faster.
    blocks = at.withColumns(made).withColumn("block_", F.floor((F.col("at_") - 1) / math.ceil(REACH / slow)))
    inner = Window.partitionBy(key, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    decays = blocks.withColumns({f"p_{name}": F.sum(f"a_{name}").over(inner) for name in calls})
    local = decays.withColumns({f"l_{name}": F.exp(F.col(f"p_{name}")) * F.coalesce(F.sum(F.col(f"b_{name}") * F.exp(-F.col(f"p_{name}"))).over(inner), F.lit(0.0)) for name in calls})
    ends = local.groupBy(key, "block_").agg(*[F.max_by(F.struct(F.col(f"l_{n}").alias("l"), F.col(f"p_{n}").alias("p")), "at_").alias(f"e_{n}") for n in calls])
    ordered = Window.partitionBy(key).orderBy("block_")
    # What lies two blocks back counts only where the nearer block has few known values, and so has decayed little.
    carry = lambda n: F.coalesce(F.lag(f"e_{n}.l").over(ordered), F.lit(0.0)) + F.coalesce(F.exp(F.lag(f"e_{n}.p").over(ordered)) * F.lag(f"e_{n}.l", 2).over(ordered), F.lit(0.0))
    handed = ends.select(F.col(key).alias("key_"), F.col("block_").alias("b_"), *[carry(n).alias(f"c_{n}") for n in calls])
    joined = local.join(handed, local[key].eqNullSafe(F.col("key_")) & (local["block_"] == F.col("b_")))
    value = {n: F.when(F.col(f"x_{n}").isNotNull(), F.col(f"l_{n}") + F.exp(F.col(f"p_{n}")) * F.col(f"c_{n}")) for n in calls}
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)  # where a value is unknown, the last mean stands
    return joined.withColumns({f"y_{n}": v for n, v in value.items()}).select(*names, *[F.last(f"y_{n}", ignorenulls=True).over(so_far).alias(n) for n in calls])


def exponential_indicators(panel: DataFrame) -> DataFrame:
    """Add ema_20, ema_60, dif, dea, macd_hist and rsi_14 of close.

    NULL closes leave the means as they were; the first change is not known.
    """
    close, of_span = F.col("close"), lambda n: 2 / (n + 1)
    change = F.col("change_")
    moved = panel.withColumn("change_", F.col("close") - F.lag("close").over(w.by_time()))
    calls = {f"ema_{n}": (close, of_span(n)) for n in (20, 60)} | {f"e{n}_": (close, of_span(n)) for n in (12, 26)}
    calls |= {"gain_": (F.greatest(change, F.when(change.isNotNull(), 0.0)), 1 / 14), "loss_": (F.greatest(-change, F.when(change.isNotNull(), 0.0)), 1 / 14)}
    first = exponential_means(moved, calls).withColumn("dif", F.col("e12_") - F.col("e26_"))
    second = exponential_means(first, {"dea": (F.col("dif"), of_span(9))})
    rsi = F.when(F.col("loss_") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain_") / F.nullif(F.col("loss_"), F.lit(0.0))))
    told = second.withColumns({"macd_hist": 2 * (F.col("dif") - F.col("dea")), "rsi_14": F.when(change.isNotNull(), rsi)})
    return told.drop("change_", "e12_", "e26_", "gain_", "loss_")


def ewm_mean(panel: DataFrame, value: str, span: int, out: str) -> DataFrame:
    """Add the exponential mean of span n, without adjustment, NULL before n known values."""
    found = exponential_means(panel, {out: (F.col(value), 2 / (span + 1))})
    known = F.count(value).over(w.by_time().rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn(out, F.when(known >= span, F.col(out)))


def trend_signal(
    panel: DataFrame, top: int = 10, weight: float = 0.1, least_days: int = 60, members: DataFrame | None = None, board: Column | None = None, least_amount: float | None = None
) -> DataFrame:
    """Trend-following picks (date, instrument, rank_score, weight): the best `top` names a date that pass all rules.

    Rules: not flagged, listed for over least_days observations, EMA20 > EMA60,
    DIF > DEA with a positive histogram, RSI from 40 to 72, close above its
    20-mean. Where given: a member as of the date (date, instrument), of an
    allowed board, with at least such an amount. Ranks are among the names that
    pass. Score: 0.40, 0.35 and 0.25 times the ranks of histogram, momentum and
    RSI. Scores are ordered by nine digits, as equal sums of different ranks
    differ in their last bit; the smaller instrument wins ties.
    """
    close = F.col("close")
    built = exponential_indicators(panel).withColumns(
        {"mid": w.rolling_mean(close, 20), "mom_20": w.pct_change(close, 20), "age": F.row_number().over(w.by_time())}
    )
    rules = (
        (F.col("st_status") == 0) & (F.col("age") > least_days) & (F.col("ema_20") > F.col("ema_60")) & (F.col("dif") > F.col("dea"))
        & (F.col("macd_hist") > 0) & F.col("rsi_14").between(40, 72) & (close > F.col("mid"))
    )
    for rule in (board, None if least_amount is None else F.col("amount") >= least_amount):
        rules = rules if rule is None else rules & rule
    passed = built.where(w.two_valued(rules))
    if members is not None:
        passed = passed.join(members.select("date", "instrument").distinct(), ["date", "instrument"], "left_semi")
    score = 0.40 * w.cs_rank(F.col("macd_hist")) + 0.35 * w.cs_rank(F.col("mom_20")) + 0.25 * w.cs_rank(F.col("rsi_14"))
    ranked = passed.withColumn("rank_score", score)
    best = Window.partitionBy("date").orderBy(F.desc_nulls_last(F.round("rank_score", 9)), "instrument")
    return ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("date", "instrument", "rank_score", F.lit(weight).alias("weight"))


def volume_screen(panel: DataFrame, period: Column, cap: tuple[float, float], turn: float, growth: float = 1.0, long_ret: float = 0.2, last_ret: tuple[float, float] = (0.0, 0.03), long_bars: int = 120) -> DataFrame:
    """Volume-growth picks (date, instrument, place): period-to-date volume over the last period's, quiet price, small name.

    period: the week of a daily panel (labels.friday_week), or a longer period;
    growth: of volume, at least. long_ret is a bound of the return over long_bars
    observations, last_ret of the last one's. Names of a date are ordered by
    period return, then instrument.
    """
    close = F.col("close")
    built = period_features(panel, period).withColumns({"ret_1": w.pct_change(close, 1), "ret_long": w.pct_change(close, long_bars)})
    rules = (
        F.col("float_market_cap").between(*cap) & (F.col("turn") < turn) & (F.col("ret_long") < long_ret)
        & F.col("ret_1").between(*last_ret) & (F.col("growth") > growth)
    )
    order = Window.partitionBy("date").orderBy("period_ret", "instrument")
    return built.where(w.two_valued(rules)).withColumn("place", F.row_number().over(order)).select("date", "instrument", "period_ret", "place")
