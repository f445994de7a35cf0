"""Books in weight form, ledgers and the measures of a curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.window import div
from panelspark.operators.diagnostics import guarded_corr

#: Share invested, and costs of one unit bought and sold.
INVESTED, BUY_COST, SELL_COST = 0.95, 0.0005, 0.0015


def top_n(scores: DataFrame, score: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n best names of a date, ties to the smaller instrument, with place."""
    best = Window.partitionBy(*by, "date").orderBy(F.desc(score), "instrument")
    return scores.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def target_weights(scores: DataFrame, score: str, n: int, by_score: bool = False) -> DataFrame:
    """(date, instrument, weight): equal weights of the top n, or in proportion to positive scores."""
    top = top_n(scores, score, n)
    day = Window.partitionBy("date")
    positive = F.greatest(F.col(score), F.lit(0.0))
    weight = div(positive, F.sum(positive).over(day)) if by_score else 1 / F.count("*").over(day)
    return top.select("date", "instrument", weight.alias("weight"))


def weight_changes(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, instrument, before, after, change): against the book's last date; the first date buys all."""
    days = weights.select(*by, "date").distinct()
    order = Window.partitionBy(*by).orderBy("date")  # one row a session
    steps = days.withColumn("next_", F.lead("date").over(order))
    gone = weights.join(steps.where(F.col("next_").isNotNull()), [*by, "date"]).select(*by, F.col("next_").alias("date"), "instrument", F.col("weight").alias("before"))
    now = weights.select(*by, "date", "instrument", F.col("weight").alias("after"))
    both = now.join(gone, [*by, "date", "instrument"], "full").fillna(0.0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before")).where(F.abs("change") > 1e-12)


def top_k_book(scores: DataFrame, score: str, outcome: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, turnover, ret, bench, excess) of the book that holds today's top k at INVESTED / k each.

    turnover: sum of what is bought. Costs take BUY_COST of it and SELL_COST of
    what is sold. bench: mean outcome of all names of the date.
    """
    held = scores.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    book = top_n(held, score, k, by).select(*by, "date", "instrument", outcome, F.lit(INVESTED / k).alias("weight"))
    moves = weight_changes(book.select(*by, "date", "instrument", "weight"), by).groupBy(*by, "date").agg(
        F.sum(F.greatest("change", F.lit(0.0))).alias("turnover"), F.sum(F.greatest(-F.col("change"), F.lit(0.0))).alias("sold")
    )
    gained = book.groupBy(*by, "date").agg(F.sum(F.col("weight") * F.col(outcome)).alias("gross"))
    bench = held.groupBy(*by, "date").agg(F.avg(outcome).alias("bench"))
    joined = gained.join(moves, [*by, "date"], "left").join(bench, [*by, "date"]).fillna(0.0, ["turnover", "sold"])
    ret = F.col("gross") - BUY_COST * F.col("turnover") - SELL_COST * F.col("sold")
    return joined.select(*by, "date", "turnover", ret.alias("ret"), "bench", (ret - F.col("bench")).alias("excess"))


def wealth(returns: DataFrame, ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """Add wealth (compounded from 1) and drawdown (against the running peak, which starts at 1)."""
    so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("wealth", F.exp(F.sum(F.log1p(F.greatest(F.col(ret), F.lit(-0.999999)))).over(so_far)))
    peak = F.greatest(F.max("wealth").over(so_far), F.lit(1.0))
    return grown.withColumn("drawdown", F.col("wealth") / peak - 1)


def book_metrics(returns: DataFrame, by: tuple[str, ...] = (), per_year: int = 52) -> DataFrame:
    """Days, total and yearly return, worst drawdown, Sharpe, Sortino, Calmar, win rate, mean turnover, information ratio."""
    curve = wealth(returns, by=by)
    n = F.count("*")
    total = F.max_by("wealth", "date")
    annual = F.pow(total, per_year / n) - 1
    down = F.sqrt(F.avg(F.pow(F.least(F.col("ret"), F.lit(0.0)), 2)))
    root = per_year**0.5
    return curve.groupBy(*by).agg(
        n.alias("days"), (total - 1).alias("total_return"), annual.alias("annual_return"), F.min("drawdown").alias("max_drawdown"),
        (div(F.avg("ret"), F.stddev_samp("ret")) * root).alias("sharpe"), (div(F.avg("ret"), down) * root).alias("sortino"),
        div(annual, -F.min("drawdown")).alias("calmar"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.avg("turnover").alias("turnover"), (div(F.avg("excess"), F.stddev_samp("excess")) * root).alias("information_ratio"),
    )


def longest_loss(returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, streak): the most losing days in a row."""
    order = Window.partitionBy(*by).orderBy("date")
    numbered = returns.withColumn("i_", F.row_number().over(order)).where(F.col("ret") < 0)
    island = numbered.withColumn("island_", F.col("i_") - F.row_number().over(order))
    runs = island.groupBy(*by, "island_").agg(F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("streak"))


def by_period(returns: DataFrame, unit: str) -> DataFrame:
    """(period, ret): returns compounded within each calendar month or year."""
    return returns.groupBy(F.date_trunc(unit, "date").cast("date").alias("period")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))


def active_correlation(a: DataFrame, b: DataFrame, least: int = 20) -> DataFrame:
    """(days, corr) of two return series over dates on which not both are zero; none with fewer than `least`."""
    both = a.select("date", F.col("ret").alias("x")).join(b.select("date", F.col("ret").alias("y")), "date").where((F.col("x") != 0) | (F.col("y") != 0))
    return both.agg(F.count("*").alias("days"), guarded_corr(F.col("x"), F.col("y")).alias("corr")).where(F.col("days") >= least)


def blended(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """(date, ret): two return series mixed, a missing day as 0."""
    both = a.select("date", F.col("ret").alias("x")).join(b.select("date", F.col("ret").alias("y")), "date", "full").fillna(0.0, ["x", "y"])
    return both.select("date", (weight * F.col("x") + (1 - weight) * F.col("y")).alias("ret"))


def mar(returns: DataFrame, per_year: int = 52, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cagr, max_drawdown, mar)."""
    curve = wealth(returns, by=by).groupBy(*by).agg(F.count("*").alias("n"), F.max_by("wealth", "date").alias("w"), F.min("drawdown").alias("max_drawdown"))
    cagr = F.pow("w", per_year / F.col("n")) - 1
    return curve.select(*by, cagr.alias("cagr"), "max_drawdown", div(cagr, -F.col("max_drawdown")).alias("mar"))


def incremental_mar(own: DataFrame, bench: DataFrame, weight: float = 0.5, per_year: int = 52) -> DataFrame:
    """(series, cagr, max_drawdown, mar, gain) of two return series ('own', 'bench') and their blend; gain: over the MAR of 'bench'."""
    named = lambda rows, name: rows.select(F.lit(name).alias("series"), "date", "ret")
    every = named(own, "own").unionByName(named(bench, "bench")).unionByName(named(blended(own, bench, weight), "blend"))
    found = mar(every, per_year, ("series",))
    base = found.where(F.col("series") == "bench").select(F.col("mar").alias("base_"))  # one row
    return found.join(F.broadcast(base)).withColumn("gain", F.col("mar") - F.col("base_")).drop("base_")


def numbered_sessions(calendar: DataFrame) -> DataFrame:
    """(date, s_): the dates of a calendar, numbered from 0; a row a session."""
    return calendar.select("date").distinct().withColumn("s_", F.row_number().over(Window.orderBy("date")) - 1)


def on_or_after(rows: DataFrame, day: str, sessions: DataFrame, name: str) -> DataFrame:
    """Add `name`, the number of the first session on or after a day: the number of sessions where there is none; NULL for a NULL day.

    sessions: as numbered_sessions gives them. Every calendar day between two
    sessions belongs to the later one, so that rows find theirs by an equi-join.
    """
    before = F.lag("date").over(Window.orderBy("date"))  # one row a session
    days = sessions.withColumn("first_", F.coalesce(F.date_add(before, 1), F.col("date"))).select(F.explode(F.sequence("first_", "date")).alias("day_"), F.col("s_").alias("on_"))
    ends = sessions.agg(F.min("date").alias("low_"), F.count("*").cast("int").alias("n_"))  # one row
    found = rows.join(F.broadcast(days), F.col(day) == F.col("day_"), "left").join(F.broadcast(ends))
    number = F.when(F.col(day) < F.col("low_"), 0).when(F.col(day).isNotNull(), F.coalesce("on_", "n_"))
    return found.withColumn(name, number.cast("int")).drop("day_", "on_", "low_", "n_")


def _over_sessions(rows: DataFrame, begin: str, end: str, sessions: DataFrame) -> DataFrame:
    """A row for each session from number `begin` to before number `end` (NULL: to the last), with its date."""
    n = sessions.agg(F.count("*").cast("int").alias("n_"))  # one row
    spans = rows.join(F.broadcast(n)).withColumn("last_", F.coalesce(F.col(end), F.col("n_")) - 1).where(F.col(begin) <= F.col("last_"))
    each = spans.withColumn("s_", F.explode(F.sequence(F.col(begin), F.col("last_")))).drop("n_", "last_")
    return each.join(F.broadcast(sessions), "s_").drop("s_")


def daily_holdings(trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, instrument, trade_id) of each trade on every session from its buy date to before its sell date, if any."""
    sessions = numbered_sessions(calendar)
    placed = on_or_after(on_or_after(trades.select("instrument", "trade_id", "buy_date", "sell_date"), "buy_date", sessions, "from_"), "sell_date", sessions, "to_")
    return _over_sessions(placed, "from_", "to_", sessions).select("date", "instrument", "trade_id")


def ledger_curve(trades: DataFrame, calendar: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """(date, cash, invested, equity): trades as flows of cash and quantity, holdings at the last known price."""
    buys = trades.select("instrument", F.col("buy_date").alias("day"), F.col("quantity").alias("q"), (-F.col("buy_price") * F.col("quantity")).alias("cash"))
    sells = trades.where(F.col("sell_date").isNotNull()).select("instrument", F.col("sell_date").alias("day"), (-F.col("quantity")).alias("q"), (F.col("sell_price") * F.col("quantity")).alias("cash"))
    # A flow counts from the first session on or after its day.
    sessions = numbered_sessions(calendar)
    flows = buys.unionByName(sells).groupBy("instrument", "day").agg(F.sum("q").alias("q"), F.sum("cash").alias("cash"))
    placed = on_or_after(flows, "day", sessions, "s_").groupBy("instrument", "s_").agg(F.sum("q").alias("q"), F.sum("cash").alias("cash"))
    placed = placed.join(F.broadcast(sessions), "s_")  # flows after the last session have no date and go
    # A name has a row for each session to its last flow, or to the end while something is held; earlier prices carry forward.
    spans = placed.groupBy("instrument").agg(F.when(F.sum("q") == 0, F.max("s_") + 1).alias("until_")).withColumn("from_", F.lit(0))
    grid = _over_sessions(spans, "from_", "until_", sessions).select("instrument", "date")
    line = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(placed.drop("s_"), ["instrument", "date"], "left").join(prices.select("instrument", "date", "close"), ["instrument", "date"], "left")
    marked = held.select("date", F.coalesce("cash", F.lit(0.0)).alias("cash"), (F.coalesce(F.sum("q").over(line), F.lit(0)) * F.coalesce(F.last("close", ignorenulls=True).over(line), F.lit(0.0))).alias("value"))
    summed = marked.groupBy("date").agg(F.sum("cash").alias("flow"), F.sum("value").alias("invested"))
    daily = sessions.select("date").join(summed, "date", "left").fillna(0.0, ["flow", "invested"])
    cash = F.lit(capital) + F.sum("flow").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row a session
    return daily.select("date", cash.alias("cash"), "invested", (cash + F.col("invested")).alias("equity"))


def benchmark_curve(prices: DataFrame, calendar: DataFrame, start: float) -> DataFrame:
    """(date, equity): a benchmark's closes (date, close) carried forward over the dates of a curve, scaled to begin at `start`.

    Closes that are NULL or zero are not prices. Dates before the first price have none; without a positive first price there is no curve.
    """
    first = prices.agg(F.min_by("close", "date").alias("first_")).where(F.col("first_") > 0)
    known = prices.where(F.col("close") != 0)
    line = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    every = calendar.select("date").withColumn("asked_", F.lit(True)).join(known.select("date", "close"), "date", "left")
    carried = every.withColumn("close", F.last("close", ignorenulls=True).over(line)).where(F.col("close").isNotNull())
    return carried.join(F.broadcast(first)).select("date", (F.lit(start) * F.col("close") / F.col("first_")).alias("equity"))  # first: one row


def one_price_a_date(index_daily: DataFrame, code: str) -> DataFrame:
    """(date, close) of one index: positive closes, one row a date."""
    own = index_daily.where((F.col("ts_code") == code) & (F.col("close") > 0))
    return own.groupBy("date").agg(F.max("close").alias("close"))


def curve_metrics(curve: DataFrame, per_year: int = 252) -> DataFrame:
    """One row: days, total and yearly return (by 365.25 days), Sharpe, worst drawdown, win rate and mean share of capital in use.

    curve: (date, equity, invested).
    """
    daily = curve_returns(curve).join(curve, "date")
    peak = F.max("equity").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row a session
    drawn = daily.withColumns({"drawdown_": div(F.col("equity"), peak) - 1, "use_": div(F.col("invested"), F.col("equity"))})
    total = div(F.max_by("equity", "date"), F.min_by("equity", "date"))
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    return drawn.agg(
        F.count("*").alias("days"), (total - 1).alias("total_return"), (F.pow(total, div(F.lit(1.0), years)) - 1).alias("annual_return"),
        (div(F.avg("ret"), F.stddev_samp("ret")) * per_year**0.5).alias("sharpe"), F.min("drawdown_").alias("max_drawdown"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("use_").alias("capital_usage"),
    )


def by_year(curve: DataFrame) -> DataFrame:
    """(year, ret, max_drawdown) of an equity curve within each calendar year, from its first to its last session."""
    inside = Window.partitionBy(F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    drawn = curve.withColumn("drawdown_", div(F.col("equity"), F.max("equity").over(inside)) - 1)
    ret = div(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1
    return drawn.groupBy(F.year("date").alias("year")).agg(ret.alias("ret"), F.min("drawdown_").alias("max_drawdown"))


def holding_profit(weights: DataFrame, outcomes: DataFrame, outcome: str, curve: DataFrame) -> DataFrame:
    """(instrument, start, end, sessions, profit) of each episode: the sum of weight, outcome and the book's wealth before the day."""
    before = curve.select("date", F.lag("wealth", 1, 1.0).over(Window.orderBy("date")).alias("wealth_"))  # one row a session
    gains = weights.join(outcomes.select("date", "instrument", outcome), ["date", "instrument"]).join(F.broadcast(before), "date")
    gains = gains.select("instrument", "date", (F.col("weight") * F.coalesce(F.col(outcome), F.lit(0.0)) * F.col("wealth_")).alias("gain_"))
    runs = episodes(weights)
    inside = (gains["instrument"] == runs["instrument"]) & gains["date"].between(runs["start"], runs["end"])
    return runs.join(gains, inside).groupBy(runs["instrument"], "start", "end", "sessions").agg(F.sum("gain_").alias("profit"))


def curve_returns(curve: DataFrame) -> DataFrame:
    """(date, ret) of an equity curve, 0 where the equity before is 0 or missing."""
    before = F.lag("equity").over(Window.orderBy("date"))
    return curve.select("date", F.coalesce(div(F.col("equity"), before) - 1, F.lit(0.0)).alias("ret"))


def top_name_share(trades: DataFrame) -> DataFrame:
    """(instrument, share): the name with most of the gross positive profit."""
    by_name = trades.groupBy("instrument").agg(F.sum(F.greatest("pnl", F.lit(0.0))).alias("gain"))
    total = by_name.agg(F.sum("gain").alias("total"))
    return by_name.crossJoin(F.broadcast(total)).orderBy(F.desc("gain"), "instrument").limit(1).select("instrument", div(F.col("gain"), F.col("total")).alias("share"))


def segment_books(scores: DataFrame, score: str, outcome: str, dimensions: tuple[str, ...], k: int) -> DataFrame:
    """top_k_book inside each daily quintile of each dimension, one job for all: (dimension, bucket, date, ...)."""
    from panelspark.operators.buckets import daily_quintile

    stacked = ", ".join(f"'{d}', cast({d} as double)" for d in dimensions)
    long = scores.select("date", "instrument", score, outcome, F.expr(f"stack({len(dimensions)}, {stacked}) AS (dimension, level)"))
    inside = daily_quintile(long, "level", keys=("dimension", "date")).where(F.col("bucket").isNotNull())
    return top_k_book(inside, score, outcome, k, ("dimension", "bucket"))


def episodes(weights: DataFrame) -> DataFrame:
    """(instrument, start, end, sessions): runs of the book's sessions over which a name is held."""
    numbered = weights.select("date").distinct().withColumn("i_", F.row_number().over(Window.orderBy("date")))
    own = Window.partitionBy("instrument").orderBy("date")
    runs = weights.join(F.broadcast(numbered), "date").withColumn("island_", F.col("i_") - F.row_number().over(own))
    return runs.groupBy("instrument", "island_").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions")).drop("island_")


def blend_score(panel: DataFrame, legs: dict[str, int]) -> Column:
    """Mean of the legs' ranks within the date; a leg of direction -1 counts 1 - rank. NULL if any leg is."""
    from panelspark.functions.window import cs_rank

    total = F.lit(0.0)
    for name, direction in legs.items():
        rank = cs_rank(F.col(name))
        total = total + (rank if direction > 0 else 1 - rank)
    return total / len(legs)


def lot_ledger(fills: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(instrument, buy, sell, quantity, buy_price, sell_price, profit): which quantity of each buy was sold by which sell, first in first out.

    fills: (instrument, fill, side 'buy' or 'sell', quantity above 0, price), in
    an order without ties. Fills of a side take up consecutive stretches of the
    quantity that is traded in all; the ends of both sides' stretches cut it into
    pieces, each of one buy and one sell. What is never sold has no sell, what is
    sold without being held no buy; there is no profit then. One pass a name over
    its ordered ends: no pairs of fills are formed.
    """
    so_far = Window.partitionBy("instrument", "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = fills.withColumn("end_", F.sum("quantity").over(so_far))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("fill", "price"))).alias(side)  # noqa: E731  one fill a side ends at a point
    points = ends.groupBy("instrument", "end_").agg(of("buy"), of("sell"))
    down = Window.partitionBy("instrument").orderBy(F.desc("end_"))
    seen = down.rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select(
        "instrument", (F.col("end_") - F.lead("end_", 1, 0).over(down)).alias("quantity"), F.last("buy", ignorenulls=True).over(seen).alias("b_"), F.last("sell", ignorenulls=True).over(seen).alias("s_")
    )
    profit = (F.col("s_.price") - F.col("b_.price")) * F.col("quantity")
    return pieces.select("instrument", F.col("b_.fill").alias("buy"), F.col("s_.fill").alias("sell"), "quantity", F.col("b_.price").alias("buy_price"), F.col("s_.price").alias("sell_price"), profit.alias("profit"))
