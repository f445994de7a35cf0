"""The factor catalogues on the bar panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.functions.catalog import alpha158, alpha191, pack, sleeves
from panelspark.functions.series import LONG, Series, Stages
from panelspark.operators import universe
from panelspark.plans.catalogue import REGISTRY
from panelspark.sources.panel import BARS_SQL, MEMBERSHIP_SQL, MONEYFLOW_SQL, bars, membership, moneyflow, with_sql

TIMED_SQL = "timed AS (SELECT *, (row_number() OVER (PARTITION BY instrument ORDER BY date))::DOUBLE AS t FROM bars)"
FLOWS_SQL = "flows AS (SELECT * FROM bars LEFT JOIN moneyflow USING (instrument, date))"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("t", F.row_number().over(w.by_time()).cast("double"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).join(moneyflow(spark, sf_dir), ["instrument", "date"], "left")


def _catalogue(name: str, formulas: Callable[[Stages], dict[str, Series]], panel: Callable[[SparkSession, str], DataFrame], source: str, *parts: str, digits: int = 5, corr_digits: int | None = None, long: int = LONG) -> None:
    text = Stages(sql=True, corr_digits=corr_digits)
    staged, select = text.text(source, formulas(text), digits)

    @REGISTRY.query(name, with_sql(BARS_SQL, *parts, *staged, select=select))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stages = Stages(corr_digits=corr_digits, long=long)
        return stages.frame(panel(spark, sf_dir), formulas(stages), digits=digits)


_catalogue("builtin_factors", pack.builtin, bars, "bars")
_catalogue("pack_factors", pack.canonical, bars, "bars")
_catalogue("moneyflow_factors", pack.moneyflow, flows, "flows", MONEYFLOW_SQL, FLOWS_SQL)
_catalogue("alpha158_candle", alpha158.candle, bars, "bars")
_catalogue("alpha158_trend", lambda s: {k: x for n in alpha158.WINDOWS for k, x in alpha158.trend(s, n).items()}, timed, "timed", TIMED_SQL, digits=4)
_catalogue("alpha158_flow", lambda s: {k: x for n in alpha158.WINDOWS for k, x in alpha158.flow(s, n).items()}, bars, "bars", digits=4, long=min(alpha158.WINDOWS))
_catalogue("alpha191_price", alpha191.price_alphas, bars, "bars", digits=4)
_catalogue("alpha191_corr", alpha191.correlation_alphas, bars, "bars", digits=4, corr_digits=6)

#: A core of four legs, and grids of weights; any others can be given.
CORE = {"high60": 1.0, "size": 1.0, "yield": 1.0, "earnings": -1.2}
GRID = (0.0, 0.4, 0.8, 1.6, 2.4)
TILTS = (-0.4, -0.15, 0.15, 0.4)
FLOORS = (0.008, 0.012, 0.018)  # shares of an index
SHARES = (0.15, 0.35)


def base_sleeves(s: Stages) -> dict[str, Series]:
    return sleeves.sums(sleeves.legs(s), ("size", "yield", "move20", "high60", "turn"), (2, 3))


def swept_sleeves(s: Stages) -> dict[str, Series]:
    return sleeves.swept(sleeves.legs(s), CORE, GRID)


def weighted_sleeves(s: Stages) -> dict[str, Series]:
    parts = sleeves.legs(s)
    return sleeves.swept_pairs(parts, CORE, 0.5, 2.0) | sleeves.replaced(parts, CORE, "high60", ("high20", "high120", "move60", "unrest")) | sleeves.replaced(parts, CORE, "size", ("float", "amount"))


def blended_sleeves(s: Stages) -> dict[str, Series]:
    parts = sleeves.legs(s)
    base = sleeves.sleeve(parts, CORE)
    return sleeves.tilted(base, {k: x for k, x in parts.items() if k not in CORE}, TILTS) | sleeves.shaped(base, parts["yield"], sleeves.SHAPES, 0.2)


def masked_sleeves(s: Stages) -> dict[str, Series]:
    """The core under own conditions, without the most traded fifth, tilted against the last move and the gap, and ranked again inside a pool."""
    parts, c = sleeves.legs(s), s.column("close")
    base = sleeves.sleeve(parts, CORE)
    masks = {"busy": s.column("amount").ts_zscore(20), "above20": c.rolling_bias(20), "above60": c.rolling_bias(60), "unflagged": 1 - s.column("st_status"), "quiet": 1 - parts["turn"] - 0.2}
    against = {"move10": c.pct_change(10).cs_rank(), "gap": parts["gap"]}
    return sleeves.masked(base, masks) | sleeves.tilted(base, against, (-0.5,)) | sleeves.ranked_again(base, {"unflagged": masks["unflagged"]})


def index_sleeves(s: Stages) -> dict[str, Series]:
    base = sleeves.sleeve(sleeves.legs(s), CORE)
    weight, tenure = s.column("index_weight"), s.column("tenure")
    out = sleeves.masked(base, {"members": weight, "stayed": tenure - 1}) | sleeves.ranked_again(base, {"members": weight})
    return out | sleeves.tilted(base, sleeves.ranked_within({"weight": weight, "tenure": tenure}, weight), TILTS)


def pool_sleeves(s: Stages) -> dict[str, Series]:
    """Members of two indexes: pools, floors by weight, cuts and tilts within a pool, board masks, ranks within the pool as sleeves of their own."""
    column, parts = s.column, sleeves.legs(s)
    base, in_a, in_b, weight = sleeves.sleeve(parts, CORE), column("in_a"), column("in_b"), column("weight")
    either = in_a.either(in_b)
    stable = either.both(column("before"))
    pools = {"a": in_a, "b": in_b, "either": either, "stable": stable, "b_alone": in_b.both(in_a.not_())}
    boards = {"no_star": column("star").not_(), "no_growth": column("growth").not_(), "neither": column("star").either(column("growth")).not_()}
    out = sleeves.masked(base, boards, "board") | sleeves.masked(base, pools, "pool") | sleeves.ranked_again(base, pools)
    held = base.where(stable)
    out |= sleeves.floored(held, stable, weight, FLOORS, SHARES, "weight") | sleeves.floored(held, stable, column("weight_before"), FLOORS, (), "weight_before")
    out |= sleeves.floored_apart(held, in_a, in_b, weight, FLOORS)
    c, h, lo = column("close"), column("high"), column("low")
    values = {"move20": c.pct_change(20), "span": (h - lo) / c, "turn": column("turn"), "yield": column("dividend_yield_ratio"), "earnings": column("pe_ttm"), "size": column("total_market_cap"), "tenure": column("tenure")}
    own = sleeves.ranked_within(values, stable)
    out |= sleeves.cut(held, stable, {k: values[k] for k in ("move20", "span", "turn")}, SHARES)
    out |= sleeves.tilted(held, own, TILTS, "within") | {f"only_{name}": x for name, x in own.items()}
    return out | {f"own_{name}": x for name, x in sleeves.sums(own, ("move20", "yield", "size", "turn"), (2, 3)).items()}


_catalogue("sleeves_base", base_sleeves, bars, "bars")
_catalogue("sleeves_swept", swept_sleeves, bars, "bars")
_catalogue("sleeves_masked", masked_sleeves, bars, "bars")


INDEX_PANEL_SQL = """
snapshots AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS n FROM (SELECT DISTINCT snapshot FROM membership WHERE index_code = '2-HIGH')),
stays AS (SELECT m.*, n - row_number() OVER (PARTITION BY con_code ORDER BY snapshot) AS island FROM membership m JOIN snapshots USING (snapshot) WHERE index_code = '2-HIGH'),
tenured AS (SELECT con_code, snapshot, weight, (row_number() OVER (PARTITION BY con_code, island ORDER BY snapshot))::DOUBLE AS tenure FROM stays),
last_seen AS (SELECT date, max(snapshot) AS snapshot FROM (SELECT DISTINCT date FROM bars) JOIN snapshots ON snapshot <= date GROUP BY 1),
indexed AS (
  SELECT b.*, t.weight AS index_weight, t.tenure FROM bars b LEFT JOIN last_seen USING (date) LEFT JOIN tenured t ON t.snapshot = last_seen.snapshot AND t.con_code = b.instrument
)"""


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the as-of weight and tenure of one index."""
    panel = bars(spark, sf_dir)
    own = membership(spark, sf_dir).where(F.col("index_code") == "2-HIGH")
    stayed = universe.tenure(own).select("snapshot", "con_code", F.col("tenure").cast("double").alias("tenure"))
    held = own.join(stayed, ["snapshot", "con_code"])
    days = universe.last_snapshots(panel.select("date").distinct(), own)
    now = days.join(held, "snapshot").select("date", F.col("con_code").alias("instrument"), F.col("weight").alias("index_weight"), "tenure")
    return panel.join(now, ["date", "instrument"], "left")


_catalogue("sleeves_index", index_sleeves, indexed, "indexed", MEMBERSHIP_SQL, INDEX_PANEL_SQL)


POOL_PANEL_SQL = """
held AS (SELECT * FROM membership WHERE index_code IN ('1-URGENT', '2-HIGH')),
marks AS (SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS prev, row_number() OVER (ORDER BY snapshot) AS n FROM (SELECT DISTINCT snapshot FROM held)),
last_seen AS (SELECT date, max(snapshot) AS snapshot FROM (SELECT DISTINCT date FROM bars) JOIN marks ON snapshot <= date GROUP BY 1),
own_last AS (SELECT date, index_code, max(h.snapshot) AS snapshot FROM (SELECT DISTINCT date FROM bars) JOIN (SELECT DISTINCT index_code, snapshot FROM held) h ON h.snapshot <= date GROUP BY 1, 2),
own AS (SELECT o.date, o.index_code, con_code, weight FROM own_last o JOIN held h USING (index_code, snapshot)),
pooled AS (
  SELECT date, con_code, max((index_code = '1-URGENT')::INTEGER)::DOUBLE AS in_a, max((index_code = '2-HIGH')::INTEGER)::DOUBLE AS in_b, arg_min(weight, index_code) AS weight FROM own GROUP BY 1, 2
),
earlier AS (SELECT l.date, con_code, arg_min(weight, index_code) AS weight_before FROM last_seen l JOIN marks k USING (snapshot) JOIN held h ON h.snapshot = k.prev GROUP BY 1, 2),
once AS (SELECT DISTINCT snapshot, con_code FROM held),
stays AS (SELECT o.*, n - row_number() OVER (PARTITION BY con_code ORDER BY snapshot) AS island FROM once o JOIN marks USING (snapshot)),
tenured AS (SELECT con_code, snapshot, (row_number() OVER (PARTITION BY con_code, island ORDER BY snapshot))::DOUBLE AS tenure FROM stays),
pool_panel AS (
  SELECT b.*, coalesce(in_a, 0.0) AS in_a, coalesce(in_b, 0.0) AS in_b, p.weight, CASE WHEN e.con_code IS NOT NULL THEN 1.0 ELSE 0.0 END AS before, weight_before, tenure,
    (b.instrument % 10 = 3)::INTEGER::DOUBLE AS star, (b.instrument % 10 IN (4, 5))::INTEGER::DOUBLE AS growth
  FROM bars b LEFT JOIN last_seen l USING (date) LEFT JOIN pooled p ON p.date = b.date AND p.con_code = b.instrument
    LEFT JOIN earlier e ON e.date = b.date AND e.con_code = b.instrument LEFT JOIN tenured t ON t.snapshot = l.snapshot AND t.con_code = b.instrument
)"""


def pool_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the as-of membership and weights of two indexes, what was held a snapshot before, tenure and board flags."""
    panel = bars(spark, sf_dir)
    days = panel.select("date").distinct()
    held = membership(spark, sf_dir).where(F.col("index_code").isin("1-URGENT", "2-HIGH"))
    first = lambda name: F.min_by("weight", "index_code").alias(name)
    has = lambda code: F.max((F.col("index_code") == code).cast("double"))
    now = universe.members_by_index(days, held).groupBy("date", "instrument").agg(has("1-URGENT").alias("in_a"), has("2-HIGH").alias("in_b"), first("weight"))
    earlier = universe.members_before(days, held).groupBy("date", "instrument").agg(first("weight_before"), F.lit(1.0).alias("before"))
    once = held.select(F.lit("pool").alias("index_code"), "snapshot", "con_code").distinct()
    stayed = universe.last_snapshots(days, once).join(universe.tenure(once), "snapshot").select("date", F.col("con_code").alias("instrument"), F.col("tenure").cast("double").alias("tenure"))
    joined = panel
    for part in (now, earlier, stayed):
        joined = joined.join(part, ["date", "instrument"], "left")
    boards = {"star": (F.col("instrument") % 10 == 3).cast("double"), "growth": (F.col("instrument") % 10).isin(4, 5).cast("double")}
    return joined.fillna(0.0, ["in_a", "in_b", "before"]).withColumns(boards)


_catalogue("sleeves_weighted", weighted_sleeves, bars, "bars")
_catalogue("sleeves_blended", blended_sleeves, bars, "bars")
_catalogue("sleeves_pool", pool_sleeves, pool_panel, "pool_panel", MEMBERSHIP_SQL, POOL_PANEL_SQL)
