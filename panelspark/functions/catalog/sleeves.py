"""Composite sleeves: weighted sums of ranks, under masks and inside pools.

A sleeve is a rule, not an entry of a table. The families below take legs, grids
of weights, masks, pools, fields and shares from the caller and build every sleeve
that follows from them; names tell how a sleeve was made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import combinations

from panelspark.functions.series import Series, Stages

Sleeves = dict[str, Series]


def legs(s: Stages) -> Sleeves:
    """Ranks of the panel's fields, each within its date or its own history: what sleeves can be made of."""
    o, h, lo, c = (s.column(x) for x in ("open", "high", "low", "close"))
    fields = {"size": "total_market_cap", "float": "float_market_cap", "yield": "dividend_yield_ratio", "earnings": "pe_ttm", "turn": "turn", "amount": "amount"}
    values = {name: s.column(column) for name, column in fields.items()} | {
        "gap": o / c.shift(1) - 1, "span": (h - lo) / c, "place": (c - lo) / (h - lo), "volume": s.column("vol").rolling_mean(20), "unrest": c.pct_change(1).rolling_std(20),
    }
    out = {name: x.cs_rank() for name, x in values.items()}
    out |= {f"move{n}": c.pct_change(n).cs_rank() for n in (5, 20, 60)}
    return out | {f"high{n}": c.ts_rank(n) for n in (20, 60, 120)}


def mark(x: float) -> str:
    """A number as part of a name, in thousandths."""
    return f"{round(1000 * x):04d}"


def sleeve(parts: Mapping[str, Series], weights: Mapping[str, float]) -> Series:
    """The weighted sum of legs, NULL if any is; a leg of negative weight counts from its other end."""
    terms = [w * parts[leg] if w > 0 else -w * (1 - parts[leg]) for leg, w in weights.items() if w]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def sums(parts: Mapping[str, Series], names: Iterable[str], sizes: Iterable[int]) -> Sleeves:
    """All sums of so many of the named legs, each of weight 1."""
    names = tuple(names)
    return {"sum_" + "_".join(own): sleeve(parts, dict.fromkeys(own, 1.0)) for n in sizes for own in combinations(names, n)}


def swept(parts: Mapping[str, Series], core: Mapping[str, float], grid: Iterable[float]) -> Sleeves:
    """The core with each of its legs at each weight of the grid, 0 to leave it out."""
    return {f"sweep_{leg}_{mark(w)}": sleeve(parts, {**core, leg: w}) for leg in core for w in grid if w != core[leg]}


def swept_pairs(parts: Mapping[str, Series], core: Mapping[str, float], low: float, high: float) -> Sleeves:
    """The core with one leg at the low and another at the high weight, for every two of its legs in both ways."""
    return {f"pair_{a}_{mark(low)}_{b}_{mark(high)}": sleeve(parts, {**core, a: low, b: high}) for a in core for b in core if a != b}


def replaced(parts: Mapping[str, Series], core: Mapping[str, float], leg: str, others: Iterable[str]) -> Sleeves:
    """The core with one leg exchanged for each of the others, at its weight."""
    rest = {k: w for k, w in core.items() if k != leg}
    return {f"for_{leg}_{other}": sleeve(parts, {**rest, other: core[leg]}) for other in others}


def tilted(base: Series, tilts: Mapping[str, Series], grid: Iterable[float], prefix: str = "tilt") -> Sleeves:
    """The base plus each tilt, a value from 0 to 1, at each weight of the grid; at a negative one its other end."""
    return {f"{prefix}_{name}_{'n' if w < 0 else ''}{mark(abs(w))}": base + (w * x if w > 0 else -w * (1 - x)) for name, x in tilts.items() for w in grid}


def masked(base: Series, masks: Mapping[str, Series], prefix: str = "mask") -> Sleeves:
    """The base where a mask is above zero, NULL elsewhere."""
    return {f"{prefix}_{name}": base.where(x) for name, x in masks.items()}


def ranked_within(values: Mapping[str, Series], pool: Series) -> Sleeves:
    """Each value's rank among the names of a pool."""
    return {name: x.where(pool).cs_rank() for name, x in values.items()}


def ranked_again(base: Series, pools: Mapping[str, Series]) -> Sleeves:
    return {f"again_{name}": x for name, x in {k: base.where(pool).cs_rank() for k, pool in pools.items()}.items()}


def floored(base: Series, pool: Series, value: Series, floors: Iterable[float], shares: Iterable[float], name: str) -> Sleeves:
    """The base where a value reaches a floor, or the quantile that a share of the pool lies below."""
    out = {f"floor_{name}_{mark(x)}": base.where(pool.both(value >= x)) for x in floors}
    return out | {f"share_{name}_{mark(x)}": base.where(pool.both(value >= value.where(pool).cs_quantile(x))) for x in shares}


def floored_apart(base: Series, first: Series, second: Series, value: Series, floors: Iterable[float]) -> Sleeves:
    """As floored, with a floor for the names of a first pool and another for those of the second alone; all ways to choose two of the floors."""
    floors = tuple(floors)
    either = lambda a, b: first.both(value >= a).either(first.not_().both(second).both(value >= b))
    return {f"floors_{mark(a)}_{mark(b)}": base.where(either(a, b)) for a in floors for b in floors if a != b}


def cut(base: Series, pool: Series, values: Mapping[str, Series], shares: Iterable[float]) -> Sleeves:
    """The base without the lowest share of a pool by each value, and without the highest."""
    out = {}
    for name, x in values.items():
        for share in shares:
            out[f"cut_low_{name}_{mark(share)}"] = base.where(x >= x.where(pool).cs_quantile(share))
            out[f"cut_high_{name}_{mark(share)}"] = base.where(x <= x.where(pool).cs_quantile(1 - share))
    return out


def shaped(base: Series, term: Series, shapes: Mapping[str, Callable[[Series], Series]], weight: float) -> Sleeves:
    """The base plus a term bent by each shape."""
    return {f"shape_{name}": base + weight * bend(term) for name, bend in shapes.items()}


#: Ways to bend a value from 0 to 1.
SHAPES: dict[str, Callable[[Series], Series]] = {
    "upper": lambda x: x * (x > 0.5), "lower": lambda x: x * (x < 0.5), "flat": lambda x: x.min(0.7), "square": lambda x: x.pow(2.0), "root": lambda x: x.max(0.0).sqrt(), "middle": lambda x: 1 - 2 * (x - 0.5).abs(),
}
