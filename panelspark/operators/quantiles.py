"""Exact quantiles of whole columns: bracketed by sketches, then selected."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.files import shared_folder

#: With so many items, the rank of a sketch's quantile is off by about a thousandth; brackets reach SLACK to both sides.
SKETCH_ITEMS = 4_096
SLACK = 0.005
#: Brackets are narrowed until they hold at most so many rows, which are then put in order.
SELECTED_ROWS = 100_000


@dataclass
class Place:
    """The value of a rank (from 0) of a column, once it is known; till then it lies strictly between a and b, or is one of them.

    before, equal: rows below a and at a. inside: rows strictly between a and b.
    """

    name: str
    rank: int
    a: float
    b: float
    before: int
    equal: int
    inside: int
    value: float | None = None

    def cut(self, c: float, d: float, below: int, at_c: int, between: int, at_d: int) -> None:
        """Go on between the ends of a, c, d and b that enclose the rank, given the rows below c, at c, between c and d, and at d."""
        until = self.before + self.equal + self.inside  # rows below b
        if self.rank < below:
            self.b, self.inside = c, below - self.before - self.equal
        elif self.rank < below + at_c:
            self.value = c
        elif self.rank < below + at_c + between:
            self.a, self.b, self.before, self.equal, self.inside = c, d, below, at_c, between
        elif c < d and self.rank < below + at_c + between + at_d:
            self.value = d
        else:
            self.a, self.before, self.equal = (d, below + at_c + between, at_d) if c < d else (c, below, at_c)
            self.inside = until - self.before - self.equal


def exact_quantiles(rows: DataFrame, values: dict[str, Column], marks: tuple[float, ...]) -> dict[str, list[float | None]]:
    """For each named column the linear quantiles at the marks, exactly as `percentile` gives them; None of a column without values.

    `percentile` gathers all distinct values in one task. Here a mergeable sketch
    brackets each rank that is asked for; the bracket's rows are counted and
    sketched again until few are left, and those alone are ordered. Counts decide,
    sketches only propose, so the result is exact whatever a sketch's error; values
    that many rows share are counted at the brackets' ends. The driver sees counts
    and ends. NULL and NaN count as unknown.
    """
    shared_folder(rows.sparkSession)
    plain = {name: F.when(~F.isnan(x.cast("double")), x.cast("double")) for name, x in values.items()}
    held = rows.select(*[x.alias(name) for name, x in plain.items()]).checkpoint(eager=True)  # narrow, and read again
    first = held.agg(*[f(F.col(name)).alias(f"{name}_{i}") for name in values for i, f in enumerate((F.count, F.min, F.max))]).first()
    wanted: dict[tuple[str, float], tuple[int, float]] = {}
    for name in values:
        n = first[f"{name}_0"]
        wanted |= {(name, mark): (floor(mark * (n - 1)), mark * (n - 1) - floor(mark * (n - 1))) for mark in marks if n}
    ranks = sorted({(name, r) for (name, _), (low, share) in wanted.items() for r in (low, low + (share > 0))})
    ends = {name: (first[f"{name}_1"], first[f"{name}_2"]) for name in values}
    edges = held.agg(*[F.count_if(F.col(name) == F.lit(x)).alias(f"{name}_{i}") for name in values for i, x in enumerate(ends[name])]).first()
    places = []
    for name, rank in ranks:
        (a, b), n, low, high = ends[name], first[f"{name}_0"], edges[f"{name}_0"], edges[f"{name}_1"]
        known = a if rank < low else b if rank >= n - high else None
        places.append(Place(name, rank, a, b, 0, low, n - low - high, known))
    while open_ := [x for x in places if x.value is None and x.inside > SELECTED_ROWS]:
        _narrow(held, open_)
    _select(held, [x for x in places if x.value is None])
    found = {(x.name, x.rank): x.value for x in places}

    def quantile(name: str, mark: float) -> float | None:
        if (name, mark) not in wanted:
            return None
        low, share = wanted[name, mark]
        v = found[name, low]
        return v + (found[name, low + 1] - v) * share if share else v

    return {name: [quantile(name, mark) for mark in marks] for name in values}


def _narrow(held: DataFrame, places: list[Place]) -> None:
    """Sketch the rows strictly within each bracket, and cut it where the sketch puts the rank, with some slack."""
    inside = [F.when((F.col(x.name) > x.a) & (F.col(x.name) < x.b), F.col(x.name)) for x in places]
    sketches = held.agg(*[F.kll_sketch_agg_double(v, F.lit(SKETCH_ITEMS)).alias(f"k{i}") for i, v in enumerate(inside)])
    share = lambda x, way: min(1.0, max(0.0, (x.rank - x.before - x.equal + 0.5) / x.inside + way * SLACK))
    ends = sketches.select(*[F.kll_sketch_get_quantile_double(F.col(f"k{i}"), F.lit(share(x, way))).alias(f"e{i}{way + 1}") for i, x in enumerate(places) for way in (-1, 1)]).first()
    cuts = [(ends[f"e{i}0"], ends[f"e{i}2"]) for i in range(len(places))]
    counts = []
    for i, (x, (c, d)) in enumerate(zip(places, cuts, strict=True)):
        v = F.col(x.name)
        counts += [F.count_if(when).alias(f"n{i}{j}") for j, when in enumerate((v < c, v == c, (v > c) & (v < d), v == d))]
    told = held.agg(*counts).first()
    for i, (x, (c, d)) in enumerate(zip(places, cuts, strict=True)):
        x.cut(c, d, *[told[f"n{i}{j}"] for j in range(4)])


def _select(held: DataFrame, places: list[Place]) -> None:
    """Order the rows that are left in each bracket, SELECTED_ROWS at most, and look the ranks up."""
    if not places:
        return
    pair = lambda i, x: F.when((F.col(x.name) > x.a) & (F.col(x.name) < x.b), F.struct(F.lit(i).alias("i"), F.col(x.name).alias("v")))
    counted = held.select(F.explode(F.array(*[pair(i, x) for i, x in enumerate(places)])).alias("p")).where(F.col("p").isNotNull()).groupBy("p.i", "p.v").agg(F.count("*").alias("n"))
    until = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    of_place = lambda number: F.element_at(F.array(*[F.lit(number(x)) for x in places]), F.col("i") + 1)
    rank = of_place(lambda x: x.rank - x.before - x.equal)
    placed = counted.withColumn("until_", until).where((F.col("until_") > rank) & (F.col("until_") - F.col("n") <= rank))
    for r in placed.select("i", "v").collect():  # a row a rank
        places[r["i"]].value = r["v"]
