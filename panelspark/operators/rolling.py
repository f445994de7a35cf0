"""Rolling statistics in one pass over ordered histories, in constant or logarithmic time a row.

Histories are cut into blocks of rows; each block also gets the rows before it that
its windows reach back to, so that a long history is spread over tasks. Within a
task, rows stream by in order, with a tail of rows carried from batch to batch.
Quantiles and ranks come from an ordered structure that takes one value in and one
out (O(log n)), extremes from a table of doubling spans, and all else from differences
of running sums, which are held in extended precision about each block's own mean.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of a history.
BLOCK_ROWS = 8_192
KINDS = (
    "ts_rank", "rolling_quantile", "rolling_rank_share", "bars_since_max", "bars_since_min", "ols_slope", "ols_rsquare", "ols_residual",
    "rolling_mean", "rolling_std", "rolling_sum", "rolling_max", "rolling_min", "rolling_cov", "rolling_corr", "rolling_corr_zero",
)
#: Deviations up to this share of the mean are the rounding error of equal values, as in functions.window.
NOISE = 1e-9


@dataclass(frozen=True)
class Rolling:
    """A statistic of the last n values of x (and y). The result is NULL unless all are known; ts_rank asks for the last value and n rows alone.

    ols_*: of the line through the values over their numbers. q: of rolling_quantile.
    digits: the result is rounded to so many; by default not at all.
    """

    kind: str
    x: Column
    n: int
    y: Column | None = None
    q: float | None = None
    digits: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.n < 1 or (self.kind == "rolling_quantile") != (self.q is not None):
            raise ValueError(f"no such statistic: {self.kind} of {self.n}")


class Runs:
    """Values of consecutive rows, whose histories (runs) begin at `begins`."""

    def __init__(self, x: np.ndarray, run: np.ndarray) -> None:
        self.x, self.run, self.known = x, run, ~np.isnan(x)
        self.sums: dict[str, np.ndarray] = {}

    def total(self, name: str, values: np.ndarray, n: int) -> np.ndarray:
        """Sums of the last n values, by difference of running sums."""
        if name not in self.sums:
            self.sums[name] = np.concatenate([[0], np.cumsum(values.astype(np.longdouble))])
        s = self.sums[name]
        out = np.zeros(len(values), dtype=np.longdouble)
        out[n - 1 :] = s[n:] - s[: len(s) - n]
        return out

    def full(self, n: int) -> np.ndarray:
        return self.total("known", self.known, n) == n

    def centred(self) -> np.ndarray:
        """Values less the mean of their run, 0 where unknown."""
        if not hasattr(self, "_centred"):
            count = np.bincount(self.run, self.known)
            self.mean = (np.bincount(self.run, np.where(self.known, self.x, 0.0)) / np.maximum(count, 1))[self.run]
            self._centred = np.where(self.known, self.x - self.mean, 0.0)
        return self._centred

    def constant(self, n: int) -> np.ndarray:
        """Whether the last n values are equal."""
        same = np.concatenate([[False], self.x[1:] == self.x[:-1]])
        return self.total("same", same, n - 1) == n - 1 if n > 1 else np.ones(len(self.x), dtype=bool)

    def squares(self, n: int) -> np.ndarray:
        """Sum of squares about the window's mean."""
        d = self.centred()
        square = self.total("square", d.astype(np.longdouble) ** 2, n) - self.total("sum", d, n) ** 2 / n
        return np.where(self.constant(n), 0, np.maximum(square, 0))

    def latest(self, n: int, sign: int) -> np.ndarray:
        """The row of the greatest (sign 1) or least of the last n values, the latest of equal ones."""
        value = np.where(self.known, self.x * sign, -np.inf)
        best, span = np.arange(len(value)), 1
        while span * 2 <= n:
            before = best[:-span]
            best = np.concatenate([best[:span], np.where(value[best[span:]] >= value[before], best[span:], before)])
            span *= 2
        if span < n:
            back = n - span
            before = best[:-back]
            best = np.concatenate([best[:back], np.where(value[best[back:]] >= value[before], best[back:], before)])
        return best


def compute(call: Rolling, x: Runs, y: Runs | None) -> np.ndarray:
    """The statistic of each row, NaN where it is NULL; rows whose run is shorter than the window are not looked at by the caller."""
    n, kind, size = call.n, call.kind, len(x.x)
    if size < n:
        return np.full(size, np.nan)
    rows = np.arange(size)
    if kind in ("ts_rank", "rolling_quantile", "rolling_rank_share"):
        ordered = pd.Series(x.x).rolling(n, min_periods=1 if kind == "ts_rank" else n)
        if kind == "rolling_quantile":
            return ordered.quantile(call.q).to_numpy()
        if kind == "ts_rank":
            return np.where(x.known, ordered.rank().to_numpy() / n, np.nan)
        return ordered.rank(method="max").to_numpy() / n
    full = x.full(n)
    d = x.centred()
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = x.mean + x.total("sum", d, n) / n
        if kind in ("bars_since_max", "bars_since_min", "rolling_max", "rolling_min"):
            at = x.latest(n, 1 if kind.endswith("max") else -1)
            out = rows - at if kind.startswith("bars") else x.x[at]
        elif kind == "rolling_mean":
            out = mean
        elif kind == "rolling_sum":
            out = mean * n
        elif kind == "rolling_std":
            out = np.sqrt(x.squares(n) / (n - 1)) if n > 1 else np.full(size, np.nan)
        elif kind.startswith("ols"):
            spread = n * (n * n - 1) / 12
            weighted = x.total("weighted", rows * d.astype(np.longdouble), n) - (rows - (n - 1) / 2) * x.total("sum", d, n)
            slope = np.where(x.constant(n), 0, weighted / spread)
            if kind == "ols_slope":
                out = slope
            elif kind == "ols_rsquare":
                square = x.squares(n)
                out = np.where(square > 0, slope**2 * spread / square, 0)
            else:
                out = x.x - (mean + slope * (n - 1) / 2)
        else:
            both = full & y.full(n)
            cross = x.total(f"cross{id(y)}", d.astype(np.longdouble) * y.centred(), n) - x.total("sum", d, n) * y.total("sum", y.centred(), n) / n
            if kind == "rolling_cov":
                out = cross / (n - 1)
            else:
                sx, sy = np.sqrt(x.squares(n) / (n - 1)), np.sqrt(y.squares(n) / (n - 1))
                moved = (sx > NOISE * np.abs(mean)) & (sy > NOISE * np.abs(y.mean + y.total("sum", y.centred(), n) / n))
                out = np.where(moved, cross / (n - 1) / (sx * sy), 0.0 if kind == "rolling_corr_zero" else np.nan)
            full = both
    return np.where(full, np.asarray(out, dtype=np.float64), np.nan)


def with_rolling(panel: DataFrame, calls: Mapping[str, Rolling], key: str = "instrument", order: str = "date", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """panel with a column for each statistic, over the last n rows of a key in an order that has no ties.

    All statistics are computed in one pass: one shuffle by key for the rows'
    numbers, one by key and block. Windows longer than a block make it longer.
    Keys may be NULL; an empty table gives no rows.
    """
    if not calls:
        return panel
    names, longest = panel.columns, max(c.n for c in calls.values())
    block_rows = max(block_rows, longest)
    inputs: dict[str, Column] = {}
    places = []
    for name, call in calls.items():
        used = []
        for column in (call.x, call.y):
            if column is not None:
                text = str(column)
                if text not in inputs:
                    inputs[text] = column
                used.append(list(inputs).index(text))
        places.append((name, call.kind, call.n, call.q, used))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = panel.withColumns({f"x{i}_": F.coalesce(c.cast("double"), F.lit(float("nan"))) for i, c in enumerate(inputs.values())}).withColumn("at_", at)
    own = F.floor(F.col("at_") / block_rows)
    next_too = F.col("at_") % block_rows >= block_rows - (longest - 1)
    blocks = F.when(next_too, F.array(own, own + 1)).otherwise(F.array(own)) if longest > 1 else F.array(own)
    cut = numbered.withColumn("block_", F.explode(blocks)).withColumn("warm_", F.col("block_") > own)
    dealt = cut.repartition(key, "block_").sortWithinPartitions(key, "block_", "at_")
    size = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None  # of the last rows: inputs and places
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(f"x{i}_").to_numpy(zero_copy_only=False) for i in range(size)]
            at = batch.column("at_").to_numpy()
            carried = len(tail[-1]) if tail else 0
            values = [np.concatenate([t, v]) for t, v in zip(tail or [v[:0] for v in (*own, at)], (*own, at), strict=True)]
            step = values[-1]
            begins = np.concatenate([[True], step[1:] != step[:-1] + 1])
            runs = [Runs(v, np.cumsum(begins) - 1) for v in values[:-1]]
            made = {}
            for name, kind, n, q, used in places:
                call = Rolling(kind, None, n, None, q)
                found = compute(call, runs[used[0]], runs[used[1]] if len(used) > 1 else None)[carried:]
                made[name] = pa.array(np.where(at >= n - 1, found, np.nan), pa.float64(), from_pandas=True)
            kept = pa.array(~batch.column("warm_").to_numpy(zero_copy_only=False))
            columns = {c: batch.column(c) for c in names} | made
            yield pa.RecordBatch.from_pydict(columns).filter(kept)
            tail = [v[len(v) - min(len(v), longest - 1) :] for v in values]

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema]
    made = dealt.mapInArrow(run, ", ".join([*kinds, *[f"`{name}` double" for name in calls]]))
    return made.withColumns({name: F.round(name, call.digits) for name, call in calls.items() if call.digits is not None})
