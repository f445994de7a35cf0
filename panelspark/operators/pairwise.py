"""Correlations of very many columns: cross-products in tiles, summed over the rows where both are known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a tile. A task holds six numbers for each pair of columns, and sends them on tile by tile.
TILE = 64


def _matrix(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])


def _means(values: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """About the mean of each column: it is taken off before products are taken, so that levels don't cost digits."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(columns)), np.zeros(len(columns))
        for batch in batches:
            x = _matrix(batch, columns)
            total, n = total + np.nansum(x, axis=0), n + (~np.isnan(x)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(columns))), "total": pa.array(total), "n": pa.array(n)})

    found = values.mapInArrow(part, "i long, total double, n double").groupBy("i").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean")).collect()  # a row a column
    out = np.zeros(len(columns))
    for row in found:
        out[row["i"]] = row["mean"] or 0.0
    return out


def correlations(panel: DataFrame, columns: tuple[str, ...], least: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b, n, corr) of every two columns, over the rows in which both are known; NULL where one is constant there or n is below `least`.

    Each task multiplies whole blocks of columns and adds up counts, sums and
    products; the sums of tiles of columns are then added up over tasks, one tile
    after the other. NULL and NaN count as unknown; infinite values do too.
    """
    size, tiles = len(columns), -(-len(columns) // tile)
    known = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in columns]
    values = panel.select(*known)
    mean = _means(values, columns)
    spans = [(at * tile, min((at + 1) * tile, size)) for at in range(tiles)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, j): np.zeros((6, spans[i][1] - spans[i][0], spans[j][1] - spans[j][0])) for i in range(tiles) for j in range(i, tiles)}
        for batch in batches:
            x = _matrix(batch, columns) - mean
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(np.float64)
            for (i, j), sums in total.items():
                (a, b), (c, d) = spans[i], spans[j]
                for k, (left, right) in enumerate(((there, there), (x, there), (there, x), (x * x, there), (there, x * x), (x, x))):
                    sums[k] += left[:, a:b].T @ right[:, c:d]
        for (i, j), sums in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, j, sums in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "sums")), strict=True):
                if at != (i, j):
                    if at is not None:
                        yield told(at, total)
                    at, total = (i, j), 0.0
                total = total + np.frombuffer(sums).reshape(6, spans[i][1] - spans[i][0], spans[j][1] - spans[j][0])
        if at is not None:
            yield told(at, total)

    def told(at: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        n, sx, sy, sxx, syy, sxy = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy, cov = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2, sxy / n - sx * sy / n**2
            # A variance that is no more than the rounding error of its terms is none.
            moved = (vx > 1e-13 * sxx / n) & (vy > 1e-13 * syy / n) & (n >= least)
            corr = np.where(moved, cov / np.sqrt(np.where(moved, vx * vy, 1.0)), np.nan)
        row, column = np.meshgrid(np.arange(*spans[at[0]]), np.arange(*spans[at[1]]), indexing="ij")
        upper = row < column
        names = np.array(columns, dtype=object)
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(names[row[upper]], pa.string()), "b": pa.array(names[column[upper]], pa.string()), "n": pa.array(n[upper].astype(np.int64)), "corr": pa.array(corr[upper], pa.float64(), from_pandas=True)}
        )

    sums = values.mapInArrow(part, "i int, j int, sums binary").repartition("i", "j").sortWithinPartitions("i", "j")
    return sums.mapInArrow(merged, "a string, b string, n long, corr double")
