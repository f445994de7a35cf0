"""Ranks and quantiles within the sections (dates) of a panel: any number of columns in one pass.

As window functions, each ranked column asks for a sort of the whole rows. Here
rows are dealt and ordered by section once, stream by, and the values of a
section are ordered column by column; a task holds one section at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("cs_rank", "cs_quantile")


@dataclass(frozen=True)
class Section:
    """cs_rank: the average rank of x over the number of known values, NULL where x is. cs_quantile: the linear quantile q of the known values."""

    kind: str
    x: Column
    q: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS or (self.kind == "cs_quantile") != (self.q is not None):
            raise ValueError(f"no such statistic: {self.kind}")


def compute(kind: str, q: float | None, x: pa.Array) -> pa.Array:
    """The statistic of each row of a section; NaN is above all values, and equal to NaN."""
    unknown = x.is_null().to_numpy(zero_copy_only=False)
    values = x.to_numpy(zero_copy_only=False)[~unknown]
    n, out = len(values), np.zeros(len(unknown))
    if kind == "cs_quantile":
        if not n:
            return pa.nulls(len(unknown), pa.float64())
        at, ordered = (n - 1) * q, np.sort(values)
        low, high = int(np.floor(at)), int(np.ceil(at))
        a, b = float(ordered[low]), float(ordered[high])
        return pa.array(np.full(len(unknown), a if low == high or a == b else (high - at) * a + (at - low) * b))
    order = np.argsort(values)
    ordered = values[order]
    differs = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
    first = np.flatnonzero(np.concatenate([np.ones(min(n, 1), dtype=bool), differs]))
    ties = np.diff(np.append(first, n))
    places = np.empty(n)
    places[order] = np.repeat(first + 1 + (ties - 1) / 2, ties) / max(n, 1)
    out[~unknown] = places
    return pa.array(out, mask=unknown)


def with_sections(panel: DataFrame, calls: Mapping[str, Section], key: str = "date") -> DataFrame:
    """panel with a column for each statistic within the rows of a key: one shuffle by key. A call may ask for the column of an earlier one."""
    if not calls:
        return panel
    names, inputs, places = panel.columns, {}, []
    for name, call in calls.items():
        text = str(call.x)
        earlier = next((own for own, *_ in places if text == str(F.col(own))), None)
        if earlier is None:
            inputs.setdefault(text, call.x)
        places.append((name, call.kind, call.q, earlier if earlier is not None else f"x{list(inputs).index(text)}_"))
    valued = panel.withColumns({f"x{i}_": x.cast("double") for i, x in enumerate(inputs.values())})
    dealt = valued.repartition(key).sortWithinPartitions(key)
    size = len(inputs)

    def finished(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {f"x{i}_": pa.chunked_array([b.column(f"x{i}_") for b in held]).combine_chunks() for i in range(size)}
        found = {name: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for name, x in found.items()}
        for name, kind, q, of in places:
            found[name] = compute(kind, q, found[of])
        at = 0
        for batch in held:
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {name: found[name].slice(at, batch.num_rows) for name, *_ in places})
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the section under way
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.run_end_encode(batch.column(key)).run_ends.to_pylist()
            for begin, end in zip([0, *ends], ends):
                if held and batch.column(key)[begin].as_py() != held[-1].column(key)[0].as_py():
                    yield from finished(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from finished(held)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema]
    return dealt.mapInArrow(run, ", ".join([*kinds, *[f"`{name}` double" for name in calls]]))
