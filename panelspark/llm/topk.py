"""Exact top-k by integer inner product: tiles of queries and shards, partial selection, tree merge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import is_finite

#: Rows of a tile's two sides: each row is sent once for every tile of its side, so both are large. A task holds one tile,
#: about 50 MB at 64 dimensions; scores are made a few queries at a time.
QUERY_ROWS = 32_768
SHARD_ROWS = 65_536
#: Lists merged into one at each level of the tree.
FAN_IN = 16
#: Products of whole numbers below this are exact in double precision.
EXACT = float(1 << 53)


def quantised(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of all vectors as doubles; shorter vectors are filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(scale * flat)
    return out


def tile_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> dict:
    """The k best rows of a tile for every query, ties to the smaller id."""
    width = max(queries.shape[1], rows.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * width >= EXACT:
        queries, rows = queries.astype(np.int64), rows.astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    found_query, found_id, found_score = [], [], []
    step = max(1, (1 << 22) // max(1, len(ids)))
    for start in range(0, len(query_ids), step):
        scores = queries[start : start + step] @ rows.T
        for own, line in zip(query_ids[start : start + step], scores, strict=True):
            at = np.flatnonzero(ids != own)
            if len(at) > k:
                floor = np.partition(line[at], len(at) - k)[len(at) - k]
                at = at[line[at] >= floor]
            best = at[np.argsort(-line[at], kind="stable")[:k]]
            found_query.append(np.full(len(best), own))
            found_id.append(ids[best])
            found_score.append(line[best].astype(np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return {"query_id": join(found_query), "vec_id": join(found_id), "score": join(found_score)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the k best other rows of each query.

    The score is the inner product of floor(scale * x), as 64-bit integers.
    Rows are dealt by hash into shards and queries into blocks, both of bounded
    size, so that every pair of a block and a shard is one task's tile. Each
    tile selects k rows a query; lists then merge, FAN_IN shards at a time.

    Vectors that are null or hold a null or non-finite component take no part,
    nor do rows without an id. A shorter vector counts as filled up with zeros.
    Rows that repeat an id are all candidates, but none for a query of that id.
    Queries that repeat an id all ask, and share one list: a candidate stands in
    it once for each of them, as in the SQL of op3_topk.
    With fewer than k candidates all are returned; empty tables give no rows.
    """
    rows = vectors.where(is_finite(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(is_finite(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    # Small inputs are still cut into a tile for each core or so.
    shards = max(shards, min(vectors.sparkSession.sparkContext.defaultParallelism, shards * 16))
    spread = F.pmod(F.xxhash64("id", F.hash("v")), F.lit(shards)).cast("int")
    side = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), spread.alias("shard"), F.lit(False).alias("asks"), "id", "v")
    block = F.pmod(F.xxhash64("id", F.hash("v")), F.lit(blocks)).cast("int")
    other = asked.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")

    def tile(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        ids = table.column("id").combine_chunks().to_numpy()
        values = quantised(table.column("v").combine_chunks(), scale)
        out = tile_top(ids[asks], values[asks], ids[~asks], values[~asks], k)
        n = len(out["query_id"])
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32())} | {name: pa.array(x, pa.int64()) for name, x in out.items()})

    lists = side.unionByName(other).groupBy("block", "shard").applyInArrow(tile, "shard int, query_id long, vec_id long, score long")
    while True:
        shards = math.ceil(shards / FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        best = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
