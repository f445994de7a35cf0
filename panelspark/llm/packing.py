"""Best-fit-decreasing packing of token ids into rows of fixed length."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bpe import read_ranks


#: Packed rows of a batch on their way to the JVM, and bytes of a row group: they bound a task's memory.
BATCH_ROWS = 256
GROUP_BYTES = 1 << 25


class CapacityTree:
    """Counts of open rows by free capacity, in a segment tree: finds the least sufficient capacity in log time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, change: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += change
            at >>= 1

    def least(self, size: int) -> int | None:
        """The smallest free capacity of at least `size` that some row has."""
        count, at = self.count, self.leaves + size
        if count[at]:
            return size
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of item positions; sizes are from 1 to capacity. Ties keep the given order."""
    tree, rows, free_rows = CapacityTree(capacity), [], [[] for _ in range(capacity + 1)]
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = tree.least(sizes[item])
        if free is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row = free_rows[free].pop()
            tree.add(free, -1)
        rows[row].append(item)
        left = free - sizes[item]
        if left:
            free_rows[left].append(row)
            tree.add(left, 1)
    return rows


def pack_tokens(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, block_docs: int = 2048
) -> DataFrame:
    """Encode whole texts and pack them into rows of at most `capacity` token ids.

    Returns (block long, row long, ids binary, positions binary, n_tokens int,
    cu_seqlens array<int>, ids_of array<long>, offsets array<long>): ids and
    positions are little-endian unsigned 32-bit integers; segment j is
    ids[cu_seqlens[j]:cu_seqlens[j + 1]], from the document ids_of[j], whose
    tokens it continues at offsets[j]; positions restart at 0 at each cumulative
    length. Texts with more than
    `capacity` tokens are split into segments without loss. Each block of
    `block_docs` documents of a task is packed by itself: no shuffle, bounded
    memory, and a lost task packs the same rows anew.

    Null and empty texts have no tokens and so no segment. Null ids stay null.
    Repeated rows are packed each. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast({base64.b64encode(k).decode(): v for k, v in read_ranks(vocabulary).items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(k): v for k, v in shared.value.items()}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        block = 0
        for batch in batches:
            for start in range(0, batch.num_rows, block_docs):
                part = batch.slice(start, block_docs)
                tokens = [np.array(encode(x or ""), dtype="<u4") for x in part.column(1).to_pylist()]  # a ninth of a list's memory
                rows = _packed(part.column(0).to_pylist(), tokens, capacity, block)
                yield from (rows.slice(at, BATCH_ROWS) for at in range(0, rows.num_rows, BATCH_ROWS))
                block += 1

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = given.mapInArrow(
        pack, "block long, row long, ids binary, positions binary, n_tokens int, cu_seqlens array<int>, ids_of array<long>, offsets array<long>"
    )
    return packed.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("block"))


def _packed(ids: list, encoded: list[np.ndarray], capacity: int, block: int) -> pa.RecordBatch:
    segments = [(d, at, min(capacity, len(x) - at)) for d, x in enumerate(encoded) for at in range(0, len(x), capacity)]
    rows = best_fit_decreasing([size for _, _, size in segments], capacity)
    out: dict[str, list] = {"ids": [], "positions": [], "n_tokens": [], "cu_seqlens": [], "ids_of": [], "offsets": []}
    places = np.arange(capacity, dtype="<u4")
    for row in rows:
        own = [segments[i] for i in row]
        out["positions"].append(b"".join(places[:size].tobytes() for _, _, size in own))
        out["ids"].append(b"".join(encoded[d][at : at + size].tobytes() for d, at, size in own))
        lengths = np.cumsum([0, *(size for _, _, size in own)])
        out["n_tokens"].append(int(lengths[-1]))
        out["cu_seqlens"].append(lengths)
        out["ids_of"].append([ids[d] for d, _, _ in own])
        out["offsets"].append([at for _, at, _ in own])
    kinds = {"ids": pa.binary(), "positions": pa.binary(), "n_tokens": pa.int32(), "cu_seqlens": pa.list_(pa.int32()), "ids_of": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64())}
    n = len(rows)
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([block] * n, pa.int64()), "row": pa.array(range(n), pa.int64())} | {k: pa.array(v, kinds[k]) for k, v in out.items()}
    )


def free_id(vocabulary: str) -> int:
    """An id that no token of a rank file has, for padding."""
    return max(read_ranks(vocabulary).values()) + 1


def write_matrices(packed: DataFrame, path: str, capacity: int = 2048, pad: int = 50_256) -> None:
    """Write packed rows as Parquet: matrices of ids and positions, and what pack_tokens says of their segments.

    A matrix row is a binary value of `capacity` little-endian 32-bit integers,
    so a batch of them is one array to numpy. positions restart at 0 with each
    segment. What a row has free is filled with `pad` (see free_id: an id outside
    the vocabulary) at position 0; n_tokens tells where that begins. Null and
    empty texts are in no row; an empty table gives an empty file with the same
    columns.
    """
    if not 0 <= pad < 1 << 32:
        raise ValueError(f"not an id: {pad}")
    filled = lambda name, filler: F.rpad(name, capacity * 4, F.lit(bytearray(filler.to_bytes(4, "little")))).alias(name)
    rows = packed.select("block", "row", filled("ids", pad), filled("positions", 0), "n_tokens", "cu_seqlens", "ids_of", "offsets")
    rows.write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def digests(matrices: DataFrame) -> DataFrame:
    """Written matrices with SHA-256 digests in place of ids (a row's own, without padding) and positions (the whole row)."""
    own = F.substring("ids", F.lit(1), F.col("n_tokens") * 4)
    return matrices.select(
        "block", "row", F.sha2(own, 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"), "n_tokens", "cu_seqlens", "ids_of", "offsets"
    )
