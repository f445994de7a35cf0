"""Embedding near-duplicates by NN-descent.

1. Start: random hyperplanes cut the vectors of a label into small leaves, some
   times over; each leaf gives its rows their first neighbours.
2. Descent: around every node, its neighbours and the nodes that have it as a
   neighbour meet; pairs that improve a list are kept, until few change.
3. Lists that are full of links are enlarged and refined again. A list holds
   every link that was met until it has `largest` of them. Components that hold
   a node whose list is then full are compared exactly, in blocks, with all
   rows of their label that a bound on angles does not rule out.
4. Audit: a fixed number of nodes whose lists are not full is compared with all
   rows; if too few of their links were found, another start is added and the
   descent repeated. If the last start fails too, all pairs are compared.
The search carries vectors of unit length as 16-bit integers; pairs whose cosine
lies closer to the threshold than that rounding are compared again in double
precision. Links are the pairs at or above the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import is_finite, joined_by, saved
from panelspark.llm.components import connected_components


#: Sizes of components are broadcast only up to this count.
BROADCAST_ROOTS = 100_000
#: A component x of a unit vector is carried as round(SHORT * x).
SHORT = 32_767


@dataclass(frozen=True)
class Settings:
    """threshold: least cosine of a link. neighbours, largest: list sizes, first and at most. trees, leaf: of a start; labels
    of many rows get more trees. rounds: descents of a start. audit: nodes of the audit; recall: what it asks for; starts: at most so many."""

    threshold: float = 0.93
    neighbours: int = 10
    largest: int = 40
    trees: int = 12
    leaf: int = 32
    rounds: int = 3
    audit: int = 512
    recall: float = 0.98
    starts: int = 3
    seed: int = 11


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    for batch in batches:
        v = batch.column("v")
        flat, size = np.asarray(v.flatten().to_numpy(zero_copy_only=False), dtype=np.float64), np.diff(v.offsets.to_numpy())
        start = np.cumsum(size) - size
        if len(flat):
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), start), size)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, start)), size) + 0.0
        unit = pa.ListArray.from_arrays(pa.array(np.append(start, len(flat)), pa.int32()), pa.array(flat, pa.float64()))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": unit, "label": batch.column("label")})


def _rounded(v: pa.ListArray) -> pa.Array:
    """The vectors as 16-bit integers, a binary value each."""
    flat = np.rint(np.asarray(v.flatten().to_numpy(zero_copy_only=False)) * SHORT).astype("<i2")
    ends = np.append(0, np.cumsum(np.diff(v.offsets.to_numpy()))).astype(np.int32) * 2
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _short(q: pa.Array) -> np.ndarray:
    """Rounded vectors of one length as a matrix."""
    return np.frombuffer(b"".join(q.to_pylist()), dtype="<i2").reshape(len(q), -1).astype(np.float32) / SHORT


def _margin(dim: int) -> float:
    """The most by which a product of rounded unit vectors differs from their cosine.

    Rounding moves a vector by at most sqrt(dim) / 2 / SHORT; sums in single precision are off by far less than the second term.
    """
    return math.sqrt(dim) / SHORT + 1e-5 + dim * 1e-7


def _runs(key: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal keys, and the end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no run of equal values is split."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column(column).to_numpy()
        cut = int(_runs(key)[-2])
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None:
        yield held


def _edges(a: list, b: list, cosine: list) -> pa.RecordBatch:
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.RecordBatch.from_pydict({"a": join(a, pa.int64()), "b": join(b, pa.int64()), "cosine": join(cosine, pa.float64())})


def _best(ids: np.ndarray, cosine: np.ndarray, floor: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a cosine matrix, the k best others above the row's floor; the `largest` best where so many are links."""
    n = len(ids)
    cosine = cosine.copy()
    cosine[ids[:, None] == ids[None]] = -2
    k, most = min(k, n - 1), min(max(k, s.largest), n - 1)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-cosine, axis=1)[:, :k]
    value = np.take_along_axis(cosine, near, 1)
    row, at = np.nonzero(value > floor[:, None])
    a, b, found = ids[row], ids[near[row, at]], value[row, at]
    many = np.flatnonzero((cosine >= s.threshold).sum(1) > k)
    if len(many):
        near = np.argpartition(-cosine[many], most - 1, axis=1)[:, :most]
        value = np.take_along_axis(cosine[many], near, 1)
        row, at = np.nonzero((value >= s.threshold) & (value > floor[many][:, None]))
        a, b, found = np.append(a, ids[many[row]]), np.append(b, ids[near[row, at]]), np.append(found, value[row, at])
    return a, b, found


def _trees(bits: int, s: Settings) -> int:
    """Trees after which a pair at the threshold has shared a leaf with probability `recall`, `trees` at least."""
    apart = 1 - (1 - math.acos(s.threshold) / math.pi) ** bits
    return max(s.trees, math.ceil(math.log(max(1 - s.recall, 1e-9)) / math.log(apart))) if 0 < apart < 1 else s.trees


def _start(nodes: DataFrame, sizes: DataFrame, bits: int, seed: int, s: Settings) -> DataFrame:
    """First neighbours: leaves of at most 2 * leaf rows, of independent cuts by random hyperplanes.

    A label (and length of vectors) takes as many bits and trees as its own
    count asks for; `bits` are those of the largest. sizes: (label, dim, bits, trees).
    """
    most = _trees(bits, s)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, size = batch.column("v").flatten(), np.diff(batch.column("v").offsets.to_numpy())
            values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
            code = np.zeros((len(size), most), dtype=np.int64)
            spread = np.zeros((len(size), most))
            start = np.cumsum(size) - size
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                x = values[start[own][:, None] + np.arange(dim)]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), most * (bits + 1)))
                side = (x @ planes[dim]).reshape(len(own), most, bits + 1)
                code[own] = (side[:, :, :bits] > 0) @ (1 << np.arange(bits)) if bits else 0
                spread[own] = side[:, :, bits]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "label": batch.column("label"),
                    "q": batch.column("q"),
                    "codes": pa.array(list(code), pa.list_(pa.int64())),
                    "spread": pa.array(list(spread), pa.list_(pa.float64())),
                }
            )

    kind = nodes.schema["label"].dataType.simpleString()
    coded = nodes.mapInArrow(codes, f"id long, label {kind}, q binary, codes array<long>, spread array<double>")
    coded = coded.withColumn("dim", (F.octet_length("q") / 2).cast("int")).join(_few(sizes), ["label", "dim"])
    trees = coded.select("id", "label", "dim", "q", "spread", "bits", F.posexplode(F.slice("codes", F.lit(1), F.col("trees"))).alias("tree", "code"))
    own_bits = F.col("code").bitwiseAND(F.expr("shiftleft(1L, bits) - 1"))
    leaf_key = F.xxhash64("label", "tree", own_bits, "dim")
    placed = trees.select(leaf_key.alias("leaf"), F.element_at("spread", F.col("tree") + 1).cast("float").alias("place"), "id", "q")
    # Ordered by place within a leaf and dealt by range, a crowded leaf is cut between tasks and into parts.
    ordered = placed.repartitionByRange("leaf", "place", "id").sortWithinPartitions("leaf", "place", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, ids = batch.column("leaf").to_numpy(), batch.column("id").to_numpy()
            lists = batch.column("q")
            a, b, cosine = [], [], []
            bounds = _runs(leaf)
            for low, high in zip(bounds, bounds[1:], strict=False):
                for at in range(low, high, s.leaf):
                    end = min(at + 2 * s.leaf, high)  # parts overlap by half
                    if end - at > 1:
                        x = _short(lists.slice(at, end - at))
                        found = _best(ids[at:end], x @ x.T, np.full(end - at, -1.5), s.neighbours, s)
                        for out, part in zip((a, b, cosine), found, strict=True):
                            out.append(part)
                    if end == high:
                        break
            yield _edges(a, b, cosine)

    return ordered.mapInArrow(meet, "a long, b long, cosine double")


def _lists(edges: DataFrame, k: int, s: Settings) -> DataFrame:
    """The k best distinct neighbours of each node and its links, `largest` at most, as a table (a, b, cosine, rank)."""
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    distinct = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    ranked = distinct.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(k, s.largest))
    return ranked.where((F.col("rank") <= k) | (F.col("cosine") >= s.threshold))


def _descend(lists: DataFrame, nodes: DataFrame, k: int, s: Settings) -> DataFrame:
    """One round: neighbours of neighbours meet around their common node; better pairs join the lists."""
    back = Window.partitionBy("b").orderBy(F.desc("cosine"), "a")
    top = lists.where(F.col("rank") <= k)
    reverse = top.withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= k)
    around = top.select(F.col("a").alias("hub"), F.col("b").alias("id")).unionByName(reverse.select(F.col("b").alias("hub"), F.col("a").alias("id"))).distinct()
    # A list of fewer than `largest` links still takes every link.
    full = F.count_if(F.col("cosine") >= s.threshold) >= s.largest
    floor = F.when(full, F.min("cosine")).when(F.count("*") >= k, F.least(F.min("cosine"), F.lit(s.threshold - 1e-12))).otherwise(F.lit(-1.5))
    floor = lists.groupBy(F.col("a").alias("id")).agg(floor.alias("floor"))
    filled = nodes.select("id", "q").join(floor, "id", "left").select("id", "q", F.coalesce("floor", F.lit(-1.5)).cast("float").alias("floor"))
    met = around.join(filled, "id").repartition("hub").sortWithinPartitions("hub", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, "hub"):
            hub, ids, floor = (batch.column(c).to_numpy() for c in ("hub", "id", "floor"))
            a, b, cosine = [], [], []
            bounds = _runs(hub)
            for low, high in zip(bounds, bounds[1:], strict=False):
                if high - low > 1:
                    own = _short(batch.column("q").slice(low, high - low))
                    found = _best(ids[low:high], own @ own.T, floor[low:high], k, s)
                    for out, part in zip((a, b, cosine), found, strict=True):
                        out.append(part)
            yield _edges(a, b, cosine)

    better = met.select("hub", "id", "q", "floor").mapInArrow(meet, "a long, b long, cosine double")
    return saved(_lists(lists.drop("rank").unionByName(better), k, s))


def _links(lists: DataFrame, nodes: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Each linked pair once, the smaller id first. Pairs within the margin of the threshold are compared in double precision."""
    near = lists.where(F.col("cosine") >= threshold - margin)
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))
    sure = pairs.where(F.col("cosine") >= threshold + margin).select("a", "b")
    close = pairs.where(F.col("cosine") < threshold + margin)
    whole = lambda end: nodes.select(F.col("id").alias(end), F.col("v").alias(f"v{end}"))
    product = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    exact = close.join(whole("a"), "a").join(whole("b"), "b").where(product >= threshold).select("a", "b")
    return sure.unionByName(exact)


def _audit(nodes: DataFrame, links: DataFrame, full: DataFrame, s: Settings) -> float:
    """Share of the links of `audit` nodes, chosen by hash, that were found. The nodes are compared with all rows.

    Nodes with a full list are left out on both sides: their links are compared exactly later.
    """
    nodes = nodes.join(full, "id", "left_anti")
    probe = saved(nodes.orderBy(F.xxhash64("id", F.lit(s.seed))).limit(s.audit))
    rows = probe.select("id", "label", "v").collect()  # bounded by `audit`
    shared = nodes.sparkSession.sparkContext.broadcast([(r["id"], r["label"], np.array(r["v"])) for r in rows])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = batch.column("id").to_numpy(), np.array(batch.column("label").to_pylist(), dtype=object)
            size = np.diff(batch.column("v").offsets.to_numpy())
            a, b, cosine = [], [], []
            for label in {r[1] for r in shared.value}:
                for dim in {len(r[2]) for r in shared.value if r[1] == label}:
                    asked = [r for r in shared.value if r[1] == label and len(r[2]) == dim]
                    at = np.flatnonzero((labels == label) & (size == dim))
                    if len(at):
                        x = _matrix(batch.column("v").take(pa.array(at)))
                        near = np.array([r[2] for r in asked]) @ x.T
                        q, r = np.nonzero(near >= s.threshold)
                        a.append(np.array([x[0] for x in asked])[q])
                        b.append(ids[at[r]])
                        cosine.append(near[q, r])
            yield _edges(a, b, cosine)

    true = nodes.select("id", "label", "v").mapInArrow(compare, "a long, b long, cosine double").where(F.col("a") != F.col("b"))
    pairs = true.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("true", F.lit(1))
    there, found = pairs.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").agg(F.count("*"), F.count("found")).first()
    return found / there if there else 1.0


def _few(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROOTS else small


def _candidates(members: DataFrame, nodes: DataFrame, s: Settings, block: int = 2048) -> DataFrame:
    """(root, id, v, copies): all nodes of a component's label, but for those that can't link with any of its members.

    By the triangle inequality of angles a node that links with a member is at
    most the radius of the component and the angle of a link away from its root.
    """
    pivots = members.where(F.col("id") == F.col("root")).select("root", "label", F.col("v").alias("pivot"))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, pivot = (batch.column(c) for c in ("v", "pivot"))
                product = np.asarray(v.flatten().to_numpy(zero_copy_only=False)) * np.asarray(pivot.flatten().to_numpy(zero_copy_only=False))
                size = np.diff(v.offsets.to_numpy())
                cosine = np.add.reduceat(product, np.cumsum(size) - size)
                yield pa.RecordBatch.from_pydict({"root": batch.column("root"), "cosine": pa.array(cosine, pa.float64())})

    met = members.select("root", "v").join(_few(pivots.select("root", "pivot")), "root").mapInArrow(cosines, "root long, cosine double")
    radius = met.groupBy("root").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cosine")))).alias("radius"))
    reach = F.cos(F.least(F.lit(math.pi), F.col("radius") + math.acos(s.threshold))) - 1e-6  # far above rounding
    pivots = saved(pivots.join(radius, "root").select("label", F.size("pivot").alias("dim"), "root", "pivot", reach.alias("reach")))
    # Every block of rows of a label meets every block of its pivots in one task.
    sized = nodes.select("label", F.size("v").alias("dim"), "id", "v", "copies")
    count = lambda t, name: t.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = _few(saved(count(sized, "row_blocks").join(count(pivots, "pivot_blocks"), ["label", "dim"])))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    rows = sized.join(blocks, ["label", "dim"]).select(
        "label", "dim", place("id", "row_blocks").alias("x"), upto("pivot_blocks").alias("y"), F.lit(False).alias("asks"), "id", "v", "copies", F.lit(0.0).alias("reach")
    )
    asks = pivots.join(blocks, ["label", "dim"]).select(
        "label", "dim", upto("row_blocks").alias("x"), place("root", "pivot_blocks").alias("y"), F.lit(True).alias("asks"),
        F.col("root").alias("id"), F.col("pivot").alias("v"), F.lit(0).cast("long").alias("copies"), "reach",
    )

    def tile(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        x = _matrix(table.column("v").combine_chunks())
        reach, ids = (table.column(c).combine_chunks().to_numpy() for c in ("reach", "id"))
        pivot, row = np.nonzero(x[asks] @ x[~asks].T >= reach[asks][:, None])
        found = table.select(["id", "v", "copies"]).take(pa.array(np.flatnonzero(~asks)[row]))
        return found.add_column(0, "root", pa.array(ids[asks][pivot], pa.int64()))

    return rows.unionByName(asks).groupBy("label", "dim", "x", "y").applyInArrow(tile, "root long, id long, v array<double>, copies long")


def _compared(asks: DataFrame, answers: DataFrame, s: Settings, block: int = 512) -> DataFrame:
    """(id, asks boolean, copies, mate) of the nodes that link, in parts: sums over all linked nodes of the other side, and a node of the same component.

    Both sides (root, id, v, copies) are dealt into blocks by hash; every pair
    of blocks of a root meets in one task, which returns sums, not pairs.
    """
    count = lambda t, name: t.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = _few(saved(count(asks, "ask_blocks").join(count(answers, "answer_blocks"), "root")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asks.join(blocks, "root").select("root", place("ask_blocks").alias("x"), upto("answer_blocks").alias("y"), F.lit(True).alias("asks"), "id", "v", "copies")
    right = answers.join(blocks, "root").select("root", upto("ask_blocks").alias("x"), place("answer_blocks").alias("y"), F.lit(False).alias("asks"), "id", "v", "copies")

    def tile(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        x = _matrix(table.column("v").combine_chunks())
        ids, copies = (table.column(c).combine_chunks().to_numpy() for c in ("id", "copies"))
        one, two = ids[asks], ids[~asks]
        linked = (x[asks] @ x[~asks].T >= s.threshold) & (one[:, None] != two[None])
        none, low, high = np.iinfo(np.int64).max, one, two
        while linked.any():
            before = low, high
            low = np.minimum(low, np.where(linked, high[None], none).min(1, initial=none))
            high = np.minimum(high, np.where(linked, low[:, None], none).min(0, initial=none))
            if (low == before[0]).all() and (high == before[1]).all():
                break
        total = np.append((linked * copies[~asks]).sum(1), (linked * copies[asks][:, None]).sum(0)).astype(np.int64)
        kept = np.flatnonzero(total)
        side = np.repeat([True, False], [len(one), len(two)])
        out = {"id": np.append(one, two), "asks": side, "copies": total, "mate": np.append(low, high)}
        return pa.table({name: pa.array(value[kept]) for name, value in out.items()})

    return left.unionByName(right).groupBy("root", "x", "y").applyInArrow(tile, "id long, asks boolean, copies long, mate long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", s: Settings = Settings()) -> DataFrame:
    """(id, n_links long, component_id long, kept boolean) of every row.

    Rows link if their labels are equal and not null and their cosine, in double
    precision, is at or above the threshold. Equal vectors of a label are one
    node that stands for all its copies, so no pairs within a group of copies
    arise. Vectors of different lengths link with nothing of another length.
    Null or zero vectors, vectors with a null or non-finite component, and rows
    without label or id link with nothing: 0 links, their own id, kept. Rows
    that repeat an id are rows of their own, each a link of the other if their
    vectors are equal. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    able = is_finite("v") & F.col("label").isNotNull() & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)
    good = saved(rows.where(able).mapInArrow(_unit, f"id long, v array<double>, label {rows.schema['label'].dataType.simpleString()}"))
    classes = good.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    shorter = lambda batches: (batch.append_column("q", _rounded(batch.column("v"))) for batch in batches)
    shorted = classes.mapInArrow(shorter, f"label {rows.schema['label'].dataType.simpleString()}, v array<double>, least long, copies long, q binary")
    # Classes of equal vectors go by numbers of their own: one id may stand at several vectors.
    nodes = saved(shorted.withColumn("id", F.monotonically_increasing_id()))
    sizes = saved(nodes.groupBy("label", F.size("v").alias("dim")).count())
    largest, longest = sizes.agg(F.max("count"), F.max("dim")).first()
    largest, margin = largest or 0, _margin(longest or 0)
    loose = replace(s, threshold=s.threshold - margin)
    bits = max(0, math.ceil(math.log2(max(1, largest) / s.leaf)))
    trees = F.array(*[F.lit(_trees(b, s)) for b in range(bits + 1)])
    own_bits = F.least(F.lit(bits), F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / s.leaf)))).cast("int")
    sizes = sizes.select("label", "dim", own_bits.alias("bits")).withColumn("trees", F.element_at(trees, F.col("bits") + 1))

    lists, k, passed = None, s.neighbours, False
    for start in range(s.starts):
        fresh = _start(nodes, sizes, bits, s.seed + start, loose)
        lists = saved(_lists(fresh if lists is None else lists.drop("rank").unionByName(fresh), k, loose))
        for _ in range(s.rounds):
            before = lists
            lists = _descend(lists, nodes, k, loose)
            gained = lists.join(before.select("a", "b"), ["a", "b"], "left_anti").count()
            if gained <= 0.01 * max(1, lists.count()):
                break
        while k < s.largest and not _saturated(lists, k, loose).isEmpty():
            k = min(2 * k, s.largest)
            crowded = _saturated(lists, k // 2, loose)
            near = lists.join(crowded.withColumnRenamed("id", "a"), "a", "left_semi")
            more = _descend(near, nodes.join(near.select(F.col("b").alias("id")).unionByName(crowded).distinct(), "id", "left_semi"), k, loose)
            lists = saved(_lists(lists.unionByName(more).drop("rank"), k, loose))
        links = saved(_links(lists, nodes, s.threshold, margin))
        full = saved(_saturated(lists, s.largest, loose))
        passed = _audit(nodes, links, full, s) >= s.recall
        if passed:
            break
    roots = saved(connected_components(links)).withColumnRenamed("node", "id")
    asked = nodes.select("id").limit(0)
    part = None
    if not passed:
        whole = nodes.withColumn("root", F.xxhash64("label", F.size("v"))).select("root", "id", "v", "copies")
        asked, part = nodes.select("id"), saved(_compared(whole, whole, s))
        roots = _joined(roots, part)
    elif not full.isEmpty():
        crowds = _few(saved(roots.join(full, "id", "left_semi").select("root").distinct()))
        members = saved(nodes.join(roots.join(crowds, "root", "left_semi"), "id"))
        asked = members.select("id")
        part = saved(_compared(members.select("root", "id", "v", "copies"), _candidates(members, nodes, s), s))
        roots = _joined(roots, part)
    counted = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(asked.withColumnRenamed("id", "b"), "b", "left_anti")
    counted = counted.join(nodes.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("linked"))
    # Nodes that were asked are counted whole; of the others, the links with asked nodes.
    sums = F.sum(F.when(F.col("asks"), F.col("copies"))).alias("exact"), F.sum(F.when(~F.col("asks"), F.col("copies"))).alias("answered")
    exact = (nodes.select("id", F.lit(True).alias("asks"), "copies", F.col("id").alias("mate")).limit(0) if part is None else part).groupBy("id").agg(*sums)
    named = nodes.join(counted, "id", "left").join(exact, "id", "left").join(roots, "id", "left")
    linked = F.coalesce("exact", F.coalesce("linked", F.lit(0)) + F.coalesce("answered", F.lit(0)))
    told = saved(named.select("label", "v", "least", (F.col("copies") - 1 + linked).alias("n_links"), F.coalesce("root", "id").alias("group")))
    known = joined_by(told, told.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    found = good.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    rest = rows.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _saturated(lists: DataFrame, k: int, s: Settings) -> DataFrame:
    """Nodes whose list is full of links: they may have more."""
    return lists.where(F.col("cosine") >= s.threshold).groupBy(F.col("a").alias("id")).count().where(F.col("count") >= k).select("id")


def _joined(roots: DataFrame, part: DataFrame) -> DataFrame:
    """Roots (id, root) after the components that hold a node and its mate became one."""
    pairs = part.where(F.col("id") != F.col("mate")).select("id", "mate").distinct()
    pairs = pairs.join(roots, "id", "left").select("mate", F.coalesce("root", "id").alias("a"))
    pairs = pairs.join(roots.withColumnRenamed("id", "mate"), "mate", "left").select("a", F.coalesce("root", "mate").alias("b"))
    merged = saved(pairs.where(F.col("a") != F.col("b")).distinct())
    if merged.isEmpty():
        return roots
    last = saved(connected_components(merged)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    old = roots.join(last, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    # A node that had no link until now is its own root.
    new = last.select(F.col("root").alias("id"), F.col("last").alias("root")).join(roots.select("id"), "id", "left_anti")
    return saved(old.unionByName(new))
