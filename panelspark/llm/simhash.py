"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into a ring of segments. If two of them differ in at most
t of all bits, some segment starts a chain whose first l segments differ in at
most l * t / m bits together, for every l (m segments in all). So candidates
must agree on a first segment, and a pair is dropped as soon as its chain
exceeds the budget; only what survives the whole ring has its full distance
within t. For 64 bits and t = 3 the remaining three segments, cut into four
parts, must agree on one part too, which makes the join keys 28 bits wide and
loses no pair. For wide fingerprints and t beyond that, a chain's first segment
may differ in a few bits itself; those most likely to, the ones whose counts
were closest to half, are flipped in turn for further keys (probes). A common key
is then likely rather than certain, so such a plan is audited: a fixed number of
fingerprints is compared with all; while links are missing, a further round
takes its keys from other bits, and after the last one all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import joined_by, mapped, saved, text_bytes
from panelspark.llm.components import connected_components
from panelspark.llm.shingle_hash import fingerprints

SEGMENT_BITS = 16
#: Runs up to this length are compared by shifting the whole batch, longer ones in blocks.
SHORT_RUN = 48
#: A key with more fingerprints is dealt out over tiles of two blocks of about this size.
BLOCK_ROWS = 4096
#: Hot keys are broadcast only up to this count.
BROADCAST_KEYS = 100_000
#: Bits of a probed key, and how far apart the keys of a round begin.
PROBED_BITS = 20
PROBED_STEP = 32
#: Rounds of probed keys: where in each step the keys begin.
ROUND_STARTS = (0, 12, 22, 6)


@dataclass(frozen=True)
class Plan:
    """How fingerprints are compared.

    words: words of a shingle. bits: fingerprint width. distance: largest
    number of differing bits that links. slack: bits added to the budget of
    every chain; any budget at or above l * t / m keeps the filter safe. probes:
    keys of PROBED_BITS bits from every 32, as they are and with each of the
    probes - 1 weakest flipped (0: the keys of `keys()` instead). audit, recall:
    with probes, so many fingerprints are compared with all, and that share of
    those with links must have every link of theirs within its component.

    The default finds all pairs. `near()` is for similarity 0.8: shingle sets
    with Jaccard j have an expected share of acos(2j / (1 + j)) / pi differing
    bits, 0.151 at 0.8; distance 90 of 512 adds 1.5 standard deviations. Of the
    pairs within it, 95 to 97 % share a key of the first round at 0.8, 99 % at
    0.85 and all at 0.9. Slack 16 of a chain is four standard deviations of how
    unevenly 90 differing bits lie.
    """

    words: int = 3
    bits: int = 64
    distance: int = 3
    slack: int = 0
    probes: int = 0
    audit: int = 2_048
    recall: float = 0.98

    @staticmethod
    def near() -> Plan:
        return Plan(words=5, bits=512, distance=90, slack=16, probes=3)

    @property
    def segments(self) -> int:
        return self.bits // SEGMENT_BITS

    def budget(self, chain: int) -> int:
        """Differing bits allowed in a chain of so many segments."""
        return min(self.distance, chain * self.distance // self.segments + self.slack)

    def keys(self) -> list[tuple[int, list[int]]]:
        """Of each join key: the chain's first segment, and the hex digits that must agree."""
        digits = SEGMENT_BITS // 4
        out = []
        for start in range(self.segments):
            own = [start * digits + i for i in range(digits)]
            rest = [d for d in range(self.bits // 4) if d not in own]
            parts = self.distance + 1
            if self.distance < self.segments and len(rest) % parts == 0:
                size = len(rest) // parts
                out += [(start, own + rest[p * size : (p + 1) * size]) for p in range(parts)]
            else:
                out.append((start, own))
        return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """(node, text binary, fp binary) of whole texts; null, empty and blank texts have all bits zero.

    text is the MD5 of the text, null for a null one. With probes, also (weak
    binary): of each key of each round the places of its weakest bits, a byte
    each; weak is a bit whose count was close to half.
    """
    schema = "node long, text binary, fp binary" + ", weak binary" * bool(plan.probes)
    places = _key_places(plan) if plan.probes else None

    def block(batch: pa.RecordBatch) -> dict:
        fp, margin = fingerprints(text_bytes(batch.column(2)), plan.words, plan.bits)
        out = {"node": batch.column(0), "text": batch.column(1), "fp": pa.array([x.tobytes() for x in fp], pa.binary())}
        if places is not None:
            weak = np.argsort(margin.reshape(len(fp), plan.bits)[:, places], axis=3, kind="stable")[..., : plan.probes - 1].astype(np.uint8)
            out["weak"] = pa.array([x.tobytes() for x in weak], pa.binary())
        return out

    given = docs.select(F.col(id_col).cast("long").alias("node"), F.unhex(F.md5(text_col)).alias("text"), F.col(text_col).alias("whole"))
    return mapped(given, schema, block, 512)


def _key_places(plan: Plan) -> np.ndarray:
    """Of each round and key the places of its bits; the last key of a round may run over the end to the first bits."""
    steps = np.arange(0, plan.bits, PROBED_STEP)
    return (np.array(ROUND_STARTS)[:, None, None] + steps[:, None] + np.arange(PROBED_BITS)) % plan.bits


def _probed(nodes: DataFrame, plan: Plan, turn: int) -> DataFrame:
    """(node, fp, which, key) of every key of a round: its bits as they are and with each weak bit flipped."""
    places = _key_places(plan)[turn]
    value = 1 << np.arange(PROBED_BITS - 1, -1, -1, dtype=np.int64)

    def block(batch: pa.RecordBatch) -> dict:
        n, keys = batch.num_rows, len(places)
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint8).reshape(n, -1), axis=1)
        weak = np.frombuffer(b"".join(batch.column("weak").to_pylist()), dtype=np.uint8).reshape(n, len(ROUND_STARTS), keys, -1)[:, turn]
        own = bits[:, places] @ value
        flip = np.zeros((n, keys, plan.probes), dtype=np.int64)
        flip[:, :, 1:] = value[weak]
        key = own[:, :, None] ^ flip | (np.arange(keys) << PROBED_BITS)[None, :, None]
        ends = np.arange(n + 1, dtype=np.int32) * (keys * plan.probes)
        return {"node": batch.column("node"), "fp": batch.column("fp"), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(key.reshape(-1)))}

    found = mapped(nodes.select("node", "fp", "weak"), "node long, fp binary, keys array<long>", block)
    return found.select("node", "fp", F.posexplode("keys").alias("which", "key"))


def _star(pairs: np.ndarray, n: int) -> np.ndarray:
    """Component label (smallest index) of each of n rows under index pairs."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 0], low)
        np.minimum.at(label, pairs[:, 1], low)
        label = label[label]
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    return label


def _viable(segs: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray, plan: Plan) -> np.ndarray:
    """Positions of the pairs (i, j) within the distance whose chain stays within its budgets."""
    at = np.arange(len(i))
    total = np.zeros(len(i), dtype=np.int32)
    for step in range(plan.segments):
        if not len(at):
            break
        a, b = i[at], j[at]
        place = (start[a] + step) % plan.segments
        total = total + np.bitwise_count(segs[a, place] ^ segs[b, place])
        fits = total <= plan.budget(step + 1)
        at, total = at[fits], total[fits]
    return at


def _run_pairs(key: np.ndarray, segs: np.ndarray, start: np.ndarray, plan: Plan) -> np.ndarray:
    """Linked index pairs among rows of equal key; rows come sorted by key.

    Of a long run, each block is replaced by its components' pairs at once, so
    that memory stays bounded.
    """
    n = len(key)
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(bounds)
    found = []
    short = np.repeat(size <= SHORT_RUN, size)
    for gap in range(1, min(SHORT_RUN, int(size.max(initial=1)))):
        i = np.flatnonzero((key[gap:] == key[:-gap]) & short[gap:])
        if not len(i):
            break
        ok = _viable(segs, start, i, i + gap, plan)
        found.append(np.stack([i[ok], i[ok] + gap], axis=1))
    for b, length in zip(bounds[:-1][size > SHORT_RUN], size[size > SHORT_RUN], strict=True):
        for i in range(b, b + length - 1):
            later = np.arange(i + 1, b + length)
            ok = _viable(segs, start, np.full(len(later), i), later, plan)
            found.append(np.stack([np.full(len(ok), i), later[ok]], axis=1))
            if len(found) > 256:
                found = [_reduced(found, n)]
    return _reduced(found, n)


def _reduced(found: list[np.ndarray], n: int) -> np.ndarray:
    """At most one pair a row with the same components."""
    pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
    if not len(pairs):
        return pairs
    label = _star(pairs, n)
    child = np.flatnonzero(label != np.arange(n))
    return np.stack([child, label[child]], axis=1)


def linked(nodes: DataFrame, plan: Plan, turn: int = 0) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints (node long, fp binary, with probes also weak binary).

    turn: with probes, the round of keys.

    Every row meets, in sorted runs, the rows that share a key. Runs longer than
    BLOCK_ROWS are dealt out: each row goes to the tiles of its own block with
    every block, so that all pairs still meet and no task holds a whole key.
    """
    if plan.probes:
        starts = np.repeat(_key_places(plan)[turn, :, 0] // SEGMENT_BITS, plan.probes)
        dealt = _probed(nodes, plan, turn)
    else:
        keys = plan.keys()
        starts = np.array([start for start, _ in keys], dtype=np.int64)
        digits = F.hex("fp")
        spelled = [F.xxhash64(F.lit(k), _spell(digits, places)) for k, (_, places) in enumerate(keys)]
        dealt = nodes.select("node", "fp", F.posexplode(F.array(*spelled)).alias("which", "key"))
    hot = saved(dealt.groupBy("key").count().where(F.col("count") > BLOCK_ROWS))
    n_hot = hot.count()
    if n_hot:
        blocks = hot.select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
        dealt = dealt.join(F.broadcast(blocks) if n_hot <= BROADCAST_KEYS else blocks, "key", "left")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))).alias("other")
        dealt = dealt.select("node", "fp", "which", "key", "blocks", own.alias("own"), other)
        tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select("node", "fp", "which", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(tile).alias("key"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def meet(batch: pa.RecordBatch) -> pa.RecordBatch:
            key = batch.column("key").to_numpy()
            node = batch.column("node").to_numpy()
            raw = b"".join(batch.column("fp").to_pylist())
            segs = np.frombuffer(raw, dtype=np.uint16).reshape(len(key), -1)
            pairs = _run_pairs(key, segs, starts[batch.column("which").to_numpy()], plan)
            return pa.RecordBatch.from_pydict({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield meet(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield meet(held)

    ordered = dealt.select("key", "which", "node", "fp").repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(edges, "a long, b long")


def _spell(digits, places: list[int]):
    """The hex digits at the given places, as one string column."""
    parts, at = [], 0
    while at < len(places):
        end = at
        while end + 1 < len(places) and places[end + 1] == places[end] + 1:
            end += 1
        parts.append(digits.substr(places[at] + 1, end - at + 1))
        at = end + 1
    return F.concat(*parts)


def _missing(nodes: DataFrame, roots: DataFrame, plan: Plan) -> DataFrame:
    """(node, whole boolean) of the audited fingerprints that have links: whether all their links lie in one component.

    The fingerprints, chosen by hash and bounded by plan.audit, are compared with all.
    """
    rooted = nodes.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root"))
    order = F.shiftrightunsigned(F.xxhash64("fp"), 1)
    bound = min(1.0, 2 * plan.audit / max(1, nodes.count())) * 2.0**63  # about twice as many are ordered
    asked = rooted.where(order <= F.lit(bound)).orderBy(order).limit(plan.audit).collect()
    ids, own = np.array([r["node"] for r in asked], dtype=np.int64), np.array([r["root"] for r in asked], dtype=np.int64)
    words = np.frombuffer(b"".join(bytes(r["fp"]) for r in asked), dtype=np.uint64).reshape(len(asked), plan.bits // 64)
    shared = nodes.sparkSession.sparkContext.broadcast((ids, own, words))

    def block(batch: pa.RecordBatch) -> dict:
        ids, own, words = shared.value
        node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
        other = np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        distance = np.zeros((len(ids), len(node)), dtype=np.uint16)
        for w in range(words.shape[1]):
            distance += np.bitwise_count(words[:, w, None] ^ other[None, :, w])
        near = (distance <= plan.distance) & (ids[:, None] != node[None])
        some = np.flatnonzero(near.any(1))
        apart = (near & (own[:, None] != root[None])).any(1)
        return {"node": pa.array(ids[some], pa.int64()), "whole": pa.array(~apart[some])}

    return mapped(rooted, "node long, whole boolean", block, 1024).groupBy("node").agg(F.min("whole").alias("whole"))


def _every_pair(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) that span the components, all pairs of fingerprints compared in tiles of two blocks; the work is quadratic."""
    blocks = max(1, -(-nodes.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = nodes.select("node", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    tile = F.least("own", "other") * F.lit(blocks).cast("long") + F.greatest("own", "other")

    def meet(table: pa.Table) -> pa.Table:
        node = table.column("node").combine_chunks().to_numpy()
        segs = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype=np.uint16).reshape(len(node), -1)
        pairs = _run_pairs(np.zeros(len(node), dtype=np.int64), segs, np.zeros(len(node), dtype=np.int64), Plan(plan.words, plan.bits, plan.distance, plan.distance))
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return dealt.select("node", "fp", tile.alias("tile")).groupBy("tile").applyInArrow(meet, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """(node, text, fp, group long, component) of every row: group tells components apart, component is its smallest id."""
    prints = saved(with_fingerprints(docs, id_col, text_col, plan))
    by = [name for name in prints.columns if name not in ("node", "text")]
    classes = prints.groupBy("fp").agg(F.min("node").alias("least"), *[F.min(name).alias(name) for name in by if name != "fp"])
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()))
    roots = saved(connected_components(linked(classes, plan)))
    for turn in range(1, len(ROUND_STARTS) + 1) if plan.probes else ():
        asked, whole = _missing(classes, roots, plan).agg(F.count("*"), F.count_if("whole")).first()
        if whole >= plan.recall * asked:
            break
        further = linked(classes, plan, turn) if turn < len(ROUND_STARTS) else _every_pair(classes, plan)
        roots = saved(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(further)))
    named = classes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component"))
    return joined_by(prints.drop("weak"), saved(named.drop("least").join(ids, "group")), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per document: (node, fp binary, component long: smallest id reachable by links).

    Exact copies of a fingerprint meet by grouping; only one of each takes part
    in the search, so no pairs within a group of copies arise. Null, empty and
    blank texts have the zero fingerprint, linked like any other. Rows with the
    same id stay separate rows. A row without an id is linked like any other;
    a component without any id is null. An empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col, plan).select("node", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """The documents without near-duplicates: of each group one row, with its columns as in docs.

    It is the row with the smallest id (null last), among those the one whose
    text has the smallest MD5 (null last), among those the one with the
    smallest hash of all its columns. A row is judged by its own text, whatever
    other rows have its id. Clashing column names are no matter. An empty table
    gives no rows.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}_", f"c{names.index(text_col)}_"
    found = _grouped(own, ident, text, plan)
    order = F.struct(F.col("node").isNull().alias("a"), "node", F.col("text").isNull().alias("b"), "text")
    key = lambda node, md5: F.concat_ws("|", F.coalesce(node.cast("string"), F.lit("-")), F.coalesce(md5, F.lit("-"))).alias("key_")
    best = found.groupBy("group").agg(F.min(order).alias("o")).select(key(F.col("o.node"), F.lower(F.hex("o.text"))))
    keyed = own.select("*", key(F.col(ident).cast("long"), F.md5(text)))
    # Rows that share id and text are copies of each other; one of them stays. Copies are reduced before they travel.
    rows = joined_by(keyed, best, "key_", "left_semi").groupBy("key_").agg(F.min_by(F.struct(*own.columns), F.xxhash64(*own.columns)).alias("row_"))
    return rows.select(*[F.col(f"row_.c{i}_").alias(name) for i, name in enumerate(names)])
