"""Removal of passages that repeat across documents: windows of consecutive words, behind a count-min prefilter.

1. Documents with the same sequence of words as one with a smaller id are found by
   a hash of the whole sequence; all their windows repeat.
2. Of the others, every partition counts its windows in a count-min sketch; the
   sketches are merged by sum. A window is counted under its anchor, the least hash
   of the runs of `anchor` words in it: equal windows have equal anchors, so the
   merged count is never below the number of documents with the window, and windows
   next to one another mostly share theirs.
3. Only windows whose estimate is two or more are grouped exactly, by a hash of 128
   bits; the others stand in one document alone.
4. Words of windows that also start in a document with a smaller id are taken out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import by_size, fresh_folder, mapped_by_size, removed, saved, text_bytes
from panelspark.llm.shingle_hash import SPACE, xxh64

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd multipliers of the two rolling hashes, and of the rows of the sketch.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Cells of a sketch are merged in blocks of so many.
BLOCK = 1 << 12
#: Texts are hashed in blocks of so many bytes, each of which takes about a hundred times its size for a moment.
BLOCK_BYTES = 1 << 20
#: Documents equal to an earlier one are broadcast only up to this count; beyond it they are joined.
BROADCAST_COPIES = 200_000


@dataclass(frozen=True)
class Settings:
    """window: words. anchor: words of the runs whose least hash stands for a window. rows: of the sketch. cells_bits: at most so many bits of
    cells in each; with fewer cells more windows are estimated to repeat, and are then grouped exactly: none is lost."""

    window: int = 50
    anchor: int = 16
    rows: int = 2
    cells_bits: int = 26


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            with np.errstate(over="ignore"):
                size = len(self.up)
                self.up = np.append(self.up, self.up * np.uint64(pow(self.base, size, 1 << 64)))
                self.down = np.append(self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = [Powers(m) for m in MULTIPLIERS]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block of texts: their hashes, and the text of each."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
        self.hash = xxh64(raw, starts, ends - starts)
        self.count = np.bincount(self.text, minlength=len(texts))
        self.end = np.cumsum(self.count)
        self.sums = []
        with np.errstate(over="ignore"):
            for powers in POWERS:
                up, _ = powers.upto(len(self.hash) + 1)
                self.sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.hash * up[: len(self.hash)])]))

    def runs(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words from begin up to end, which depends on these words alone."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[which][end] - self.sums[which][begin]) * POWERS[which].down[begin])

    def windows(self, window: int) -> np.ndarray:
        """Where a window starts that lies within one text."""
        at = np.arange(max(0, len(self.hash) - window + 1))
        return at[at + window <= self.end[self.text[: len(at)]]]

    def anchors(self, at: np.ndarray, window: int, anchor: int) -> np.ndarray:
        """Of the windows that start at `at`, the least hash of the runs of `anchor` words in each."""
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        begin = np.arange(len(self.hash) - anchor + 1)
        least, size, wanted = self.runs(begin, begin + anchor), 1, window - anchor + 1
        while size * 2 <= wanted:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < wanted:
            least = np.minimum(least[: len(least) - (wanted - size)], least[wanted - size :])
        return least[at]


def _cells(anchors: np.ndarray, rows: int, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mixed(anchors + np.uint64(r)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(rows)]


def sequences(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns `keep`, n_words, and h1 and h2, a hash of the whole sequence of words."""

    def block(batch: pa.RecordBatch) -> dict:
        words = Words(text_bytes(batch.column("text_")))
        begin = words.end - words.count
        made = {"n_words": pa.array(words.count, pa.int64())} | {f"h{k + 1}": pa.array(words.runs(begin, words.end, k).view(np.int64)) for k in range(2)}
        return {name: batch.column(name) for name in keep} | made

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped_by_size(docs.select(*keep, F.col(text_col).alias("text_")), f"{kinds}, n_words long, h1 long, h2 long", block, "text_", BLOCK_BYTES)


def repeated_cells(docs: DataFrame, text_col: str, bits: int, s: Settings) -> list[np.ndarray]:
    """The merged sketch of all texts, as one bit a cell: whether its count is two or more.

    A text counts its anchors once. A partition sends its cells that are not
    zero, in blocks; they are added up by block, and the bits, at most
    rows * 2^cells_bits of them, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((s.rows, 1 << bits), dtype=np.uint8)
        for batch in batches:
            for part in by_size(batch, "text_", BLOCK_BYTES):
                words = Words(text_bytes(part.column("text_")))
                at = words.windows(s.window)
                anchor, text = words.anchors(at, s.window, s.anchor), words.text[at]
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(at) else at
                anchor, text = anchor[new], text[new]
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                anchor = anchor[np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])] if len(anchor) else anchor
                for row, cells in zip(sketch, _cells(anchor, s.rows, bits), strict=True):
                    cell, n = np.unique(cells, return_counts=True)
                    row[cell] = np.minimum(2, row[cell] + n)  # whether it is two or more is all that is asked
        flat = sketch.reshape(-1)
        some = np.flatnonzero(flat)
        block = some // BLOCK
        bounds = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(some) else [0]
        for low in range(0, len(bounds) - 1, 1024):
            pairs = list(zip(bounds[low : low + 1024], bounds[low + 1 : low + 1025], strict=False))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([int(block[a]) for a, _ in pairs], pa.int32()),
                    "at": pa.array([(some[a:b] % BLOCK).astype("<u2").tobytes() for a, b in pairs], pa.binary()),
                    "n": pa.array([flat[some[a:b]].tobytes() for a, b in pairs], pa.binary()),
                }
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK, dtype=np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None and (total > 1).any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

        for batch in batches:
            for own, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n")), strict=True):
                if own != block:
                    yield from done()
                    block, total = own, np.zeros(BLOCK, dtype=np.int64)
                total[np.frombuffer(at, dtype="<u2")] += np.frombuffer(n, dtype=np.uint8)
        yield from done()

    parts = docs.select(F.col(text_col).alias("text_")).mapInArrow(count, "block int, at binary, n binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    out = np.zeros((s.rows << bits) // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():  # at most rows * 2^cells_bits / 8 bytes
        start = row["block"] * BLOCK // 8
        out[start : start + BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return list(out.reshape(s.rows, -1))


def candidate_windows(docs: DataFrame, keep: list[str], text_col: str, sketch: list[np.ndarray], bits: int, s: Settings) -> DataFrame:
    """The columns `keep`, the start and the hash (h1, h2) of every window whose estimate is two or more."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def block(batch: pa.RecordBatch) -> dict:
        words = Words(text_bytes(batch.column("text_")))
        at = words.windows(s.window)
        anchors = words.anchors(at, s.window, s.anchor)
        many = np.ones(len(at), dtype=bool)
        for row, cell in zip(shared.value, _cells(anchors, s.rows, bits), strict=True):
            many &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        at = at[many]
        of = words.text[at]
        made = {"at": pa.array(at - (words.end - words.count)[of], pa.int32())} | {f"h{k + 1}": pa.array(words.runs(at, at + s.window, k).view(np.int64)) for k in range(2)}
        return {name: batch.column(name).take(pa.array(of)) for name in keep} | made

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped_by_size(docs.select(*keep, F.col(text_col).alias("text_")), f"{kinds}, at int, h1 long, h2 long", block, "text_", BLOCK_BYTES)


def repeated_starts(docs: DataFrame, id_col: str, mark: str, text_col: str, s: Settings) -> DataFrame:
    """(id, mark, whole boolean, starts array<int>): where windows start that also start in a document with a smaller id.

    whole: the document has the same words as one with a smaller id, so all its
    windows do. docs must hold the columns id_col, mark and text_col; mark tells
    texts of one id apart. Documents with a null id are left out.
    """
    spark, own = docs.sparkSession, docs.where(F.col(id_col).isNotNull())
    known = saved(sequences(own, [id_col, mark], text_col).where(F.col("n_words") >= s.window))
    first = known.groupBy("h1", "h2", "n_words").agg(F.min(id_col).alias("first_"), F.count("*").alias("copies_")).where(F.col("copies_") > 1)
    copies = saved(known.join(first, ["h1", "h2", "n_words"]).where(F.col(id_col) > F.col("first_")).select(id_col, mark).distinct())
    some = copies.count()
    rest = own.join(F.broadcast(copies) if some <= BROADCAST_COPIES else copies, [id_col, mark], "left_anti") if some else own

    # A window of w words has w - a + 1 runs of a words; a random text changes its anchor every (w - a + 2) / 2 words.
    words = known.agg(F.sum("n_words")).first()[0] or 0
    bits = min(s.cells_bits, max(12, (8 * words // (s.window - s.anchor + 2)).bit_length()))
    sketch = repeated_cells(rest, text_col, bits, s)
    folder = fresh_folder(spark, "windows")
    candidate_windows(rest, [id_col, mark], text_col, sketch, bits, s).write.parquet(folder)
    found = spark.read.parquet(folder)
    first = found.groupBy("h1", "h2").agg(F.min(id_col).alias("first_"), F.max(id_col).alias("last_")).where(F.col("first_") < F.col("last_"))
    later = found.join(first.select("h1", "h2", "first_"), ["h1", "h2"]).where(F.col(id_col) > F.col("first_"))
    starts = later.groupBy(id_col, mark).agg(F.collect_set("at").alias("starts"))  # at most the words of one document
    out = saved(copies.select(id_col, mark, F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts")).unionByName(starts.select(id_col, mark, F.lit(False).alias("whole"), "starts")))
    removed(spark, folder)
    return out


def drop_repeats(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The columns `keep`, n_words, n_removed (long) and kept (string) of every whole text.

    A word goes if it is covered by a window of `window` consecutive words, all
    in one text, that also starts in a document with a smaller id. Windows are
    judged on the texts as they are given. kept has the other words, joined by
    one space. Null and empty texts have no words and an empty kept; texts with
    fewer words than a window keep all. Rows that repeat an id don't take words
    from one another; documents with a null id neither take nor lose words.
    Repeated rows stay; an empty table gives no rows. Columns of any name can
    be kept, but for n_words, n_removed and kept.
    """
    names = [f"c{i}_" for i in range(len(keep))]
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(id_col).alias("id_"), F.col(text_col).alias("given_"))
    own = own.withColumn("mark_", F.xxhash64("given_"))
    starts = repeated_starts(own, "id_", "mark_", "given_", s)
    joined = own.join(starts, ["id_", "mark_"], "left").select(*names, F.col("given_").alias("text_"), "whole", "starts")
    window = s.window

    def block(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for text, whole, at in zip(text_bytes(batch.column("text_")), batch.column("whole").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            words = WORD.findall(text)
            left = [] if whole else words
            if at:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                change[at] += 1
                change[np.array(at) + window] -= 1
                left = list(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        made = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return {name: batch.column(name) for name in names} | made

    kinds = [f"`{n}` {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    told = mapped_by_size(joined, ", ".join([*kinds, "n_words long, n_removed long, kept string"]), block, "text_", BLOCK_BYTES)
    return told.toDF(*keep, "n_words", "n_removed", "kept")


def sql(window: int = 50, docs: str = "documents") -> str:
    """(doc_id, n_words, n_removed, kept_sha256) in DuckDB SQL: windows as text."""
    return rf"""
    WITH given AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM {docs}),
    windows AS (
      SELECT row_, doc_id, pos, md5(array_to_string(w[pos : pos + {window - 1}], ' ')) AS k
      FROM (SELECT *, unnest(range(1, len(w) - {window} + 2)) AS pos FROM given WHERE len(w) >= {window} AND doc_id IS NOT NULL)
    ),
    firsts AS (SELECT k, min(doc_id) AS first_ FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
    starts AS (SELECT row_, pos FROM windows JOIN firsts USING (k) WHERE doc_id > first_),
    words AS (SELECT row_, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM given),
    marked AS (
      SELECT w.row_, w.pos, word, coalesce(max(s.pos) OVER (PARTITION BY w.row_ ORDER BY w.pos), -{window}) > w.pos - {window} AS gone
      FROM words w LEFT JOIN starts s ON s.row_ = w.row_ AND s.pos = w.pos
    ),
    left_ AS (SELECT row_, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY 1)
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM given LEFT JOIN left_ USING (row_)
    """
