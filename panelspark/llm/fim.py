"""Fill-in-the-middle transformation: documents cut in three by code points and put into another order.

A rolling hash cuts the bytes of a text into chunks by content, so equal passages
give equal chunks. What is known of a chunk (how many code points begin in it,
where every 64th of them begins, and whether it holds a sentinel) is remembered by
its content. Adding up the counts of a text's chunks gives its length and the
chunk that holds a cut; only that chunk is looked into.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mapped_by_size, text_bytes

#: A chunk ends where the upper CUT_BITS bits of the hash of the last 32 bytes are zero: after about 1,024 bytes.
CUT_BITS = 10
SHORTEST, LONGEST = 128, 8_192
#: Chunks are remembered until they hold so many bytes; then the memory begins anew.
REMEMBERED_BYTES = 16 << 20
#: The begin of every so many code points of a chunk is remembered.
MARK_EVERY = 64
GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Format:
    """The sentinels before prefix, suffix and middle, and how many of a hundred documents are changed, and of these put suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    changed: int = 90
    suffix_first: int = 20

    def __post_init__(self) -> None:
        marks = self.marks
        for one in marks:
            # Else a sentinel could begin in one part of an output and end in the next.
            overlaps = any(one[-k:] == two[:k] for two in marks for k in range(1, min(len(one), len(two)) + (one is not two)))
            if not one or overlaps or sum(one in two for two in marks) > 1:
                raise ValueError("sentinels must not be empty, overlap or hold one another")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Summary:
    """What is known of a chunk: code points that begin in it; byte offsets of every MARK_EVERY-th (None: each byte begins one); a sentinel within; its ends."""

    count: int
    marks: np.ndarray | None
    held: bool
    head: bytes
    tail: bytes


def chunks(data: bytes) -> list[bytes]:
    """data cut by content; no chunk is longer than LONGEST, and only a last one shorter than SHORTEST."""
    if len(data) <= SHORTEST:
        return [data] if data else []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # each time, a hash covers twice as many bytes
        h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for end in (*(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist(), len(data)):
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= SHORTEST:
            ends.append(end)
            last = end
    if last < len(data):
        ends.append(len(data))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Chunks:
    """Summaries of chunks, remembered by content."""

    def __init__(self, marks: Sequence[str]) -> None:
        self.marks = [m.encode() for m in marks]
        self.edge = max(map(len, self.marks)) - 1
        self.known: dict[bytes, Summary] = {}
        self.bytes = 0

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)  # equal in content, not only in hash
        if found is None:
            count, begins = len(chunk.translate(None, CONTINUATION)), None
            if count < len(chunk):
                begins = np.flatnonzero((np.frombuffer(chunk, dtype=np.uint8) & 0xC0) != 0x80)[::MARK_EVERY]
            held = any(m in chunk for m in self.marks)
            found = Summary(count, begins, held, chunk[: self.edge], chunk[len(chunk) - min(self.edge, len(chunk)) :])
            if self.bytes > REMEMBERED_BYTES:
                self.known.clear()
                self.bytes = 0
            self.known[chunk] = found
            self.bytes += len(chunk)
        return found

    def document(self, data: bytes) -> Document:
        parts = chunks(data)
        known = [self.summary(c) for c in parts]
        held, tail = any(s.held for s in known), b""
        for s in known:
            held = held or any(m in tail + s.head for m in self.marks)
            tail = (tail + s.tail)[-self.edge :] if self.edge else b""
        return Document(parts, known, [0, *accumulate(s.count for s in known)], [0, *accumulate(map(len, parts))], held)


@dataclass(frozen=True)
class Document:
    """A text's chunks and their summaries, the code points and bytes before each, and whether it holds a sentinel."""

    parts: list[bytes]
    known: list[Summary]
    points: list[int]
    begins: list[int]
    held: bool

    def __len__(self) -> int:
        return self.points[-1]

    def offset(self, point: int) -> int:
        """The byte at which a code point begins; that after the last byte for the number of code points."""
        if point >= self.points[-1]:
            return self.begins[-1]
        at = bisect_right(self.points, point) - 1
        inner, s = point - self.points[at], self.known[at]
        if s.marks is None:
            return self.begins[at] + inner
        start = int(s.marks[inner // MARK_EVERY])
        near = np.frombuffer(self.parts[at], dtype=np.uint8, offset=start)[: 4 * MARK_EVERY]
        return self.begins[at] + start + int(np.flatnonzero((near & 0xC0) != 0x80)[inner % MARK_EVERY])


def draws(id_col: str, seed: str = "1") -> list[Column]:
    """Four numbers below 2^32 of a document: the first digits of the SHA-256 of seed, colon and id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", form: Format = Format(), seed: str = "1") -> DataFrame:
    """The columns `keep`, and n, form, prefix_chars, middle_chars (long) and output (string) of every whole text.

    The two cuts are drawn by a hash of the id, as is the form: `plain`, the text
    as it is; `psm`, prefix, suffix, middle; `spm`, suffix, prefix, middle, each
    part led by its sentinel. Empty texts and those that hold a sentinel stay
    plain, so every output can be taken apart again (`restore`). A null text
    counts as empty. Parts may be empty. Equal ids are cut by the same draws,
    each by its own length; repeated rows stay; an empty table gives no rows.
    Columns named like those that are added must not be kept.
    """
    given = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("text_"), F.array(*draws(id_col, seed)).alias("draws_"))
    lead = {k: m.encode() for k, m in zip("psm", form.marks, strict=True)}
    held: list[Chunks] = []  # one in each Python worker and task

    def block(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Chunks(form.marks))
        rows = [_changed(held[0].document(data), data, draw, form, lead) for data, draw in zip(text_bytes(batch.column("text_")), batch.column("draws_").to_pylist(), strict=True)]
        n, kind, prefix, middle, out = zip(*rows, strict=True) if rows else [()] * 5
        made = {"n": pa.array(n, pa.int64()), "form": pa.array(kind, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64())}
        return {name: batch.column(name) for name in keep} | made | {"output": pa.array(out, pa.binary()).cast(pa.string())}

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return mapped_by_size(given, ", ".join([*kinds, "n long, form string, prefix_chars long, middle_chars long, output string"]), block, "text_")


def _changed(doc: Document, data: bytes, draw: list[int], form: Format, lead: dict[str, bytes]) -> tuple:
    n = len(doc)
    if not n or doc.held or draw[2] % 100 >= form.changed:
        return n, "plain", None, None, data
    first, second = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    a, b = doc.offset(first), doc.offset(second)
    parts = {"p": data[:a], "m": data[a:b], "s": data[b:]}
    order = "spm" if draw[3] % 100 < form.suffix_first else "psm"
    return n, order, first, second - first, b"".join(lead[x] + parts[x] for x in order)


def restore(output: str = "output", form_col: str = "form", form: Format = Format()) -> Column:
    """The text from which an output was made, told from output and form alone."""
    x = F.col(output)
    between = lambda text, mark, part: F.split_part(text, F.lit(mark), F.lit(part))  # noqa: E731  a mark stands once in a changed output
    middle = between(x, form.middle, 2)
    front = between(x, form.middle, 1)
    psm = F.concat(between(between(front, form.suffix, 1), form.prefix, 2), middle, between(front, form.suffix, 2))
    spm = F.concat(between(front, form.prefix, 2), middle, between(between(front, form.prefix, 1), form.suffix, 2))
    return F.when(F.col(form_col) == "psm", psm).when(F.col(form_col) == "spm", spm).otherwise(x)


def sql(docs: str = "documents", seed: str = "1") -> str:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) in DuckDB SQL, with the default format."""
    number = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
    return f"""
    WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {docs}),
    cut AS (
      SELECT doc_id, text, n, least({number(0)} % (n + 1), {number(1)} % (n + 1)) AS a, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(2)} % 100 >= 90 THEN 'plain'
          WHEN {number(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
        ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM cut
    """
