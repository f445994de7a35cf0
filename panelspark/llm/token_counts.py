"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge text is cut into overlapping windows, each encoded alone, with offsets.
The windows' counts are spliced where two neighbours provably agree for good:

* A pre-token that ends before a window's end was matched without looking past
  it, so all pre-token borders of a window that starts at a true border are
  true, but for those near its end (`margin`: the longest added token).
* What follows a pre-token border is split by the text behind it alone.

So at a border that both windows show, the left one has counted rightly up to
there, and from there on the right one does. If two neighbours share no border
in their overlap, the text is done again with overlaps four times as wide, up
to one window for the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.chunks import cut
from panelspark.llm.common import mapped, saved

#: A space in the alphabet of byte-level vocabularies.
SPACE = "\u0120"
#: So many chunks are remembered by a Python worker.
CHUNK_LIMIT = 600_000


class Counter:
    """Token counts by one tokenizer (the content of its JSON file); remembers the counts of chunks."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.known: dict[str, int] = {}
        added = json.loads(content).get("added_tokens") or []
        self.margin = max((len(x["content"]) for x in added), default=0) + 1

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. A text is cut at spaces that begin a pre-token; chunks are encoded once."""
        if len(self.known) > CHUNK_LIMIT:
            self.known.clear()
        parts = [cut(text) for text in texts]
        heads = [len(x) for x in self._encode([head for head, _ in parts])]
        new = [x for x in set().union(*(rest for _, rest in parts)) if x not in self.known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.known.update(zip(some, map(len, self._encode([" " + x for x in some])), strict=True))
        known = self.known.__getitem__
        return [n + sum(map(known, rest)) for n, (_, rest) in zip(heads, parts, strict=True)]

    def borders(self, text: str) -> tuple[list[int], list[int], int]:
        """Offsets where a pre-token or added token begins, tokens before each, and all tokens."""
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        words, offsets = encoded.word_ids, encoded.offsets
        at = [i for i in range(len(words)) if not i or words[i] != words[i - 1] or words[i] is None]
        return [offsets[i][0] for i in at], at, len(words)


#: By tokenizer file: a counter lives as long as its Python worker.
_COUNTERS: dict[int, Counter] = {}


def _counter(content: str) -> Counter:
    key = hash(content)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(content)
    return _COUNTERS[key]


def _check(parts: dict) -> None:
    """Cuts at spaces hold for byte-level BPE with its own pre-token pattern, no normaliser, and added tokens without white space at which they could be cut.

    Proof: text is cut before a space that a character other than white space
    follows. Without an added token right behind the space, the space leads a
    pre-token, and what is left of it splits the same with or without it. With one,
    the library ends the text before the added token, and the space ends a run of
    white space; the cut tells it from the rest of that run. The rest and the space
    have as many tokens apart as together, unless a token of several characters
    ends in a space. So with added tokens such vocabularies are refused.
    """
    model, before = parts.get("model") or {}, parts.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = parts.get("added_tokens") or []
    whole = not any(x.get("lstrip") or x.get("rstrip") or x["content"].split() != [x["content"]] for x in added)
    merged = any(len(token) > 1 and token.endswith(SPACE) for token in model.get("vocab") or ()) if added else False
    if model.get("type") != "BPE" or not plain or parts.get("normalizer") or not whole or merged:
        raise ValueError("not a plain byte-level BPE tokenizer whose texts can be cut at spaces")


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    token_limit: int = 512,
    window: int = 32_768,
    overlap: int = 1_024,
) -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) of every whole text.

    tokenizer: path of a byte-level BPE tokenizer's JSON file, read on the
    driver. Special strings inside texts count as the library's default has it;
    none are added. Texts over `window` characters go through overlapping
    windows. A null text counts as empty, with 0 bytes and tokens; repeated rows
    stay; an empty table gives no rows. A ValueError for other kinds of
    tokenizer files, whose texts may not be cut at spaces.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    _check(json.loads(content))
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text_"))

    def whole(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text_").to_pylist()
        return {
            id_col: batch.column(id_col),
            "n_bytes": batch.column("n_bytes"),
            "n_tokens": pa.array(_counter(shared.value).counts(texts), pa.int64()),
        }

    sized = given.withColumn("n_bytes", F.octet_length("text_").cast("long"))
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long"
    parts = [mapped(sized.where(F.char_length("text_") <= window), schema, whole, 512)]
    huge = sized.where(F.char_length("text_") > window).withColumn("mark", F.xxhash64(id_col, "text_"))
    while overlap:
        spliced = saved(_windows_spliced(huge, shared, id_col, kind, window, overlap))
        parts.append(spliced.where("aligned").select(id_col, "n_bytes", "n_tokens"))
        failed = spliced.where("not aligned").select("mark").distinct()
        if failed.isEmpty():
            break
        huge, overlap = huge.join(failed, "mark", "left_semi").select(*huge.columns), overlap * 4
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.withColumn("over_limit", F.col("n_tokens") > token_limit)


def _windows_spliced(huge: DataFrame, shared, id_col: str, kind: str, window: int, overlap: int) -> DataFrame:
    """(mark, id, n_bytes, n_tokens, aligned) of each huge text, by windows dealt out over the cluster."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                text = one.pop("text_")
                starts = range(0, max(1, len(text) - overlap), window)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    yield pa.RecordBatch.from_pydict(
                        {name: pa.array([value] * len(some), batch.schema.field(name).type) for name, value in one.items()}
                        | {
                            "k": pa.array([s // window for s in some], pa.int64()),
                            "last": [s == starts[-1] for s in some],
                            "piece": pa.array([text[s : s + window + overlap] if s != starts[-1] else text[s:] for s in some]),
                        }
                    )

    def encode(batch: pa.RecordBatch) -> dict:
        counter = _counter(shared.value)
        out: dict[str, list] = {name: [] for name in ("head_at", "head_n", "tail_at", "tail_n", "n")}
        for k, piece in zip(batch.column("k").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            at, before, n = counter.borders(piece)
            at, before = np.array(at, dtype=np.int64), np.array(before, dtype=np.int64)
            head = at < overlap
            tail = (at >= window) & (at < len(piece) - counter.margin)
            out["head_at"].append(at[head] + k * window)
            out["head_n"].append(before[head])
            out["tail_at"].append(at[tail] + k * window)
            out["tail_n"].append(before[tail])
            out["n"].append(n)
        kept = {name: batch.column(name) for name in batch.schema.names if name != "piece"}
        return kept | {name: pa.array(x, pa.int64() if name == "n" else pa.list_(pa.int64())) for name, x in out.items()}

    keys = f"row long, mark long, `{id_col}` {kind}, n_bytes long, k long, last boolean"
    numbered = huge.withColumn("row", F.monotonically_increasing_id())
    pieces = numbered.select("row", "mark", id_col, "n_bytes", "text_").mapInArrow(cut_up, f"{keys}, piece string")
    lists = ", ".join(f"{name} array<long>" for name in ("head_at", "head_n", "tail_at", "tail_n"))
    encoded = mapped(pieces.repartition("row", "k"), f"{keys}, {lists}, n long", encode, 64)
    by_text = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect("tail_at", F.lead("head_at").over(by_text)))
    met = encoded.withColumn("to", common)
    met = met.withColumn("since", F.lag("to").over(by_text))

    def tokens_before(places: str, counts: str, at: str) -> Column:
        return F.element_at(counts, F.array_position(places, F.col(at)).cast("int"))

    end = F.when(F.col("last"), F.col("n")).when(F.col("to").isNotNull(), tokens_before("tail_at", "tail_n", "to"))
    begin = F.when(F.col("k") == 0, F.lit(0)).when(F.col("since").isNotNull(), tokens_before("head_at", "head_n", "since"))
    return met.groupBy("row", "mark", id_col, "n_bytes").agg(
        F.sum(end - begin).alias("n_tokens"), (F.count(end - begin) == F.count("*")).alias("aligned")
    )
