"""Byte-level BPE by prefix dynamic programming, and its inverse.

Of every byte prefix, the correct encoding ends in one token only: the token t
that is a suffix of the prefix and whose merge with the last token p of the
remaining, shorter prefix is never undone, that is, (p, t) encodes to itself.
So one pass over a piece stores a last token for each prefix; following them
back gives the encoding of any prefix, appending goes on from what is stored,
and an edit needs work only from the edit on, up to where the stored tokens
agree with the new ones again.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.chunks import cut
from panelspark.llm.common import mapped

#: Larger than any token id.
NO_LIMIT = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixBpe:
    """A vocabulary with the tables for prefix dynamic programming.

    split: of each token the two tokens that its last merge joins (itself twice
    for a single byte). merged: by id pair, the token that the pair merges to.
    Tokens that no merge order reaches stay outside; as whole pieces they are
    still found, as the ranks say. suffixes: the reachable tokens, and their
    suffixes with -1.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.reachable: dict[bytes, int] = {}
        self._holds: dict[int, dict[int, bool]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
                self.reachable[token] = rank
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token, rank)
        self.longest = max(map(len, self.reachable))
        self.suffixes = {token[n:]: -1 for token in self.reachable for n in range(1, len(token))} | self.reachable
        self.lengths = [0] * (max(self.tokens) + 1)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)

    def _learn(self, token: bytes, rank: int) -> None:
        for at in range(1, len(token)):
            left, right = self.reachable.get(token[:at]), self.reachable.get(token[at:])
            if left is not None and right is not None and left < rank and right < rank and self._pair_holds(left, right):
                self.split[rank] = (left, right)
                self.merged[left, right] = rank
                self.reachable[token] = rank
                return

    def _pair_holds(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens encode to just these two tokens.

        Both are unmerged step by step, the later merge first; at each step no
        merge across the border may come before the merges that are still to be
        made on either side.
        """
        seam = NO_LIMIT
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < seam:
                return False
            inner_left, inner_right = self.split[left], self.split[right]
            left_single, right_single = inner_left[0] == left, inner_right[0] == right
            if left_single and right_single:
                return True
            # On equal ranks the left merge is made first, so the right one is undone first.
            if right_single or (not left_single and left > right):
                seam, left = left, inner_left[1]
            else:
                seam, right = right + 1, inner_right[0]

    def holds(self, left: int, right: int) -> bool:
        """As _pair_holds; remembered for the pairs that the vocabulary allows."""
        row = self._holds.setdefault(left, {})
        known = row.get(right)
        if known is None:
            known = row[right] = self._pair_holds(left, right)
        return known

    def extend(self, piece: bytes, last: list[int], start: int, stop: int) -> None:
        """Fill last[i], the last token of the prefix of i bytes, for start < i <= stop."""
        known, holds = self.suffixes.get, self.holds
        for end in range(start + 1, stop + 1):
            tokens, begin = [], end
            while begin and (token := known(piece[begin - 1 : end])) is not None:
                begin -= 1
                if token >= 0:
                    tokens.append((begin, token))
            for begin, token in reversed(tokens):
                if not begin or holds(last[begin], token):
                    last[end] = token
                    break

    def back(self, last: list[int], end: int) -> list[int]:
        """The encoding of the prefix of `end` bytes."""
        out, lengths = [], self.lengths
        while end:
            out.append(token := last[end])
            end -= lengths[token]
        out.reverse()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The encodings of sorted pieces; what is stored for a common prefix serves the next piece too."""
        out, last, before = [], [-1], b""
        for piece in pieces:
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            del last[same + 1 :]
            last += [-1] * (len(piece) - same)
            self.extend(piece, last, same, len(piece))
            before = piece
            whole = self.ranks.get(piece)
            out.append(self.back(last, len(piece)) if whole is None else [whole])
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """The encoding of one match of the pre-token pattern."""
        return self.encode_pieces([piece])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoding:
    """A byte string with the last token of each of its prefixes; appending and editing keep it exact."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b"") -> None:
        self.bpe, self.piece, self.last = bpe, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        self.last += [-1] * len(more)
        self.bpe.extend(self.piece, self.last, start, len(self.piece))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace the bytes [start, end); returns the number of prefixes that were encoded anew.

        Behind the edit, a last token depends on the bytes and the last tokens
        of the `longest` prefixes before it. Once so many in a row lie behind
        the edit and equal the stored ones, all that follow do.
        """
        old, shift = self.last, start + len(new) - end
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1] + [-1] * (len(self.piece) - start)
        same, at = 0, start
        while at < len(self.piece):
            at += 1
            self.bpe.extend(self.piece, self.last, at - 1, at)
            behind = at > start + len(new) and self.last[at] == old[at - shift]
            same = same + 1 if behind else 0
            if same > self.bpe.longest:
                self.last[at + 1 :] = old[at - shift + 1 :]
                break
        return at - start

    def ids(self) -> list[int]:
        return self.bpe.back(self.last, len(self.piece))


class TextEncoder:
    """Encodes blocks of texts, each match of the pattern by itself; remembers the chunks that it met.

    A chunk of letters is one match together with its leading space, and a mark
    of MARKS behind the letters is one more; all else goes through the pattern.
    Before a block, all is forgotten if over `limit` chunks are held.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, bpe: PrefixBpe, pattern: str, limit: int = 600_000) -> None:
        self.bpe, self.find, self.limit = bpe, regex.compile(pattern).findall, limit
        self.known: dict[str, bytes] = {}
        self.marks = {mark: self._ids(self.bpe.encode_piece(mark.encode())) for mark in self.MARKS}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Encode new chunks, given without their leading space."""
        known, words, marked, odd = self.known, set(), [], []
        for chunk in chunks:
            if chunk.isalpha():
                words.add(chunk)
            elif chunk[-1:] in self.MARKS and (word := chunk[:-1]).isalpha():
                marked.append(chunk)
                if word not in known:
                    words.add(word)
            else:
                odd.append(chunk)
        order = sorted((" " + word).encode() for word in words)
        for piece, ids in zip(order, self.bpe.encode_pieces(order), strict=True):
            known[piece[1:].decode()] = self._ids(ids)
        for chunk in marked:
            known[chunk] = known[chunk[:-1]] + self.marks[chunk[-1]]
        for chunk in odd:
            known[chunk] = self._by_pattern(" " + chunk)

    def _by_pattern(self, text: str) -> bytes:
        pieces = self.find(text)
        return b"".join(known if (known := self._word(piece)) is not None else self._ids(self.bpe.encode_piece(piece.encode())) for piece in pieces)

    def _word(self, piece: str) -> bytes | None:
        return self.known.get(piece[1:]) if piece[0] == " " and piece[1:].isalpha() else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.limit:
            self.known.clear()
        parts = [cut(text) for text in texts]
        chunks = set().union(*(rest for _, rest in parts))
        self._learn({chunk for chunk in chunks if chunk not in self.known})
        known = self.known.__getitem__
        return [b"".join(chain((self._by_pattern(head),), map(known, rest))) for head, rest in parts]


#: By vocabulary and pattern: an encoder, with what it remembers, lives as long as its Python worker.
_ENCODERS: dict[int, TextEncoder] = {}


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary, decoded binary) of every whole text, without special tokens.

    ids holds little-endian unsigned 32-bit integers, decoded the bytes that
    they decode to. A null text counts as empty: no tokens, empty bytes. Rows
    are independent; repeated ids stay repeated, an empty table gives no rows.
    vocabulary: path of a rank file, read on the driver; its tables (bounded by
    the vocabulary) are broadcast. pattern: the pre-token pattern.
    """
    return _encoded(docs, vocabulary, pattern, id_col, text_col, digests=False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with SHA-256 in hex in place of the ids and the decoded bytes."""
    return _encoded(docs, vocabulary, pattern, id_col, text_col, digests=True)


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(PrefixBpe(read_ranks(vocabulary)))
    key = f"{vocabulary}|{hashlib.sha256(pattern.encode()).hexdigest()}"

    def block(batch: pa.RecordBatch) -> dict:
        encoder = _ENCODERS.get(key)
        if encoder is None:
            encoder = _ENCODERS[key] = TextEncoder(shared.value, pattern)
        ids = encoder.encode([text or "" for text in batch.column(1).to_pylist()])
        decoded = [encoder.bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
        out = {id_col: batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
        if digests:
            return out | {
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            }
        return out | {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary())}

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, F.col(text_col).alias("text_")), f"`{id_col}` {kind}, n_tokens long, {rest}", block, 512)
