"""XXH64 of word shingles and majority fingerprints, vectorised over a block of texts."""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)
#: Odd constant of the additive sequence that derives further hashes from the first.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LANES = np.uint64(0x0101010101010101)
#: So many ones fit into a byte lane.
LANE_ROWS = 255


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the slices [start, start + length) of a byte array."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    wide = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    seed64, n = np.uint64(seed), length.astype(np.uint64)
    at, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        acc = np.full(len(at), seed64 + P5, dtype=np.uint64)
        if len(long := np.flatnonzero(left >= 32)):
            v = [np.full(len(long), x, dtype=np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            stripes, live = left[long] >> 5, np.arange(len(long))
            for stripe in range(int(stripes.max())):
                live = live[stripes[live] > stripe]
                base = at[long[live]] + 32 * stripe
                for k in range(4):
                    v[k][live] = _round(v[k][live], wide[base + 8 * k])
            merged = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                merged = (merged ^ _round(np.zeros_like(x), x)) * P1 + P4
            acc[long] = merged
            at, left = at + (left >> 5) * 32, left & 31
        acc += n
        for step in range(3):
            if not len(i := np.flatnonzero(left >= 8 * (step + 1))):
                break
            lane = _round(np.zeros(len(i), dtype=np.uint64), wide[at[i] + 8 * step])
            acc[i] = _rotl(acc[i] ^ lane, 27) * P1 + P4
        at, left = at + (left & ~7), left & 7
        if len(i := np.flatnonzero(left >= 4)):
            acc[i] = _rotl(acc[i] ^ ((wide[at[i]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at, left = at + (left & 4), left & 3
        for step in range(3):
            if not len(i := np.flatnonzero(left > step)):
                break
            acc[i] = _rotl(acc[i] ^ (padded[at[i] + step].astype(np.uint64) * P5), 11) * P1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        return acc ^ (acc >> np.uint64(32))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased, space-joined shingles of all texts: bytes, start, length, and text of each shingle.

    A text with fewer words than a shingle gives its whole sequence, one without words nothing.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = SPACE[raw]
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    text = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    keep = ~space
    keep[ends] = True
    raw[space] = 0x20
    place = np.cumsum(keep) - 1
    first, last = place[starts], place[ends]
    n = len(first)
    per_text = np.bincount(text, minlength=len(texts))
    begin = np.cumsum(per_text) - per_text
    rank = np.arange(n) - begin[text]
    size = np.minimum(per_text[text], words)
    head = np.flatnonzero(rank + size <= per_text[text])
    return raw[keep], first[head], last[head + size[head] - 1] - first[head], text[head]


def fingerprints(texts: list[bytes], words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Majority fingerprint of every text, big-endian bytes: bit 0 of the first hash is the last bit of word 0.

    A bit is 1 where over half of the shingle hashes, repeats included, have it.
    Beyond 64 bits, further hashes are mixed from the XXH64 of the shingle.
    The second array holds each bit's margin, from the first byte's high bit on:
    how far its count is from half (times two); the smallest flip first when a text is edited.
    """
    out = np.zeros((len(texts), bits // 64, 8), dtype=np.uint8)
    margin = np.zeros((len(texts), bits // 64, 8, 8), dtype=np.int32)
    data, start, length, text = shingles(texts, words)
    if not len(start):
        return out.reshape(len(texts), -1), margin.reshape(len(texts), -1)
    base = xxh64(data, start, length)
    count = np.bincount(text, minlength=len(texts))
    some = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[some]
    blocks = -(-count[some] // LANE_ROWS)
    block_text = np.repeat(np.arange(len(some)), blocks)
    inner = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_start = begin[block_text] + inner * LANE_ROWS
    text_start = np.cumsum(blocks) - blocks
    with np.errstate(over="ignore"):
        for w in range(bits // 64):
            h = base
            if w:
                h = base + np.uint64(w) * GOLDEN
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            over = np.empty((len(some), 8, 8), dtype=np.int32)
            for k in range(8):
                lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, block_start)
                byte = lanes.view(np.uint8).reshape(-1, 8).astype(np.uint32)
                over[:, ::-1, 7 - k] = np.add.reduceat(byte, text_start, axis=0) * 2 - count[some, None]
            out[some, w] = np.packbits(over > 0, axis=2)[:, :, 0]
            margin[some, w] = np.abs(over)
    return out.reshape(len(texts), -1), margin.reshape(len(texts), -1)
