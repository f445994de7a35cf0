"""Substring dedup, fill-in-the-middle and importance resampling against brute force; odd rows, repeats, empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from panelspark.llm import fim, importance, substrings

ODD = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "null id é"), (4, " \n\t "), (5, "y " * 30_000), (6, "€\U0001f600" * 700), (7, "a <P> b"), (8, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.5, "clash") for i, t in ODD], "doc_id long, text string, score double, block string").cache()


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_kept(rows, w):
    first = {}
    for i, text in rows:
        own = words_of(text)
        for k in range(len(own) - w + 1 if i is not None else 0):
            key = tuple(own[k : k + w])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        own = words_of(text)
        gone = [False] * len(own)
        for k in range(len(own) - w + 1 if i is not None else 0):
            if first[tuple(own[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out.append((i, len(own), sum(gone), b" ".join(x for x, g in zip(own, gone, strict=True) if not g).decode()))
    return out


def planted(rng, n):
    """Texts that share passages around the window's length, copies, texts that repeat themselves, a passage in a third of all."""
    vocabulary = [f"w{k}" for k in range(400)]
    some = lambda k: rng.choices(vocabulary, k=k)
    passages, hot = [some(rng.randint(8, 40)) for _ in range(12)], some(30)
    rows = []
    for i in range(n):
        parts = [some(rng.randint(0, 30)) for _ in range(4)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 4), rng.choice(passages))
        if i % 3 == 0:
            parts.append(hot)
        if i % 10 == 0:
            parts += [parts[0]] * 2
        rows.append((rng.randint(0, n), rng.choice([" ", "\n", "\t "]).join(x for p in parts for x in p)))
    return rows + [(n + k, rows[k % 4][1]) for k in range(12)] + rows[:3] + [(None, rows[0][1])]


@pytest.mark.parametrize("settings", [substrings.Settings(12, 5), substrings.Settings(12, 12, 1, 12), substrings.Settings(1, 1)])
def test_repeated_windows_equal_brute_force(spark, settings):
    rows = planted(random.Random(4), 150)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, at string").repartition(3)
    got = [tuple(r) for r in substrings.drop_repeats(frame, ["doc_id"], s=settings).collect()]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=key) == sorted(brute_kept(rows, settings.window), key=key)


def test_a_crowded_sketch_loses_no_window(spark, monkeypatch):
    """With far too few cells nearly every window is estimated to repeat; the exact pass decides alike. Copies may be many."""
    monkeypatch.setattr(substrings, "BROADCAST_COPIES", 0)
    rows = planted(random.Random(5), 80)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.drop_repeats(frame, ["doc_id"], s=substrings.Settings(12, 4, 2, 12)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_kept(rows, 12)))


def test_anchors_are_the_least_runs_of_equal_windows():
    words = substrings.Words([b"a b c d e f g h", b"", b"x c d e f g y", b"one"])
    at = words.windows(5)
    assert list(at) == [0, 1, 2, 3, 8, 9, 10] and list(words.count) == [8, 0, 7, 1]
    runs = words.runs(np.arange(14), np.arange(14) + 3)
    assert list(words.anchors(at, 5, 3)) == [min(runs[i : i + 3]) for i in at]
    same = words.runs(at, at + 5)
    assert same[2] == same[5] and len(set(same.tolist())) == 6  # c d e f g stands in both texts


def test_substrings_of_odd_rows(odd):
    got = substrings.drop_repeats(odd, ["doc_id", "score", "block"]).collect()
    want = [(i, 1.5, "clash", n, g, k) for i, n, g, k in brute_kept(ODD, 50)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert substrings.drop_repeats(odd.limit(0), ["doc_id"]).count() == 0


def brute_fim(i, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_slices(spark, odd):
    rng = random.Random(6)
    pieces = ["plain words ", "ünïcödé ", "漢字", "\U0001f600", "<", "P>", "<S", ">", "\n"]
    rows = ODD + [(100 + k, "".join(rng.choices(pieces, k=rng.choice([1, 5, 400, 3000])))) for k in range(120)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, text_ string")
    made = fim.fill_in_middle(frame, ["doc_id"]).withColumn("back", fim.restore())
    got = [tuple(r) for r in made.collect()]
    want = [(*brute_fim(*r), r[1] or "") for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(odd, ["doc_id", "score"]).count() == len(ODD) and fim.fill_in_middle(odd.limit(0), ["doc_id"]).count() == 0


def test_chunks_follow_content_and_are_remembered():
    rng = random.Random(7)
    shared = "".join(rng.choices("abcdé €", k=60_000)).encode()
    one, two = fim.chunks(shared), fim.chunks("früher ".encode() * 9 + shared)
    assert b"".join(one) == shared and len(set(one) & set(two)) > 0.8 * len(one)
    assert all(fim.SHORTEST <= len(c) <= fim.LONGEST for c in one[:-1])
    assert [len(c) for c in fim.chunks(b"z" * 20_000)] and b"".join(fim.chunks(b"z" * 20_000)) == b"z" * 20_000
    memory = fim.Chunks(("<P>", "<S>", "<M>"))
    text = shared.decode()
    doc = memory.document(shared)
    before = len(memory.known)
    assert len(doc) == len(text) and memory.document(shared).points == doc.points and len(memory.known) == before
    for k in (0, 1, 777, 31_000, len(text) - 1, len(text)):
        assert doc.offset(k) == len(text[:k].encode())
    # A sentinel across the border of two chunks is seen.
    border = len(one[0])
    assert memory.document(shared[: border - 1] + b"<P>" + shared[border:]).held and not doc.held


def test_sentinels_that_could_be_mistaken_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">x", "<M>"), ("<P>", "x<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.Format(*marks)


def brute_importance(rows, target, s):
    def runs(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % s.buckets for k in range(1, s.runs + 1) for i in range(len(w) - k + 1)]

    own, wanted = [runs(t) for _, t in rows], [runs(t) for t in target]
    count = lambda found: np.bincount([b for _, x in found for b in x] or [0], minlength=s.buckets) - (0 if any(x for _, x in found) else np.eye(1, s.buckets, dtype=int)[0])
    a, b = count(own), count(wanted)
    gain = [math.floor(1000 * math.log((int(t) + 1) * (int(a.sum()) + s.buckets) / ((int(r) + 1) * (int(b.sum()) + s.buckets)))) for r, t in zip(a, b)]
    out = []
    for (i, _), (n, x) in zip(rows, own):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in x) // len(x) if x else 0
        out.append([i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for place, r in enumerate(able[: len(able) * s.share // 100], 1):
        r[5] = place
    return out


@pytest.mark.parametrize("s", [importance.Settings(share=60), importance.Settings(runs=3, buckets=70_000, least_words=5, share=100), importance.Settings(runs=1, buckets=50)])
def test_resampling_equals_brute_force(spark, s):
    rng = random.Random(8)
    vocabulary = ["Über", "TOKEN", "x-1", "don't", "42", "漢", "plain", "é", " ", "K"]
    rows = ODD + [(50 + k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 90)))) for k in range(80)]
    rows += [rows[-1]] * 40  # repeated rows are ranked one after another
    target = [" ".join(rng.choices(vocabulary[:4], k=30)) for _ in range(9)] + [None, ""]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, noise_ string").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = [list(r) for r in importance.resample(frame, wanted, s=s).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_importance(rows, target, s)))
    assert importance.resample(frame.limit(0), wanted, s=s).count() == 0 and importance.resample(frame, wanted.limit(0), s=s).count() == len(rows)
