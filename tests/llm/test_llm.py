"""The text operators on small fixtures: against brute force, libraries and round trips; nulls, empties, ties, repeats, clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from panelspark.llm import bpe, common, langid, line_dedup, mixing, nn_descent, packing, quality, shingle_hash, simhash, token_counts, topk
from panelspark.llm.components import connected_components

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bear today", "en", "a"),
    (2, "The QUICK brown fox jumps over\tthe lazy dog and runs away from the big bear today", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \n\t ", "de", "a"),
    (6, "!!! ??? 123", "en", "c"),
    (7, "word " * 20_000, "en", "a"),
    (7, "word " * 20_000, "en", "a"),
    (8, "zwei wörter", "de", "b"),
    (None, "kein schlüssel hier", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "clash", 1.0) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double").cache()


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_xxh64_equals_the_library_at_all_lengths():
    data = np.frombuffer(random.Random(1).randbytes(400), dtype=np.uint8)
    start = np.arange(200)
    length = np.arange(200) % 150
    got = shingle_hash.xxh64(data, start, length)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(start, length)]


def test_simhash_equals_brute_force(spark, docs):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "eps"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    near = [t.replace("alpha", "alphb", 1) for t in base] + [t + " tail" for t in base]
    texts = [(i, t) for i, t in enumerate(base + near + base[:5] + ["", None, "one", "one two"])]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["node"]: (bytes(r["fp"]).hex(), r["component"]) for r in simhash.near_duplicates(frame).collect()}
    prints = [brute_fingerprint(t) for _, t in texts]
    want = components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i, _ in texts}


def test_simhash_edge_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["node"]: r["component"] for r in rows}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[None] is None
    assert simhash.keep_one(docs.limit(0), plan=simhash.Plan.near()).count() == 0
    kept = simhash.keep_one(docs, plan=simhash.Plan.near())
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8] and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_hot_keys_are_dealt_out_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    base = random.Random(5).getrandbits(64)
    prints = [base ^ (1 << (i % 64)) ^ (1 << (i // 3 % 64)) for i in range(150)]
    nodes = spark.createDataFrame([(i, x.to_bytes(8, "big")) for i, x in enumerate(prints)], "node long, fp binary").dropDuplicates(["fp"])
    ids = sorted(r["node"] for r in nodes.collect())
    got = {r["node"]: r["root"] for r in connected_components(simhash.linked(nodes, simhash.Plan())).collect()}
    want = components(len(ids), lambda a, b: (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3)
    assert [got.get(i, i) for i in ids] == [ids[w] for w in want]


def test_wide_plan_finds_similar_texts_and_leaves_others(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=200) for _ in range(30)]
    edited = [t[:100] + ["changed"] + t[101:] for t in base]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + edited)], "doc_id long, text string")
    got = {r["node"]: r["component"] for r in simhash.near_duplicates(frame, plan=simhash.Plan.near()).collect()}
    assert all(got[i] == i for i in range(30)) and sum(got[30 + i] == i for i in range(30)) >= 29


def test_wide_plan_keeps_its_recall_near_the_threshold(spark):
    """Pairs at Jaccard 0.81 of 100 words; brute force over the same fingerprints says which are within the distance."""
    rng = random.Random(21)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(300)]
    edited = [t[:30] + ["one"] + t[31:60] + ["two"] + t[61:] for t in base]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + edited)], "doc_id long, text string")
    rows = {r["node"]: r for r in simhash.near_duplicates(frame, plan=simhash.Plan.near()).collect()}
    bits = {i: int.from_bytes(r["fp"], "big") for i, r in rows.items()}
    close = [i for i in range(300) if (bits[i] ^ bits[300 + i]).bit_count() <= 90]
    found = [i for i in close if rows[300 + i]["component"] == i]
    assert len(close) >= 0.9 * 300 and len(found) >= 0.94 * len(close)
    assert all(rows[i]["component"] == i for i in range(300))


def test_probed_keys_flip_the_weakest_bits(spark):
    plan = simhash.Plan.near()
    text = " ".join(f"w{i % 37}" for i in range(90))
    prints = simhash.with_fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", plan)
    fp, margin = shingle_hash.fingerprints([text.encode()], plan.words, plan.bits)
    whole = int.from_bytes(fp[0].tobytes(), "big")
    for turn, start in enumerate(simhash.ROUND_STARTS):
        keys = [r["key"] for r in simhash._probed(prints, plan, turn).orderBy("which").collect()]
        assert len(keys) == 16 * 3
        for word in range(16):
            own = [(32 * word + start + i) % 512 for i in range(20)]
            lead = sum((whole >> 511 - p & 1) << 19 - i for i, p in enumerate(own))
            weak = sorted(range(20), key=lambda i: (margin[0, own[i]], i))[:2]
            assert keys[3 * word : 3 * word + 3] == [(word << 20) | lead ^ flip for flip in (0, 1 << 19 - weak[0], 1 << 19 - weak[1])]


def test_further_rounds_and_the_whole_comparison_find_what_the_first_round_lacks(spark, monkeypatch):
    """Keys that no pair shares: the audit asks for further rounds, and the last of them compares all pairs."""
    rng = random.Random(31)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(80)]
    edited = [t[:30] + ["one"] + t[31:60] + ["two"] + t[61:] for t in base]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + edited)], "doc_id long, text string")
    turns, first = [], simhash.linked

    def few(nodes, plan, turn=0):
        turns.append(turn)
        return first(nodes, plan, turn).where("a < 0") if turn < 2 else first(nodes, plan, turn)

    monkeypatch.setattr(simhash, "linked", few)
    plan = simhash.Plan.near()
    for last in (False, True):
        if last:
            monkeypatch.setattr(simhash, "ROUND_STARTS", simhash.ROUND_STARTS[:2])
        got = {r["node"]: r for r in simhash.near_duplicates(frame, plan=plan).collect()}
        bits = [int.from_bytes(got[i]["fp"], "big") for i in range(160)]
        close = [i for i in range(80) if (bits[i] ^ bits[80 + i]).bit_count() <= plan.distance]
        found = sum(got[80 + i]["component"] == i for i in close)
        assert found == len(close) if last else found >= 0.9 * len(close)
    assert turns[:3] == [0, 1, 2] and turns[-2:] == [0, 1]


@pytest.mark.parametrize("hot", [2_000, 1])
def test_rows_of_one_id_are_judged_by_their_own_texts(spark, monkeypatch, hot):
    """Also where every repeated key counts as hot and meets a broadcast part."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    a = " ".join(f"a{i % 50}" for i in range(200))
    b = " ".join(f"b{i % 70}" for i in range(200))
    rows = [(1, a, "x"), (7, a, "y"), (7, b, "z"), (7, b, "z"), (9, a + " end", "u"), (None, b, "v"), (None, "c c c", "w"), (2, None, "n"), (3, "", "e"), (1, b, "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node_ string")
    for plan in (simhash.Plan(), simhash.Plan.near()):
        kept = sorted((r["doc_id"] or 0, r["text"] or "", r["node_"]) for r in simhash.keep_one(frame, plan=plan).collect())
        assert kept == sorted([(1, a, "x"), (1, b, "t"), (0, "c c c", "w"), (2, "", "n")])
    got = sorted((r["node"] or 0, r["component"]) for r in simhash.near_duplicates(frame).collect() if r["component"] is not None)
    assert got == sorted([(1, 1), (7, 1), (7, 1), (7, 1), (9, 1), (0, 1), (2, 2), (3, 2), (1, 1)])


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)}


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.PrefixBpe(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def fuzz(n, seed):
    rng = random.Random(seed)
    parts = [*"ab cdE1'2\n\t  é漢字🙂!?.s", "'s", " the", "ing", "  ", "\r\n", "\x00", "\x1c", "\x85", " ", "aaaa", "<|endoftext|>", "<|endof"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library(vocabulary, library):
    encoder = bpe.TextEncoder(vocabulary, P.PATTERN, limit=50)
    texts = fuzz(1500, 2) + ["aaaa" * 2000, "x" * 3000]
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100])):
            own = np.frombuffer(ids, dtype="<u4").tolist()
            assert own == library.encode_ordinary(text) and vocabulary.decode(own) == text.encode()


def test_appends_and_edits_equal_fresh_encodings(vocabulary):
    rng = random.Random(4)
    for _ in range(200):
        raw = bytes(rng.choices(b"abcdethin\xc3\xa9 ", k=rng.randint(0, 200)))
        own = bpe.PrefixEncoding(vocabulary, raw)
        low = rng.randint(0, len(raw))
        high = rng.randint(low, len(raw))
        new = bytes(rng.choices(b"aeth", k=rng.randint(0, 5)))
        own.edit(low, high, new)
        fresh = bpe.PrefixEncoding(vocabulary, raw[:low] + new + raw[high:])
        assert own.last == fresh.last and own.ids() == fresh.ids()
        own.append(b"hin")
        assert own.ids() == bpe.PrefixEncoding(vocabulary, fresh.piece + b"hin").ids()


def test_bpe_digests_of_edge_rows(docs, library):
    rows = bpe.encode_digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    want = sorted((i or 0, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in TEXTS)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4), (3, [0.5, 0.5, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<double>, rank string")
    good = [(i, np.floor(1024 * np.array(v, dtype=float))) for i, v in vectors[:60] + vectors[-1:]]
    rows = topk.top_k(frame, frame.where("vec_id % 10 = 0"), 5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for query, q in good:
        if query % 10 == 0:
            assert got[query] == sorted((-int(v @ q), i) for i, v in good if i != query)[:5]
    assert len(topk.top_k(frame.where("vec_id < 3"), frame.where("vec_id = 0"), 5).collect()) == 2
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_topk_of_a_repeated_query_id(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(1, 30)] + [(0, [9.0, 9.0, 9.0, 9.0])] * 4 + [(0, [-3.0, 0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)
    got = [(-r["score"], r["vec_id"]) for r in topk.top_k(frame, frame.where("vec_id = 0")).orderBy("rank").collect()]
    q = [(i, np.floor(1024 * np.array(v))) for i, v in vectors]
    assert got == sorted((-int(a @ b), i) for own, a in q if own == 0 for i, b in q if i)[:10]
    ids, rows = np.array([0] * 4 + list(range(1, 30))), np.array([v for _, v in [vectors[-2]] * 4 + vectors[:29]])
    assert len(topk.tile_top(np.array([0]), rows[:1], ids, rows, 10)["vec_id"]) == 10


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(docs.where(~langid.held_out("doc_id", 4, 2)))
    told = langid.predict(docs, net, ["doc_id", "lang"]).where(langid.held_out("doc_id", 4, 2)).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in told)
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.95 and all(0 <= r["score"] <= 1 for r in told)


def test_language_id_edge_rows(docs):
    net = langid.fit(docs)
    told = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, net, ["doc_id"]).collect()}
    assert [told[i] for i in (3, 4, 5, 6)] == ["und"] * 4 and told[8] in ("de", "en")
    left = langid.rejected(docs, net)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} <= {1, 2, 7, 8, None}
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs, None, ["doc_id"]).where("lang_pred = 'und'").count() == len(TEXTS)


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(3)
    net = langid.ByteConvNet.fresh(["a", "b", "c"], widths=(2, 3), dims=3, count=4)
    for name in ("embed", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.bias = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) + 0.1 for b in net.bias]
    x, y = rng.integers(0, 6, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = net.step(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[:40]:
            old = p[at]
            losses = []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                losses.append(net.step(x, y)[0])
            p[at] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5, (p.shape, at)


def test_language_id_learns_from_whole_texts_and_rare_labels(spark):
    """The languages differ only behind the first kilobyte, one of them is in two rows of 400."""
    rows = [(i, "0123 " * 300 + ("abc abd acb " if i % 200 else "xyz xzy zyx ") * 300, "common" if i % 200 else "rare") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(frame, sample_rows=100)
    assert net.labels == ["common", "rare"]
    told = langid.predict(frame, net, ["lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] for r in told)


def test_samples_are_bounded_and_hold_no_copies(spark):
    from panelspark.llm.common import hash_sample

    frame = spark.createDataFrame([(7, "a", "copied")] * 900 + [(i, "a", f"t{i}") for i in range(60)] + [(1, "b", "only")], "id long, g string, text string")
    found = hash_sample(frame, [frame["id"], frame["text"]], 20, "g").collect()
    assert len(found) == len({(r["id"], r["text"]) for r in found}) == 21 and {r["g"] for r in found} == {"a", "b"}
    again = hash_sample(frame.repartition(3), [frame["id"], frame["text"]], 20, "g").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert hash_sample(frame.limit(0), [frame["id"]], 20, "g").count() == 0


def test_lookup_tables_equal_the_trained_network():
    net = langid.ByteConvNet.fresh(["a", "b"])
    x, _ = langid.windows([b"some bytes here", b"", b"x" * 700])
    logits = []
    for row in x:
        e = net.embed[row]
        pooled = [np.max([(e[i : i + len(f)].reshape(-1) @ f.reshape(-1, f.shape[2])) for i in range(len(row) - len(f) + 1)], axis=0) + b for f, b in zip(net.filters, net.bias)]
        logits.append(np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias)
    want = np.array(logits) - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-4)


def test_other_tokenizers_are_refused(docs):
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, P.path("word_bpe_49k.json"))


@pytest.mark.parametrize(("window", "overlap"), [(32_768, 1_024), (500, 8)])
def test_token_counts_equal_the_library(spark, window, overlap):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*fuzz(150, 6), None, "", "x " * 20_000, "ab" * 20_000, " " * 3_000, "word <|endoftext|> x" * 300, "<|endoftext|>" * 300, "é🙂 <|endof" * 500, "a" * 501]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = token_counts.count_tokens(frame, P.path("byte_bpe_50k.json"), window=window, overlap=overlap).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(8)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    free, want = [], []
    for item in sorted(range(300), key=lambda i: -sizes[i]):
        fits = [(f, -k) for k, f in enumerate(free) if f >= sizes[item]]
        if fits:
            least = min(f for f, _ in fits)
            free[next(k for k, f in enumerate(free) if f == least)] -= sizes[item]
        else:
            free.append(50 - sizes[item])
    want = len(free)
    rows = packing.best_fit_decreasing(sizes, 50)
    assert len(rows) == want and sorted(i for r in rows for i in r) == list(range(300)) and all(sum(sizes[i] for i in r) <= 50 for r in rows)


def test_packing_is_lossless(spark, docs, tmp_path):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    packed = packing.pack_tokens(docs.where("doc_id is null or doc_id <> 7"), path, P.PATTERN, capacity=8)
    found = {}
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["n_tokens"] == r["cu_seqlens"][-1] <= 8
        for j, (own, at) in enumerate(zip(r["ids_of"], r["offsets"])):
            found.setdefault(own, []).append((at, ids[r["cu_seqlens"][j] : r["cu_seqlens"][j + 1]].tolist()))
    got = {i: [x for _, part in sorted(parts) for x in part] for i, parts in found.items()}
    assert got == {i: encode(t) for i, t, _, _ in TEXTS if t and i != 7}
    packing.write_matrices(packed, str(tmp_path / "m"), 8, pad=packing.free_id(path))
    written = {(r["block"], r["row"]): r for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    told = {(r["block"], r["row"]): r for r in packing.digests(spark.read.parquet(str(tmp_path / "m"))).collect()}
    rows = packed.collect()
    assert len(rows) == len(written) == len(told)
    for r in rows:
        m, n, d = written[r["block"], r["row"]], r["n_tokens"], told[r["block"], r["row"]]
        own = np.frombuffer(r["ids"], dtype="<u4").tolist()
        places = [x for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]) for x in range(b - a)] + [0] * (8 - n)
        matrix = {c: np.frombuffer(m[c], dtype="<u4").tolist() for c in ("ids", "positions")}
        assert matrix == {"ids": own + [50_256] * (8 - n), "positions": places} and m["n_tokens"] == n and m["ids_of"] == r["ids_of"]
        assert d["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and d["positions_sha256"] == hashlib.sha256(np.array(places, dtype="<u4").tobytes()).hexdigest()
    none = packing.pack_tokens(docs.where("doc_id in (3, 4)"), path, P.PATTERN, capacity=8)
    packing.write_matrices(none, str(tmp_path / "none"), 8)
    assert packing.digests(spark.read.parquet(str(tmp_path / "none"))).count() == 0
    with pytest.raises(ValueError):
        packing.write_matrices(none, str(tmp_path / "bad"), 8, pad=-1)


def test_quality_on_held_out_rows(spark, docs):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    space = quality.fit(table.where(~langid.held_out("doc_id", 3, 1)), labels)
    told = quality.predict(table, space, ["doc_id"]).join(labels, "doc_id").where(langid.held_out("doc_id", 3, 1)).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in told]) > 0.97
    rows = quality.predict(docs, space, ["doc_id"]).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit(docs, labels.limit(0)) is None and quality.predict(docs, None, ["doc_id"]).where("score = 0.5").count() == len(TEXTS)


def test_votes_equal_brute_force(spark):
    """Term counts, space and vote done again plainly; texts are long, so that their ends matter, and two labelled ones tie."""
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta", "é", "##"]
    texts = ["".join(rng.choice(words) + " " for _ in range(rng.randint(1, 80))) * (60 if i % 9 == 0 else 1) for i in range(120)] + [""]
    texts[5] = texts[4]
    quality_of = {i: int("alpha" in t[:40]) for i, t in enumerate(texts) if i % 3}
    quality_of[5] = 1 - quality_of[4]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "alpha")], "doc_id long, text string")
    labels = spark.createDataFrame([*quality_of.items(), (1, quality_of[1]), (2, 1 - quality_of[2]), (None, 1), (900, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.predict(frame, quality.fit(frame, labels), ["doc_id"]).collect()}

    learned = sorted((q, i) for i, q in quality_of.items() if i != 2)  # id 2 has both labels
    pairs = [Counter(zip(t.encode(), t.encode()[1:])) for t in texts]
    total = Counter()
    for _, i in learned:
        total.update(pairs[i])
    top = sorted(sorted(total, key=lambda p: (-total[p], p))[: quality.TERMS])

    def distances(text):
        seen, out = {}, Counter()
        for at, word in enumerate(text.encode().lower().split()):
            out[0 if word not in seen else 1 + math.floor(2 * math.log2(at - seen[word]))] += 1
            seen[word] = at
        return out

    counts = np.array([[pairs[i].get(p, 0) for p in top] + [distances(t).get(g, 0) for g in range(quality.GAPS)] for i, t in enumerate(texts)], dtype=float)
    n = len(top)
    idf = np.log((1 + len(learned)) / (1 + (counts[[i for _, i in learned]] > 0).sum(0))) + 1
    share = np.concatenate([counts[:, :n] / np.maximum(counts[:, :n].sum(1, keepdims=True), 1), counts[:, n:] / np.maximum(counts[:, n:].sum(1, keepdims=True), 1)], 1)
    x = np.sqrt(share) * idf
    _, _, right = np.linalg.svd(x[[i for _, i in learned]], full_matrices=False)
    y = x @ right[: quality.DIMENSIONS].T
    for i in range(len(texts)):
        near = []
        for q, j in learned:
            size = np.linalg.norm(y[i]) * np.linalg.norm(y[j])
            near.append((round(float(y[i] @ y[j]) / size, 7) if size else 0.0, q))
        least = sorted(near, reverse=True)[quality.NEIGHBOURS - 1][0]
        votes = [(c * c, q) for c, q in near if c >= least and c > 0]
        want = sum(c * q for c, q in votes) / sum(c for c, _ in votes) if votes else np.mean([q for q, _ in learned])
        assert got[i] == pytest.approx(want, abs=1e-4), i
    assert got[500] == got[120] == pytest.approx(np.mean([q for q, _ in learned]))


def test_exponent_meets_its_target(spark):
    p = np.array([0.7, 0.2, 0.06, 0.04])
    shares = spark.createDataFrame([(float(x),) for x in p], "p double")
    weights = lambda a: p**a / (p**a).sum()
    a = mixing.exponent(shares, None, 3.0)
    assert (weights(a) / p).max() == pytest.approx(3.0, abs=1e-6)
    a = mixing.exponent(shares, 1.2, None)
    assert -(weights(a) * np.log(weights(a))).sum() == pytest.approx(1.2, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.exponent(shares, None, 0.5)
    assert mixing.exponent(shares, None, 100.0) == 0.0 and mixing.exponent(shares, 0.1, None) == pytest.approx(1.0)


def test_mixing_stays_within_its_budget(spark, docs):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(frame, max_repeats=1.5, block_tokens=50).collect()
    total = sum(1 + i % 7 for i in range(600))
    assert total * 0.98 <= sum(1 + r["doc_id"] % 7 for r in mixed) <= total
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    per = {s: {copies.get(i, 0) for i, _, x in rows if x == s} for s in {x for _, _, x in rows}}
    assert all(max(c) - min(c) <= 1 for c in per.values()) and min(per["hot"]) == 0
    assert mixing.mix_sources(docs, max_repeats=2.0).columns == [*docs.columns, "mix_epoch_"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_line_dedup_drops_cross_site_lines_only(spark, docs, monkeypatch):
    foot = "All rights reserved everywhere"
    rows = [(i, f"own line {i} with many more words than the foot has\n{foot}\n\nlast own line {i}", f"s{i % 6}", 0) for i in range(30)]
    rows += [(100 + i, "a whole copy\nof two lines", f"s{i}", 0) for i in range(6)] + [(200, None, "s1", 0), (201, "", None, 0)]
    rows += [(310, f"{foot}\nshort", "s1", 0), (320, f"{foot}\n{foot}", None, 0)]  # mostly and wholly such lines
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(frame, least_sites=6).collect()}
    assert all(got[i] == f"own line {i} with many more words than the foot has\n\nlast own line {i}" for i in range(30))
    assert got[100] == "a whole copy\nof two lines" and got[200] is None and got[201] == ""
    assert got[310] == "short" and got[320] == f"{foot}\n{foot}"
    monkeypatch.setattr(line_dedup, "HELD_LINES", 0)
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(frame, least_sites=6).collect()} == got
    most = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(frame, least_sites=6, whole_from=0.8).collect()}
    assert most == got | {310: f"{foot}\nshort"}
    assert line_dedup.drop_boilerplate(frame, least_sites=7).where(f"text like '%{foot}%'").count() == 32
    assert line_dedup.drop_boilerplate(docs, 2).columns == docs.columns and line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_nn_descent_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 16))
    dense = [(c + 0.05 * rng.standard_normal(16)) for c in centre for _ in range(12)]
    one = centre[0] + 0.02 * rng.standard_normal((90, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate([*dense, *rng.standard_normal((60, 16)), *one])]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, rows[0][1], None), (n + 5, [float("nan")] * 16, 0), (n + 6, [2 * x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r["id"]: r for r in nn_descent.near_vectors(frame, s=nn_descent.Settings(largest=20)).collect()}
    good = [k for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and np.isfinite(v).all() and any(v)]
    u = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    near = {a: {b for b in good if a != b and rows[a][2] == rows[b][2] and u[a] @ u[b] >= 0.93} for a in good}
    assert len(got) == len(rows) and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(len(rows)) if k not in near)
    assert {k: got[k]["n_links"] for k in good} == {k: len(near[k]) for k in good}
    root = {k: k for k in range(len(rows))}
    for k in good:
        for j in near[k]:
            low, high = sorted((root[k], root[j]))
            root = {i: low if x == high else x for i, x in root.items()}
    assert {k: (got[k]["component_id"], got[k]["kept"]) for k in got} == {k: (root[k], root[k] == k) for k in root}
    assert nn_descent.near_vectors(frame.limit(0)).count() == 0


def test_pairs_near_the_threshold_are_compared_exactly(spark):
    """Cosines that lie within the rounding of the carried vectors, on both sides of the threshold."""
    rng = np.random.default_rng(8)
    first = rng.standard_normal((120, 24))
    first /= np.linalg.norm(first, axis=1)[:, None]
    side = rng.standard_normal(first.shape)
    side -= (side * first).sum(1)[:, None] * first
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = 0.93 + np.linspace(-1e-6, 1e-6, 120)[:, None]
    u = np.concatenate([first, cosine * first + np.sqrt(1 - cosine**2) * side])
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(u)], "vec_id long, embedding array<double>, label int")
    linked = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
    assert linked.sum() == 120 and nn_descent._margin(24) > 1e-5
    got = {r["id"]: r["n_links"] for r in nn_descent.near_vectors(frame).collect()}
    assert [got[i] for i in range(len(u))] == list(linked.sum(1))


def test_nn_descent_links_across_full_lists(spark):
    """Two tight groups, each of more rows than a list holds; all links across them are weaker than those within."""
    rng = np.random.default_rng(5)
    a, b = np.eye(24)[0], 0.945 * np.eye(24)[0] + np.sqrt(1 - 0.945**2) * np.eye(24)[1]
    near = [c + 0.006 * rng.standard_normal(24) for c in (a, b) for _ in range(60)]
    loose = 0.945 * np.eye(24)[0] - np.sqrt(1 - 0.945**2) * np.eye(24)[1]  # a row with links to the first group only
    u = np.array([*near, loose, *rng.standard_normal((40, 24))])
    u = u / np.linalg.norm(u, axis=1)[:, None]
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(u)], "vec_id long, embedding array<double>, label int")
    linked = u @ u.T >= 0.93
    assert linked[:60, 60:120].any() and np.sort((u @ u.T)[0])[-41] > (u @ u.T)[0, 60:120].max()
    got = {r["id"]: r for r in nn_descent.near_vectors(frame).collect()}
    assert [got[i]["n_links"] for i in range(len(u))] == list(linked.sum(1) - 1)
    assert [got[i]["component_id"] for i in range(len(u))] == components(len(u), lambda x, y: linked[x, y])


def _pairs_beside_a_crowd(rng):
    """A label with 60 near-copies and 700 pairs at a cosine little over the threshold, and a small label of lone pairs."""
    first = rng.standard_normal((740, 24))
    first /= np.linalg.norm(first, axis=1)[:, None]
    side = rng.standard_normal(first.shape)
    side -= (side * first).sum(1)[:, None] * first
    side /= np.linalg.norm(side, axis=1)[:, None]
    crowd = first[0] + 0.006 * rng.standard_normal((60, 24))
    u = np.concatenate([first, 0.935 * first + np.sqrt(1 - 0.935**2) * side, crowd / np.linalg.norm(crowd, axis=1)[:, None]])
    label = np.concatenate([np.repeat([0, 1, 0, 1], [700, 40, 700, 40]), np.zeros(60, dtype=int)])
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    return u, label, linked & ~np.eye(len(u), dtype=bool)


def test_nn_descent_audit_counts_beside_a_crowd(spark, monkeypatch):
    """One tree finds few pairs at the threshold; a crowd with full lists does not end the search, all pairs are compared."""
    assert [nn_descent._trees(b, nn_descent.Settings()) for b in (0, 10, 19)] == [12, 12, 43]
    monkeypatch.setattr(nn_descent, "_trees", lambda bits, s: s.trees)
    u, label, linked = _pairs_beside_a_crowd(np.random.default_rng(6))
    frame = spark.createDataFrame([(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(u, label))], "vec_id long, embedding array<double>, label int")
    few = nn_descent.Settings(trees=1, leaf=4, neighbours=2, rounds=1, starts=1)
    got = {r["id"]: r for r in nn_descent.near_vectors(frame, s=few).collect()}
    assert [got[i]["n_links"] for i in range(len(u))] == list(linked.sum(1))
    root = list(range(len(u)))
    for a, b in np.argwhere(np.triu(linked)):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert [got[i]["component_id"] for i in range(len(u))] == root


@pytest.mark.parametrize("label", [0, "a"])
def test_nn_descent_tells_rows_of_one_id_apart(spark, label):
    """One id at several vectors, in one label and in two, equal, near and far."""
    rows = [(5, [1.0, 0.0], 0), (6, [1.0, 0.01], 0), (5, [0.0, 1.0], 1), (7, [0.0, -1.0], 1), (8, [1.0, 0.0], None), (9, [0.0, 1.0], 2), (5, [0.0, 1.001], 2), (11, [1.0, 0.02], 2)]
    rows += [(5, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (12, [1.0, 0.0], 1), (12, [1.0, 0.1], 1), (4, [-1.0, 0.0], 0)]
    kind = "string" if label else "int"
    given = [(i, v, None if c is None else (f"{label}{c}" if label else c)) for i, v, c in rows]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], f"row long, vec_id long, embedding array<double>, label {kind}")
    u = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    linked = lambda a, b: a != b and rows[a][2] is not None and rows[a][2] == rows[b][2] and u[a] @ u[b] >= 0.93
    group = components(len(rows), linked)
    want = []
    for a, (i, _, _) in enumerate(rows):
        least = min(rows[b][0] for b in range(len(rows)) if group[b] == group[a])
        want.append((i, sum(linked(a, b) for b in range(len(rows))), least, i == least))
    got = [tuple(r) for r in nn_descent.near_vectors(frame).select("id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(want)


def test_numerals_are_no_letters(spark):
    frame = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ ৩ _ 7"), (3, "ª"), (4, "½ ² ① 語"), (5, "plain words")], "doc_id long, text string")
    net = langid.ByteConvNet.fresh(["x", "y"])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame, net, ["doc_id"]).collect()}
    assert got[1] == got[2] == ("und", 0.0) and all(got[i][0] in "xy" and 0 < got[i][1] <= 1 for i in (3, 4, 5))
    assert langid.fit(frame.selectExpr("doc_id", "'½ ²' text", "'en' lang")) is None


def test_votes_of_all_windows_of_a_text(spark):
    """The label of a text is that of the weighted mean of its windows' log-probabilities, taken one by one here."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("abc déλ \n", k=k)) for k in (1, 255, 256, 257, 700, 5_000)] + ["x" + "\0" * 600]
    net = langid.ByteConvNet.fresh(["de", "en", "fr"])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame, net, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        data, total, weight = text.encode(), np.zeros(3), 0
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            x = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), dtype=np.uint8)[None]
            own = max(1, len(part) - part.count(0))
            total += own * net.log_probabilities(x, net.tables())[0].astype(float)
            weight += own
        share = np.exp(total / weight - (total / weight).max())
        share /= share.sum()
        if any(c.isalpha() for c in text):
            assert got[i][0] == net.labels[int(share.argmax())] and abs(got[i][1] - share.max()) < 1e-6


def test_vocabularies_that_merge_spaces_are_refused_beside_added_tokens(docs):
    import json

    parts = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    small = {"model": {"type": "BPE", "vocab": {"a": 0, "Ġ": 1, "ĠĠ": 2}}, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": parts["added_tokens"]}
    token_counts._check(parts)
    with pytest.raises(ValueError):
        token_counts._check(small)
    token_counts._check(small | {"added_tokens": []})


def test_hot_keys_are_few_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    left = spark.createDataFrame([(k % 40 if k % 2 else 7, k) for k in range(400)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(k, k * 10) for k in range(30)], "k long, y long")
    hot = common.hot_keys(left.groupBy("k").count(), "k")
    assert [r["k"] for r in hot.collect()] == [7]  # each of the others has over HOT_ROWS rows, but a small share
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, map(tuple, left.join(right, "k", how).collect())))
        assert sorted(map(str, map(tuple, common.joined_by(left, right, "k", how).collect()))) == want
