"""Language identification by a byte convolutional network, trained in numpy.

Each byte has an embedding; filters of several widths slide over a fixed-length
window; the maximum of each filter over the window feeds a softmax layer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import hash_sample, mapped, text_bytes

WINDOW = 256
#: Labelled rows that a network is trained on, at most; so many windows of each.
SAMPLE_ROWS = 4_000
SAMPLE_WINDOWS = 2
#: A letter by its Unicode category; numerals such as superscripts and fractions are none.
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def windows(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows of `length` bytes, zero-filled: (bytes, text of each window)."""
    counts = np.array([-(-len(t) // length) for t in texts], dtype=np.int64)
    out = np.frombuffer(b"".join(t.ljust(n * length, b"\0") for t, n in zip(texts, counts, strict=True)), dtype=np.uint8)
    return out.reshape(-1, length), np.repeat(np.arange(len(texts)), counts)


@dataclass
class ByteConvNet:
    """Parameters, and forward and backward passes of the network."""

    labels: list[str]
    embed: np.ndarray  # (256, d)
    filters: list[np.ndarray]  # a (width, d, f) array for each width
    bias: list[np.ndarray]  # (f,) for each width
    out: np.ndarray  # (all f, labels)
    out_bias: np.ndarray

    @staticmethod
    def fresh(labels: list[str], widths: tuple[int, ...] = (2, 3, 4), dims: int = 8, count: int = 16, seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        shape = lambda *s: (rng.standard_normal(s) / np.sqrt(np.prod(s[:-1]))).astype(np.float32)
        embed = rng.standard_normal((256, dims)).astype(np.float32)
        embed[0] = 0
        return ByteConvNet(labels, embed, [shape(w, dims, count) for w in widths], [np.zeros(count, np.float32) for _ in widths], shape(count * len(widths), len(labels)), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of a batch of windows, and the gradients in the order of parameters()."""
        n, length = x.shape
        e = self.embed[x]
        pooled, arg, columns = [], [], []
        for f, b in zip(self.filters, self.bias, strict=True):
            width, dims, count = f.shape
            col = np.lib.stride_tricks.sliding_window_view(e, width, axis=1).transpose(0, 1, 3, 2).reshape(n, length - width + 1, width * dims)
            conv = col @ f.reshape(-1, count) + b
            at = conv.argmax(1)
            arg.append(at)
            columns.append(col)
            pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(n), y] + 1e-9).mean()
        p[np.arange(n), y] -= 1
        p /= n
        d_hidden = (p @ self.out.T) * (raw > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias, start = [], [], 0
        for f, at, col in zip(self.filters, arg, columns, strict=True):
            width, dims, count = f.shape
            d = d_hidden[:, start : start + count]
            start += count
            picked = col[np.arange(n)[:, None], at]  # (n, count, width * dims)
            d_filters.append(np.einsum("nc,nck->kc", d, picked).reshape(f.shape))
            d_bias.append(d.sum(0))
            d_col = d[:, :, None] * f.reshape(-1, count).T[None]
            for w in range(width):
                np.add.at(d_embed, x[np.arange(n)[:, None], at + w], d_col[:, :, w * dims : (w + 1) * dims])
        return float(loss), [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1_000, batch: int = 64, rate: float = 0.005, seed: int = 7) -> None:
        """Adam, for as many steps whatever the number of windows; the same data and seed give the same network."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        order = np.empty(0, dtype=np.int64)
        for t in range(1, steps + 1):
            if len(order) < min(batch, len(x)):
                order = np.concatenate([order, rng.permutation(len(x))])
            own, order = order[:batch], order[batch:]
            _, grads = self.step(x[own], y[own])
            for p, g, a, b in zip(self.parameters(), grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, what byte pairs (or a last single byte) add to the filters: lookups replace the products."""
        out = []
        pairs = np.arange(65536)
        low, high = pairs & 255, pairs >> 8  # a little-endian pair: the low byte comes first
        for f in self.filters:
            single = np.einsum("bd,wdc->wbc", self.embed, f)
            own = [single[w][low] + single[w + 1][high] for w in range(0, len(f) - 1, 2)]
            out.append([np.ascontiguousarray(t) for t in own] + ([np.ascontiguousarray(single[-1])] if len(f) % 2 else []))
        return out

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]], batch: int = 64) -> np.ndarray:
        """Log of the softmax of every window."""
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        for start in range(0, len(x), batch):
            part = x[start : start + batch]
            pair = part[:, :-1].astype(np.int32) + (part[:, 1:].astype(np.int32) << 8)
            pooled = []
            for f, own, b in zip(self.filters, tables, self.bias, strict=True):
                size = part.shape[1] - len(f) + 1
                conv = np.take(own[0], pair[:, :size], axis=0)
                for k, table in enumerate(own[1:], 1):
                    index = pair if len(table) == 65536 else part
                    conv += np.take(table, index[:, 2 * k : 2 * k + size], axis=0)
                pooled.append(conv.max(1) + b)
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            out[start : start + batch] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo parts, is part."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> ByteConvNet | None:
    """A network trained on at most `sample_rows` labelled rows, as many of each label where there are enough; None without any.

    Rows are chosen by a hash of id and text; of each, SAMPLE_WINDOWS windows
    from anywhere in the whole text, also chosen by hash, reach the driver. Left
    out are rows with a null text or label and windows without a letter. With
    more than `sample_rows` labels the most frequent ones are learned.
    """
    text = F.col("text_")
    given = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    given = given.select(F.col(text_col).alias("text_"), F.col(label_col).alias("label_"), F.col(id_col).cast("string").alias("id_"))
    labels = [r["label_"] for r in given.groupBy("label_").count().orderBy(F.desc("count"), "label_").limit(sample_rows).collect()]
    if not labels:
        return None
    room = F.greatest(F.char_length(text) - WINDOW, F.lit(0)) + 1
    place = lambda turn: (F.pmod(F.xxhash64("id_", text, F.lit(turn)), room) + 1).cast("int")
    drawn = F.array(*[F.substring(text, place(t), F.lit(WINDOW)) for t in range(SAMPLE_WINDOWS)])
    # Windows are cut where the text lies; of a text only they and its hash travel on.
    drawn = given.where(F.col("label_").isin(labels)).select("label_", drawn.alias("windows_"), F.xxhash64("id_", text).alias("hash_"))
    sample = hash_sample(drawn, [F.col("hash_")], max(1, sample_rows // len(labels)), "label_")
    found = sample.select("label_", F.explode("windows_").alias("window_")).orderBy("label_", "window_").collect()
    rows = [(r["window_"].encode()[:WINDOW], r["label_"]) for r in found if LETTER.search(r["window_"])]
    if not rows:
        return None
    labels = sorted({label for _, label in rows})
    net = ByteConvNet.fresh(labels)
    x, of = windows([t for t, _ in rows])
    y = np.array([labels.index(label) for _, label in rows])[of]
    # Short windows too, so that short texts are known.
    short = x.copy()
    short[:, 48:] = 0
    net.train(np.concatenate([x, short]), np.concatenate([y, y]))
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score of every whole text.

    All windows of a text count, each by its number of bytes; the label with the
    highest mean log-probability wins, and the score is its share of their
    softmax. A text that is null or has no letter, or any text if there was
    nothing to learn from, gets `und` and score 0. Text alone is read. Rows stay
    as they are, repeated ones too; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    tables: list = []

    def block(batch: pa.RecordBatch) -> dict:
        net = shared.value
        texts = text_bytes(batch.column("text_"))
        n = len(texts)
        pred, score = [UNDETERMINED] * n, np.zeros(n)
        if net is not None:
            if not tables:
                tables.extend(net.tables())
            x, of = windows(texts)
            weight = np.maximum((x != 0).sum(1), 1).astype(np.float64)
            total = np.zeros((n, len(net.labels)))
            np.add.at(total, of, net.log_probabilities(x, tables) * weight[:, None])
            mean = total / np.maximum(np.bincount(of, weight, minlength=n), 1)[:, None]
            share = np.exp(mean - mean.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            for i, text in enumerate(texts):
                if LETTER.search(text.decode()):
                    best = int(share[i].argmax())
                    pred[i], score[i] = net.labels[best], share[i, best]
        return {name: batch.column(name) for name in keep} | {"lang_pred": pa.array(pred), "score": pa.array(score)}

    given = docs.select(*keep, F.col(text_col).alias("text_"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(given, f"{kinds}, lang_pred string, score double", block, 256)


def rejected(docs: DataFrame, net: ByteConvNet | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the texts whose language can't be told: `und`, or a score under `least`. All columns stay.

    Null, empty and letterless texts are `und` and go. Without a network (there
    was nothing to learn from) no text can be judged, and all rows stay. Repeated
    rows are judged each; an empty table gives no rows. A clashing column named
    lang_pred or score is kept as it was.
    """
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    text = f"c{names.index(text_col)}_"
    told = predict(renamed, net, renamed.columns, text)
    if net is None:
        return docs
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])
