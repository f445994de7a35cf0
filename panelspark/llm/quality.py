"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are of two families: byte pairs, and of every word how far back it last
stood (in half octaves; one term for a word that is new). Damped, idf-weighted
shares of either family are projected on the leading right singular vectors of a
labelled sample; each document then takes a vote of its nearest labelled vectors,
weighted by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import hash_sample, mapped, saved, text_bytes

#: Labelled documents in the space, at most.
SAMPLE_ROWS = 4_000
#: The most frequent byte pairs of the sample are terms; so many terms are for distances.
TERMS = 1_024
GAPS = 64
DIMENSIONS = 48
NEIGHBOURS = 25
#: Cosines are compared to this many digits, so that the shape of a block makes no difference.
DIGITS = 9


def all_pairs(texts: list[bytes]) -> np.ndarray:
    """Counts of all byte pairs over the texts."""
    total = np.zeros(65536, dtype=np.int64)
    for text in texts:
        b = np.frombuffer(text, dtype=np.uint8).astype(np.int32)
        if len(b) > 1:
            total += np.bincount((b[:-1] << 8) | b[1:], minlength=65536)
    return total


def gaps(text: bytes) -> np.ndarray:
    """Counts of the distance terms of a text: term 0 for new words, 1 + the half octave of the distance for others."""
    last: dict[bytes, int] = {}
    distance = []
    for at, word in enumerate(text.lower().split()):
        distance.append(at - last.get(word, at))
        last[word] = at
    d = np.array(distance, dtype=np.int64)
    terms = np.where(d > 0, np.minimum(np.log2(np.maximum(d, 1)) * 2 + 1, GAPS - 1), 0).astype(np.int64)
    return np.bincount(terms, minlength=GAPS)


def term_counts(texts: list[bytes], term_of: np.ndarray) -> np.ndarray:
    """Counts of the TERMS byte pairs and GAPS distances in each text; term_of maps a byte pair to its term, or to TERMS for none."""
    out = np.zeros((len(texts), TERMS + GAPS))
    for i, text in enumerate(texts):
        b = np.frombuffer(text, dtype=np.uint8).astype(np.int32)
        if len(b) > 1:
            out[i, :TERMS] = np.bincount(term_of[(b[:-1] << 8) | b[1:]], minlength=TERMS + 1)[:TERMS]
        out[i, TERMS:] = gaps(text)
    return out


def term_map(top: np.ndarray) -> np.ndarray:
    """The term of each byte pair, given the pairs that are terms."""
    out = np.full(65536, TERMS, dtype=np.int32)
    out[np.sort(top)] = np.arange(len(top))
    return out


@dataclass
class LabelledSpace:
    """A latent-semantic space and the labelled vectors in it."""

    term_of: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of_counts(term_of: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> LabelledSpace:
        idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
        space = LabelledSpace(term_of, idf, np.empty(0), np.empty(0), np.asarray(labels, dtype=np.float64))
        weighted = space.weighted(counts)
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        space.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS])
        space.vectors = space.placed(counts)
        return space

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Damped shares within each family times idf, so that the length of a text does not matter."""
        parts = [part / np.maximum(part.sum(1, keepdims=True), 1) for part in (counts[:, :TERMS], counts[:, TERMS:])]
        return np.sqrt(np.concatenate(parts, axis=1)) * self.idf

    def placed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the space; zero for texts without terms."""
        x = self.weighted(counts) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its squared cosine.

        The nearest are those at or above the NEIGHBOURS-th largest cosine, to
        DIGITS digits: all that tie with the last one vote. Without a neighbour
        of positive cosine it is the share of label 1 in the sample.
        """
        cosine = np.round(self.placed(term_counts(texts, self.term_of)) @ self.vectors.T, DIGITS)
        k = min(NEIGHBOURS, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        weight = np.where(cosine >= least, np.maximum(cosine, 0) ** 2, 0)
        total = weight.sum(1)
        vote = weight @ self.labels
        return np.clip(np.where(total > 0, vote / np.where(total > 0, total, 1), self.labels.mean()), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> LabelledSpace | None:
    """The space of at most `sample_rows` labelled documents, half of either label where there are enough, chosen by a hash of their ids.

    Whole texts are counted, on the executors; term counts of the sample reach
    the driver. Left out are rows with a null id, text or label, labels other
    than 0 and 1, and ids with both labels. Of rows that repeat an id, the text
    with the smallest MD5 counts. None if nothing is left.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_"))
    marked = marked.agg(F.min(label_col).alias("label_"), F.max(label_col).alias("other_")).where(F.col("label_") == F.col("other_")).drop("other_")
    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    chosen = hash_sample(marked.join(given.select("id_"), "id_", "left_semi"), [F.col("id_")], sample_rows // 2, "label_")
    own = given.join(F.broadcast(chosen), "id_")  # chosen: sample_rows at most
    sample = saved(own.groupBy("id_", "label_").agg(F.min_by("text_", F.md5("text_")).alias("text_")))

    def totals(batch: pa.RecordBatch) -> dict:
        total = all_pairs(text_bytes(batch.column("text_")))
        return {"pair": pa.array(np.flatnonzero(total), pa.int32()), "n": pa.array(total[total > 0], pa.int64())}

    by_pair = mapped(sample.select("text_"), "pair int, n long", totals).groupBy("pair").agg(F.sum("n").alias("n"))
    top = np.array([r["pair"] for r in by_pair.orderBy(F.desc("n"), "pair").limit(TERMS).collect()], dtype=np.int64)
    term_of = term_map(top)

    def counted(batch: pa.RecordBatch) -> dict:
        counts = term_counts(text_bytes(batch.column("text_")), term_of)
        rows = [np.flatnonzero(line) for line in counts]
        return {
            "id_": batch.column("id_"), "label_": batch.column("label_"), "term": pa.array(rows, pa.list_(pa.int32())),
            "n": pa.array([line[at] for line, at in zip(counts, rows, strict=True)], pa.list_(pa.float64())),
        }

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in ("id_", "label_"))
    rows = mapped(sample, f"{kinds}, term array<int>, n array<double>", counted).orderBy("label_", "id_").collect()
    if not rows:
        return None
    counts = np.zeros((len(rows), TERMS + GAPS))
    for line, row in zip(counts, rows, strict=True):
        line[row["term"]] = row["n"]
    return LabelledSpace.of_counts(term_of, counts, np.array([r["label_"] for r in rows]))


def predict(docs: DataFrame, space: LabelledSpace | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, score double and predicted int of every whole text.

    The labelled vectors (bounded by the sample) are broadcast; each block of
    documents is one exact product with them. Null and empty texts have no
    terms and get the sample's share of label 1; so does every text, as 0.5, if
    there was nothing to learn from. Ties at the last neighbour all vote. Rows
    stay as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def block(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column("text_"))
        score = shared.value.score(texts) if shared.value is not None else np.full(len(texts), 0.5)
        return {name: batch.column(name) for name in keep} | {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(docs.select(*keep, F.col(text_col).alias("text_")), f"{kinds}, score double, predicted int", block, 512)
