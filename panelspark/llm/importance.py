"""Importance resampling of documents towards the word runs of a target collection.

Separators of a text become single spaces; a regular expression with
boundary lookarounds, scanned with overlaps, gives the span of every run of words
straight from the bytes, and the CRC-32 of a span is its feature. Features are
counted in a fixed number of buckets, over all documents and over the target; a
document's weight is the mean gain of its features, and the draw adds Gumbel noise
from a hash of its id, so that the highest scores are a sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import by_size, fresh_folder, mapped_by_size, removed, saved, text_bytes

#: Bytes that separate words become spaces and A-Z lower case: words are digits, letters and all beyond ASCII.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SPAN = regex.compile("").match("").__class__.span


@dataclass(frozen=True)
class Settings:
    """runs: longest run of words that is a feature. buckets: of the features' hashes. least_words: of a document that can be drawn. share: of these, in hundredths, that are drawn."""

    runs: int = 2
    buckets: int = 10_000
    least_words: int = 20
    share: int = 25
    seed: str = "7"

    @property
    def kind(self) -> str:
        return "<u2" if self.buckets <= 1 << 16 else "<u4"


def scan(runs: int) -> regex.Pattern:
    """From the space before a word to the end of the longest run of `runs` words from there: with overlaps, one match a word."""
    return regex.compile(rb" [^ ]++(?: [^ ]++){0,%d}+(?![^ ])" % (runs - 1))


def hashes(text: bytes, pattern: regex.Pattern, runs: int) -> list[list[int]]:
    """The CRC-32 of every run of words of a text, by the length of the run.

    One overlapped scan gives the spans of the longest runs; a shorter run ends where the word after it is led by its space.
    """
    clean = b" " + b" ".join(text.translate(FOLD).split())
    spans = list(map(SPAN, pattern.finditer(clean, overlapped=True))) if len(clean) > 1 else []
    begins = [begin for begin, _ in spans]
    begins.append(len(clean))
    short = [[crc32(clean[begin + 1 : end]) for begin, end in zip(begins, begins[k:], strict=False)] for k in range(1, runs)]
    return [*short, [crc32(clean[begin + 1 : end]) for begin, end in spans[: max(0, len(spans) - runs + 1)]]]


def features(docs: DataFrame, keep: list[str], text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The columns `keep`, n_words, n_features (long) and the buckets of a text's features, as little-endian integers of 2 bytes (4 beyond 65,536 buckets)."""
    runs, buckets, kind, pattern = s.runs, s.buckets, s.kind, scan(s.runs)

    def block(batch: pa.RecordBatch) -> dict:
        found = [hashes(text, pattern, runs) for text in text_bytes(batch.column("text_"))]
        each = [(np.fromiter(chain(*x), dtype=np.uint32) % buckets).astype(kind) for x in found]
        made = {"n_words": pa.array([len(x[0]) for x in found], pa.int64()), "n_features": pa.array([len(x) for x in each], pa.int64())}
        return {name: batch.column(name) for name in keep} | made | {"buckets": pa.array([x.tobytes() for x in each], pa.binary())}

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    given = docs.select(*keep, F.col(text_col).alias("text_"))
    return mapped_by_size(given, ", ".join([*kinds, "n_words long, n_features long, buckets binary"]), block, "text_")


def bucket_counts(found: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """How many features fall into each bucket. Every task sends one count a bucket, and so many reach the driver."""
    buckets, kind = s.buckets, s.kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in by_size(batch, "buckets", 4 << 20):
                total += np.bincount(np.frombuffer(b"".join(part.column("buckets").to_pylist()), dtype=kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(buckets, dtype=np.int64)
    for row in found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its smoothed share of the target over that of all documents, rounded down."""
    size, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    ratio = [((int(t) + 1) * (all_raw + size)) / ((int(r) + 1) * (all_target + size)) for r, t in zip(raw, target, strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(id_col: str, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of seed, colon and id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(found: DataFrame, gain: np.ndarray, keep: list[str], s: Settings = Settings()) -> DataFrame:
    """The columns `keep`, n_words, n_features and weight (long): the mean gain of a text's features, rounded down; 0 without any."""
    shared, kind = found.sparkSession.sparkContext.broadcast(gain), s.kind  # one number a bucket

    def block(batch: pa.RecordBatch) -> dict:
        total = [int(shared.value[np.frombuffer(x, dtype=kind)].sum()) for x in batch.column("buckets").to_pylist()]
        weight = [t // n if n else 0 for t, n in zip(total, batch.column("n_features").to_pylist(), strict=True)]
        return {name: batch.column(name) for name in (*keep, "n_words", "n_features")} | {"weight": pa.array(weight, pa.int64())}

    kinds = [f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep]
    return mapped_by_size(found, ", ".join([*kinds, "n_words long, n_features long, weight long"]), block, "buckets")


def ranked(rows: DataFrame, order: list[Column], copies: str) -> DataFrame:
    """rows with the column `before`: how many there are before each in the given order, each counted `copies` times.

    Rows are dealt by range and counted by partition; the partitions' totals, one
    number each, are added up on the driver. No task sees all rows.
    """
    dealt = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()))
    totals = {r["part_"]: r["n"] for r in dealt.groupBy("part_").agg(F.sum(copies).alias("n")).collect()}
    parts = sorted(totals)
    before = dict(zip(parts, np.cumsum([0, *[totals[p] for p in parts]]).tolist(), strict=False))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                n = batch.column(copies).to_numpy()
                ends = np.cumsum(n) + seen
                first = ends - n + np.array([before[p] for p in batch.column("part_").to_pylist()])
                yield batch.append_column("before", pa.array(first, pa.int64()))
                seen = int(ends[-1])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(add, f"{kinds}, before long").drop("part_")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank, all long) of every document; rank is null where it isn't drawn.

    Of the documents with at least `least_words` words, `share` hundredths
    (rounded down) with the highest scores are drawn, ties to the smaller id.
    Null, empty and wordless texts have no features and weight 0. Without any
    text in the target all gains follow from smoothing alone. Repeated rows are
    documents of their own, with consecutive ranks; a null id comes before all
    others. An empty table gives no rows. Other columns are not read.
    """
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "buckets")
    features(docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), ["id_"], "text_", s).write.parquet(folder)
    found = spark.read.parquet(folder)  # texts are scanned once; their buckets are read twice
    gain = gains(bucket_counts(found, s), bucket_counts(features(target, [], target_col, s), s))
    told = saved(weighted(found, gain, ["id_"], s).withColumn("score", F.col("weight") + noise("id_", s.seed)))
    removed(spark, folder)
    able = F.col("n_words") >= s.least_words
    drawn = told.where(able).count() * s.share // 100
    same = ["id_", "n_words", "n_features", "weight", "score"]
    # Rows that repeat one another are ranked once and numbered after it, so that they don't meet in one task.
    once = told.where(able).groupBy(*same).agg(F.count("*").alias("copies"))
    order = [F.desc("score"), F.asc("id_"), F.asc("n_features"), F.asc("n_words"), F.asc("weight")]
    placed = ranked(once, order, "copies")
    many = placed.select(*same, F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))).alias("rank"))
    many = many.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = told.where(~able).select(*same, F.lit(None).cast("long").alias("rank"))
    return many.unionByName(rest).withColumnRenamed("id_", id_col)


def sql(docs: str = "documents", target: str = "benchmark") -> str:
    """(doc_id, n_features, weight, score, rank) in DuckDB SQL, with the default settings. DuckDB has no CRC-32: it is taken byte by byte, once a distinct feature."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH RECURSIVE bits AS (
      SELECT i, i::UBIGINT AS v, 0 AS step FROM range(256) r(i)
      UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8
    ),
    crc AS (SELECT list(v ORDER BY i) AS entries FROM bits WHERE step = 8),
    words AS (
      SELECT row_number() OVER () AS row_, doc_id, FALSE AS wanted,
        coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {docs}
      UNION ALL SELECT NULL, NULL, TRUE, coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM {target}
    ),
    features AS (
      SELECT row_, wanted, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
    ),
    hashed AS (
      SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 1 + octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k - 1, 2))::UBIGINT)),
        lambda c, b: xor(c >> 8, entries[(1 + (xor(c, b) & 255))::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
      FROM (SELECT DISTINCT f FROM features), crc
    ),
    placed AS (SELECT row_, wanted, bucket FROM features JOIN hashed USING (f)),
    counts AS (SELECT bucket, count(*) FILTER (WHERE NOT wanted) AS s, count(*) FILTER (WHERE wanted) AS t FROM placed GROUP BY 1),
    totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
    gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM counts, totals),
    weighed AS (SELECT row_, count(*) AS n_features, sum(gain)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE NOT wanted GROUP BY 1),
    scored AS (
      SELECT d.row_, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
        CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM words d LEFT JOIN weighed USING (row_) WHERE NOT wanted
    ),
    noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
    able AS (SELECT row_, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () * 25 // 100 AS drawn FROM noisy WHERE n_words >= 20)
    SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank
    FROM noisy LEFT JOIN able USING (row_)
    """
