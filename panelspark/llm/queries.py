"""The queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, fim, importance, langid, line_dedup, mixing, nn_descent, packing, quality, simhash, substrings, token_counts, topk
from panelspark.llm.common import fresh_folder
from panelspark.registry import Registry

REGISTRY = Registry()


@REGISTRY.query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("node").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@REGISTRY.query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@REGISTRY.query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@REGISTRY.query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices are written to the shared folder; digests are of what is read back."""
    vocabulary, folder = public_tokenizers.path("byte_bpe_50k.tiktoken"), fresh_folder(spark, "packed")
    packed = packing.pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, public_tokenizers.PATTERN)
    packing.write_matrices(packed, folder, pad=packing.free_id(vocabulary))
    return packing.digests(spark.read.parquet(folder))


@REGISTRY.query("op8_mixing", f"SELECT doc_id, source, mix_epoch_ AS epoch FROM ({mixing.sql()})")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", F.col("mix_epoch_").alias("epoch"))


@REGISTRY.query("op9_line_dedup", f"SELECT doc_id, text, n_chars FROM ({line_dedup.sql()})")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_chars")


def _learned(docs: DataFrame, parts: int, part: int) -> DataFrame:
    return docs.where(~langid.held_out("doc_id", parts, part))


@REGISTRY.query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(_learned(docs, 4, 2))
    told = langid.predict(docs, net, ["doc_id"])
    return told.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@REGISTRY.query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = quality.fit(_learned(docs, 3, 1), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = quality.predict(docs, space, ["doc_id"])
    return told.select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@REGISTRY.query("op3_topk", OP3_SQL)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@REGISTRY.query("op10_nn_descent")
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


@REGISTRY.query("op11_substrings", substrings.sql())
def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = substrings.drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return told.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@REGISTRY.query("op12_fim", fim.sql())
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restore()).alias("restored_sha256"))


@REGISTRY.query("op13_importance", importance.sql())
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
