"""A corpus pipeline of five stages, each one operator of panelspark.llm over all that its predecessor kept.

Each stage's result is written as Parquet and read again as the next one's
documents. The columns are those of `documents`, whatever further ones the table
has, but for the last stage, which returns the encoded corpus.

Every stage takes null and empty texts, nulls in any other column, very long
texts, repeated ids and rows, columns with names that it uses itself, and empty
tables; its docstring says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import bpe, langid, line_dedup, mixing, simhash
from panelspark.llm.common import fresh_folder, removed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told. The network learns from the labelled rows of docs (those with lang).

    Null, empty and letterless texts go. Without any labelled text nothing can be learned and all documents stay.
    """
    return langid.rejected(docs, langid.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out, which stand on eight sources and in eight distinct texts or more; no row goes.

    A text of which such lines make up 0.8 or more is a near copy of others by
    the measure of the next stage; it is left whole to that stage, which could
    not tell from the few other lines what it is a copy of.
    """
    return line_dedup.drop_boilerplate(docs, whole_from=0.8)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: shingles of five words, similarity 0.8 or more.

    Null, empty and blank texts are one group. Rows are judged by their own text, also where ids repeat; of equal ids
    and texts one row stays.
    """
    return simhash.keep_one(docs, plan=simhash.Plan.near())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Even the sources out until the most repeated one is read 1.25 times; a document has a row for each reading.

    Null sources are one source; documents of a source without tokens stay as they are.
    """
    mixed = mixing.mix_sources(docs, max_repeats=1.25)
    # The last column counts the readings; docs may have one of that name itself, so columns go by place.
    places = [f"c{i}_" for i in range(len(mixed.columns))]
    return mixed.toDF(*places).select(*places[:-1]).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: the digests of the ids and of what they decode to. Null texts count as empty."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL expresses neither the network nor fingerprints nor token ids; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Results between stages lie in the shared folder that the session names.

    A stage's table is deleted once the next stage's is written; the last one stays, as the result is read from it.
    """
    home = fresh_folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{home}/{name}")
        if before is not None:
            removed(spark, f"{home}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
