import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages_keep_the_columns_and_clean_documents(spark, docs):
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, "").cache()
        assert after.columns == names, name
        if name == "language_id":
            assert after.count() == docs.where(F.col("text").rlike("\\p{L}")).count()
        if name == "near_dedup":
            assert after.groupBy("text").count().where("count > 1").count() == 0
            assert after.count() >= 0.8 * kept.select("text").distinct().count()
        kept = after
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert last.count() == kept.count()


def test_run_reads_whole_documents(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeats, and names that the stages use themselves."""
    rows = [
        (1, "A plain text of some words that stays as it is, with a line\nand another", "en", "a", 70, 1.5, "k"), (1, "A second text under the same id, of other words", "en", "a", 46, None, None),
        (2, None, None, None, None, 1.0, "x"), (3, "", "en", "b", 0, 2.0, "y"), (None, "Ein Text ohne Schl\u00fcssel, aber mit Sprache", "de", "b", 40, 3.0, "z"), (4, "12 34 !!", "en", None, 8, 4.0, "q"),
        (5, "lang und breit " * 20_000, "de", "c", 300_000, 5.0, "w"), (5, "lang und breit " * 20_000, "de", "c", 300_000, 5.0, "w"), (6, "no language is given here, but letters are", None, "a", 42, 6.0, "v"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, mix_epoch_ string").cache()


def test_stages_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    kinds = odd.dtypes
    texts = lambda df: sorted((r["doc_id"] or 0, (r["text"] or "")[:8], r["mix_epoch_"]) for r in df.collect())
    told = stages["language_id"](spark, odd, "")
    assert told.dtypes == kinds and {t for _, t, _ in texts(told)} <= {"A plain ", "A second", "Ein Text", "lang und", "no langu"} and told.count() >= 4
    lines = stages["line_dedup"](spark, odd, "")
    assert lines.dtypes == kinds and texts(lines) == texts(odd)
    near = stages["near_dedup"](spark, odd, "")
    assert near.dtypes == kinds
    # The null and the empty text are one group, whose smallest id is 2; of the repeated row one stays; both texts of id 1 stay.
    assert [(i, t) for i, t, _ in texts(near)] == [(0, "Ein Text"), (1, "A plain "), (1, "A second"), (2, ""), (4, "12 34 !!"), (5, "lang und"), (6, "no langu")]
    mixed = stages["mixing"](spark, odd, "")
    assert mixed.dtypes == kinds and {m for *_, m in texts(mixed)} <= {"k", None, "x", "y", "z", "q", "w", "v"}
    # Small sources stay whole; the long text fills its source beyond what is left of it, so it is not read.
    assert {"k", "v", "z", "x"} <= {m for *_, m in texts(mixed)} and all(i != 5 for i, *_ in texts(mixed))
    assert stages["encoding"](spark, odd, "").count() == odd.count()


def test_stages_on_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, odd.limit(0), "")
        assert after.count() == 0 and (name == "encoding" or after.dtypes == odd.dtypes), name


def test_a_row_that_resembles_nothing_stays_beside_a_copy_of_its_id(spark):
    a, b = (" ".join(f"{c}{i % 90}" for i in range(300)) for c in "ab")
    frame = spark.createDataFrame([(1, a), (7, a), (7, b)], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, "")
    assert sorted(map(tuple, kept.collect())) == [(1, a), (7, b)]
