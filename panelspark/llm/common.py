"""What the text operators share: checkpoints, Arrow columns and row blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.files import shared_folder


#: A key with more rows, and more than one of HOT_KEYS parts of all rows, is dealt apart from the rest.
HOT_ROWS = 2_000
HOT_KEYS = 100_000


def saved(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that the session names and read it from there.

    The folder is shared by driver and executors, so a lost executor loses
    nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a written table, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a written table that nothing reads any more, on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_finite(vector: str) -> Column:
    """True where an array column is not null and holds neither nulls nor NaN nor infinities."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad, F.lit(False))


def hot_keys(counted: DataFrame, key: str, count: str = "count") -> DataFrame:
    """The keys of a table (key, count) that one task should not hold alone: over HOT_ROWS rows, and over 1 / HOT_KEYS of all.

    So there are fewer than HOT_KEYS of them, whatever the size of the table, and a key that is none has few rows or a very small share.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    return counted.where((F.col(count) > max(HOT_ROWS, total // HOT_KEYS)) & F.col(key).isNotNull()).select(key)


def joined_by(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right (one row a key). Keys that very many left rows have (`hot_keys`, unless they are given) meet a broadcast part of right,

    so that no task holds all rows of such a key.
    """
    hot = saved(hot_keys(saved(left.groupBy(key).count()), key) if hot is None else hot)
    if hot.isEmpty():
        return left.join(right, key, how)
    held = F.broadcast(hot)
    few = F.broadcast(right.join(held, key, "left_semi"))
    return left.join(held, key, "left_anti").join(right, key, how).unionByName(left.join(held, key, "left_semi").join(few, key, how))


def hash_sample(rows: DataFrame, by: list[Column], n: int, group: str) -> DataFrame:
    """Distinct rows by the hash of `by`: of each value of `group` the n with the smallest hashes.

    Only rows below about twice the n-th smallest hash of their group are
    ordered. Where copies of few rows leave too few below it, all distinct ones
    of that group are.
    """
    marked = rows.withColumn("order_", F.shiftrightunsigned(F.xxhash64(*by), 1))
    sizes = saved(marked.groupBy(group).count())

    def least(some: DataFrame) -> DataFrame:
        once = some.dropDuplicates([group, "order_"])
        return once.withColumn("place_", F.row_number().over(Window.partitionBy(group).orderBy("order_"))).where(F.col("place_") <= n).drop("place_")

    bound = F.least(F.lit(2.0) * n / F.col("count"), F.lit(1.0)) * float(1 << 63)
    below = least(marked.join(F.broadcast(sizes), group).where(F.col("order_") <= bound).drop("count"))
    found = saved(below)
    short = found.groupBy(group).agg(F.count("*").alias("found_")).join(sizes, group, "right").where(F.coalesce("found_", F.lit(0)) < F.least(F.col("count"), F.lit(n)))
    short = saved(short.where(F.col("count") > 2 * n).select(group))
    if not short.isEmpty():
        again = saved(least(marked.join(F.broadcast(short), group, "left_semi")))
        found = found.join(F.broadcast(short), group, "left_anti").unionByName(again)
    return found.drop("order_")


def mapped(df: DataFrame, schema: str, block: Callable[[pa.RecordBatch], dict], rows: int = 2048) -> DataFrame:
    """Apply a function of a record batch (at most `rows` rows) that returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(block(batch.slice(start, rows)))

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def by_size(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts of a column have at most `limit` bytes together; a longer text is a slice of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy() if batch.num_rows else []
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def mapped_by_size(df: DataFrame, schema: str, block: Callable[[pa.RecordBatch], dict], column: str, limit: int = 4 << 20) -> DataFrame:
    """As `mapped`, in slices of at most `limit` bytes of a text column, so that memory is bounded by it or by the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, column, limit):
                yield pa.RecordBatch.from_pydict(block(part))

    return df.mapInArrow(run, schema)
