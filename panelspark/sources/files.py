"""Files in and out: dated folders, run archives, factor sidecars, bounded CSV."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.quality import keep_last


def _file_date() -> Column:
    """The date (YYYYMMDD) in a file's name, or else in that of its folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|/)[^/]*?(\d{8})[^/]*(?:/[^/]*)?$", 1)


def read_dated_folder(spark: SparkSession, folder: str, keys: tuple[str, ...], columns: tuple[str, ...], since: str | None = None) -> DataFrame:
    """Rows of `<YYYYMMDD>.parquet` files or folders whose columns may grow over time: the row of the newest file wins for each key.

    folder: the folder, or a pattern of its parts. Columns that no file has are
    NULL strings. since: files with a date (YYYYMMDD) before it are not opened.
    """
    rows, day = spark.read.option("mergeSchema", True).parquet(folder), _file_date()
    if since is not None:
        rows = rows.where(day >= since)
    rows = rows.withColumn("file_date_", day)
    have = set(rows.columns)
    chosen = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    return keep_last(rows.select(*chosen, "file_date_"), keys, ("file_date_",)).drop("file_date_")


def interface_profile(spark: SparkSession, folder: str) -> DataFrame:
    """(files, rows, first, last) of a dated folder, by the dates of its files."""
    rows = spark.read.option("mergeSchema", True).parquet(folder).select(_file_date().alias("day"))
    by_file = rows.groupBy("day").agg(F.count("*").alias("n"))
    return by_file.agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))


def interface_drift(before: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """(interface, change, files, rows, first, last): profiles (of interface_profile) that differ, `gone` as they were and `new` as they are."""
    named = lambda found: reduce(DataFrame.unionByName, [p.withColumn("interface", F.lit(name)) for name, p in found.items()])  # noqa: E731  a row each
    old, new = named(before), named(now)
    changed = old.exceptAll(new).withColumn("change", F.lit("gone")).unionByName(new.exceptAll(old).withColumn("change", F.lit("new")))
    return changed.select("interface", "change", "files", "rows", "first", "last")


def write_run_archive(runs: DataFrame, folder: str, per_file: int = 500) -> None:
    """Runs as nested JSON, so many to a file about, each file a compressed array over several lines.

    Runs are dealt as they are and become text, which is several times as long, by file.
    """
    parts = max(1, -(-runs.count() // per_file))
    dealt = runs.select(F.pmod(F.xxhash64("run_id"), F.lit(parts)).alias("part"), F.struct(*runs.columns).alias("run"))
    texts = F.transform(F.collect_list("run"), lambda run: F.to_json(run, {"pretty": "true"}))
    whole = F.concat(F.lit("["), F.array_join(F.sort_array(texts), ",\n"), F.lit("]"))
    dealt.groupBy("part").agg(whole.alias("value")).write.partitionBy("part").option("compression", "gzip").text(folder)


def read_run_archive(spark: SparkSession, pattern: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs, and their equity curves as rows (run_id, date, equity), of JSON files with a nested curve. schema: else it is inferred."""
    reader = spark.read.option("multiLine", True)
    runs = (reader.schema(schema) if schema else reader).json(pattern)
    curve = runs.select("run_id", F.explode("equity_curve").alias("p")).select("run_id", "p.*")
    return runs.drop("equity_curve"), curve


def archived_trades(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """The trades of archived runs as rows (run_id, and a trade's own fields); runs without any give none."""
    reader = spark.read.option("multiLine", True)
    runs = (reader.schema(schema) if schema else reader).json(pattern)
    if "trades" not in runs.columns:
        return runs.select("run_id").limit(0)
    return runs.select("run_id", F.explode("trades").alias("t")).select("run_id", "t.*")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which driver and executors share.

    Where it names none, a local session (tests) gets a folder of its own; on a
    cluster that is an error, as each executor would write to its own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir().rstrip("/")


def shared(spark: SparkSession, name: str) -> str:
    """A folder of its own for a written table, in the checkpoint folder that the session names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_by_year(rows: DataFrame, folder: str, date: str = "date") -> None:
    """A snapshot in folders year=*; each year is written by few tasks."""
    keyed = rows.withColumn("year", F.year(date))
    keyed.repartition("year", F.pmod(F.xxhash64(date), F.lit(8))).write.partitionBy("year").parquet(folder)


def read_years(spark: SparkSession, folder: str, years: tuple[int, ...]) -> DataFrame:
    """Rows of the given years of a snapshot in folders year=*; other folders are not read."""
    return spark.read.parquet(folder).where(F.col("year").isin(*years)).drop("year")


def write_sidecar(factors: DataFrame, path: str, mode: str = "error") -> None:
    """A factor table as zstd Parquet."""
    factors.write.option("compression", "zstd").mode(mode).parquet(path)


def append_factors(sidecar: DataFrame, factors: DataFrame, keys: tuple[str, ...] = ("instrument", "date")) -> DataFrame:
    """The sidecar with those columns of `factors` that it lacks; keys of the sidecar stay as they are."""
    missing = [c for c in factors.columns if c not in sidecar.columns]
    return sidecar.join(factors.select(*keys, *missing), list(keys), "left") if missing else sidecar


def export_csv(rows: DataFrame, path: str, order: tuple[str, ...], most: int) -> None:
    """The first rows in an order, with a header; an export is bounded by `most`."""
    rows.orderBy(*order).limit(most).coalesce(1).write.option("header", True).csv(path)


def write_buckets(rows: DataFrame, name: str, folder: str, buckets: int = 8, key: str = "instrument", order: str = "date", dealt: bool = False) -> DataFrame:
    """rows laid out by a key: a table in buckets of it, each file sorted by key and order.

    Windows over the key and joins of tables with as many buckets then need no
    shuffle, and a bucket of a single file no sort. Rows are dealt by key before
    they are written, so that a bucket is one file; dealt: they lie so already.
    name: of the table in the session's catalogue; its files lie in the given
    (shared) folder.
    """
    own = rows if dealt else rows.repartition(buckets, key)
    own.write.bucketBy(buckets, key).sortBy(key, order).option("path", folder).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def attach_on_buckets(left: DataFrame, right: DataFrame, keys: tuple[str, ...], name: str, folder: str, buckets: int = 8) -> DataFrame:
    """left with the columns of right, both laid out by `write_buckets`, as a table that is laid out alike: nothing is shuffled.

    The first of the keys is that of the buckets. Spark joins on part of the keys
    only where it is allowed to; that is allowed for this one write.
    """
    spark, allowed = left.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(allowed)
    spark.conf.set(allowed, "false")
    try:
        return write_buckets(left.join(right.hint("merge"), list(keys), "left"), name, folder, buckets, *keys[:2], dealt=True)
    finally:
        spark.conf.set(allowed, before)
