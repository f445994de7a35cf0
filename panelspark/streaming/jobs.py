"""Structured Streaming jobs: landing of daily rows, duplicate suppression, bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelspark.operators.quality import keep_last, merge_rows
from panelspark.sources.files import shared


def event_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder or file pattern; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(path)
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]  # watermarks need an instant
    return rows.withColumns({name: F.col(name).cast("timestamp") for name in zoneless}) if zoneless else rows


def weekly_bars(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Monday-aligned weekly bars of (user_id, ts, value): final once the watermark passes, later rows are dropped."""
    tick = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", "7 days", "7 days", "4 days"))
        .agg(
            F.min_by("value", tick).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", tick).alias("close"),
            F.count("*").alias("ticks"),
        )
        .select(F.col("user_id").alias("instrument"), F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "ticks")
    )


def first_of_key(rows: DataFrame, keys: tuple[str, ...], time: str, late: str = "2 days") -> DataFrame:
    """Rows without repeats of a key that arrive within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def session_bars(ticks: DataFrame, late: str = "1 day", close_hour: int = 16) -> DataFrame:
    """Daily bars of (user_id, ts, value) with checks, final once the watermark passes.

    A tick after the close of its session (close_hour o'clock) belongs to no bar;
    it is counted in `after_close`. violations: ticks whose value is no positive
    number; they make no price. A row that comes when its day is final is dropped.
    """
    tick, inside = F.struct("ts", "event_id"), F.hour("ts") < close_hour
    good = F.coalesce((F.col("value") > 0) & ~F.isnan("value"), F.lit(False))
    priced = F.when(inside & good, F.col("value"))
    bars = ticks.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day")).agg(
        F.min_by(priced, F.when(priced.isNotNull(), tick)).alias("open"), F.max(priced).alias("high"), F.min(priced).alias("low"), F.max_by(priced, F.when(priced.isNotNull(), tick)).alias("close"),
        F.count(priced).alias("ticks"), F.count_if(~good).alias("violations"), F.count_if(good & ~inside).alias("after_close"),
    )
    return bars.select(F.col("user_id").alias("instrument"), F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "ticks", "violations", "after_close")


def land(rows: DataFrame, target: str, keys: tuple[str, ...], order: tuple[str, ...], day: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch of new rows into a Parquet table in folders `day`=*; runs until the source is used up.

    Of a key's rows in a batch the last by the `order` columns wins, and over
    rows of earlier batches. `day` is one of the keys. A batch reads and writes
    the folders of its own days alone, so it costs what it and they hold, not
    what the table holds. A batch that is done again after a failure gives the
    same table: its rows replace themselves, and a folder is replaced whole.
    """
    if day not in keys:
        raise ValueError("the day must be one of the keys, or rows of a key could lie in two folders")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = keep_last(batch, keys, order)
        if batch.isEmpty():
            return
        old = _landed(spark, target, new.schema)
        if old is not None:
            touched = F.broadcast(batch.select(day).distinct())  # the days of one batch
            new = merge_rows(old.join(touched, day, "left_semi"), new, keys)
        writer = new.repartition(day, F.pmod(F.xxhash64(*keys), F.lit(4))).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _landed(spark: SparkSession, target: str, schema: StructType) -> DataFrame | None:
    """The landed table, if there is one; the folders' names have the type that the rows have."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    found = spark.read.option("mergeSchema", True).parquet(target)
    return found.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in found.columns})


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet files of a fresh folder under the shared checkpoint folder."""
    spark = stream.sparkSession
    folder = shared(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
