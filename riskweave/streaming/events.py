"""Streams: event-time windows with late data, deduplication, and growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_checkpoint_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Stream over the Parquet files of a path, with ts as an instant."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, keys: list[str], size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(keys, window_start, n, total) per event-time window; events later than `late` behind the newest are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def unique_events(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of every key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now, appends each batch's rows with its number to a table in the shared folder, and reads it.

    A restart goes on where the last run stopped; a batch that is run again replaces its own files.
    """
    spark = stream.sparkSession
    import uuid

    base = f"{shared_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{base}/data").parquet(f"{base}/data")


def newest_version(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update-mode table the last batch's row of each key."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
