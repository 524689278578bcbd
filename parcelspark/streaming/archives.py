"""Archives as a stream: new files below a folder are imported as they arrive."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import archives


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A streaming table (path, archive_name, content) of the archives below ``path``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    r = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bz2").option("maxFilesPerTrigger", files_per_batch)
    return r.load(path).select("path", F.regexp_extract(F.col("path"), "([^/]*)$", 1).alias("archive_name"), "content")


def stream_features(spark: SparkSession, path: str, types: frozenset[str] | None = None) -> DataFrame:
    """A streaming table of features and errors; parsing is stateless, so it runs in any output mode."""
    return archives.parse_files(stream_files(spark, path), types)


def run_available(features: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what there is and stop. ``sink`` gets each batch with its number and must do nothing for a number it has seen:
    the checkpoint repeats the batch that was running when a query died, under the same number."""
    return features.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def once_per_batch(root: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its number, replacing what a died attempt left there."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(root, f"batch={number:09d}"))

    return write


def events_by_window(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind, for a streaming or plain table (ts, event_type, value); rows later than ``late`` are left out."""
    return (
        events.filter(F.col("ts").isNotNull())
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "event_type", "n", "total")
    )
