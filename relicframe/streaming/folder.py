"""A drop folder as a stream: blocks and log windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.blocks import scan_blocks


def block_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Blocks of files as they arrive below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return scan_blocks(files.select(F.col("path").alias("file"), "content"))


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


def into_tables(rows: DataFrame, target: str, checkpoint: str, wants: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each batch to Parquet once; ``wants`` prunes rows and columns before they are computed."""

    def put(batch: DataFrame, number: int) -> None:
        kept = wants(batch) if wants else batch
        kept.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(target)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
