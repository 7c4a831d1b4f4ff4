"""Streaming: an extension, as the batch workflow has none. Windowed counts and resumable intake of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder; a batch takes files_per_batch of them at most, which bounds its memory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, key, n of batch or streaming events; a stream drops rows later than its watermark and closes windows by it.

    Null times fall in no window. State is one counter for each open window and key.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def take_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come since the last call, then stops; the checkpoint makes a repeated call resume, not redo."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
