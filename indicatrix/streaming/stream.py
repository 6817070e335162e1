"""The same operators on polled feeds: file streams and event-time duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from indicatrix.operators.extract import extract_indicators


def read_documents(
    spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.parquet", max_files: int = 1000
) -> DataFrame:
    """A file stream over landed parquet documents."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def stream_extract(docs: DataFrame, types: list[str] | None = None, do_refang: bool = True) -> DataFrame:
    """Extraction holds no state, so the batch operator is the streaming one."""
    return extract_indicators(docs, types, do_refang)


def stream_dedup(indicators: DataFrame, event_time: str = "ts", within: str = "1 day") -> DataFrame:
    """``since, type, value`` and the event time: the first report of each ``(type, value)`` in each span of time.

    Answers at once, in update mode: what a micro-batch reports is combined before the shuffle, so a
    hot value sends one row for each task, and a value goes out in the batch that first has it. State
    holds one entry for each value and span until the watermark, which is one span, passes. The event time
    is the earliest in that batch; null times are not reported. Batches are told apart by their time, so
    the driver's clock must not go back.
    """
    timed = indicators.withColumn(event_time, F.col(event_time).cast("timestamp")).withColumn("_batch", F.current_timestamp())
    spans = timed.withWatermark(event_time, within).groupBy(F.window(event_time, within).alias("_span"), "type", "value")
    first = spans.agg(F.min("_batch").alias("_seen"), F.min(event_time).alias(event_time))
    return first.where(F.col("_seen") == F.current_timestamp()).select(F.col("_span.start").alias("since"), "type", "value", event_time)


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed so far in update mode and stop; each micro-batch is a folder ``batch=<id>`` below ``path``.

    A batch that is run again after a failure replaces its folder, so each row is there once.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("update")
        .start()
    )


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed so far into parquet files, exactly once, and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
