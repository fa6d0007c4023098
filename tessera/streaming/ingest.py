"""Ingestion as a stream: files in, texts and chunks out, with a checkpoint and idempotent sinks.

A micro-batch does all stages; its batch number names its output folder, so a batch that
runs again after a failure replaces what it wrote instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, at timestamp", fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def chunk_stream(source: DataFrame, out: str, checkpoint: str, *, once: bool = True, stage: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Documents to chunks, one folder per micro-batch."""
    work = stage or (lambda df: chunking.with_flags(chunking.chunk_texts(df), chunking.document_spans(df)))

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def upload_trend(source: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads per day, closed once the watermark has passed."""
    return source.withWatermark("at", late).groupBy(F.window("at", "1 day")).agg(F.count("*").alias("uploads")).select(F.to_date("window.start").alias("day"), "uploads")


def recent_once(source: DataFrame, key: str = "doc_id", within: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the time to live."""
    return source.withWatermark("at", within).dropDuplicatesWithinWatermark([key])


def route_by_stage(batch: DataFrame, out: str) -> None:
    """Tasks to one folder per stage, as queues would take them."""
    batch.write.mode("append").partitionBy("stage").parquet(out)
