"""The stage chain of documents as a stream: each (document, stage) holds its own state, and failures come back.

Reports may come late, more than once and in any order: the newest one decides the status, a repeated failure counts
once, and the result does not depend on how reports fall into micro-batches.  So the rows at the stream's end are those
that :func:`tessera.operators.lifecycle.stage_status` gives for all reports at once.

State lives in the state store of the checkpoint, a few fields for each key; the identifiers of its failures are kept so
that repeats are known.  A failed stage with attempts left says when it is due again (``retry_at``), which is what the queue's claim
asks for; the time comes from the report and not from the clock, so a replay gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import latest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stage_updates(reports: DataFrame, *, retry_after_s: int = 60, attempts: int = 3) -> DataFrame:
    """A row for each (document, stage) that a micro-batch changes; input: doc_id, stage, status, at, event_id.

    State is a streaming aggregate's: the newest report, the first one's time and the identifiers of the failures.
    """
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = reports.select("doc_id", "stage", "status", F.col("at").cast("timestamp").alias("at"), "event_id")
    failed = F.size(F.collect_set(F.when(F.col("status") == "failed", F.col("event_id")))).cast("long")
    held = rows.groupBy("doc_id", "stage").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("updated_at"), F.min("at").alias("started_at"), failed.alias("failures"))
    due = F.timestamp_micros(F.unix_micros("updated_at") + retry_after_s * 1_000_000)
    return held.withColumn("retry_at", F.when((F.col("status") == "failed") & (F.col("failures") <= attempts), due))


def run_stages(reports: DataFrame, out: str, checkpoint: str, **options: int) -> StreamingQuery:
    """Write the updates of each micro-batch to a folder named by its number, which a repeated batch replaces.

    ``version`` is that number, so the newest row of a key is known however they are stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stage_updates(reports, **options).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest status of each (document, stage), as :func:`tessera.operators.lifecycle.stage_status` has it, and when a failed one is due again."""
    rows = latest(spark.read.parquet(out), ["doc_id", "stage"], F.col("version").desc())
    spent = (F.unix_micros("updated_at") - F.unix_micros("started_at")) / 1000
    return rows.select("doc_id", "stage", "status", "updated_at", "started_at", "failures", F.when(F.col("status") == "completed", spent).cast("long").alias("duration_ms"), (F.col("failures") + 1).alias("attempt_number"), "retry_at")
