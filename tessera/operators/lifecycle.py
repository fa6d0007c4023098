"""Document lifecycle: stages, queue, versions, orphans, duplicates, constraints.

``now`` is always an argument, never the clock, so results can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("upload", "extraction", "chunking", "embedding", "indexing", "validation", "publishing")
SEARCH_STAGES = ("extraction", "chunking", "embedding")
# fixed values: allowed changes of a stage's status
TRANSITIONS = (("not_started", "in_progress"), ("not_started", "skipped"), ("in_progress", "completed"), ("in_progress", "failed"), ("failed", "in_progress"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def stage_status(events: DataFrame) -> DataFrame:
    """Latest status of each (document, stage), with attempts and duration; input: doc_id, stage, status, at, event_id."""
    agg = events.groupBy("doc_id", "stage").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("updated_at"), F.min("at").alias("started_at"), F.sum((F.col("status") == "failed").cast("int")).alias("failures"))
    return agg.withColumn("duration_ms", F.when(F.col("status") == "completed", (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long")).withColumn("attempt_number", F.col("failures") + 1)


def progress(status: DataFrame, total_stages: int = len(STAGES)) -> DataFrame:
    """Completed stages over all, plus the running stage's share; input: doc_id, stage, status, percentage."""
    agg = status.groupBy("doc_id").agg(F.sum((F.col("status") == "completed").cast("int")).alias("completed_stages"), F.min(F.when(F.col("status") == "in_progress", F.struct("stage", "percentage"))).alias("now"))
    value = (F.col("completed_stages") + F.coalesce("now.percentage", F.lit(0.0)) / 100) / total_stages * 100
    return agg.select("doc_id", F.col("now.stage").alias("current_stage"), "completed_stages", F.lit(total_stages).alias("total_stages"), F.round(value, 1).alias("overall_progress"))


def readiness(status: DataFrame) -> DataFrame:
    """Status of the three search stages by document, whether it is ready, and what to do next."""
    of = {s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("status"))), F.lit("not_started")).alias(f"{s}_status") for s in SEARCH_STAGES}
    df = status.groupBy("doc_id").agg(*of.values())
    is_ = lambda s, v: F.col(f"{s}_status") == v
    ready = is_("extraction", "completed") & is_("chunking", "completed") & is_("embedding", "completed")
    failed = is_("extraction", "failed") | is_("chunking", "failed") | is_("embedding", "failed")
    action = F.when(ready, "ready_for_search")
    for s in SEARCH_STAGES:
        action = action.when(is_(s, "failed"), f"retry_{s}")
    action = action.when(is_("extraction", "completed") & is_("chunking", "completed"), "wait_for_embedding").when(is_("extraction", "completed"), "wait_for_chunking").otherwise("wait_for_extraction")
    return df.withColumns({"ready_for_search": ready, "can_retry": failed, "next_action": action})


def stage_map(status: DataFrame) -> DataFrame:
    return status.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "status")))).alias("stages"))


def transition_violations(events: DataFrame) -> DataFrame:
    """Changes of status that are not allowed; input: doc_id, stage, status, at, event_id.  The first row counts as from not_started."""
    w = Window.partitionBy("doc_id", "stage").orderBy("at", "event_id")
    moved = events.withColumn("previous", F.coalesce(F.lag("status").over(w), F.lit("not_started")))
    allowed = F.concat_ws(">", "previous", "status").isin(*(f"{a}>{b}" for a, b in TRANSITIONS))
    return moved.where(~allowed)


def clamp_progress(status: DataFrame) -> DataFrame:
    """Percentages within 0-100, and only for stages in progress."""
    return status.withColumn("percentage", F.when(F.col("status") == "in_progress", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("percentage")))))


def processing_summary(docs: DataFrame, status: DataFrame) -> DataFrame:
    """Stage counts by status for each document, also for those without any."""
    joined = docs.select("doc_id", "name").join(status.select("doc_id", "stage", "status", "updated_at"), "doc_id", "left")
    counts = [F.sum((F.col("status") == s).cast("int")).alias(f"{s}_stages") for s in ("completed", "failed", "in_progress")]
    return joined.groupBy("doc_id", "name").agg(F.count("stage").alias("total_stages"), *(F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts, ("completed_stages", "failed_stages", "in_progress_stages"), strict=True)), F.max("updated_at").alias("last_update"))


def queue_claim(queue: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next ``n`` due items: smallest priority first, then the longest scheduled."""
    due = queue.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    return due.orderBy("priority", "scheduled_at", "item_id").limit(n)


def claimed(queue: DataFrame, claim: DataFrame, worker: str, now: Column) -> DataFrame:
    """The queue after a claim."""
    mine = claim.select("item_id", F.lit(True).alias("mine"))
    df = queue.join(mine, "item_id", "left")
    held = F.coalesce("mine", F.lit(False))
    return df.withColumns({"status": F.when(held, "processing").otherwise(F.col("status")), "processor_id": F.when(held, worker), "locked_at": F.when(held, now), "attempts": F.coalesce("attempts", F.lit(0)) + held.cast("int")}).drop("mine")


def queue_summary(queue: DataFrame, now: Column) -> DataFrame:
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return queue.groupBy("status").agg(F.count("*").alias("count"), F.round(F.avg(age), 3).alias("avg_age_seconds"), F.min("created_at").alias("oldest_item"))


def active_versions(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Live documents with their latest version, if any."""
    return docs.where(~F.col("is_deleted")).join(versions.where("is_latest").select("doc_id", "version_number", "version_path"), "doc_id", "left")


def mark_latest(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("version_number").desc())
    return versions.withColumn("is_latest", F.row_number().over(w) == 1)


def orphans(files: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Files without a live document."""
    return files.join(docs.where(~F.col("is_deleted")).select(key), key, "left_anti")


def duplicate_uploads(uploads: DataFrame, live: DataFrame, order: str | None = None) -> DataFrame:
    """Uploads whose checksum a live document has; with ``order``, one that comes before the upload in that column.

    So a table can be checked against itself: of each group of equal files, all but the first live one are found.
    """
    if order is None:
        return uploads.join(live.select("checksum").distinct(), "checksum", "left_semi")
    first = live.groupBy("checksum").agg(F.min(order).alias("__first"))
    return uploads.join(first, "checksum").where(F.col("__first") < F.col(order)).drop("__first")


def soft_delete(docs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Mark documents deleted; those being processed are refused and stay."""
    df = docs.join(ids.select("doc_id", F.lit(True).alias("__ask")), "doc_id", "left")
    go = F.coalesce("__ask", F.lit(False)) & (F.col("status") != "processing") & ~F.col("is_deleted")
    return df.withColumns({"is_deleted": F.col("is_deleted") | go, "deleted_at": F.when(go, now).otherwise(F.col("deleted_at"))}).drop("__ask")


def purge(docs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Deleted documents whose time to keep is over."""
    return docs.where(F.col("is_deleted") & (F.col("deleted_at") < now - F.expr(f"interval {days} days")))


def expired_files(files: DataFrame, now: Column, days: int = 1) -> DataFrame:
    return files.where(F.col("modificationTime") < now - F.expr(f"interval {days} days"))


def access_counts(accesses: DataFrame) -> DataFrame:
    return accesses.groupBy("doc_id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed_at"))


def violations(docs: DataFrame, versions: DataFrame, chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """Rows per broken constraint, as (constraint, key, n)."""

    def unique(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("constraint"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"), "n")

    def holds(df: DataFrame, name: str, key: str, rule: Column) -> DataFrame:
        return df.where(~F.coalesce(rule, F.lit(False))).select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))

    parts = [
        unique(docs, "unique_checksum", "checksum"),
        unique(docs, "unique_path", "storage_provider", "storage_path"),
        unique(versions, "unique_version", "doc_id", "version_number"),
        unique(chunks, "unique_chunk", "doc_id", "chunk_index"),
        holds(docs, "deleted_at", "doc_id", F.col("is_deleted") == F.col("deleted_at").isNotNull()),
        holds(docs, "quality_range", "doc_id", F.col("quality").isNull() | F.col("quality").between(0, 1)),
        holds(queue, "queue_priority", "item_id", F.col("priority").between(1, 10)),
        holds(queue, "queue_status", "item_id", F.col("status").isin("pending", "processing", "completed", "failed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_queue(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Summary of a batch by ``batch_id``: requested documents, those that can be queued, and those that are not there."""
    known = docs.select("doc_id").distinct().withColumn("known", F.lit(True))
    joined = requests.select("batch_id", "doc_id").join(known, "doc_id", "left")
    return joined.groupBy("batch_id").agg(F.count("*").alias("total"), F.count("known").alias("queued"), F.count_if(F.col("known").isNull()).alias("errors"))


def breaker(events: DataFrame, *, failures: int = 5, recovery_seconds: float = 30.0, probes: int = 3) -> DataFrame:
    """Replay a circuit breaker over ordered calls; input: store, at (seconds), ok.  Adds state and whether the call was let through.

    The state after a call depends on all calls before it.  Calls are sorted by store and time, and each task folds its
    stores batch by batch with a few numbers of state, so a store of any length needs no more memory than a batch.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, state, bad, good, opened = None, "", 0, 0, 0.0
        for batch in batches:
            names, ats, oks = (c.to_pylist() for c in batch.columns)
            states, let = [], []
            for name, at, ok in zip(names, ats, oks, strict=True):
                if not state or name != store:
                    store, state, bad, good, opened = name, "CLOSED", 0, 0, 0.0
                if state == "OPEN" and at - opened >= recovery_seconds:
                    state, good = "HALF_OPEN", 0
                through = state != "OPEN"
                if through and ok:
                    bad, good = 0, good + 1
                    if state == "HALF_OPEN" and good >= probes:
                        state = "CLOSED"
                elif through:
                    bad += 1
                    if state == "HALF_OPEN" or bad >= failures:
                        state, opened = "OPEN", at
                states.append(state)
                let.append(through)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string()), pa.array(let, pa.bool_())], names=["store", "at", "ok", "state", "allowed"])

    calls = events.select(F.col("store").cast("string").alias("store"), F.col("at").cast("double").alias("at"), F.col("ok").cast("boolean").alias("ok"))
    ordered = calls.repartition("store").sortWithinPartitions("store", "at", F.col("ok").desc())
    return ordered.mapInArrow(replay, "store string, at double, ok boolean, state string, allowed boolean")
