"""Statistics, validation reports and pipeline metrics, each as one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profile as P
from ..functions import text as T

MB = 1024 * 1024
DATE_RANGES = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": None}
# fixed values: histogram bounds
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60, 120)
SIZE_BUCKETS = (1024, 10240, 102400, 1048576, 10485760, 31457280)
CHUNK_TOKEN_BUCKETS = (50, 100, 200, 500, 800, 1000, 1200, 1500)
MIN_QUALITY, MIN_TEXT = 0.5, 50
CHUNK_CHARS, CHUNK_OVERLAP, OVERLAP_TOLERANCE = (100, 1500), 200, 50


def in_range(docs: DataFrame, now: Column, days: int | None) -> DataFrame:
    live = docs.where(~F.col("is_deleted"))
    return live if days is None else live.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))


def by_status(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count("*").alias("documents"), F.sum("file_size").alias("bytes"), F.round(F.avg("file_size") / MB, 2).alias("avg_mb"))


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("documents")).orderBy(F.col("documents").desc(), key).limit(n)


def top_tags(docs: DataFrame, n: int = 10) -> DataFrame:
    return top_counts(docs.select(F.explode("tags").alias("tag")), "tag", n)


def upload_trend(docs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Uploads of each of the last days; the range filter of other statistics does not apply."""
    return in_range(docs, now, days).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("uploads"))


def statistics(docs: DataFrame, now: Column, date_range: str = "all") -> dict[str, DataFrame]:
    """The bundle of document statistics for a named range."""
    days = DATE_RANGES[date_range]
    live = in_range(docs, now, days)
    out = {
        "totals": live.agg(F.count("*").alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.round(F.avg("file_size") / MB, 2).alias("avg_mb")),
        "by_status": by_status(live),
        "by_mime_type": top_counts(live, "mime_type"),
        "by_provider": live.groupBy("storage_provider").agg(F.count("*").alias("documents")),
        "tags": top_tags(docs.where(~F.col("is_deleted"))),
    }
    if days is None or days >= 30:
        out["trend"] = upload_trend(docs, now)
    return out


def workspace_storage(docs: DataFrame, quota: int) -> DataFrame:
    """Bytes, files, share of the quota, extensions, first and last upload by workspace."""
    per = docs.groupBy("workspace", "file_extension").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    agg = per.groupBy("workspace").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_extension", "b")))).alias("by_extension"), F.min("lo").alias("first_upload"), F.max("hi").alias("last_upload"))
    return agg.withColumns({"quota_percent": F.round(F.col("bytes") / quota * 100, 2), "mean_bytes": F.round(F.col("bytes") / F.col("files"), 2)})


def quota_excess(docs: DataFrame, quota: int) -> DataFrame:
    """Uploads that pass a workspace's quota, in upload order."""
    w = Window.partitionBy("workspace").orderBy("created_at", "doc_id")
    return docs.withColumn("used", F.sum("file_size").over(w)).where(F.col("used") > quota)


def admin_storage(docs: DataFrame, temp_files: DataFrame, orphan_files: DataFrame, capacity: int) -> DataFrame:
    """One row: totals, live bytes, temporary and orphaned files, and a health level."""
    live = ~F.col("is_deleted")
    base = docs.agg(F.count("*").alias("documents"), F.sum(live.cast("int")).alias("live"), F.sum(F.when(live, F.col("file_size")).otherwise(0)).alias("live_bytes"))
    df = base.crossJoin(temp_files.agg(F.count("*").alias("temp_files"))).crossJoin(orphan_files.agg(F.count("*").alias("orphans")))  # one row each
    used = F.col("live_bytes") / capacity * 100
    return df.withColumn("used_percent", F.round(used, 2)).withColumn("health", F.when(used >= 90, "critical").when((used >= 80) | (F.col("orphans") > 1000), "warning").otherwise("healthy"))


def gauge_matrix(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status", "storage_provider").agg(F.count("*").alias("documents"), F.sum("file_size").alias("bytes"))


def coverage(chunks: DataFrame, least: float = 80.0) -> DataFrame:
    """Share of chunks with a vector."""
    n, has = F.count("*"), F.count("embedding")
    pct = F.round(F.when(n > 0, 100.0 * has / n).otherwise(0.0), 2)
    return chunks.agg(n.alias("chunks"), has.alias("with_vector"), pct.alias("percent"), (pct >= least).alias("valid"))


def dimensions(vectors: DataFrame, expected: int, model: str = "default") -> DataFrame:
    return vectors.groupBy(F.lit(model).alias("model"), F.size("embedding").alias("dims")).agg(F.count("*").alias("vectors")).withColumn("mismatch", F.col("dims") != expected)


def embedding_status(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("with_vector"), F.round(100.0 * F.count("embedding") / F.count("*"), 2).alias("percent"))


def check_rollup(checks: DataFrame) -> DataFrame:
    """One row from (check, valid): all valid, and their share."""
    return checks.agg(F.bool_and("valid").alias("all_valid"), F.round(F.avg(F.col("valid").cast("int")), 4).alias("score"))


def extraction_report(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Status and issues of each document's text; input texts: doc_id, text_length, quality, ocr_pages, pages, language."""
    df = docs.select("doc_id").join(texts, "doc_id", "left")
    none = F.col("text_length").isNull()
    low = F.col("quality") < MIN_QUALITY
    issues = F.array_compact(F.array(
        F.when(none, "no text"), F.when(F.col("text_length") == 0, "empty text"), F.when(F.col("text_length").between(1, MIN_TEXT - 1), "short text"),
        F.when(low, "low quality"), F.when(~none & F.col("quality").isNull(), "no quality"),
        F.when(F.col("ocr_pages") > 0.5 * F.col("pages"), "much OCR"), F.when(~none & F.col("language").isNull(), "no language"),
    ))
    status = F.when(none | low, "failed").when(F.col("quality").isNull() | F.col("text_length").between(1, MIN_TEXT - 1), "warning").when(F.col("text_length") == 0, "failed").otherwise("passed")
    return df.select("doc_id", F.coalesce("text_length", F.lit(0)).alias("text_length"), "quality", issues.alias("issues"), status.alias("status"))


def chunking_report(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Sizes, gaps in the index, overlap of neighbours and count against what the text's length lets expect."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    overlap = F.col("end_position") - F.lead("start_position").over(w)
    df = chunks.select("doc_id", "chunk_index", F.length("chunk_text").alias("size"), overlap.alias("overlap"))
    agg = df.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.floor(F.avg("size")).cast("int").alias("avg_size"), F.sum(F.col("size").between(*CHUNK_CHARS).cast("int")).alias("in_range"),
        (F.count_distinct("chunk_index") - F.count(F.when((F.col("chunk_index") >= 0), 1))).alias("repeated"), F.max("chunk_index").alias("last_index"), F.min("chunk_index").alias("first_index"), F.count_distinct("chunk_index").alias("indexes"),
        F.round(100.0 * F.avg((F.abs(F.col("overlap") - CHUNK_OVERLAP) <= OVERLAP_TOLERANCE).cast("int")), 2).alias("overlap_percent"),
    )
    df = agg.join(texts.select("doc_id", "text_length"), "doc_id", "left")
    gaps = (F.col("first_index") != 0) | (F.col("last_index") != F.col("chunks") - 1) | (F.col("indexes") != F.col("chunks"))
    few = (F.col("text_length") > 0) & (F.col("chunks") < F.col("text_length") / 800 * 0.5)
    poor = F.col("overlap_percent") < 80
    issues = F.array_compact(F.array(F.when(F.col("in_range") < F.col("chunks"), "sizes out of range"), F.when(gaps, "missing indexes"), F.when(poor, "little overlap"), F.when(few, "few chunks")))
    status = F.when(few | poor, "warning").when(gaps, "failed").when(F.col("in_range") < F.col("chunks"), "warning").otherwise("passed")
    return df.select("doc_id", "chunks", "avg_size", "in_range", "overlap_percent", issues.alias("issues"), status.alias("status"))


def search_readiness(extraction: DataFrame, chunking: DataFrame) -> DataFrame:
    """Both reports passed and a mean of quality, length and count scores of at least one half."""
    e, c = extraction.alias("e"), chunking.select("doc_id", "chunks", F.col("status").alias("chunk_status")).alias("c")
    df = e.join(c, "doc_id", "left")
    parts = F.array_compact(F.array(F.when(F.col("quality") > 0, F.col("quality")), F.when(F.col("text_length") > 0, F.least(F.col("text_length") / 1000, F.lit(1.0))), F.when(F.col("chunks") > 0, F.least(F.col("chunks") / 10, F.lit(1.0)))))
    score = F.round(F.round(F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0), 9), 4)
    ready = (F.col("status") == "passed") & (F.coalesce("chunk_status", F.lit("failed")) == "passed") & (score >= 0.5)
    return df.select("doc_id", F.col("status").alias("extraction_status"), F.coalesce("chunk_status", F.lit("failed")).alias("chunking_status"), score.alias("score"), ready.alias("is_ready"))


def readiness_rollup(ready: DataFrame) -> DataFrame:
    return ready.agg(F.count("*").alias("total"), F.sum(F.col("is_ready").cast("int")).alias("passed"), F.sum((~F.col("is_ready")).cast("int")).alias("failed"), F.round(F.avg("score"), 4).alias("avg_score"))


def stage_latency(metrics: DataFrame) -> DataFrame:
    """Requests, errors and mean latency by stage; input: stage, seconds, ok."""
    return metrics.groupBy("stage").agg(F.count("*").alias("requests"), F.sum((~F.col("ok")).cast("int")).alias("errors"), F.round(F.avg("seconds"), 4).alias("avg_latency_seconds"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: str | None = None) -> DataFrame:
    """Cumulative counts at each bound (and +Inf, with a null bound): one count per bound, no explosion of rows."""
    keys = [by] if by else []
    counts = df.groupBy(*keys).agg(*(F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("b_inf"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.coalesce(f"b{k}", F.lit(0)).alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("b_inf").alias("n"))]
    return counts.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.le", "c.n")


def bottlenecks(latency: DataFrame, active: DataFrame) -> DataFrame:
    """Slow, failing and congested stages with the worst of each marked; input active: stage, active."""
    kinds = [
        latency.where(F.col("avg_latency_seconds") > 1).select(F.lit("slow").alias("issue"), "stage", F.col("avg_latency_seconds").alias("value"), F.lit("high").alias("priority")),
        latency.where(F.col("errors") > 5).select(F.lit("errors").alias("issue"), "stage", F.col("errors").cast("double").alias("value"), F.lit("high").alias("priority")),
        active.where(F.col("active") > 5).select(F.lit("congested").alias("issue"), "stage", F.col("active").cast("double").alias("value"), F.lit("medium").alias("priority")),
    ]
    df = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    worst = F.row_number().over(Window.partitionBy("issue").orderBy(F.col("value").desc(), "stage")) == 1
    return df.withColumn("recommended", worst)


def health(latency: DataFrame) -> DataFrame:
    return latency.agg(F.sum("errors").alias("errors"), F.when(F.sum("errors") > 10, "degraded").otherwise("healthy").alias("status"))


def size_category(size: Column) -> Column:
    return F.when(size < MB, "small").when(size < 10 * MB, "medium").otherwise("large")


def vision_cost(images: DataFrame, per_image: float, limit: float) -> DataFrame:
    """Running cost of each document's images, and where it passes the limit; input: doc_id, image_no."""
    w = Window.partitionBy("doc_id").orderBy("image_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.count("*").over(w) * per_image
    return images.withColumn("cost", F.round(cost, 6)).withColumn("within", cost <= limit)


def search_health(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of four counts."""
    d = docs.agg(F.count("*").alias("documents"), F.sum(((F.col("status") == "completed") & ~F.col("is_deleted")).cast("int")).alias("searchable"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("with_vector")))  # one row each


def keywords(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent words of four letters or more that occur twice, in order of first appearance."""
    words = df.where(F.length("text") >= 100).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word")).where(F.col("word").rlike("^[a-z]{4,}$") & ~F.col("word").isin(*P.STOP_WORDS))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first"))
    return counts.withColumn("rank", rank).where((F.col("rank") <= n) & (F.col("n") > 1)).select("doc_id", "word", "n", "rank")


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *, least: float, text_col: str = "text") -> DataFrame:
    """(left_id, right_id, overlap) of texts whose Jaccard similarity over distinct words is ``least`` or more.

    An inverted join: common words are counted per pair and the sizes of both sets do the rest, so no two texts meet
    that share no word.  Two sets are at most as similar as the smaller one's size is to the larger one's, so pairs
    whose sizes lie too far apart are never counted.
    """

    def words(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.array_distinct(T.words(T.normalize(F.col(text_col)))).alias("w")).select(key, F.size("w").alias(f"n_{key}"), F.explode("w").alias("word"))

    a, b = F.col(f"n_{left_id}"), F.col(f"n_{right_id}")
    fit = (b >= (least - 1e-6) * a) & (a >= (least - 1e-6) * b)  # overlaps are rounded to 6 digits
    common = words(left, left_id).join(words(right, right_id), "word").where(fit).groupBy(left_id, right_id, f"n_{left_id}", f"n_{right_id}").agg(F.count("*").alias("common"))
    overlap = F.round(F.col("common") / (F.col(f"n_{left_id}") + F.col(f"n_{right_id}") - F.col("common")), 6)
    return common.select(left_id, right_id, overlap.alias("overlap")).where(F.col("overlap") >= least)
