"""Tables derived from the star schema, each as Spark columns and as the same SQL.

The driver's tables have no status, dates or tags for documents; these views define them
once, so that a query and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

NOW_SQL = "TIMESTAMP '2024-02-15 00:00:00'"


def now() -> Column:
    return F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")



# column: (Spark SQL, DuckDB SQL); one string serves both where they agree
DOC_COLUMNS: dict[str, str | tuple[str, str]] = {
    "doc_id": "doc_id",
    "name": "concat('doc_', doc_id)",
    "original_name": "concat('Document ', doc_id, ' of ', source)",
    "mime_type": "CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/markdown' ELSE 'text/csv' END",
    "file_extension": "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'md' ELSE 'csv' END",
    "status": "CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 23 = 0 THEN 'processing' ELSE 'completed' END",
    "is_deleted": "doc_id % 17 = 0",
    "storage_provider": "CASE WHEN doc_id % 3 = 0 THEN 's3' ELSE 'local' END",
    "workspace": "source",
    "file_size": "n_chars",
    "metadata": "concat('{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}')",
    "tags": ("array(lang, source)", "[lang, source]"),
    "quality": "round(least(n_chars / 5000.0D, 1.0D), 4)",
    "checksum": ("sha2(text, 256)", "sha256(text)"),
    "storage_path": "concat(source, '/', doc_id)",
    "created_at": ("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)", "TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id)"),
    "updated_at": ("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 7 as int), cast(doc_id as int), 0, 0)", "TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) + to_days(CAST(doc_id % 7 AS INTEGER))"),
    "deleted_at": ("CASE WHEN doc_id % 17 = 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(1, cast(doc_id as int), 0, 0) END", "CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) + INTERVAL 1 DAY END"),
    "lang": "lang",
    "source": "source",
    "text": "text",
}


def _pick(columns: dict[str, str | tuple[str, str]], side: int) -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[side] for k, v in columns.items()}


DOCS_SQL = "docs AS (SELECT " + ", ".join(f"{e.replace('5000.0D', '5000.0::DOUBLE').replace('1.0D', '1.0::DOUBLE')} AS {k}" for k, e in _pick(DOC_COLUMNS, 1).items()) + " FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {k}" for k, e in _pick(DOC_COLUMNS, 0).items()))


# Extracted texts of all documents; the language is unknown for some.
TEXTS_SQL = "texts AS (SELECT doc_id, text, CAST(length(text) AS INTEGER) AS text_length, CAST(doc_id % 5 AS INTEGER) AS ocr_pages, CAST(greatest(1, length(text) // 2000) AS INTEGER) AS pages, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE lang END AS language FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "documents"))
    return df.selectExpr("doc_id", "text", "cast(length(text) as int) AS text_length", "cast(doc_id % 5 as int) AS ocr_pages", "cast(greatest(1, length(text) div 2000) as int) AS pages", "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE lang END AS language")


# Chunks of visible documents, CHUNK characters each; vectors cover a part of them.
CHUNK = 2000
CHUNKS_SQL = DOCS_SQL + ", pieces AS (SELECT doc_id, CAST(unnest(range(0, CAST(greatest(1, ceil(length(text) / 2000.0)) AS BIGINT))) AS INTEGER) AS chunk_index, text, name, mime_type, quality, created_at, tags FROM docs WHERE status = 'completed' AND NOT is_deleted), chunks AS (SELECT d.doc_id, d.chunk_index, substr(d.text, d.chunk_index * 2000 + 1, 2000) AS chunk_text, d.name, d.mime_type, d.quality, d.created_at, d.tags, e.embedding FROM pieces d LEFT JOIN embeddings e ON e.vec_id = d.doc_id + d.chunk_index)"


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    d = spread(docs(spark, sf_dir).where("status = 'completed' AND NOT is_deleted"))
    last = F.greatest(F.lit(0), F.ceil(F.length("text") / CHUNK) - 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substr("text", k * CHUNK + 1, F.lit(CHUNK)))
    d = d.select("doc_id", F.posexplode(parts).alias("chunk_index", "chunk_text"), "name", "mime_type", "quality", "created_at", "tags")
    if not vectors:
        return d
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return d.join(e, F.col("doc_id") + F.col("chunk_index") == F.col("vec_id"), "left").drop("vec_id")


# Questions: term lists that occur in the corpus, with vectors of the first rows.
QUESTIONS = ((1, "The of", 0), (2, "thin and", 1), (3, "de la", 2), (4, "und der", 3))
QUERIES_SQL = "queries AS (SELECT q.query_id, q.text, e.embedding AS vector FROM (VALUES " + ", ".join(f"({i}, '{t}', {v})" for i, t, v in QUESTIONS) + ") q(query_id, text, vec_id) JOIN embeddings e ON e.vec_id = q.vec_id)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame(list(QUESTIONS), "query_id int, text string, vec_id long")
    return q.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("query_id", "text", "vector")


VERSIONS_SQL = "versions AS (SELECT conv_id AS doc_id, turn AS version_number, concat('v', turn, '/doc_', conv_id) AS version_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS is_latest FROM conversations)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn AS version_number", "concat('v', turn, '/doc_', conv_id) AS version_path")


# Events as stage reports.
STAGE_CASE = "CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'extraction' WHEN 'click' THEN 'chunking' WHEN 'purchase' THEN 'embedding' ELSE 'extraction' END"
STATUS_CASE = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 9 = 0 THEN 'in_progress' ELSE 'completed' END"
EVENTS_SQL = f"reports AS (SELECT user_id AS doc_id, {STAGE_CASE} AS stage, {STATUS_CASE} AS status, ts AS \"at\", event_id, value AS seconds, event_type <> 'error' AS ok FROM events)"
STATUS_SQL = EVENTS_SQL + ", status AS (SELECT doc_id, stage, arg_max(status, row(\"at\", event_id)) AS status, max(\"at\") AS updated_at, min(\"at\") AS started_at, 25.0::DOUBLE AS percentage FROM reports GROUP BY doc_id, stage)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", f"{STAGE_CASE} AS stage", f"{STATUS_CASE} AS status", "ts AS at", "event_id", "value AS seconds", "event_type <> 'error' AS ok")


QUEUE_SQL = "queue AS (SELECT o_orderkey AS item_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS scheduled_at, o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' END AS next_retry_at FROM orders)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS item_id", "cast(substr(o_orderpriority, 1, 1) as int) AS priority", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status", "o_orderdate AS scheduled_at", "o_orderdate AS created_at", "CASE WHEN o_orderkey % 5 = 0 THEN timestamp_ntz'2030-01-01 00:00:00' END AS next_retry_at")


QUEUE_NOW_SQL = "TIMESTAMP '2000-01-01 00:00:00'"


def queue_now() -> Column:
    return F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
