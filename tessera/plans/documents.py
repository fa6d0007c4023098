"""Registered queries over documents, lifecycle and metrics, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import analytics as A
from ..operators import lifecycle as L
from ..operators.filters import DocumentList, NameSearch, SearchFilters
from ..session import table
from . import views as V

DOC = ("doc_id", "name", "mime_type", "status", "file_size", "created_at")
DOC_SQL = ", ".join(DOC)
LIVE = "NOT is_deleted"

QUERIES = {
    "doc_list_filtered": lambda s, d: DocumentList(status="completed", mime_type="text/plain", min_size=500, max_size=20000, created_after=datetime(2024, 1, 3), created_before=datetime(2024, 2, 5)).matching(V.docs(s, d)).select(*DOC),
    "doc_list_page": lambda s, d: DocumentList(page=2, page_size=25, sort_by="file_size").rows(V.docs(s, d)).select(*DOC),
    "doc_page_info": lambda s, d: DocumentList(page=2, page_size=25, status="completed").page_info(V.docs(s, d)),
    "doc_name_search": lambda s, d: NameSearch("DOC_12").rows(V.docs(s, d)).select(*DOC),
    "doc_metadata_search": lambda s, d: NameSearch('"lang":"de"', ("metadata",), "completed").rows(V.docs(s, d)).select(*DOC),
    "doc_tags_all": lambda s, d: DocumentList(tags=("en", "src1")).matching(V.docs(s, d)).select(*DOC),
    "doc_tags_overlap": lambda s, d: V.docs(s, d).where(SearchFilters(tags=("fr", "src2"), min_quality=0.1).predicate()).select(*DOC),
    "doc_stats_status": lambda s, d: A.by_status(V.docs(s, d).where(~F.col("is_deleted"))),
    "doc_stats_mime_top10": lambda s, d: A.top_counts(V.docs(s, d).where(~F.col("is_deleted")), "mime_type"),
    "doc_stats_provider": lambda s, d: V.docs(s, d).where(~F.col("is_deleted")).groupBy("storage_provider").agg(F.count("*").alias("documents")),
    "doc_upload_trend": lambda s, d: A.upload_trend(V.docs(s, d), V.now()).withColumn("day", F.col("day").cast("string")),
    "doc_tag_top10": lambda s, d: A.top_tags(V.docs(s, d).where(~F.col("is_deleted"))),
    "doc_storage_by_workspace": lambda s, d: A.workspace_storage(V.docs(s, d), 10_000_000).withColumn("by_extension", F.array_join(F.transform(F.map_entries("by_extension"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")),
    "quota_excess": lambda s, d: A.quota_excess(V.docs(s, d), 50_000).select("doc_id", "workspace", "used"),
    "admin_storage": lambda s, d: A.admin_storage(V.docs(s, d), V.docs(s, d).where("doc_id % 50 = 1"), L.orphans(table(s, d, "labels"), V.docs(s, d)), 100_000_000),
    "gauge_matrix": lambda s, d: A.gauge_matrix(V.docs(s, d)),
    "doc_active_versions": lambda s, d: L.active_versions(V.docs(s, d), L.mark_latest(V.versions(s, d))).select("doc_id", "name", "version_number", "version_path"),
    "doc_latest_version": lambda s, d: L.mark_latest(V.versions(s, d)),
    "doc_paths": lambda s, d: V.docs(s, d).select("doc_id", paths.document_path(F.col("workspace"), F.col("name"), F.concat(F.col("original_name"), F.lit("..tar.gz")), F.col("created_at")).alias("path")).withColumn("file", paths.components(F.col("path"))["file"]).withColumn("safe", paths.is_safe(F.col("path"))),
    "stage_status": lambda s, d: L.stage_status(V.reports(s, d)).select("doc_id", "stage", "status", "updated_at", "attempt_number"),
    "stage_progress": lambda s, d: L.progress(L.stage_status(V.reports(s, d)).withColumn("percentage", F.lit(25.0))),
    "ready_for_search": lambda s, d: L.readiness(L.stage_status(V.reports(s, d))),
    "status_transition_violations": lambda s, d: L.transition_violations(V.reports(s, d)).select("doc_id", "stage", "event_id", "previous", "status"),
    "processing_summary": lambda s, d: L.processing_summary(V.docs(s, d), L.stage_status(V.reports(s, d))),
    "queue_claim": lambda s, d: L.queue_claim(V.queue(s, d), V.queue_now(), 50).select("item_id", "priority", "scheduled_at"),
    "queue_summary": lambda s, d: L.queue_summary(V.queue(s, d), V.queue_now()),
    "orphan_files": lambda s, d: L.orphans(table(s, d, "labels").select("doc_id", "quality"), V.docs(s, d)),
    "duplicate_uploads": lambda s, d: L.duplicate_uploads(V.docs(s, d).select("doc_id", "checksum"), V.docs(s, d).where("NOT is_deleted").select("doc_id", "checksum"), order="doc_id").select("doc_id", "checksum"),
    "purge_due": lambda s, d: L.purge(V.docs(s, d), V.now()).select("doc_id", "deleted_at"),
    "soft_delete": lambda s, d: L.soft_delete(V.docs(s, d), V.docs(s, d).where("doc_id % 3 = 0").select("doc_id"), V.now()).select("doc_id", "status", "is_deleted", "deleted_at"),
    "access_counts": lambda s, d: L.access_counts(V.reports(s, d)),
    "constraint_violations": lambda s, d: L.violations(V.docs(s, d), V.versions(s, d), V.chunks(s, d, False), V.queue(s, d)),
    "stage_latency": lambda s, d: A.stage_latency(V.reports(s, d)),
    "latency_histogram": lambda s, d: A.histogram(V.reports(s, d), "seconds", A.LATENCY_BUCKETS, "stage"),
    "size_histogram": lambda s, d: A.histogram(V.docs(s, d), "file_size", A.SIZE_BUCKETS),
    "bottlenecks": lambda s, d: A.bottlenecks(A.stage_latency(V.reports(s, d)), L.stage_status(V.reports(s, d)).groupBy("stage").agg(F.sum((F.col("status") == "in_progress").cast("long")).alias("active"))),
    "pipeline_health": lambda s, d: A.health(A.stage_latency(V.reports(s, d))),
    "upload_size_categories": lambda s, d: V.docs(s, d).groupBy(A.size_category(F.col("file_size") * 1000).alias("category")).agg(F.count("*").alias("uploads")),
    "search_health": lambda s, d: A.search_health(V.docs(s, d), V.chunks(s, d)),
    "vision_cost": lambda s, d: A.vision_cost(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("image_no")), 0.002, 0.008),
    "pricing_summary": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")),
}

_MB = "1048576"
_PROGRESS = "(sum((status = 'completed')::INT) + coalesce(min(CASE WHEN status = 'in_progress' THEN percentage END), 0) / 100) / 7 * 100"

SQL = {
    "doc_list_filtered": f"WITH {V.DOCS_SQL} SELECT {DOC_SQL} FROM docs WHERE {LIVE} AND status = 'completed' AND mime_type = 'text/plain' AND file_size BETWEEN 500 AND 20000 AND created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-02-05'",
    "doc_list_page": f"WITH {V.DOCS_SQL} SELECT {DOC_SQL} FROM docs WHERE {LIVE} ORDER BY file_size DESC, doc_id LIMIT 25 OFFSET 25",
    "doc_page_info": f"WITH {V.DOCS_SQL}, t AS (SELECT count(*) AS total FROM docs WHERE {LIVE} AND status = 'completed') SELECT total, CAST(ceil(total / 25.0) AS BIGINT) AS total_pages, ceil(total / 25.0) > 2 AS has_next, true AS has_previous FROM t",
    "doc_name_search": f"WITH {V.DOCS_SQL} SELECT {DOC_SQL} FROM docs WHERE {LIVE} AND (lower(name) LIKE '%doc\\_12%' ESCAPE '\\' OR lower(original_name) LIKE '%doc\\_12%' ESCAPE '\\' OR lower(metadata) LIKE '%doc\\_12%' ESCAPE '\\')",
    "doc_metadata_search": f"""WITH {V.DOCS_SQL} SELECT {DOC_SQL} FROM docs WHERE {LIVE} AND status = 'completed' AND contains(lower(metadata), '"lang":"de"')""",
    "doc_tags_all": f"WITH {V.DOCS_SQL} SELECT {DOC_SQL} FROM docs WHERE {LIVE} AND list_contains(tags, 'en') AND list_contains(tags, 'src1')",
    "doc_tags_overlap": f"WITH {V.DOCS_SQL} SELECT {DOC_SQL} FROM docs WHERE quality >= 0.1 AND list_has_any(tags, ['fr', 'src2'])",
    "doc_stats_status": f"WITH {V.DOCS_SQL} SELECT status, count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS bytes, round(avg(file_size) / {_MB}, 2) AS avg_mb FROM docs WHERE {LIVE} GROUP BY status",
    "doc_stats_mime_top10": f"WITH {V.DOCS_SQL} SELECT mime_type, count(*) AS documents FROM docs WHERE {LIVE} GROUP BY mime_type ORDER BY documents DESC, mime_type LIMIT 10",
    "doc_stats_provider": f"WITH {V.DOCS_SQL} SELECT storage_provider, count(*) AS documents FROM docs WHERE {LIVE} GROUP BY storage_provider",
    "doc_upload_trend": f"WITH {V.DOCS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS uploads FROM docs WHERE {LIVE} AND created_at >= {V.NOW_SQL} - INTERVAL 30 DAY GROUP BY 1",
    "doc_tag_top10": f"WITH {V.DOCS_SQL} SELECT tag, count(*) AS documents FROM (SELECT unnest(tags) AS tag FROM docs WHERE {LIVE}) GROUP BY tag ORDER BY documents DESC, tag LIMIT 10",
    "doc_storage_by_workspace": f"WITH {V.DOCS_SQL}, per AS (SELECT workspace, file_extension, count(*) AS n, sum(file_size) AS b, min(created_at) AS lo, max(created_at) AS hi FROM docs GROUP BY 1, 2) SELECT workspace, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, string_agg(file_extension || '=' || b, ',' ORDER BY file_extension) AS by_extension, min(lo) AS first_upload, max(hi) AS last_upload, round(sum(b) / 10000000.0::DOUBLE * 100, 2) AS quota_percent, round(sum(b) / sum(n)::DOUBLE, 2) AS mean_bytes FROM per GROUP BY workspace",
    "quota_excess": f"WITH {V.DOCS_SQL} SELECT doc_id, workspace, used FROM (SELECT doc_id, workspace, CAST(sum(file_size) OVER (PARTITION BY workspace ORDER BY created_at, doc_id) AS BIGINT) AS used FROM docs) WHERE used > 50000",
    "admin_storage": f"WITH {V.DOCS_SQL}, a AS (SELECT count(*) AS documents, CAST(sum((NOT is_deleted)::INT) AS BIGINT) AS live, CAST(sum(CASE WHEN is_deleted THEN 0 ELSE file_size END) AS BIGINT) AS live_bytes FROM docs), t AS (SELECT count(*) AS temp_files FROM docs WHERE doc_id % 50 = 1), o AS (SELECT count(*) AS orphans FROM labels l WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = l.doc_id AND NOT d.is_deleted)) SELECT *, round(live_bytes / 1000000.0::DOUBLE, 2) AS used_percent, CASE WHEN live_bytes / 1000000.0 >= 90 THEN 'critical' WHEN live_bytes / 1000000.0 >= 80 OR orphans > 1000 THEN 'warning' ELSE 'healthy' END AS health FROM a, t, o",
    "gauge_matrix": f"WITH {V.DOCS_SQL} SELECT status, storage_provider, count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS bytes FROM docs GROUP BY 1, 2",
    "doc_active_versions": f"WITH {V.DOCS_SQL}, {V.VERSIONS_SQL} SELECT d.doc_id, d.name, v.version_number, v.version_path FROM docs d LEFT JOIN versions v ON v.doc_id = d.doc_id AND v.is_latest WHERE NOT d.is_deleted",
    "doc_latest_version": f"WITH {V.VERSIONS_SQL} SELECT * FROM versions",
    "doc_paths": f"WITH {V.DOCS_SQL}, p AS (SELECT doc_id, concat('Document_', doc_id, '_of_', source, '.tar.gz') AS file, workspace, name, created_at FROM docs) SELECT doc_id, concat_ws('/', workspace, strftime(created_at, '%Y'), strftime(created_at, '%m'), name, file) AS path, file, true AS safe FROM p",
    "stage_status": f"WITH {V.EVENTS_SQL} SELECT doc_id, stage, arg_max(status, row(\"at\", event_id)) AS status, max(\"at\") AS updated_at, CAST(sum((status = 'failed')::INT) + 1 AS BIGINT) AS attempt_number FROM reports GROUP BY doc_id, stage",
    "stage_progress": f"WITH {V.STATUS_SQL} SELECT doc_id, min(CASE WHEN status = 'in_progress' THEN stage END) AS current_stage, CAST(sum((status = 'completed')::INT) AS BIGINT) AS completed_stages, 7 AS total_stages, round({_PROGRESS}, 1) AS overall_progress FROM status GROUP BY doc_id",
    "ready_for_search": f"""WITH {V.STATUS_SQL}, p AS (SELECT doc_id, {', '.join(f"coalesce(max(CASE WHEN stage = '{s}' THEN status END), 'not_started') AS {s}_status" for s in L.SEARCH_STAGES)} FROM status GROUP BY doc_id)
        SELECT *, extraction_status = 'completed' AND chunking_status = 'completed' AND embedding_status = 'completed' AS ready_for_search,
        extraction_status = 'failed' OR chunking_status = 'failed' OR embedding_status = 'failed' AS can_retry,
        CASE WHEN extraction_status = 'completed' AND chunking_status = 'completed' AND embedding_status = 'completed' THEN 'ready_for_search' WHEN extraction_status = 'failed' THEN 'retry_extraction' WHEN chunking_status = 'failed' THEN 'retry_chunking' WHEN embedding_status = 'failed' THEN 'retry_embedding' WHEN extraction_status = 'completed' AND chunking_status = 'completed' THEN 'wait_for_embedding' WHEN extraction_status = 'completed' THEN 'wait_for_chunking' ELSE 'wait_for_extraction' END AS next_action FROM p""",
    "status_transition_violations": f"WITH {V.EVENTS_SQL}, m AS (SELECT doc_id, stage, event_id, coalesce(lag(status) OVER (PARTITION BY doc_id, stage ORDER BY \"at\", event_id), 'not_started') AS previous, status FROM reports) SELECT * FROM m WHERE previous || '>' || status NOT IN ({', '.join(repr(a + '>' + b) for a, b in L.TRANSITIONS)})",
    "processing_summary": f"WITH {V.DOCS_SQL}, {V.STATUS_SQL} SELECT d.doc_id, d.name, count(s.stage) AS total_stages, {', '.join(f"CAST(coalesce(sum((s.status = '{x}')::INT), 0) AS BIGINT) AS {x}_stages" for x in ('completed', 'failed', 'in_progress'))}, max(s.updated_at) AS last_update FROM docs d LEFT JOIN status s USING (doc_id) GROUP BY 1, 2",
    "queue_claim": f"WITH {V.QUEUE_SQL} SELECT item_id, priority, scheduled_at FROM queue WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {V.QUEUE_NOW_SQL}) ORDER BY priority, scheduled_at, item_id LIMIT 50",
    "queue_summary": f"WITH {V.QUEUE_SQL} SELECT status, count(*) AS count, round(avg(epoch({V.QUEUE_NOW_SQL}) - epoch(created_at)), 3) AS avg_age_seconds, min(created_at) AS oldest_item FROM queue GROUP BY status",
    "orphan_files": f"WITH {V.DOCS_SQL} SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = l.doc_id AND NOT d.is_deleted)",
    "duplicate_uploads": f"WITH {V.DOCS_SQL} SELECT doc_id, checksum FROM docs JOIN (SELECT checksum, min(doc_id) AS first FROM docs WHERE NOT is_deleted GROUP BY checksum) USING (checksum) WHERE first < doc_id",
    "purge_due": f"WITH {V.DOCS_SQL} SELECT doc_id, deleted_at FROM docs WHERE is_deleted AND deleted_at < {V.NOW_SQL} - INTERVAL 30 DAY",
    "soft_delete": f"WITH {V.DOCS_SQL}, g AS (SELECT *, doc_id % 3 = 0 AND status <> 'processing' AND NOT is_deleted AS go FROM docs) SELECT doc_id, status, is_deleted OR go AS is_deleted, CASE WHEN go THEN {V.NOW_SQL} ELSE deleted_at END AS deleted_at FROM g",
    "access_counts": f"WITH {V.EVENTS_SQL} SELECT doc_id, count(*) AS access_count, max(\"at\") AS last_accessed_at FROM reports GROUP BY doc_id",
    "constraint_violations": f"""WITH {V.CHUNKS_SQL}, {V.VERSIONS_SQL}, {V.QUEUE_SQL}
        SELECT 'unique_checksum' AS "constraint", checksum AS key, count(*) AS n FROM docs GROUP BY checksum HAVING count(*) > 1
        UNION ALL SELECT 'unique_path', storage_provider || '/' || storage_path, count(*) FROM docs GROUP BY storage_provider, storage_path HAVING count(*) > 1
        UNION ALL SELECT 'unique_version', doc_id || '/' || version_number, count(*) FROM versions GROUP BY doc_id, version_number HAVING count(*) > 1
        UNION ALL SELECT 'unique_chunk', doc_id || '/' || chunk_index, count(*) FROM chunks GROUP BY doc_id, chunk_index HAVING count(*) > 1
        UNION ALL SELECT 'deleted_at', doc_id::VARCHAR, 1 FROM docs WHERE is_deleted <> (deleted_at IS NOT NULL)
        UNION ALL SELECT 'quality_range', doc_id::VARCHAR, 1 FROM docs WHERE quality NOT BETWEEN 0 AND 1
        UNION ALL SELECT 'queue_priority', item_id::VARCHAR, 1 FROM queue WHERE priority NOT BETWEEN 1 AND 10
        UNION ALL SELECT 'queue_status', item_id::VARCHAR, 1 FROM queue WHERE status NOT IN ('pending', 'processing', 'completed', 'failed')""",
    "stage_latency": f"WITH {V.EVENTS_SQL} SELECT stage, count(*) AS requests, CAST(sum((NOT ok)::INT) AS BIGINT) AS errors, round(avg(seconds), 4) AS avg_latency_seconds FROM reports GROUP BY stage",
    "latency_histogram": f"WITH {V.EVENTS_SQL}, b AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in A.LATENCY_BUCKETS)}, NULL]) AS le) SELECT r.stage, b.le, count(CASE WHEN b.le IS NULL OR r.seconds <= b.le THEN r.seconds END) AS n FROM reports r, b GROUP BY 1, 2",
    "size_histogram": f"WITH {V.DOCS_SQL}, b AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in A.SIZE_BUCKETS)}, NULL]) AS le) SELECT b.le, count(CASE WHEN b.le IS NULL OR d.file_size <= b.le THEN 1 END) AS n FROM docs d, b GROUP BY 1",
    "bottlenecks": f"""WITH {V.STATUS_SQL}, l AS (SELECT stage, count(*) AS requests, sum((NOT ok)::INT) AS errors, round(avg(seconds), 4) AS lat FROM reports GROUP BY stage), a AS (SELECT stage, sum((status = 'in_progress')::INT) AS active FROM status GROUP BY stage),
        u AS (SELECT 'slow' AS issue, stage, lat AS value, 'high' AS priority FROM l WHERE lat > 1 UNION ALL SELECT 'errors', stage, errors::DOUBLE, 'high' FROM l WHERE errors > 5 UNION ALL SELECT 'congested', stage, active::DOUBLE, 'medium' FROM a WHERE active > 5)
        SELECT *, row_number() OVER (PARTITION BY issue ORDER BY value DESC, stage) = 1 AS recommended FROM u""",
    "pipeline_health": f"WITH {V.EVENTS_SQL} SELECT CAST(sum((NOT ok)::INT) AS BIGINT) AS errors, CASE WHEN sum((NOT ok)::INT) > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM reports",
    "upload_size_categories": f"WITH {V.DOCS_SQL} SELECT CASE WHEN file_size * 1000 < {_MB} THEN 'small' WHEN file_size * 1000 < 10485760 THEN 'medium' ELSE 'large' END AS category, count(*) AS uploads FROM docs GROUP BY 1",
    "search_health": f"WITH {V.CHUNKS_SQL} SELECT * FROM (SELECT count(*) AS documents, CAST(sum((status = 'completed' AND NOT is_deleted)::INT) AS BIGINT) AS searchable FROM docs), (SELECT count(*) AS chunks, count(embedding) AS with_vector FROM chunks)",
    "vision_cost": "SELECT conv_id AS doc_id, turn AS image_no, round(count(*) OVER w * 0.002::DOUBLE, 6) AS cost, count(*) OVER w * 0.002::DOUBLE <= 0.008::DOUBLE AS within FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "pricing_summary": "SELECT c_mktsegment, l_returnflag, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
}
