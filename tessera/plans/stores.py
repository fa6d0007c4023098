"""Registered queries over stores, readers and small helpers, with their SQL.

Stores are written to a new place in the session's shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profile as P
from ..functions import text as T
from ..operators import analytics as A
from ..operators import evidence as E
from ..operators import filters, fusion, lifecycle, retrieval
from ..session import scratch_path, table
from ..sources import files, stores
from ..streaming import ingest, stages
from . import documents
from . import search as S
from . import views as V

KNN = ("query_id", "vec_id", "similarity", "rank")


def _name(path="path"):
    return F.regexp_extract(path, r"([^/]+)$", 1)


# Files ------------------------------------------------------------------------------------


def _blobs(s, d):
    """The nations' names as files, one for each; every third is moved and every fifth deleted."""
    blobs = stores.BlobStore(s, scratch_path(s, "blobs"))
    for row in table(s, d, "nation").orderBy("n_nationkey").limit(1000).collect():  # 25 rows
        k = int(row["n_nationkey"])
        blobs.save(f"{k}:{row['n_name']}".encode(), f"in/{k}.txt")
        if k % 3 == 0:
            blobs.move(f"in/{k}.txt", f"moved/{k}.txt")
        elif k % 5 == 0:
            blobs.delete(f"in/{k}.txt")
    return blobs


def blob_round_trip(s, d):
    blobs = _blobs(s, d)
    return blobs.read().select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def blob_listing(s, d):
    return files.listing(s, _blobs(s, d).root).select(_name().alias("file"), "length")


def text_files(s, d):
    """The nations' names in several encodings, read by the first that fits."""
    blobs = stores.BlobStore(s, scratch_path(s, "texts"))
    for row in table(s, d, "nation").orderBy("n_nationkey").limit(1000).collect():
        k, text = int(row["n_nationkey"]), f"\u00e9 {row['n_name']}"
        blobs.save(text.encode("latin-1" if k % 2 else "utf-8"), f"{k}.txt")
    return files.read_texts(s, blobs.root).select(_name().alias("file"), "text", "encoding")


def file_routes(s, d):
    """Uploads by the reader that takes them, and what their names alone say."""
    names = V.docs(s, d).select(F.concat("name", F.lit("."), F.element_at(F.array(*map(F.lit, ("pdf", "txt", "png", "exe", "csv"))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"))
    routed = [df.withColumn("reader", F.lit(k)) for k, df in files.route(names).items()]
    every = routed[0].unionByName(routed[1]).unionByName(routed[2])
    return every.withColumn("guess", files.fallback_analysis(F.col("path"))).select("path", "reader", "guess.has_images", "guess.has_text")


def _legacy(s, d):
    """An old tree: every document's file, but failed ones have another size."""
    return V.docs(s, d).select(F.concat(F.lit("/old/"), "source", F.lit("/"), "name").alias("path"), (F.col("file_size") + F.when(F.col("status") == "failed", 1).otherwise(0)).alias("length"), F.col("created_at").alias("modificationTime"))


def expired(s, d):
    listed = V.docs(s, d).select(F.col("name").alias("path"), F.col("created_at").alias("modificationTime"))
    return lifecycle.expired_files(listed, V.now(), days=30).select("path")


# Stores -----------------------------------------------------------------------------------


def _halves(df):
    """Each text as two chunks."""
    cut = F.ceil(F.length("text") / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("chunk_index"), F.substr("text", F.lit(1), cut).alias("chunk_text")), F.struct(F.lit(1).alias("chunk_index"), F.substr("text", cut + 1).alias("chunk_text")))
    return df.select("doc_id", F.explode(both).alias("c")).select("doc_id", "c.*")


def chunk_sink(s, d):
    """All documents written as two chunks, then the completed ones again as one."""
    path, docs = scratch_path(s, "chunks"), V.docs(s, d)
    stores.write_chunks(_halves(docs), path, n=8)
    stores.write_chunks(docs.where("status = 'completed'").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text")), path, n=8)
    return s.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))


def text_upsert(s, d):
    """Texts of all documents, and newer ones of the completed."""
    old = V.docs(s, d).select("doc_id", "text", F.lit(1).alias("version"))
    new = V.docs(s, d).where("status = 'completed'").select("doc_id", F.replace(F.concat("text", F.lit("\x00 v2")), F.lit("\x00"), F.lit("")).alias("text"), F.lit(2).alias("version"))
    return stores.upsert(old, new, ["doc_id"], "version").select("doc_id", "version", F.sha2("text", 256).alias("text"))


def document_store(s, d):
    """All documents uploaded again under one name, to a store that holds the live ones."""
    uploads = V.docs(s, d).select("doc_id", F.col("source").alias("workspace"), F.lit("My report.txt").alias("name"), F.encode("text", "UTF-8").alias("content"), F.col("created_at").alias("at"))
    live = V.docs(s, d).where("NOT is_deleted").select("checksum", F.concat_ws("/", "source", F.date_format("created_at", "yyyy"), F.date_format("created_at", "MM"), F.col("doc_id").cast("string"), F.lit("My_report.txt")).alias("storage_path"))
    return stores.store_documents(uploads, live).select("doc_id", "checksum", "file_size", "is_duplicate", "storage_path")


def _vector_store(s, d):
    """All vectors indexed, those of version 1 of every seventh replaced by its negative, every tenth deleted."""
    store = stores.get_store("parquet", spark=s, path=scratch_path(s, "vectors"), dim=64)
    v = table(s, d, "embeddings").select("vec_id", "embedding", F.lit(1).cast("long").alias("version"))
    store.index(v)
    store.index(v.where("vec_id % 7 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(2).cast("long").alias("version")))
    store.delete(v.where("vec_id % 10 = 0"), 3)
    return store


def ivf_index(s, d):
    """The stored index, asked by every 50th vector."""
    index = retrieval.IvfIndex(s, scratch_path(s, "ivf")).build(table(s, d, "embeddings").select("vec_id", "embedding"))
    return index.search(S._asking(s, d), probes=12).select(*KNN)


# Streams ----------------------------------------------------------------------------------


def _stream(s, d):
    """All documents as a stream of files."""
    path = scratch_path(s, "stream")
    V.docs(s, d).select("doc_id", "text", F.col("created_at").cast("timestamp").alias("at")).write.parquet(path)
    return ingest.documents(s, path)


def stream_trend(s, d):
    out = scratch_path(s, "trend")
    writer = ingest.upload_trend(_stream(s, d)).writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", scratch_path(s, "trend_state")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).withColumn("day", F.col("day").cast("timestamp"))


def stream_sentences(s, d):
    """Sentences counted batch by batch, each batch in a folder of its own."""
    out = scratch_path(s, "batches")
    ingest.chunk_stream(_stream(s, d), out, scratch_path(s, "batches_state"), stage=lambda df: df.select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))).awaitTermination()
    return s.read.parquet(out).select("doc_id", "sentences")


def stream_stages(s, d):
    """All stage reports as a stream of files in any order, two a micro-batch; each stage keeps its own state."""
    path, out = scratch_path(s, "reports"), scratch_path(s, "stages")
    reports = V.reports(s, d).select("doc_id", "stage", "status", "at", "event_id")
    kind = dict(reports.dtypes)["at"]
    reports.repartition(6).write.parquet(path)
    source = s.readStream.schema(reports.schema).option("maxFilesPerTrigger", 2).parquet(path)
    stages.run_stages(source, out, scratch_path(s, "stages_state")).awaitTermination()
    return stages.current(s, out).select("doc_id", "stage", "status", F.col("updated_at").cast(kind).alias("updated_at"), "attempt_number")


# Helpers ----------------------------------------------------------------------------------


def _talk(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", "text")


def text_checks(s, d):
    odd = F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit("\x01\x07")).otherwise(F.lit("\t")))
    return _talk(s, d).select("conv_id", "turn", T.has_control(odd).alias("has_control"), T.sanitize_query(F.concat(F.lit("  "), odd), 60).alias("sanitized"), T.boolean_query(F.concat(F.lit('say "'), F.col("text"), F.lit('"'))).alias("boolean"))


def text_cuts(s, d):
    return _talk(s, d).select("conv_id", "turn", T.truncate_tokens(F.col("text"), 5).alias("tokens"), T.truncate_at_sentence(F.col("text"), 80).alias("at_sentence"), T.clean_snippet(F.concat(F.lit("<b>Hit</b>  in "), F.col("text")), 40).alias("snippet"), fusion.rerank_text(F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 15)), F.concat(F.lit("doc "), F.col("conv_id"))).alias("rerank"))


def variations(s, d):
    reply = F.concat(F.lit("Here they are:\n1. "), "text", F.lit("\n2) other words\n- third one\n4. ab"))
    return _talk(s, d).select("conv_id", "turn", F.posexplode(T.variations(reply, 3)).alias("pos", "variation"))


def source_contexts(s, d):
    q = F.col("turn")
    return _talk(s, d).select("conv_id", "turn", E.source_context(F.when(q % 2 == 0, q), F.when(q % 3 == 0, F.col("text")), F.when(q % 5 != 0, F.lit("file"))).alias("context"))


def highlight_all(s, d):
    return table(s, d, "benchmark").select("item_id", E.highlight_all(F.col("text"), F.array(F.substring("text", 1, 10), F.substring("text", 1, 30)), F.lit(3)).alias("marked"))


def model_costs(s, d):
    words = T.word_count(F.col("text"))
    return _talk(s, d).groupBy("conv_id").agg(F.round(F.sum(T.llm_cost(words, words * 2, 3.0, 15.0)), 9).alias("usd"))


def profile_checks(s, d):
    r = V.docs(s, d)
    errors = P.processing_errors(F.col("doc_id") % 130 - 10, F.col("doc_id") % 9 - 1, F.col("quality") * 1.1, F.col("quality"), (F.col("doc_id") % 12).cast("int"))
    return r.select("doc_id", P.language_basic(F.col("text")).alias("language"), F.array_join(errors, ",").alias("errors"), P.is_chart(F.concat(F.lit("A "), F.when(F.col("doc_id") % 4 == 0, P.CHART_WORDS[0]).otherwise("picture"))).alias("is_chart"))


def clamped_progress(s, d):
    status = lifecycle.stage_status(V.reports(s, d)).select("doc_id", "stage", "status", (F.col("doc_id") % 300 - 100).cast("double").alias("percentage"))
    return lifecycle.clamp_progress(status)


def statistics_bundle(s, d):
    """All parts of the bundle as rows (part, key, documents)."""
    out = []
    for part, df in A.statistics(V.docs(s, d), V.now(), "30d").items():
        number = "uploads" if "uploads" in df.columns else "documents"
        key = next((c for c in df.columns if c not in ("documents", "uploads", "bytes", "avg_mb")), None)
        out.append(df.select(F.lit(part).alias("part"), (F.col(key).cast("string") if key else F.lit("all")).alias("key"), F.col(number).cast("long").alias("documents")))
    return fusion.union_all(out)


QUERIES = {
    "blob_round_trip": blob_round_trip,
    "blob_listing": blob_listing,
    "text_files": text_files,
    "file_routes": file_routes,
    "legacy_matches": lambda s, d: stores.legacy_matches(_legacy(s, d), V.docs(s, d)).select("path", "length", "doc_id"),
    "migration_plan": lambda s, d: stores.migration_plan(_legacy(s, d), V.docs(s, d), "main"),
    "expired_files": expired,
    "chunk_sink": chunk_sink,
    "text_upsert": text_upsert,
    "store_delete": lambda s, d: stores.delete(V.docs(s, d).select("doc_id", "status"), V.docs(s, d).where("is_deleted"), ["doc_id"]),
    "document_store": document_store,
    "vector_store_search": lambda s, d: _vector_store(s, d).search(V.queries(s, d), 10).select(*KNN),
    "vector_store_count": lambda s, d: s.createDataFrame([(e, _vector_store(s, d).count({"version": e} if e else None)) for e in (0, 1, 2)], "version int, vectors long"),
    "payload_filter": lambda s, d: filters.payload(V.docs(s, d), {"mime_type": "text/plain", "is_deleted": False}).select("doc_id"),
    "ivf_index": ivf_index,
    "text_checks": text_checks,
    "text_cuts": text_cuts,
    "variations": variations,
    "source_contexts": source_contexts,
    "highlight_all": highlight_all,
    "model_costs": model_costs,
    "profile_checks": profile_checks,
    "clamped_progress": clamped_progress,
    "statistics_bundle": statistics_bundle,
    "stream_trend": stream_trend,
    "stream_sentences": stream_sentences,
    "stream_stages": stream_stages,
    "question_batches": lambda s, d: E.questions(_talk(s, d).select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("prop"), "text"), limit=3),
    "batch_queue": lambda s, d: lifecycle.batch_queue(table(s, d, "embeddings").select((F.col("vec_id") % 5).alias("batch_id"), (F.col("vec_id") * 3).alias("doc_id")), V.docs(s, d)),
}

_NATION = "n AS (SELECT CAST(n_nationkey AS INTEGER) AS k, n_name FROM nation)"
_STORED = "SELECT CASE WHEN k % 3 = 0 THEN 'moved/' ELSE 'in/' END || k || '.txt' AS file, k || '.txt' AS name, k || ':' || n_name AS content FROM n WHERE k % 3 = 0 OR k % 5 <> 0"
_OLD = "old AS (SELECT '/old/' || source || '/' || name AS path, file_size + (status = 'failed')::INT AS length, created_at FROM docs)"
_MATCH = "known AS (SELECT name, file_size AS length, min(doc_id) AS doc_id FROM docs GROUP BY 1, 2), m AS (SELECT o.path, o.length, k.doc_id, o.created_at, k.name FROM old o LEFT JOIN known k ON k.name = regexp_extract(o.path, '([^/]+)$', 1) AND k.length = o.length)"
_VECS = "v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE vec_id % 10 <> 0)"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_ODD = "text || CASE WHEN turn % 3 = 0 THEN chr(1) || chr(7) ELSE chr(9) END"
_HL = "replace(text, substr(text, 1, 30), '<mark data-page=\"3\">' || substr(text, 1, 30) || '</mark>')"
_LIVE30 = "live AS (SELECT * FROM docs WHERE NOT is_deleted AND created_at >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY)"

SQL = {
    "blob_round_trip": f"WITH {_NATION}, b AS ({_STORED}) SELECT file, CAST(length(content) AS BIGINT) AS length, sha256(content) AS sha256 FROM b",
    "blob_listing": f"WITH {_NATION}, b AS ({_STORED}) SELECT name AS file, CAST(length(content) AS BIGINT) AS length FROM b",
    "text_files": f"WITH {_NATION} SELECT k || '.txt' AS file, chr(233) || ' ' || n_name AS text, CASE WHEN k % 2 = 1 THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM n",
    "file_routes": f"WITH {V.DOCS_SQL} SELECT name || '.' || ['pdf', 'txt', 'png', 'exe', 'csv'][doc_id % 5 + 1] AS path, CASE doc_id % 5 WHEN 0 THEN 'document' WHEN 2 THEN 'other' WHEN 3 THEN 'other' ELSE 'text' END AS reader, doc_id % 5 = 0 AS has_images, doc_id % 5 <> 2 AS has_text FROM docs",
    "legacy_matches": f"WITH {V.DOCS_SQL}, {_OLD}, {_MATCH} SELECT path, length, doc_id FROM m",
    "migration_plan": f"WITH {V.DOCS_SQL}, {_OLD}, {_MATCH} SELECT path, doc_id, CASE WHEN doc_id IS NOT NULL THEN 'main/' || strftime(created_at, '%Y/%m') || '/' || doc_id || '/' || name END AS target, CASE WHEN doc_id IS NULL THEN 'skip' ELSE 'move' END AS action FROM m",
    "expired_files": f"WITH {V.DOCS_SQL} SELECT name AS path FROM docs WHERE created_at < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY",
    "chunk_sink": f"WITH {V.DOCS_SQL} SELECT doc_id, CASE WHEN status = 'completed' THEN 1 ELSE 2 END AS chunks, length(text) AS chars FROM docs",
    "text_upsert": f"WITH {V.DOCS_SQL} SELECT doc_id, CASE WHEN status = 'completed' THEN 2 ELSE 1 END AS version, sha256(text || CASE WHEN status = 'completed' THEN ' v2' ELSE '' END) AS text FROM docs",
    "store_delete": f"WITH {V.DOCS_SQL} SELECT doc_id, status FROM docs WHERE NOT is_deleted",
    "document_store": f"WITH {V.DOCS_SQL}, live AS (SELECT DISTINCT checksum FROM docs WHERE NOT is_deleted) SELECT doc_id, checksum, CAST(strlen(text) AS INTEGER) AS file_size, checksum IN (SELECT checksum FROM live) AS is_duplicate, source || '/' || strftime(created_at, '%Y/%m') || '/' || doc_id || '/My_report' || CASE WHEN is_deleted THEN '' ELSE '_1' END || '.txt' AS storage_path FROM docs",
    "vector_store_search": f"WITH {V.QUERIES_SQL}, {_VECS}, s AS (SELECT q.query_id, v.vec_id, {S._COS.format(a='v.embedding', b='q.vector')} AS similarity FROM v, queries q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "vector_store_count": f"WITH {_VECS} SELECT 0 AS version, count(*) AS vectors FROM v UNION ALL SELECT 1, count(*) FROM v WHERE version = 1 UNION ALL SELECT 2, count(*) FROM v WHERE version = 2",
    "payload_filter": f"WITH {V.DOCS_SQL} SELECT doc_id FROM docs WHERE mime_type = 'text/plain' AND NOT is_deleted",
    "text_checks": f"SELECT conv_id, turn, turn % 3 = 0 AS has_control, substr(trim(regexp_replace('  ' || {_ODD}, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')), 1, 60) AS sanitized, array_to_string({_WORDS.format('replace(' + chr(39) + 'say ' + chr(39) + ' || text, chr(34), ' + chr(39) * 2 + ')')}, ' & ') AS boolean FROM conversations",
    "variations": "WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split('Here they are:' || chr(10) || '1. ' || text || chr(10) || '2) other words' || chr(10) || '- third one' || chr(10) || '4. ab', chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[\\d-]')) AS l FROM conversations), v AS (SELECT conv_id, turn, list_slice(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '^(\\d+[.)]|-)\\s*', ''))), lambda x: length(x) > 3), 1, 3) AS v FROM l) SELECT conv_id, turn, CAST(unnest(range(0, len(v))) AS INTEGER) AS pos, unnest(v) AS variation FROM v",
    "source_contexts": "WITH p AS (SELECT conv_id, turn, concat_ws(', ', CASE WHEN turn % 2 = 0 THEN 'Page ' || turn END, CASE WHEN turn % 3 = 0 THEN nullif(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END, '') END) AS t FROM conversations) SELECT conv_id, turn, coalesce(nullif(t, ''), CASE WHEN turn % 5 <> 0 THEN 'file' END, 'Unknown') AS context FROM p",
    "highlight_all": f"SELECT item_id, {_HL} AS marked FROM benchmark",
    "model_costs": f"SELECT conv_id, round(sum(len({_WORDS.format('text')}) * 3.0::DOUBLE / 1e6 + len({_WORDS.format('text')}) * 2 * 15.0::DOUBLE / 1e6), 9) AS usd FROM conversations GROUP BY conv_id",
    "question_batches": "WITH f AS (SELECT conv_id AS answer_id, turn AS prop, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3), k AS (SELECT answer_id, 'vq:' || sha256(string_agg(text, '|' ORDER BY text)) AS cache_key FROM f GROUP BY answer_id) SELECT f.answer_id, f.prop, CASE WHEN regexp_matches(lower(text), '[0-9]') THEN 'Which figure do the sources give: ' WHEN regexp_matches(lower(text), '\\b(because|due to|causes?)\\b') THEN 'Do the sources name this cause: ' WHEN substr(md5(text), 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'Is it stated that ' ELSE 'Do the sources confirm: ' END || text || '?' AS question, cache_key FROM f JOIN k USING (answer_id)",
    "stream_trend": f"WITH {V.DOCS_SQL} SELECT CAST(created_at AS DATE) AS day, count(*) AS uploads FROM docs GROUP BY 1",
    "stream_stages": documents.SQL["stage_status"],
    "stream_sentences": "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')) AS sentences FROM documents",
    "batch_queue": "SELECT vec_id % 5 AS batch_id, count(*) AS total, count(d.doc_id) AS queued, count(*) - count(d.doc_id) AS errors FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3 GROUP BY 1",
    "profile_checks": f"WITH {V.DOCS_SQL} SELECT doc_id, CASE WHEN length(text) >= 100 THEN 'en' END AS language, concat_ws(',', CASE WHEN doc_id % 130 - 10 < 0 OR doc_id % 130 - 10 > 100 THEN 'percentage out of range' END, CASE WHEN doc_id % 9 = 0 THEN 'negative duration' END, CASE WHEN quality * 1.1 > 1 THEN 'quality out of range' END, CASE WHEN doc_id % 12 < 1 OR doc_id % 12 > 10 THEN 'priority out of range' END) AS errors, doc_id % 4 = 0 AS is_chart FROM docs",
    "clamped_progress": f"WITH {V.STATUS_SQL} SELECT doc_id, stage, status, CASE WHEN status = 'in_progress' THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, (doc_id % 300 - 100)::DOUBLE)) END AS percentage FROM status",
    "statistics_bundle": f"WITH {V.DOCS_SQL}, {_LIVE30}, tags AS (SELECT unnest(tags) AS tag FROM docs WHERE NOT is_deleted), b AS (SELECT 'totals' AS part, 'all' AS key, count(*) AS documents FROM live UNION ALL SELECT 'by_status', status, count(*) FROM live GROUP BY status UNION ALL (SELECT 'by_mime_type', mime_type, count(*) AS n FROM live GROUP BY mime_type ORDER BY n DESC, mime_type LIMIT 10) UNION ALL SELECT 'by_provider', storage_provider, count(*) FROM live GROUP BY 2 UNION ALL (SELECT 'tags', tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 10) UNION ALL SELECT 'trend', CAST(CAST(created_at AS DATE) AS VARCHAR), count(*) FROM live GROUP BY 2) SELECT * FROM b",
}
