"""Registered queries over retrieval, fusion and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import evidence as E
from ..operators import fulltext, fusion, retrieval
from ..operators.filters import SearchFilters, SearchRequest
from ..session import scratch_path, table
from . import views as V

KNN = ("query_id", "vec_id", "similarity", "rank")
HIT = ("query_id", "doc_id", "score", "rank")
FILTER = SearchFilters(mime_types=("text/plain", "text/csv"), min_quality=0.05, tags=("en", "de"))
BASE = SearchRequest(query="the of", limit=10)


def _vectors(s, d):
    return table(s, d, "embeddings")


def _asking(s, d):
    """Every vector whose identifier is divisible by 50, as a query."""
    return _vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _bm25(s, d, **o):
    return retrieval.bm25(V.queries(s, d), V.chunks(s, d, False), **o)


def _words(s, d, n=100):
    return _bm25(s, d, limit=n)


def _near(s, d, n=100):
    c = V.chunks(s, d).where("embedding is not null").select("doc_id", "chunk_index", "embedding")
    return retrieval.knn(V.queries(s, d), c, limit=n, id_col="doc_id")


def _ranked(s, d):
    """Neighbours with text and vector, as a reranker's input."""
    own = V.chunks(s, d).select("doc_id", "chunk_index", F.col("chunk_text").alias("snippet"), "name", "embedding")
    return _near(s, d, 60).select("query_id", "doc_id", "chunk_index", F.col("similarity").alias("score"), "rank").join(own, ["doc_id", "chunk_index"])


def _variations(s, d):
    q = V.queries(s, d)
    base = q.withColumn("group_id", F.when(F.col("query_id") <= 2, 1).otherwise(2))
    return base


def _claims(s, d):
    """Every sentence of three words or more of a benchmark text, as a claim of an answer; the answer is the item."""
    b = table(s, d, "benchmark")
    return b.select(F.col("item_id").alias("answer_id"), F.posexplode(T.sentences(F.col("text"), 3)).alias("prop", "text"))


def _passages(s, d):
    """All documents, offered to every item, and each item's own text, offered to itself."""
    score = F.round(1 / (1 + F.col("doc_id") % 7), 4).alias("score")  # a retrieval's score
    p = table(s, d, "documents").select(F.lit(None).cast("long").alias("answer_id"), F.concat(F.lit("p"), F.col("doc_id")).alias("passage_id"), "text", score)
    b = table(s, d, "benchmark").select(F.col("item_id").alias("answer_id"), F.concat(F.lit("b"), F.col("item_id")).alias("passage_id"), F.concat(F.col("text"), F.lit(" Extra words follow.")).alias("text"), F.lit(0.9).alias("score"))
    return p.unionByName(b)


def _quotes(s, d):
    return E.quote_matches(_claims(s, d), _passages(s, d))


def _best_quotes(s, d):
    """Citations and their quotes come from the same matches, which are computed once and stored."""
    path = scratch_path(s, "quotes")
    found = _quotes(s, d)
    found.write.parquet(path)
    quotes = s.read.schema(found.schema).parquet(path)
    return E.best_quotes(_citations(s, d, quotes), quotes)


def _citations(s, d, quotes):
    """The passages that an item's quotes come from, numbered, with their texts."""
    cited = quotes.select("answer_id", "passage_id").distinct()
    texts = _passages(s, d).select(F.col("passage_id").alias("id"), "text")
    numbered = cited.withColumn("citation_number", F.row_number().over(Window.partitionBy("answer_id").orderBy("passage_id")))
    return numbered.join(texts, F.col("passage_id") == F.col("id")).drop("id")


def _questions(s, d):
    """Every benchmark item asks for the first three words of its text."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ").alias("text"))


def _index(s, d, language="english"):
    return fulltext.FullTextIndex.build(V.chunks(s, d, False), scratch_path(s, "fulltext"), language=language)


def _stored_chunks(s, d):
    """Chunks with text and vector, stored: a hybrid search reads them several times, and texts meet vectors once."""
    path, found = scratch_path(s, "chunks"), V.chunks(s, d)
    found.write.parquet(path)
    return s.read.schema(found.schema).parquet(path)


# Deterministic stand-ins for a model's outputs, the same expressions in SQL.
def _judged(s, d):
    c = table(s, d, "conversations").where("role = 'assistant'")
    props = c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("prop"), "text")
    return props.selectExpr("answer_id", "prop", "text", "cast((answer_id * 7 + prop) % 3 as int) AS n_quotes", "CASE (answer_id + prop) % 5 WHEN 0 THEN 'Yes, this is confirmed' WHEN 1 THEN 'No, it is incorrect' WHEN 2 THEN 'Unclear' WHEN 3 THEN text END AS verification", "(answer_id + prop) % 11 = 0 AS contradicts", "round(((answer_id * 13 + prop * 5) % 100) / 100.0D, 4) AS relevance", "round(((answer_id * 3 + prop * 17) % 100) / 100.0D, 4) AS quote", "cast((answer_id + prop) % 5 as int) AS n_citations")


_JUDGED = "judged AS (SELECT conv_id AS answer_id, turn AS prop, text, (conv_id * 7 + turn) % 3 AS n_quotes, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Yes, this is confirmed' WHEN 1 THEN 'No, it is incorrect' WHEN 2 THEN 'Unclear' WHEN 3 THEN text END AS verification, (conv_id + turn) % 11 = 0 AS contradicts, round(((conv_id * 13 + turn * 5) % 100) / 100.0::DOUBLE, 4) AS relevance, round(((conv_id * 3 + turn * 17) % 100) / 100.0::DOUBLE, 4) AS quote, (conv_id + turn) % 5 AS n_citations FROM conversations WHERE role = 'assistant')"


def _answers(s, d):
    j = _judged(s, d)
    conf = E.confidence_breakdown(E.proposition_confidence(j)).select("answer_id", F.col("overall").alias("confidence"))
    hall = E.hallucination(j)
    n = j.groupBy("answer_id").agg(F.sum("n_quotes").alias("n_quotes"))
    df = hall.join(conf, "answer_id").join(n, "answer_id")
    v = E.verified(df)
    return df.select("answer_id", "probability", "n_quotes").join(v, "answer_id")


def _sources(s, d):
    """Scored passages of answers."""
    return table(s, d, "conversations").selectExpr("conv_id AS answer_id", "turn AS position", "concat(conv_id, '_', turn) AS passage_id", "text", "round(((conv_id * 31 + turn * 17) % 100) / 100.0D, 2) AS score")


_SOURCES = "sources AS (SELECT conv_id AS answer_id, turn AS position, concat(conv_id, '_', turn) AS passage_id, text, round(((conv_id * 31 + turn * 17) % 100) / 100.0::DOUBLE, 2) AS score FROM conversations)"

QUERIES = {
    "keyword_search": lambda s, d: retrieval.keyword(V.queries(s, d), V.chunks(s, d, False), limit=20).select(*HIT),
    "keyword_count": lambda s, d: retrieval.matches(V.queries(s, d).withColumn("terms", T.query_terms(F.col("text"))), V.chunks(s, d, False)).groupBy("query_id").agg(F.count("*").alias("matches")),
    "keyword_search_docs": lambda s, d: retrieval.keyword_documents(V.queries(s, d), V.chunks(s, d, False), V.texts(s, d), limit=10).select("query_id", "doc_id", "chunk_index", "score", "rank"),
    "fulltext_simple": lambda s, d: _index(s, d, None).search(_questions(s, d)).select("query_id", "doc_id", "chunk_index", "score", "rank"),
    "fulltext_filtered": lambda s, d: _index(s, d, None).count(_questions(s, d), FILTER),
    "fulltext_search": lambda s, d: _index(s, d).search(_questions(s, d), snippets=True).select("query_id", "doc_id", "chunk_index", "score", "rank", "snippet"),
    "bm25_topk": lambda s, d: _bm25(s, d, limit=20).select(*HIT),
    "bm25_page2": lambda s, d: _bm25(s, d, limit=10, offset=10).select(*HIT),
    "bm25_filtered": lambda s, d: _bm25(s, d, limit=10, filters=FILTER).select(*HIT),
    "bm25_robertson_topk": lambda s, d: _bm25(s, d, limit=20, idf="robertson").select(*HIT),
    "knn_topk": lambda s, d: retrieval.knn(V.queries(s, d), _vectors(s, d)).select(*KNN),
    "knn_threshold": lambda s, d: retrieval.knn(V.queries(s, d), _vectors(s, d), limit=50, threshold=0.2).select(*KNN),
    "knn_filtered": lambda s, d: retrieval.knn(V.queries(s, d), V.chunks(s, d).where("embedding is not null"), filters=FILTER, id_col="doc_id").select("query_id", "doc_id", "similarity", "rank"),
    "knn_batch": lambda s, d: retrieval.knn_batch(_vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), _vectors(s, d), limit=5),
    "knn_ivf": lambda s, d: (lambda a: retrieval.knn_ivf(_asking(s, d), a[0], a[1], probes=12))(retrieval.ivf_assign(_vectors(s, d))).select(*KNN),
    "embedding_coverage": lambda s, d: A.coverage(V.chunks(s, d)),
    "embedding_dims": lambda s, d: A.dimensions(_vectors(s, d), 1024),
    "invalid_vectors": lambda s, d: _vectors(s, d).select("vec_id", retrieval.invalid_vector(F.col("embedding"), 64).alias("invalid")),
    "snippet_bm25": lambda s, d: V.chunks(s, d, False).crossJoin(F.broadcast(V.queries(s, d).where("query_id = 2").select(T.query_terms(F.col("text")).alias("terms")))).select("doc_id", T.snippet_around(F.col("chunk_text"), F.col("terms")).alias("snippet")),
    "rrf_fuse": lambda s, d: fusion.rrf(_words(s, d), _near(s, d)).select("query_id", "key", "keyword_rank", "vector_rank", "score", "rank"),
    "hybrid_search": lambda s, d: fusion.hybrid(V.queries(s, d), _stored_chunks(s, d), BASE).select("query_id", "doc_id", "keyword_rank", "vector_rank", "score", "rank"),
    "hybrid_page2": lambda s, d: fusion.hybrid(V.queries(s, d), _stored_chunks(s, d), SearchRequest(query="the of", limit=10, offset=10, keyword_weight=0.7, vector_weight=0.3)).select("query_id", "doc_id", "score", "rank"),
    "multi_query_fuse": lambda s, d: fusion.multi_query(_words(s, d, 30).join(_variations(s, d).select("query_id", "group_id"), "query_id"), top_k=20).select("group_id", "doc_id", "frequency", "score", "rank"),
    "dedup_chunk_id": lambda s, d: fusion.dedup_key(_near(s, d, 30).select("query_id", F.col("doc_id") % 20, "chunk_index", F.col("similarity").alias("score"), "rank").toDF("query_id", "doc_id", "chunk_index", "score", "rank")).select(*HIT),
    "dedup_content_hash": lambda s, d: fusion.dedup_content(V.chunks(s, d, False).select(F.lit(1).alias("query_id"), "doc_id", "chunk_index", F.col("chunk_text").alias("snippet"), "name", F.col("doc_id").alias("rank"))).select("doc_id", "content_hash"),
    "dedup_stats": lambda s, d: (lambda h: fusion.dedup_stats(h, fusion.dedup_content(h)))(V.chunks(s, d, False).select((F.col("doc_id") % 2).alias("query_id"), "doc_id", "chunk_index", F.col("chunk_text").alias("snippet"), "name", F.col("doc_id").alias("rank"))),
    "dedup_semantic": lambda s, d: fusion.dedup_semantic(_ranked(s, d), threshold=0.95).select(*HIT),
    "mmr_topk": lambda s, d: fusion.mmr(_ranked(s, d), top_k=10).select(*HIT),
    "diversity_score": lambda s, d: fusion.diversity(_ranked(s, d)),
    "rerank_order": lambda s, d: fusion.rerank(_ranked(s, d), top_k=20, raw=F.col("score") * 6 - F.col("doc_id") % 3).select(*HIT),
    "rerank_pipeline": lambda s, d: fusion.pipeline(_ranked(s, d), final_top_k=10).select(*HIT),
    "hybrid_reranked": lambda s, d: fusion.hybrid(V.queries(s, d), _stored_chunks(s, d), SearchRequest(query="the of", limit=10, rerank=True)).select(*HIT),
    "multi_query_search": lambda s, d: fusion.multi_query_search(_variations(s, d).where("query_id in (1, 3)"), _variations(s, d).where("query_id in (2, 4)"), _stored_chunks(s, d), BASE),
    "citation_sentences": lambda s, d: E.citation_sentences(V.chunks(s, d, False)).select("doc_id", "rank", "pos", "score", F.sha2("sentence", 256).alias("sentence")),
    "citation_fallback": lambda s, d: E.citation_fallback(V.chunks(s, d, False)).select("doc_id", "pos", "sentence", "confidence"),
    "citation_select": lambda s, d: E.select_citations(_sources(s, d)),
    "quote_matches": lambda s, d: _quotes(s, d),
    "best_quotes": _best_quotes,
    "hallucination_score": lambda s, d: E.hallucination(_judged(s, d)).withColumn("flagged", F.array_join(F.transform("flagged", lambda x: x.cast("string")), ",")),
    "proposition_confidence": lambda s, d: E.proposition_confidence(_judged(s, d)).select("answer_id", "prop", "confidence", F.round("verification_agreement", 6).alias("agreement")),
    "confidence_breakdown": lambda s, d: E.confidence_breakdown(E.proposition_confidence(_judged(s, d))).select("answer_id", "overall", "n_propositions"),
    "answer_confidence": lambda s, d: _sources(s, d).groupBy("answer_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: F.concat(F.lit("[1] "), x["text"]))).alias("answer"), F.avg("score").alias("rel"), F.count("*").alias("n")).select("answer_id", E.answer_confidence(F.col("answer"), F.col("rel"), F.col("n")).alias("confidence")),
    "abstention": lambda s, d: E.abstention(_answers(s, d)).select("answer_id", "should_abstain", "reason", "abstention_confidence", F.array_join("factors", ",").alias("factors"), "message"),
    "profile_sweep": lambda s, d: E.abstention(_answers(s, d).crossJoin(F.broadcast(E.profiles(s))), F.col("low_confidence"), F.col("high_hallucination")).groupBy("level").agg(F.count("*").alias("answers"), F.sum(F.col("should_abstain").cast("int")).alias("abstained"), F.sum((F.col("probability") >= F.col("flag_threshold")).cast("int")).alias("flagged"), F.sum((F.col("strict") & (F.col("probability") > F.col("remove_threshold"))).cast("int")).alias("removed")),
    "inline_citations": lambda s, d: _sources(s, d).select("answer_id", "position", E.inline_citation(F.col("position") + 1, F.col("text"), F.when(F.col("position") % 2 == 0, F.col("position")), True).alias("detailed"), E.inline_citation(F.col("position") + 1, F.col("text"), F.lit(None), False).alias("simple")),
    "highlight": lambda s, d: table(s, d, "benchmark").select("item_id", E.highlight(F.concat(F.lit("<b>"), F.col("text"), F.lit("</b>")), F.substring("text", 5, 20)).alias("marked")),
    "citation_number_check": lambda s, d: _sources(s, d).groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("position")), lambda p: F.concat(F.lit("["), (p * 2).cast("string"), F.lit("]"))), " ").alias("answer"), F.array_sort(F.collect_list(F.col("position").cast("int"))).alias("have")).select("answer_id", E.citation_numbers(F.col("answer"), F.col("have")).alias("c")).select("answer_id", *(F.array_join(F.transform(f"c.{k}", lambda x: x.cast("string")), ",").alias(k) for k in ("missing", "unused"))),
    "context_packing": lambda s, d: E.fit_context(_sources(s, d), max_tokens=400, least_rest=40).select("answer_id", "passage_id", "rank", "truncated", F.length("text").alias("chars")),
    "context_prefix": lambda s, d: E.fit_context(_sources(s, d), max_tokens=400, least_rest=40).where("NOT truncated").select("answer_id", "passage_id", "rank"),
    "verification_questions": lambda s, d: table(s, d, "benchmark").select("item_id", E.question(F.col("text")).alias("question")),
}

_TERMS = "string_split(lower(text), ' ')"
_TOK = "regexp_extract_all(lower(coalesce(chunk_text, '')), '[\\p{L}\\p{N}_]+')"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_CAND = f"terms AS (SELECT query_id, {_TERMS} AS terms FROM queries), tok AS (SELECT *, {_TOK} AS toks FROM chunks), cand AS (SELECT t.*, q.query_id, q.terms FROM tok t JOIN terms q ON list_has_all(t.toks, q.terms))"
_STATS = "stats AS (SELECT count(*) AS n, avg(length(chunk_text)) / 5 AS avgdl FROM chunks WHERE length(chunk_text) > 0)"
_TF = "((length(o.chunk_text) - length(replace(lower(o.chunk_text), o.t, ''))) // length(o.t))"


def _bm25_sql(idf="1.0::DOUBLE", where="TRUE"):
    dl = f"len({_WORDS.format('o.chunk_text')})"
    return f"{V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_CAND}, {_STATS}, df AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS t FROM tok) GROUP BY t), one AS (SELECT c.query_id, c.doc_id, c.chunk_index, c.chunk_text, unnest(c.terms) AS t FROM cand c WHERE {where}), tf AS (SELECT o.query_id, o.doc_id, o.chunk_index, {_TF} AS tf, {dl} AS dl, s.avgdl, {idf} AS idf FROM one o, stats s LEFT JOIN df ON df.t = o.t), bm AS (SELECT query_id, doc_id, chunk_index, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS raw FROM tf GROUP BY 1, 2, 3), bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id, chunk_index) AS rank FROM bm WHERE raw > 0)"


def _page(cte, low, high, base="0.0", scale="1.0"):
    return f"SELECT query_id, doc_id, round({base} + {scale} * raw / max(raw) OVER (PARTITION BY query_id) + 1e-9, 4) AS score, rank FROM {cte} WHERE rank > {low} AND rank <= {high}"


_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def _knn_sql(where="TRUE", limit=10):
    return f"WITH {V.QUERIES_SQL}, s AS (SELECT q.query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.vector')} AS similarity FROM embeddings e, queries q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE {where}) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= {limit}"


_NEARS = f"nears AS (SELECT q.query_id, c.doc_id, c.chunk_index, c.mime_type, c.quality, c.tags, {_COS.format(a='c.embedding', b='q.vector')} AS similarity FROM chunks c, queries q WHERE c.embedding IS NOT NULL), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id, chunk_index) AS rank FROM nears)"


def _rrf_sql(kw="0.5", vw="0.5", n=100):
    return f"rrf AS (SELECT query_id, doc_id, doc_id || '_' || chunk_index AS key, a.rank AS keyword_rank, b.rank AS vector_rank, coalesce({kw}::DOUBLE / (60 + a.rank), 0) + coalesce({vw}::DOUBLE / (60 + b.rank), 0) AS raw FROM (SELECT * FROM bmr WHERE rank <= {n}) a FULL JOIN (SELECT * FROM near WHERE rank <= {n}) b USING (query_id, doc_id, chunk_index)), fused AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id) + 1e-9, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, key) AS rank FROM rrf)"


_HYBRID = f"WITH {_bm25_sql()}, {_NEARS}, "
_AGREE = "CASE WHEN verification IS NULL OR verification = '' THEN 0.5 WHEN contains(lower(verification), 'incorrect') OR contains(lower(verification), 'false') OR contains(lower(verification), 'not mentioned') OR regexp_matches(lower(verification), '\\bno\\b') THEN 0.0 WHEN contains(lower(verification), 'yes') OR contains(lower(verification), 'correct') OR contains(lower(verification), 'true') OR contains(lower(verification), 'confirmed') THEN 1.0 WHEN contains(lower(verification), 'cannot determine') OR contains(lower(verification), 'unsure') OR contains(lower(verification), 'unclear') THEN 0.5 ELSE least(1.0::DOUBLE, 2 * len(list_intersect(list_distinct({w}), list_distinct({v}))) / greatest(len(list_distinct({w})), 1)::DOUBLE) END".format(w=_WORDS.format("lower(text)"), v=_WORDS.format("lower(verification)"))
_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), '\\s+', ' ', 'g'))"
_OVERLAP = "(len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1)::DOUBLE)"
_DENY = " OR ".join(f"contains(lower(verification), '{x}')" for x in E.DENIALS)
_HALL = f"h0 AS (SELECT *, list_distinct({_WORDS.format(_NORM.format('text'))}) AS x, list_distinct({_WORDS.format(_NORM.format('verification'))}) AS y FROM judged), hall AS (SELECT answer_id, least(1.0::DOUBLE, round(sum(CASE WHEN n_quotes = 0 THEN 0.5::DOUBLE ELSE (CASE WHEN verification IS NULL THEN 0.0::DOUBLE WHEN {_DENY} THEN 0.3::DOUBLE WHEN {_OVERLAP} < 0.3 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN contradicts THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) END), 6)) AS probability, coalesce(string_agg(CASE WHEN n_quotes = 0 THEN prop::VARCHAR END, ',' ORDER BY prop), '') AS flagged, sum(n_quotes) AS n_quotes FROM h0 GROUP BY answer_id)"
_CONF = f"conf AS (SELECT answer_id, prop, {_AGREE} AS agreement, round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.40::DOUBLE * relevance + 0.35::DOUBLE * quote + 0.15::DOUBLE * ({_AGREE}) + 0.10::DOUBLE * least(1.0::DOUBLE, n_citations / 3.0::DOUBLE))), 9) + 1e-9, 3) AS confidence FROM judged), over_all AS (SELECT answer_id, round(round(avg(confidence), 9) + 1e-9, 3) AS overall, count(*) AS n_propositions FROM conf GROUP BY answer_id)"
_ANSWERS = f"WITH {_JUDGED}, {_HALL}, {_CONF}, answers AS (SELECT h.answer_id, h.probability, h.n_quotes, greatest(0.0::DOUBLE, least(1.0::DOUBLE, o.overall + round(0 - h.probability / 2, 2))) AS verified_confidence FROM hall h JOIN over_all o USING (answer_id))"
_FACTORS = "concat_ws(',', CASE WHEN verified_confidence < {low} THEN 'low_confidence' END, CASE WHEN probability > {high} THEN 'high_hallucination' END, CASE WHEN n_quotes = 0 THEN 'no_evidence' END)"
_PROFILES = ", ".join(f"('{p[0]}', {p[3]}::DOUBLE, {p[4]}::DOUBLE, {p[5]}::DOUBLE, {p[6]}::DOUBLE, {str(p[8]).lower()})" for p in E.PROFILES)
_CSENT = "list_filter(list_transform(regexp_extract_all(chunk_text, '[^.!?]+[.!?]*'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"

_ASKED = f"asked AS (SELECT item_id AS query_id, list_distinct(list_slice({_TOK.replace('chunk_text', 'text')}, 1, 3)) AS terms FROM benchmark), each AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM asked), tok AS (SELECT *, {_TOK} AS toks FROM chunks), w AS (SELECT doc_id, chunk_index, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS place FROM tok), hit AS (SELECT e.query_id, e.n, w.* FROM w JOIN each e USING (term)), whole AS (SELECT query_id, doc_id, chunk_index, max(n) AS n FROM hit GROUP BY ALL HAVING count(DISTINCT term) = max(n))"
_NEARNESS = "CASE WHEN abs(a.place - b.place) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.place - b.place) / 1.5::DOUBLE - 2)) END"
_FULLTEXT = f"WITH {V.CHUNKS_SQL}, {_ASKED}, p AS (SELECT h.query_id, h.doc_id, h.chunk_index, h.n, h.term, h.place, row_number() OVER (PARTITION BY h.query_id, h.doc_id, h.chunk_index, h.term ORDER BY h.place) AS k FROM hit h JOIN whole USING (query_id, doc_id, chunk_index)), f AS (SELECT * FROM p WHERE k <= 256), one AS (SELECT query_id, doc_id, chunk_index, 0.1::DOUBLE / 1.64493406685::DOUBLE * sum(1 / (k * k)::DOUBLE) AS raw FROM f WHERE n = 1 GROUP BY ALL), several AS (SELECT a.query_id, a.doc_id, a.chunk_index, 1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt({_NEARNESS})))) AS raw FROM f a JOIN f b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND a.term < b.term GROUP BY ALL), both_ AS (SELECT query_id, doc_id, chunk_index, round(raw, 9) AS raw FROM (SELECT * FROM one UNION ALL SELECT * FROM several)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id, chunk_index) AS rank FROM both_)"

SQL = {
    "fulltext_simple": _FULLTEXT + " " + _page("r", 0, 10, "0.6::DOUBLE", "0.4::DOUBLE").replace("doc_id,", "doc_id, chunk_index,", 1),
    "fulltext_filtered": f"WITH {V.CHUNKS_SQL}, {_ASKED} SELECT query_id, count(*) AS matches FROM whole JOIN chunks c USING (doc_id, chunk_index) WHERE c.mime_type IN ('text/plain', 'text/csv') AND c.quality >= 0.05 AND list_has_any(c.tags, ['en', 'de']) GROUP BY query_id",
    "keyword_search": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_CAND}, r AS (SELECT query_id, doc_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id, chunk_index) AS rank FROM (SELECT query_id, doc_id, chunk_index, len(list_filter(toks, lambda w: list_contains(terms, w)))::DOUBLE AS raw FROM cand)) " + _page("r", 0, 20, "0.6::DOUBLE", "0.4::DOUBLE"),
    "keyword_count": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_CAND} SELECT query_id, count(*) AS matches FROM cand GROUP BY query_id",
    "keyword_search_docs": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {V.TEXTS_SQL}, terms AS (SELECT query_id, {_TERMS} AS terms FROM queries), pool AS (SELECT doc_id, -1 AS chunk_index, text AS chunk_text, 0 AS part FROM texts UNION ALL SELECT doc_id, chunk_index, chunk_text, 1 FROM chunks), tok AS (SELECT *, {_TOK} AS toks FROM pool), r AS (SELECT query_id, part, doc_id, chunk_index, raw, row_number() OVER (PARTITION BY query_id, part ORDER BY raw DESC, doc_id, chunk_index) AS rank FROM (SELECT q.query_id, t.part, t.doc_id, t.chunk_index, len(list_filter(t.toks, lambda w: list_contains(q.terms, w)))::DOUBLE AS raw FROM tok t JOIN terms q ON list_has_all(t.toks, q.terms))), p AS (SELECT *, round(0.6::DOUBLE + 0.4::DOUBLE * raw / max(raw) OVER (PARTITION BY query_id, part), 4) AS score FROM r WHERE rank <= 10), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, part, chunk_index) AS rn FROM p), f AS (SELECT query_id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o WHERE rn = 1) SELECT * FROM f WHERE rank <= 10",
    "bm25_topk": f"WITH {_bm25_sql()} " + _page("bmr", 0, 20),
    "bm25_page2": f"WITH {_bm25_sql()} " + _page("bmr", 10, 20),
    "bm25_filtered": f"WITH {_bm25_sql(where="c.mime_type IN ('text/plain', 'text/csv') AND c.quality >= 0.05 AND list_has_any(c.tags, ['en', 'de'])")} " + _page("bmr", 0, 10),
    "bm25_robertson_topk": f"WITH {_bm25_sql(idf='greatest(0.0::DOUBLE, ln((s.n - coalesce(df.df, 0) + 0.5::DOUBLE) / (coalesce(df.df, 0) + 0.5::DOUBLE) + 1))')} " + _page("bmr", 0, 20),
    "knn_topk": _knn_sql(),
    "knn_threshold": _knn_sql("similarity > 0.2", 50),
    "knn_filtered": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_NEARS}, r AS (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id, chunk_index) AS rank FROM nears WHERE mime_type IN ('text/plain', 'text/csv') AND quality >= 0.05 AND list_has_any(tags, ['en', 'de'])) SELECT * FROM r WHERE rank <= 10",
    "knn_batch": f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 5",
    "embedding_coverage": f"WITH {V.CHUNKS_SQL} SELECT count(*) AS chunks, count(embedding) AS with_vector, round(100.0::DOUBLE * count(embedding) / count(*), 2) AS percent, round(100.0::DOUBLE * count(embedding) / count(*), 2) >= 80 AS valid FROM chunks",
    "embedding_dims": "SELECT 'default' AS model, CAST(len(embedding) AS INTEGER) AS dims, count(*) AS vectors, len(embedding) <> 1024 AS mismatch FROM embeddings GROUP BY len(embedding)",
    "invalid_vectors": "SELECT vec_id, len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 AS invalid FROM embeddings",
    "rrf_fuse": _HYBRID + _rrf_sql() + " SELECT query_id, key, keyword_rank, vector_rank, score, rank FROM fused",
    "hybrid_search": _HYBRID + _rrf_sql() + " SELECT query_id, doc_id, keyword_rank, vector_rank, score, rank FROM fused WHERE rank <= 10",
    "hybrid_page2": _HYBRID + _rrf_sql("0.7", "0.3") + " SELECT query_id, doc_id, score, rank FROM fused WHERE rank > 10 AND rank <= 20",
    "multi_query_fuse": f"WITH {_bm25_sql()}, g AS (SELECT CASE WHEN query_id <= 2 THEN 1 ELSE 2 END AS group_id, * FROM bmr WHERE rank <= 30), a AS (SELECT group_id, doc_id, chunk_index, count(*) AS frequency, round(count(*) * 2.0::DOUBLE + avg(1 / (rank + 60)::DOUBLE), 12) AS raw, min(row(query_id, rank)) AS first FROM g GROUP BY 1, 2, 3), r AS (SELECT group_id, doc_id, frequency, round(raw / max(raw) OVER (PARTITION BY group_id), 6) AS score, row_number() OVER (PARTITION BY group_id ORDER BY raw DESC, first) AS rank FROM a) SELECT * FROM r WHERE rank <= 20",
    "dedup_chunk_id": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_NEARS}, k AS (SELECT query_id, doc_id % 20 AS doc_id, chunk_index, similarity AS score, rank FROM near WHERE rank <= 30), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index ORDER BY score DESC, rank) AS rn, min(rank) OVER (PARTITION BY query_id, doc_id, chunk_index) AS place FROM k) SELECT query_id, doc_id, score, place AS rank FROM b WHERE rn = 1",
    "dedup_content_hash": f"WITH {V.CHUNKS_SQL}, h AS (SELECT doc_id, sha256(lower(trim(regexp_replace(chunk_text, '\\s+', ' ', 'g')))) AS content_hash FROM chunks) SELECT min(doc_id) AS doc_id, content_hash FROM h GROUP BY content_hash",
    "dedup_stats": f"WITH {V.CHUNKS_SQL}, h AS (SELECT doc_id % 2 AS query_id, sha256(lower(trim(regexp_replace(chunk_text, '\\s+', ' ', 'g')))) AS h FROM chunks) SELECT query_id, count(*) AS original, count(DISTINCT h) AS kept, count(*) - count(DISTINCT h) AS removed, round((count(*) - count(DISTINCT h)) / count(*)::DOUBLE, 4) AS rate FROM h GROUP BY query_id",
    "diversity_score": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_NEARS}, v AS (SELECT n.query_id, n.rank, CAST(c.embedding AS DOUBLE[]) AS v FROM near n JOIN chunks c USING (doc_id, chunk_index) WHERE n.rank <= 60) SELECT a.query_id, round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM v a JOIN v b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id",
    "rerank_order": f"WITH {V.CHUNKS_SQL}, {V.QUERIES_SQL}, {_NEARS}, s AS (SELECT query_id, doc_id, round(1 / (1 + exp(-(similarity * 6 - doc_id % 3))), 4) AS score, rank AS old FROM near WHERE rank <= 60), r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM s) SELECT * FROM r WHERE rank <= 20",
    "citation_sentences": f"WITH {V.CHUNKS_SQL}, s AS (SELECT doc_id, chunk_index, {_CSENT} AS s FROM chunks), p AS (SELECT doc_id, chunk_index, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM s), n AS (SELECT *, len({_WORDS.format('sentence')}) AS n FROM p), c AS (SELECT doc_id, chunk_index, pos, sentence, round((CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN n BETWEEN 15 AND 30 THEN 0.1::DOUBLE WHEN n BETWEEN 10 AND 40 THEN 0.05::DOUBLE ELSE 0 END), 2) AS score FROM n WHERE n BETWEEN 10 AND 50), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY score DESC, pos) AS rank FROM c) SELECT doc_id, rank, CAST(pos AS INTEGER) AS pos, score, sha256(CASE WHEN length(sentence) > 500 THEN substr(sentence, 1, 497) || '...' ELSE sentence END) AS sentence FROM r WHERE rank <= 3",
    "citation_fallback": f"WITH {V.CHUNKS_SQL}, s AS (SELECT doc_id, list_slice(string_split(chunk_text, '. '), 1, 3) AS s FROM chunks), p AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS x FROM s), b AS (SELECT doc_id, pos, trim(x) || CASE WHEN x LIKE '%.' THEN '' ELSE '.' END AS b FROM p WHERE len({_WORDS.format('x')}) >= 10) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN length(b) > 500 THEN substr(b, 1, 497) || '...' ELSE b END AS sentence, 0.5::DOUBLE AS confidence FROM b",
    "citation_select": f"WITH {_SOURCES}, q AS (SELECT *, CASE WHEN score >= 0.8 THEN 'STRONG' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'WEAK' END AS quality FROM sources), c AS (SELECT *, sum((quality = 'STRONG')::INT) OVER w AS strong, sum((quality = 'MEDIUM')::INT) OVER w AS medium, sum((quality = 'WEAK' AND score >= 0.4)::INT) OVER (PARTITION BY answer_id ORDER BY position, passage_id) AS weak_no, row_number() OVER (PARTITION BY answer_id ORDER BY position, passage_id) AS pos FROM q WINDOW w AS (PARTITION BY answer_id)), k AS (SELECT *, quality = 'STRONG' OR (quality = 'MEDIUM' AND strong < 3) OR (quality = 'WEAK' AND score >= 0.4 AND weak_no <= 3 - (CASE WHEN strong < 3 THEN strong + medium ELSE strong END)) AS keep FROM c), a AS (SELECT *, bool_or(keep) OVER (PARTITION BY answer_id) AS any_kept FROM k) SELECT answer_id, passage_id, score, quality, row_number() OVER (PARTITION BY answer_id ORDER BY CASE quality WHEN 'STRONG' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, position, passage_id) AS citation_number FROM a WHERE keep OR (NOT any_kept AND pos = 1)",
    "hallucination_score": f"WITH {_JUDGED}, {_HALL} SELECT answer_id, probability, flagged, round(0 - probability / 2, 2) AS confidence_adjustment FROM hall",
    "proposition_confidence": f"WITH {_JUDGED}, {_CONF} SELECT answer_id, prop, confidence, round(agreement::DOUBLE, 6) AS agreement FROM conf",
    "confidence_breakdown": f"WITH {_JUDGED}, {_CONF} SELECT answer_id, overall, n_propositions FROM over_all",
    "answer_confidence": f"WITH {_SOURCES}, a AS (SELECT answer_id, string_agg('[1] ' || text, ' ' ORDER BY position, text) AS answer, avg(score) AS rel, count(*) AS n FROM sources GROUP BY answer_id), w AS (SELECT *, len({_WORDS.format('answer')}) AS words, len(regexp_extract_all(answer, '\\[\\d+\\]')) AS marks FROM a) SELECT answer_id, round(round(least(least(marks / greatest(n, 1)::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * rel) + rel * 0.5::DOUBLE + CASE WHEN words >= 50 THEN 0.2::DOUBLE WHEN words >= 20 THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END, 1.0::DOUBLE), 9) + 1e-9, 2) AS confidence FROM w",
    "abstention": _ANSWERS + f", f AS (SELECT answer_id, {_FACTORS.format(low='0.30::DOUBLE', high='0.70::DOUBLE')} AS factors FROM answers), r AS (SELECT *, CASE WHEN contains(factors, 'high_hallucination') THEN 'high_hallucination' WHEN contains(factors, 'low_confidence') THEN 'low_confidence' WHEN contains(factors, 'no_evidence') THEN 'no_evidence' END AS reason, CASE WHEN factors = '' THEN 0 ELSE len(string_split(factors, ',')) END AS n FROM f) SELECT answer_id, n > 0 AS should_abstain, reason, CASE WHEN n >= 3 THEN 1.0::DOUBLE WHEN n = 2 THEN 0.8::DOUBLE WHEN n = 1 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS abstention_confidence, factors, CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.MESSAGES.items()) + " END AS message FROM r",
    "profile_sweep": _ANSWERS + f", p AS (SELECT * FROM (VALUES {_PROFILES}) p(level, flag, remove, low, high, strict)) SELECT level, count(*) AS answers, CAST(sum((verified_confidence < low OR probability > high OR n_quotes = 0)::INT) AS BIGINT) AS abstained, CAST(sum((probability >= flag)::INT) AS BIGINT) AS flagged, CAST(sum((strict AND probability > remove)::INT) AS BIGINT) AS removed FROM answers, p GROUP BY level",
    "inline_citations": f"WITH {_SOURCES} SELECT answer_id, position, '[' || (position + 1) || ': ' || CASE WHEN length(text) > 30 THEN substr(text, 1, 27) || '...' ELSE text END || CASE WHEN position % 2 = 0 THEN ', p.' || position ELSE '' END || ']' AS detailed, '[' || (position + 1) || ']' AS simple FROM sources",
    "citation_number_check": f"WITH {_SOURCES}, h AS (SELECT answer_id, list(position ORDER BY position) AS have, list(position * 2 ORDER BY position) AS used FROM sources GROUP BY answer_id) SELECT answer_id, array_to_string(list_sort(list_filter(used, lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(used, x))), ',') AS unused FROM h",
    "context_prefix": f"WITH {_SOURCES}, t AS (SELECT answer_id, passage_id, sum(CAST(ceil(length(text) / 4.0) AS INTEGER)) OVER w AS upto, row_number() OVER w AS rank FROM sources WINDOW w AS (PARTITION BY answer_id ORDER BY score DESC, passage_id)) SELECT answer_id, passage_id, rank FROM t WHERE upto <= 400",
}

_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
SQL |= {
    "highlight": f"WITH e AS (SELECT item_id, {_ESC.format("'<b>' || text || '</b>'")} AS t, {_ESC.format('substr(text, 5, 20)')} AS p FROM benchmark), a AS (SELECT *, strpos(lower(t), lower(p)) AS hit FROM e) SELECT item_id, CASE WHEN hit > 0 AND length(p) > 0 THEN substr(t, 1, hit - 1) || '<mark>' || substr(t, hit, length(p)) || '</mark>' || substr(t, hit + length(p)) ELSE t END AS marked FROM a",
    "verification_questions": "SELECT item_id, CASE WHEN regexp_matches(lower(text), '[0-9]') THEN 'Which figure do the sources give: ' WHEN regexp_matches(lower(text), '\\b(because|due to|causes?)\\b') THEN 'Do the sources name this cause: ' WHEN substr(md5(text), 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'Is it stated that ' ELSE 'Do the sources confirm: ' END || text || '?' AS question FROM benchmark",
    "snippet_bm25": f"""WITH {V.CHUNKS_SQL}, t AS (SELECT doc_id, chunk_text, length(chunk_text) AS n, strpos(lower(chunk_text), 'thin') AS a, strpos(lower(chunk_text), 'and') AS b FROM chunks),
        p AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a > 0 THEN a WHEN b > 0 THEN b END AS hit FROM t),
        w AS (SELECT *, CASE WHEN hit IS NULL THEN substr(chunk_text, 1, 300) ELSE substr(chunk_text, greatest(hit - 100, 1), least(hit + 200, n + 1) - greatest(hit - 100, 1)) END AS w FROM p),
        m AS (SELECT doc_id, trim(regexp_replace(CASE WHEN hit - 100 > 1 THEN '...' ELSE '' END || regexp_replace(regexp_replace(w, '(?i)thin', '**thin**', 'g'), '(?i)and', '**and**', 'g') || CASE WHEN hit + 200 <= n THEN '...' ELSE '' END, '\\s+', ' ', 'g')) AS m FROM w)
        SELECT doc_id, CASE WHEN length(m) > 300 THEN substr(m, 1, 300) || '...' ELSE m END AS snippet FROM m""",
    "context_packing": f"""WITH {_SOURCES}, t AS (SELECT *, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM sources), u AS (SELECT *, sum(tokens) OVER w AS upto, row_number() OVER w AS rank FROM t WINDOW w AS (PARTITION BY answer_id ORDER BY score DESC, passage_id)),
        k AS (SELECT *, min(CASE WHEN upto > 400 THEN rank END) OVER (PARTITION BY answer_id) AS broken, 400 - (upto - tokens) AS rest FROM u),
        s AS (SELECT answer_id, passage_id, rank, rest, {_CSENT.replace('chunk_text', 'text')} AS s FROM k WHERE rank = broken AND rest > 40),
        p AS (SELECT answer_id, passage_id, rank, rest, unnest(range(0, len(s))) AS n, unnest(s) AS x FROM s),
        c AS (SELECT *, sum(CAST(ceil(length(x) / 4.0) AS INTEGER)) OVER (PARTITION BY answer_id, passage_id ORDER BY n) AS upto FROM p)
        SELECT answer_id, passage_id, rank, FALSE AS truncated, length(text) AS chars FROM k WHERE upto <= 400 AND (broken IS NULL OR rank < broken) UNION ALL SELECT answer_id, passage_id, rank, TRUE, sum(length(x)) + count(*) - 1 FROM c WHERE upto <= rest GROUP BY answer_id, passage_id, rank""",
}
