"""Registered queries over texts, profiles, structure and chunks, with their SQL."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import profile as P
from ..functions import structure as S
from ..functions import text as T
from ..operators import analytics as A
from ..operators import chunking as C
from ..operators import counts as N
from ..operators import intervals as I
from ..operators import sentences as B
from ..session import spread, table
from . import views as V


def _t() -> Column:
    return F.col("text")



def _texts(s, d, *columns):
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", *columns)


def _range_bits(df):
    """Ranges for counting n-grams, as a power of 2: one for each 2 to 4 MB of the optimizer's estimate, a million n-grams or less."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(20, max(2, (size >> 22).bit_length()))


def _quality(s, d):
    return V.texts(s, d).withColumn("quality", P.extraction_quality(_t(), F.col("ocr_pages"), F.col("pages")))


def _metadata(s, d):
    scores = F.create_map(F.lit("title"), F.lit(0.9), F.lit("language"), F.col("quality"))
    name = F.col("name")
    return V.docs(s, d).select("doc_id", P.title(_t(), name).alias("title"), F.when(F.col("doc_id") % 19 != 0, F.col("lang")).alias("language"), P.page_estimate(_t()).alias("pages"), T.word_count(_t()).alias("n_words"), "quality", scores.alias("scores"), F.array("lang").alias("keywords"))


def _chunked(s, d):
    docs = spread(table(s, d, "documents").select("doc_id", "text"))
    return C.with_flags(C.chunk_texts(docs), C.document_spans(docs))


QUERIES = {
    "normalize_text": lambda s, d: _texts(s, d, F.sha2(T.normalize(_t()), 256).alias("normalized")),
    "word_ngrams": lambda s, d: N.frequent(_texts(s, d, F.explode(T.ngrams(_t(), 3)).alias("gram")), "gram", 10, range_bits=_range_bits(table(s, d, "documents"))),
    "jaccard_overlap": lambda s, d: A.overlaps(_texts(s, d, _t()), table(s, d, "benchmark"), "doc_id", "item_id", least=0.3),
    "strip_citations": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.strip_citations(F.concat(F.col("text"), F.lit(" [12] end [3]"))).alias("stripped")),
    "propositions": lambda s, d: _texts(s, d, F.posexplode(T.propositions(_t())).alias("pos", "proposition")),
    "answer_propositions": lambda s, d: table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.answer_propositions(_t())).alias("prop", "claim")),
    "query_terms": lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.query_terms(_t()), " ").alias("terms")),
    "keywords_top20": lambda s, d: A.keywords(_texts(s, d, _t())),
    "language_vote": lambda s, d: _texts(s, d, P.language_vote(_t()).alias("language")),
    "doc_type_rule": lambda s, d: V.docs(s, d).select("doc_id", P.document_type(F.concat(F.lit("file_"), F.col("source")), F.col("mime_type"), _t()).alias("kind")),
    "title_rule": lambda s, d: V.docs(s, d).select("doc_id", P.title(_t(), F.col("name")).alias("title")),
    "table_detect": lambda s, d: V.docs(s, d).select("doc_id", P.has_table(_t(), F.col("mime_type")).alias("has_table")),
    "fallback_quality": lambda s, d: _texts(s, d, P.fallback_quality(_t()).alias("score"), T.regex_word_count(_t()).alias("words"), P.page_estimate(_t()).alias("pages")).select("doc_id", P.round_scaled(F.col("score"), 6).alias("score"), P.band(F.col("score"), P.FALLBACK_BANDS).alias("band"), "words", "pages"),
    "headings": lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(S.caps_headings(_capitals(F.regexp_replace("html", "[<>.,]", "\n")))).alias("pos", "heading")),
    "lists": lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(S.list_items(F.replace(F.replace("html", F.lit("<li>"), F.lit("\n- ")), F.lit("</li>"), F.lit("\n")))).alias("pos", "item")),
    "citations_regex": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(S.citation_marks(F.concat(F.col("text"), F.lit(" [1] (Smith and Jones, 2020) [22]"))), "|").alias("marks")),
    "path_normalize": lambda s, d: table(s, d, "pages").groupBy(T.normalize_path(F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)).alias("path")).agg(F.count("*").alias("pages")),
    "sentences": lambda s, d: _texts(s, d, F.posexplode(T.sentences(_t())).alias("pos", "sentence")).select("doc_id", "pos", F.length("sentence").alias("chars"), F.sha2("sentence", 256).alias("hash")),
    "sentence_kinds": lambda s, d: _texts(s, d, F.posexplode(T.sentences(_t())).alias("pos", "sentence")).withColumn("sentence", _shown()).select("doc_id", "pos", T.is_heading(F.col("sentence")).alias("heading"), T.is_list_item(F.col("sentence")).alias("list_item")).where("heading OR list_item"),
    "snippet_plain": lambda s, d: _texts(s, d, T.snippet_plain(_t()).alias("snippet")),
    "rag_prompt": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.sha2(T.rag_prompt(F.lit("What is said?"), F.transform("t", lambda x: x["text"])), 256).alias("prompt")),
    "extraction_quality": lambda s, d: _quality(s, d).select("doc_id", "quality"),
    "extraction_report": lambda s, d: A.extraction_report(V.docs(s, d), _quality(s, d)).withColumn("issues", F.array_join("issues", ",")),
    "metadata_completeness": lambda s, d: _metadata(s, d).select("doc_id", F.round(P.completeness(F.col("title").isNotNull(), F.col("language").isNotNull(), F.col("pages").isNotNull(), F.col("n_words").isNotNull(), F.col("quality").isNotNull()), 4).alias("completeness"), P.is_complete(F.col("title"), F.col("language"), F.col("pages"), F.col("n_words")).alias("is_complete"), F.round(P.mean_score(P.clamp_scores(F.col("scores"))), 4).alias("mean_confidence")),
    "metadata_violations": lambda s, d: _metadata(s, d).select("doc_id", F.array_join(P.metadata_errors(F.col("title"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("keywords"), F.col("pages"), F.col("n_words"), F.col("quality"), F.col("scores")), ",").alias("errors"), F.array_join(P.metadata_warnings(F.col("title"), F.col("keywords"), F.col("language"), F.col("pages"), F.col("n_words"), F.col("quality"), F.lit("high"), F.col("scores")), ",").alias("warnings")),
    "merge_metadata": lambda s, d: V.docs(s, d).select("doc_id", F.from_json(P.merge_json(F.col("metadata"), F.concat(F.lit('{"lang":"xx","n":"'), F.col("doc_id"), F.lit('"}'))), "map<string,string>").alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"), F.col("m")["n"].alias("n")),
    "chunks_greedy": lambda s, d: C.chunk_texts(spread(table(s, d, "documents").select("doc_id", "text"))),
    "chunk_flags": lambda s, d: _chunked(s, d).drop("chunk_text"),
    "chunk_scores": lambda s, d: C.rule_score(_chunked(s, d)).join(C.weighted_score(_chunked(s, d)), "doc_id"),
    "chunk_token_histogram": lambda s, d: A.histogram(C.chunk_texts(spread(table(s, d, "documents").select("doc_id", "text"))), "token_count", A.CHUNK_TOKEN_BUCKETS),
    "learned_sentences": lambda s, d: (lambda docs: B.split(docs, B.learn(docs), texts=False))(spread(table(s, d, "documents").select("doc_id", "text"))),
    "span_overlaps": lambda s, d: span_overlaps(s, d),
    "figure_before": lambda s, d: figure_before(s, d),
    "chunk_adjacent_overlap": lambda s, d: adjacent(sentence_spans(s, d)),
    "chunk_quality_report": lambda s, d: A.chunking_report(C.chunk_texts(spread(table(s, d, "documents").select("doc_id", "text"))), V.texts(s, d)).withColumn("issues", F.array_join("issues", ",")),
    "search_readiness": lambda s, d: A.search_readiness(A.extraction_report(V.docs(s, d), _quality(s, d)), A.chunking_report(one_chunk(s, d), V.texts(s, d))),
    "readiness_rollup": lambda s, d: A.readiness_rollup(A.search_readiness(A.extraction_report(V.docs(s, d), _quality(s, d)), A.chunking_report(one_chunk(s, d), V.texts(s, d)))),
    "document_structure": lambda s, d: S.extract(table(s, d, "pages"), id_col="page_id", text_col="html").select("doc_id", F.explode("spans").alias("x")).groupBy("doc_id", "x.kind").agg(F.count("*").alias("n")),
}


def _capitals(text):
    """a-z as capitals; engines differ in other letters."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def _shown():
    """Sentences as a page might set them: some as capital lines without a closing mark, some as list items."""
    x, k = F.col("sentence"), F.col("pos") % 3
    return F.when(k == 0, _capitals(F.rtrim(x, F.lit(".!?")))).when(k == 1, F.concat(F.lit("2) "), x)).otherwise(x)


def sentence_spans(s, d):
    """Sentences with their places, as chunks of one sentence."""
    found = F.regexp_extract_all(_t(), F.lit(r"([^.!?]+[.!?]*)"))
    upto = F.aggregate(found, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    return _texts(s, d, F.posexplode(F.arrays_zip(F.slice(upto, 1, F.size(found)).alias("start_position"), found.alias("chunk_text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.start_position", (F.col("c.start_position") + F.length("c.chunk_text")).alias("end_position"))


def windows(s, d):
    """Windows of 2 000 characters of each text, as closed intervals."""
    last = F.greatest(F.lit(0), F.ceil(F.length(_t()) / V.CHUNK) - 1).cast("int")
    one = _texts(s, d, F.length(_t()).alias("chars"), F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return one.select("doc_id", "window", (F.col("window") * V.CHUNK).alias("start"), (F.least((F.col("window") + 1) * V.CHUNK, F.col("chars")) - 1).alias("end"))


def span_overlaps(s, d):
    """How many sentences touch each window, and the first and last of them."""
    sents = sentence_spans(s, d).select("doc_id", F.col("chunk_index").alias("sentence"), F.col("start_position").alias("from"), (F.col("end_position") - 1).alias("to"))
    return I.overlapping(windows(s, d), sents, ["doc_id"], width=V.CHUNK).groupBy("doc_id", "window").agg(F.count("*").alias("sentences"), F.min("sentence").alias("first"), F.max("sentence").alias("last"))


def figure_before(s, d):
    """The last sentence with a digit that starts before each window."""
    found = F.regexp_extract_all(_t(), F.lit(r"([^.!?]+[.!?]*)"))
    upto = F.aggregate(found, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    sents = _texts(s, d, F.posexplode(F.arrays_zip(F.slice(upto, 1, F.size(found)).alias("mark_at"), found.alias("sentence"))).alias("mark", "c"))
    marks = sents.where(F.col("c.sentence").rlike("[0-9]")).select("doc_id", "mark", "c.mark_at")
    return I.last_before(windows(s, d), marks, ["doc_id"], at="start", width=10_000).select("doc_id", "window", "mark")


def adjacent(chunks):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    gaps = chunks.withColumn("overlap", F.col("end_position") - F.lead("start_position").over(w)).where("overlap is not null")
    return gaps.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("overlap"), F.max("end_position").alias("last_end"))


def one_chunk(s, d):
    """Each document's text as one chunk."""
    shown = V.docs(s, d).where("status = 'completed' AND NOT is_deleted")
    return shown.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text")).select("doc_id", "chunk_index", "chunk_text", F.lit(0).alias("start_position"), F.length("chunk_text").alias("end_position"))


_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_NORM = _COLLAPSE.format("regexp_replace(lower({}), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')")
_SENT = "list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: " + _COLLAPSE.format("x") + "), lambda x: x <> '')"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
_CAPITALS = f"translate({{}}, '{string.ascii_lowercase}', '{string.ascii_uppercase}')"
_UW = "[\\p{L}\\p{N}_]+"


_WINDOWS = "w AS (SELECT doc_id, CAST(k AS INTEGER) AS window, k * 2000 AS lo, least((k + 1) * 2000, n) - 1 AS hi FROM (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(greatest(1, ceil(length(text) / 2000.0)) AS BIGINT))) AS k FROM documents)), s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM documents), p AS (SELECT doc_id, unnest(range(0, len(s))) AS k, unnest(s) AS x FROM s), e AS (SELECT doc_id, k, sum(length(x)) OVER o - length(x) AS lo, sum(length(x)) OVER o - 1 AS hi, regexp_matches(x, '[0-9]') AS figure FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY k))"


def _contains(words):
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


_VOTE = f"SELECT doc_id, length(text) AS n, {_contains(P.LANGUAGE_WORDS['en'])} AS en, {_contains(P.LANGUAGE_WORDS['es'])} AS es, {_contains(P.LANGUAGE_WORDS['fr'])} AS fr FROM documents"
_MEAN = f"(list_sum(list_transform({_WORDS.format('text')}, lambda x: length(x))) / greatest(len({_WORDS.format('text')}), 1)::DOUBLE)"
_QUALITY = f"round(least((CASE WHEN length(text) > 1000 THEN 0.3::DOUBLE WHEN length(text) > 100 THEN 0.15::DOUBLE ELSE 0 END) + 0.4::DOUBLE * (1 - ocr_pages / pages::DOUBLE) + (CASE WHEN {_MEAN} > 3 AND {_MEAN} < 10 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN length(text) - length(translate(text, '.,;:!?', '')) > 0.01::DOUBLE * length(text) THEN 0.15::DOUBLE ELSE 0 END), 1.0::DOUBLE), 4)"
_REPORT = f"""q AS (SELECT doc_id, text_length, {_QUALITY} AS quality, ocr_pages, pages, language FROM texts),
    x AS (SELECT d.doc_id, coalesce(q.text_length, 0) AS text_length, q.quality, q.text_length IS NULL AS none, q.ocr_pages, q.pages, q.language FROM docs d LEFT JOIN q USING (doc_id)),
    extraction AS (SELECT doc_id, text_length, quality, concat_ws(',', CASE WHEN none THEN 'no text' END, CASE WHEN NOT none AND text_length = 0 THEN 'empty text' END, CASE WHEN text_length BETWEEN 1 AND 49 THEN 'short text' END, CASE WHEN quality < 0.5 THEN 'low quality' END, CASE WHEN NOT none AND quality IS NULL THEN 'no quality' END, CASE WHEN ocr_pages > 0.5 * pages THEN 'much OCR' END, CASE WHEN NOT none AND language IS NULL THEN 'no language' END) AS issues,
      CASE WHEN none OR quality < 0.5 THEN 'failed' WHEN quality IS NULL OR text_length BETWEEN 1 AND 49 THEN 'warning' WHEN text_length = 0 THEN 'failed' ELSE 'passed' END AS status FROM x)"""
_READY = f"""WITH {V.DOCS_SQL}, whole AS (SELECT doc_id, text AS chunk_text FROM docs WHERE status = 'completed' AND NOT is_deleted), {V.TEXTS_SQL}, {_REPORT},
    chunking AS (SELECT c.doc_id, 1 AS chunks, CASE WHEN t.text_length > 0 AND 1 < t.text_length / 800.0 * 0.5 THEN 'warning' WHEN length(c.chunk_text) NOT BETWEEN 100 AND 1500 THEN 'warning' ELSE 'passed' END AS status FROM whole c LEFT JOIN texts t USING (doc_id)),
    ready AS (SELECT e.doc_id, e.status AS extraction_status, coalesce(c.status, 'failed') AS chunking_status, list_filter([CASE WHEN e.quality > 0 THEN e.quality END, CASE WHEN e.text_length > 0 THEN least(e.text_length / 1000.0::DOUBLE, 1.0::DOUBLE) END, CASE WHEN c.chunks > 0 THEN least(c.chunks / 10.0::DOUBLE, 1.0::DOUBLE) END], lambda v: v IS NOT NULL) AS parts FROM extraction e LEFT JOIN chunking c USING (doc_id)),
    scored AS (SELECT doc_id, extraction_status, chunking_status, round(round(CASE WHEN len(parts) > 0 THEN list_sum(parts) / len(parts) ELSE 0.0::DOUBLE END, 9) + 1e-9, 4) AS score FROM ready),
    final AS (SELECT *, extraction_status = 'passed' AND chunking_status = 'passed' AND score >= 0.5 AS is_ready FROM scored)"""
_TITLE = "list_filter(list_transform(list_slice(string_split(trim(text), chr(10)), 1, 10), lambda x: trim(x)), lambda x: length(x) > 5 AND length(x) < 200" + "".join(f" AND NOT contains(lower(x), '{m}')" for m in P.CODE_MARKS) + ")"
_META = f"m AS (SELECT doc_id, coalesce({_TITLE}[1], replace(name, '_', ' ')) AS title, CASE WHEN doc_id % 19 <> 0 THEN lang END AS language, greatest(1, length(text) // 2000) AS pages, len({_WORDS.format('text')}) AS n_words, quality FROM docs)"


def _regular(delimiter):
    d = f"'{delimiter}'" if delimiter != "\t" else "chr(9)"
    counts = f"list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda x: length(x) - length(replace(x, {d}, ''))), lambda x: x > 1)"
    return f"(len({counts}) > 3 AND len(list_distinct({counts})) <= 2)"


_FALLBACK = f"least(((CASE WHEN length(text) > 100 THEN 0.2::DOUBLE ELSE 0 END) + least(len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE * 2, 0.3::DOUBLE) + (CASE WHEN len(regexp_extract_all(text, '[.!?]+')) > 1 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN up > 0 AND up < length(text) * 0.1::DOUBLE THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN length(text) - length(translate(text, '.,!?;:', '')) > length(text) * 0.01::DOUBLE THEN 0.1::DOUBLE ELSE 0 END)) / 5, 1.0::DOUBLE)"

SQL = {
    "normalize_text": f"SELECT doc_id, sha256({_NORM.format('text')}) AS normalized FROM documents",
    "word_ngrams": f"WITH w AS (SELECT {_WORDS.format(_NORM.format('text'))} AS w FROM documents), g AS (SELECT unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 10",
    "jaccard_overlap": f"WITH x AS (SELECT doc_id, list_distinct({_WORDS.format(_NORM.format('text'))}) AS x FROM documents), y AS (SELECT item_id, list_distinct({_WORDS.format(_NORM.format('text'))}) AS y FROM benchmark), p AS (SELECT doc_id, item_id, len(x) + len(y) AS n, len(list_intersect(x, y)) AS i FROM x, y) SELECT doc_id, item_id, round(i / (n - i)::DOUBLE, 6) AS overlap FROM p WHERE i > 0 AND round(i / (n - i)::DOUBLE, 6) >= 0.3",
    "strip_citations": "SELECT conv_id, turn, " + _COLLAPSE.format("regexp_replace(text || ' [12] end [3]', '\\[\\d+\\]', '', 'g')") + " AS stripped FROM conversations",
    "propositions": f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), p AS (SELECT doc_id, list_filter(flatten(list_transform(s, lambda x: CASE WHEN len({_WORDS.format('x')}) <= 40 THEN [x] ELSE list_transform(string_split_regex(x, '(?i)\\s+(?:{'|'.join(T.CONJUNCTIONS)})\\s+'), lambda y: array_to_string(list_slice({_WORDS.format('y')}, 1, 40), ' ')) END)), lambda y: len({_WORDS.format('y')}) >= 5) AS p FROM s) SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS pos, unnest(p) AS proposition FROM p",
    "query_terms": "SELECT item_id, array_to_string(list_filter((SELECT list(t ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(w) AS t, unnest(range(0, len(w))) AS i FROM (SELECT string_split_regex(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')), '\\s+') AS w)) GROUP BY t)), lambda t: length(t) > 1), ' ') AS terms FROM benchmark",
    "keywords_top20": f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_UW}') AS w FROM documents WHERE length(text) >= 100), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM w), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM p WHERE regexp_matches(word, '^[a-z]{{4,}}$') AND word NOT IN ({', '.join(repr(x) for x in P.STOP_WORDS)}) GROUP BY 1, 2), r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20 AND n > 1",
    "language_vote": f"WITH v AS ({_VOTE}) SELECT doc_id, CASE WHEN n >= 100 THEN CASE WHEN greatest(en, es, fr) < 3 THEN 'en' WHEN en = greatest(en, es, fr) THEN 'en' WHEN es = greatest(en, es, fr) THEN 'es' ELSE 'fr' END END AS language FROM v",
    "doc_type_rule": f"WITH {V.DOCS_SQL} SELECT doc_id, CASE WHEN mime_type = 'text/csv' THEN 'spreadsheet' WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in P.LETTER_MARKS) + " THEN 'email' WHEN contains(lower(text), 'table of contents') OR (length(text) - length(replace(text, chr(10) || '#', ''))) / 2 > 3 THEN 'manual' ELSE 'other' END AS kind FROM docs",
    "title_rule": f"WITH {V.DOCS_SQL} SELECT doc_id, coalesce({_TITLE}[1], replace(name, '_', ' ')) AS title FROM docs",
    "table_detect": f"WITH {V.DOCS_SQL} SELECT doc_id, mime_type = 'text/csv' OR " + " OR ".join(_regular(x) for x in P.DELIMITERS) + " AS has_table FROM docs",
    "fallback_quality": f"WITH x AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{_UW}') AS w, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS up FROM documents), y AS (SELECT doc_id, text, len(regexp_extract_all(text, '{_UW}')) AS words, {_FALLBACK} AS s FROM x) SELECT doc_id, round(s, 6) AS score, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.4 THEN 'low' ELSE 'poor' END AS band, CAST(words AS INTEGER) AS words, CAST(greatest(1, length(text) // 2000) AS INTEGER) AS pages FROM y",
    "headings": f"WITH h AS (SELECT page_id, regexp_extract_all({_CAPITALS.format("regexp_replace(html, '[<>.,]', chr(10), 'g')")}, '(?m)^([A-Z][A-Z \\t]{{5,80}})$', 1) AS h FROM pages) SELECT page_id, CAST(unnest(range(0, len(h))) AS INTEGER) AS pos, unnest(h) AS heading FROM h",
    "lists": "WITH h AS (SELECT page_id, regexp_extract_all(replace(replace(html, '<li>', chr(10) || '- '), '</li>', chr(10)), '(?m)^[ \\t]*(?:[-*•+]|\\d+[.)\\]])[ \\t]+([^\\n]+)$', 1) AS h FROM pages) SELECT page_id, CAST(unnest(range(0, len(h))) AS INTEGER) AS pos, unnest(h) AS item FROM h",
    "citations_regex": "SELECT conv_id, turn, array_to_string(list_concat(regexp_extract_all(t, '\\[\\d+\\]'), regexp_extract_all(t, '\\([A-Z][a-z]+(?:\\s+(?:et\\s+al\\.|&|and)\\s+[A-Z][a-z]+)?,\\s*\\d{4}\\)')), '|') AS marks FROM (SELECT conv_id, turn, text || ' [1] (Smith and Jones, 2020) [22]' AS t FROM conversations)",
    "path_normalize": "SELECT regexp_replace(regexp_replace(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '/{id}', 'g'), '/\\d+', '/{id}', 'g') AS path, count(*) AS pages FROM pages GROUP BY 1",
    "sentences": f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), p AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS x FROM s) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(x) AS INTEGER) AS chars, sha256(x) AS hash FROM p",
    "sentence_kinds": f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), p AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS x FROM s), v AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN {_CAPITALS.format("rtrim(x, '.!?')")} WHEN 1 THEN '2) ' || x ELSE x END AS x FROM p), k AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(x) < 100 AND regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_matches(x, '[.!?,]$') AND length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) / length(x)::DOUBLE > 0.3 AS heading, regexp_matches(x, '^([-*•+]|\\d+[.)\\]])\\s') AS list_item FROM v) SELECT * FROM k WHERE heading OR list_item",
    "snippet_plain": f"WITH f AS (SELECT doc_id, {_COLLAPSE.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE '...' || t || '...' END AS snippet FROM f",
    "rag_prompt": "SELECT conv_id, sha256('Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || k || '] ' || text, chr(10) || chr(10) ORDER BY k) || chr(10) || chr(10) || 'Question: What is said?' || chr(10) || 'Answer:') AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations) GROUP BY conv_id",
    "extraction_quality": f"WITH {V.TEXTS_SQL} SELECT doc_id, {_QUALITY} AS quality FROM texts",
    "extraction_report": f"WITH {V.DOCS_SQL}, {V.TEXTS_SQL}, {_REPORT} SELECT * FROM extraction",
    "metadata_completeness": f"WITH {V.DOCS_SQL}, {_META} SELECT doc_id, round(((title IS NOT NULL)::INT + (language IS NOT NULL)::INT + 3) / 5.0::DOUBLE, 4) AS completeness, (title IS NOT NULL)::INT + (language IS NOT NULL)::INT + 1 >= 2 AS is_complete, round((0.9::DOUBLE + quality) / 2, 4) AS mean_confidence FROM m",
    "metadata_violations": f"WITH {V.DOCS_SQL}, {_META} SELECT doc_id, '' AS errors, concat_ws(',', CASE WHEN regexp_matches(title, '^[0-9\\-_]+$') THEN 'title looks like an identifier' END, CASE WHEN language IS NULL THEN 'language missing' END, CASE WHEN n_words = 0 THEN 'word count zero' END, CASE WHEN quality < 0.3 THEN 'quality low' END, CASE WHEN quality < 0.3 THEN 'confidence low' END, CASE WHEN NOT (quality >= 0.7 AND quality < 0.9) THEN 'band differs from score' END) AS warnings FROM m",
    "merge_metadata": f"WITH {V.DOCS_SQL} SELECT doc_id, 'xx' AS lang, source, doc_id::VARCHAR AS n FROM docs",
    "span_overlaps": f"WITH {_WINDOWS} SELECT w.doc_id, w.window, count(*) AS sentences, CAST(min(e.k) AS INTEGER) AS first, CAST(max(e.k) AS INTEGER) AS last FROM w JOIN e ON e.doc_id = w.doc_id AND w.lo <= e.hi AND e.lo <= w.hi AND w.lo <= w.hi GROUP BY 1, 2",
    "figure_before": f"WITH {_WINDOWS} SELECT w.doc_id, w.window, CAST(max(e.k) AS INTEGER) AS mark FROM w LEFT JOIN e ON e.doc_id = w.doc_id AND e.figure AND e.lo < w.lo GROUP BY 1, 2",
    "chunk_adjacent_overlap": "WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM documents), p AS (SELECT doc_id, unnest(range(0, len(s))) AS k, length(unnest(s)) AS n FROM s), e AS (SELECT doc_id, k, sum(n) OVER w AS hi, sum(n) OVER w - n AS lo FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)), o AS (SELECT doc_id, hi, hi - lead(lo) OVER (PARTITION BY doc_id ORDER BY k) AS overlap FROM e) SELECT doc_id, count(*) AS pairs, CAST(sum(overlap) AS BIGINT) AS overlap, CAST(max(hi) AS INTEGER) AS last_end FROM o WHERE overlap IS NOT NULL GROUP BY doc_id",
    "search_readiness": _READY + " SELECT * FROM final",
    "readiness_rollup": _READY + " SELECT count(*) AS total, CAST(sum(is_ready::INT) AS BIGINT) AS passed, CAST(sum((NOT is_ready)::INT) AS BIGINT) AS failed, round(avg(score), 4) AS avg_score FROM final",
}

_SPLIT = f"string_split_regex(x, '(?i)\\s+(?:{'|'.join(T.ANSWER_CONJUNCTIONS)})\\s+')"
SQL |= {
    "answer_propositions": f"""WITH p AS (SELECT conv_id, turn, string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM conversations WHERE role = 'assistant'),
        f AS (SELECT conv_id, turn, list_reduce(list_transform(p, lambda x: [x]), lambda acc, y: CASE
            WHEN len({_WORDS.format("y[1]")}) < 5 AND len(acc) > 0 THEN list_concat(list_slice(acc, 1, len(acc) - 1), [acc[len(acc)] || ' ' || y[1]])
            WHEN len({_WORDS.format("y[1]")}) > 40 THEN list_concat(acc, {_SPLIT.replace("(x,", "(y[1],")}) ELSE list_concat(acc, y) END, CAST([] AS VARCHAR[])) AS f FROM p),
        c AS (SELECT conv_id, turn, list_filter(list_transform(list_slice(f, 1, 5), lambda x: trim(x)), lambda x: x <> '') AS c FROM f)
        SELECT conv_id, turn, CAST(unnest(range(0, len(c))) AS INTEGER) AS prop, unnest(c) AS claim FROM c""",
}
