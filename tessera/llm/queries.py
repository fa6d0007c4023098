"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, crf, decontam, htmltext, jaccard, langid, mixing, ogg, packing, sst, urlgbt, warc
from .common import held_out, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record."""
    return warc.build_derivatives(warc.pages_to_responses(table(spark, sf_dir, "pages")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Ogg samples and read back."""
    return ogg.decode_media(ogg.encode_texts(table(spark, sf_dir, "documents")))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    return crf.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlgbt.judge(pages, urlgbt.train(pages))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.export(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_alone=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, so that sources come to their target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of five filters, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_best_fit_packing, op3_ogg_media, op4_line_quality, op5_ngram_jaccard, op6_url_filter, op7_token_shards,
        op8_decontamination, op9_language_id, op10_html_rendering, op11_source_mixing, op12_filter_audit, op13_tokenizer_alignment,
    )
}

# Tokenizers, learned models, containers and tree building have no SQL form; those are tested against brute force,
# round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": audit.ORACLE_SQL,
    "op5_ngram_jaccard": """
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END)) AS s FROM w),
        n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, other) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
        SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.other), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
    """,
}
