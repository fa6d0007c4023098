"""The corpus pipeline: quality, language, near duplicates, decontamination, packing.

Each stage takes all rows that the one before kept, as (spark, docs, sf_dir), and returns a
DataFrame that is written and read again as the next one's ``docs``.  All but the last keep
the columns of ``documents``, whatever others a table has and however they are called.

Defined cases, for every stage: a null text counts as the empty text, which has no letter and
goes with the language stage; very long texts are read whole; repeated rows are judged alike,
and the near-duplicate stage makes one of them; rows without an identifier stay until their
text rules them out; an empty table stays empty.

The stages share the executors' memory, so they bound the Arrow batches of the session (``bound_batches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import crf, decontam, jaccard, langid, packing
from tessera.llm.common import Scratch, bound_batches, table
from tessera.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier calls good; it learns from labelled rows of the training fold."""
    bound_batches(spark)
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, crf.score, model, "predicted = 1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough certainty."""
    bound_batches(spark)
    return _kept(docs, langid.predict, langid.train(docs), "not rejected")


def _kept(docs: DataFrame, score: Callable, model, rule: str) -> DataFrame:
    """Rows of ``docs`` that pass ``rule``; all columns travel with the score, so there is no join."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}  # so that no column can clash with a score's
    renamed = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()))
    scored = score(renamed, model, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    return scored.where(rule).select(*(F.col(a).alias(c) for c, a in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of linked documents."""
    bound_batches(spark)
    classes = Scratch(spark, "classes").put(jaccard.join(docs), "classes")
    return jaccard.keep_one(docs, classes).select(*_columns(docs))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    bound_batches(spark)
    hits = decontam.find(docs, table(spark, sf_dir, "benchmark"), short_alone=True).select("doc_id").distinct()
    return docs.join(Scratch(spark, "leaks").put(hits, "doc_ids"), "doc_id", "left_anti").select(*_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences."""
    bound_batches(spark)
    return packing.pack_documents(docs, TOKENIZER, cache_entries=150_000)  # the stages before share the executors' memory


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Learned models and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables and its input go as soon as its output is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = Scratch.mark()
        docs = scratch.put(stage(spark, docs, sf_dir), f"{k}_{name}")
        Scratch.drop_since(mark)
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
