"""Rank fusion, deduplication, diversification and the search pipelines built from them.

Ranked lists are DataFrames with ``query_id, doc_id, chunk_index, score, rank``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval
from .filters import SearchRequest

K = 60


def chunk_key(doc: str = "doc_id", index: str = "chunk_index") -> Column:
    """``document_index``; a missing index is 0."""
    return F.concat_ws("_", F.col(doc).cast("string"), F.coalesce(F.col(index), F.lit(0)).cast("string"))


def rank_map(hits: DataFrame) -> DataFrame:
    """Rank of each key by query; a key that occurs again keeps its worst rank, and the row of its best."""
    keyed = hits.withColumn("key", chunk_key())
    return keyed.groupBy("query_id", "key").agg(F.max("rank").alias("rank"), F.min_by("doc_id", "rank").alias("doc_id"), F.min_by("chunk_index", "rank").alias("chunk_index"))


def rrf(keyword_hits: DataFrame, vector_hits: DataFrame, *, keyword_weight: float = 0.5, vector_weight: float = 0.5, k: int = K, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion; scores are divided by the query's largest.  A side without the key adds 0."""
    a, b = rank_map(keyword_hits).alias("a"), rank_map(vector_hits).alias("b")
    both = a.join(b, ["query_id", "key"], "full_outer")
    part = lambda side, w: F.coalesce(F.lit(float(w)) / (k + F.col(f"{side}.rank")), F.lit(0.0))
    fused = both.select("query_id", "key", F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.chunk_index", "b.chunk_index").alias("chunk_index"), F.col("a.rank").alias("keyword_rank"), F.col("b.rank").alias("vector_rank"), (part("a", keyword_weight) + part("b", vector_weight)).alias("raw"))
    most = F.max("raw").over(Window.partitionBy("query_id"))
    scored = fused.withColumn("score", F.round(F.round(F.when(most > 0, F.col("raw") / most).otherwise(0.0), 9), 4))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc(), "key")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def multi_query(hits: DataFrame, *, top_k: int = 10, frequency_weight: float = 2.0, rank_weight: float = 1.0, k: int = K, group: str = "group_id") -> DataFrame:
    """Fusion over the variations of a question: ``group`` names the question, ``query_id`` the variation.

    Score = lists that hold the chunk * 2 + mean of 1 / (rank + 60); ties go to the first appearance.
    """
    keyed = hits.withColumn("key", chunk_key())
    agg = keyed.groupBy(group, "key").agg(F.count("*").alias("frequency"), F.avg(1 / (F.col("rank") + k)).alias("mean_rr"), F.min(F.struct("query_id", "rank", "doc_id", "chunk_index")).alias("first"))
    raw = F.round(F.col("frequency") * frequency_weight + F.col("mean_rr") * rank_weight, 12)
    order = Window.partitionBy(group).orderBy(F.col("raw").desc(), "first.query_id", "first.rank", "key")
    most = F.max("raw").over(Window.partitionBy(group))
    out = agg.withColumn("raw", raw).withColumn("rank", F.row_number().over(order)).withColumn("score", F.round(F.col("raw") / most, 6))
    return out.where(F.col("rank") <= top_k).select(group, "key", "first.doc_id", "first.chunk_index", "frequency", "score", "rank")


def dedup_key(hits: DataFrame) -> DataFrame:
    """One row per chunk key: its best score, at the place where it came first."""
    w = Window.partitionBy("query_id", chunk_key())
    best = hits.withColumn("rn", F.row_number().over(w.orderBy(F.col("score").desc(), "rank"))).withColumn("place", F.min("rank").over(w))
    return best.where("rn = 1").drop("rn").withColumn("rank", F.col("place")).drop("place")


def dedup_content(hits: DataFrame, text: Column | None = None) -> DataFrame:
    """The first row of each normalised text; rows without a text fall back to their name."""
    body = F.coalesce(text if text is not None else F.col("snippet"), F.col("name"))
    hashed = hits.withColumn("content_hash", T.content_hash(body))
    w = Window.partitionBy("query_id", "content_hash").orderBy("rank", chunk_key())
    return hashed.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _unit(vectors: pd.Series) -> np.ndarray:
    """Unit vectors; a missing one is zero and so is like no other."""
    dim = next((len(v) for v in vectors if v is not None), 1)
    x = np.array([np.zeros(dim) if v is None else v for v in vectors], dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _per_query(hits: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A fold over one query's candidates in rank order; a query has at most a few hundred."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("rank", kind="stable", ignore_index=True))

    return hits.groupBy("query_id").applyInPandas(run, kinds)


def dedup_semantic(hits: DataFrame, *, threshold: float = 0.95, vector_col: str = "embedding") -> DataFrame:
    """Greedy: a row goes if its cosine with a kept earlier row exceeds the threshold; rows without vectors stay."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf[vector_col])
        kept: list[int] = []
        for k in range(len(pdf)):
            if not kept or float((x[kept] @ x[k]).max()) <= threshold:
                kept.append(k)
        return pdf.iloc[kept]

    return _per_query(hits, keep)


def deduplicate(hits: DataFrame, *, threshold: float = 0.95, semantic_rows: int | None = 100, vector_col: str = "embedding") -> DataFrame:
    """By key, by content, and by meaning for queries that then have at most ``semantic_rows`` rows (None: any number)."""
    out = dedup_content(dedup_key(hits))
    if semantic_rows is None:
        return dedup_semantic(out, threshold=threshold, vector_col=vector_col)
    out = out.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    few = dedup_semantic(out.where(F.col("n") <= semantic_rows), threshold=threshold, vector_col=vector_col)
    return few.unionByName(out.where(F.col("n") > semantic_rows)).drop("n")


def mmr(hits: DataFrame, *, top_k: int = 10, trade: float = 0.7, vector_col: str = "embedding", score_col: str = "score") -> DataFrame:
    """Maximal marginal relevance: the most relevant first, then ``trade * relevance - (1 - trade) * max(0, cosine)``.

    A list of at most ``top_k`` rows stays as it is.  ``rank`` is the new order; the first row wins ties.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) <= top_k:
            return pdf.assign(rank=np.arange(1, len(pdf) + 1))
        rel = pdf[score_col].to_numpy(dtype=float)
        x = _unit(pdf[vector_col])
        chosen = [int(rel.argmax())]
        penalty = np.maximum(0.0, x @ x[chosen[0]])
        while len(chosen) < top_k:
            value = trade * rel - (1 - trade) * penalty
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
            penalty = np.maximum(penalty, x @ x[chosen[-1]])
        return pdf.iloc[chosen].assign(rank=np.arange(1, top_k + 1))

    return _per_query(hits.withColumn("rank", F.col("rank").cast("int")), pick)


def diversity(hits: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    """1 - mean pairwise cosine by query; 1.0 for a single row, 0.5 if a vector is missing.

    Pairs need not be built: over unit vectors their cosines sum to (|sum of vectors|^2 - n) / 2.
    """
    norm = F.sqrt(retrieval.dot(F.col(vector_col), F.col(vector_col)))
    parts = hits.select("query_id", F.col(vector_col).isNull().alias("missing"), F.posexplode_outer(F.transform(vector_col, lambda x: x.cast("double") / norm)).alias("dim", "x"), chunk_key().alias("key"))
    count = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.col(vector_col).isNull()).alias("missing"))
    total = parts.where("dim is not null").groupBy("query_id", "dim").agg(F.sum("x").alias("s")).groupBy("query_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    mean = (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return count.join(total, "query_id", "left").select("query_id", F.round(F.when(F.col("n") <= 1, 1.0).when(F.col("missing"), 0.5).otherwise(1 - mean), 6).alias("diversity"))


def dedup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed and their share, by query."""
    a, b = before.groupBy("query_id").agg(F.count("*").alias("original")), after.groupBy("query_id").agg(F.count("*").alias("kept"))
    joined = a.join(b, "query_id", "left").fillna({"kept": 0})
    return joined.select("query_id", "original", "kept", (F.col("original") - F.col("kept")).alias("removed"), F.round((F.col("original") - F.col("kept")) / F.col("original"), 4).alias("rate"))


def sigmoid(score: Column) -> Column:
    """1 / (1 + e^-x), rounded to 4 digits; 0.5 for NaN and infinities."""
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.5).otherwise(F.round(1 / (1 + F.exp(-score)), 4))


def rerank_text(snippet: Column, name: Column, max_tokens: int = 512) -> Column:
    """What a cross-encoder would read: the snippet, with the name if it is short or missing."""
    body = F.when(F.coalesce(snippet, F.lit("")) == "", F.concat(F.lit("Document: "), name)).when(F.length(snippet) < 20, F.concat(name, F.lit(": "), snippet)).otherwise(snippet)
    return F.substring(body, 1, max_tokens // 2 * 4)


def rerank(hits: DataFrame, *, top_k: int = 50, raw: Column | None = None) -> DataFrame:
    """Order by the sigmoid of a model's raw scores, or by the prior score where there is no model."""
    scored = hits.withColumn("score", sigmoid(raw)) if raw is not None else hits
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def pipeline(hits: DataFrame, *, final_top_k: int = 10, rerank_top_k: int = 50, raw: Column | None = None, dedup: bool = True, use_mmr: bool = True, trade: float = 0.7, threshold: float = 0.95) -> DataFrame:
    """Rerank, deduplicate by key, content and meaning (whatever the number of rows), diversify."""
    out = rerank(hits, top_k=rerank_top_k, raw=raw)
    if dedup:
        out = deduplicate(out, threshold=threshold, semantic_rows=None)
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", chunk_key())))
    if use_mmr:
        return mmr(out, top_k=final_top_k, trade=trade)
    return out.where(F.col("rank") <= final_top_k)


def hybrid(queries: DataFrame, chunks: DataFrame, request: SearchRequest, *, vector_col: str = "embedding") -> DataFrame:
    """BM25 and vector candidates, fused, and reranked if asked; the request's page, with ranks over the whole list.

    ``chunks`` carries text and vector of each chunk (null without one).
    """
    words = retrieval.bm25(queries, chunks.drop(vector_col), filters=request.filters, limit=request.keyword_top_k)
    near = retrieval.knn(queries, chunks.where(F.col(vector_col).isNotNull()).select("doc_id", "chunk_index", vector_col, *[c for c in ("mime_type", "quality", "created_at", "tags") if c in chunks.columns]), limit=request.vector_top_k, threshold=request.similarity_threshold, filters=request.filters, id_col="doc_id", vector_col=vector_col)
    fused = rrf(words, near, keyword_weight=request.keyword_weight, vector_weight=request.vector_weight)
    if request.rerank:
        own = chunks.select("doc_id", "chunk_index", F.col("chunk_text").alias("snippet"), "name", vector_col)
        best = fused.where(F.col("rank") <= request.rerank_top_k).select("query_id", "doc_id", "chunk_index", "score", "rank")
        top = retrieval.few_hits(best, queries, request.rerank_top_k).join(own, ["doc_id", "chunk_index"])
        fused = pipeline(top, final_top_k=request.limit + request.offset, rerank_top_k=request.rerank_top_k, dedup=request.dedup, use_mmr=request.mmr, trade=request.mmr_lambda, threshold=request.semantic_dedup_threshold)
    return fused.where((F.col("rank") > request.offset) & (F.col("rank") <= request.offset + request.limit))


def search(queries: DataFrame, chunks: DataFrame, request: SearchRequest, *, vector_col: str = "embedding") -> DataFrame:
    """The request's strategy."""
    if request.strategy == "keyword":
        return retrieval.keyword(queries, chunks, filters=request.filters, limit=request.limit, offset=request.offset)
    if request.strategy == "vector":
        return retrieval.knn(queries, chunks.where(F.col(vector_col).isNotNull()), limit=request.limit, offset=request.offset, threshold=request.similarity_threshold, filters=request.filters, id_col="doc_id", vector_col=vector_col)
    return hybrid(queries, chunks, request, vector_col=vector_col)


def multi_query_search(queries: DataFrame, variations: DataFrame, chunks: DataFrame, request: SearchRequest, *, top_k: int = 10) -> DataFrame:
    """Original questions and their variations (``group_id, query_id, text, vector``) in one plan, then fused."""
    each = search(queries.unionByName(variations, allowMissingColumns=True), chunks, SearchRequest(query=request.query, strategy=request.strategy, filters=request.filters, limit=3 * top_k))
    groups = queries.select("query_id", "group_id").unionByName(variations.select("query_id", "group_id"))
    return multi_query(each.join(retrieval.small(groups), "query_id"), top_k=top_k)


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
