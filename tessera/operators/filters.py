"""Requests as validated dataclasses, and their filters as predicates that Catalyst can push down."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, fields
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIME_TYPES = frozenset({
    "application/pdf", "text/plain", "text/markdown", "text/html", "text/csv", "application/json", "application/xml", "text/xml",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
})
SORT_COLUMNS = ("created_at", "updated_at", "name", "file_size")
STATUSES = ("pending", "processing", "completed", "failed")
SEARCH_FIELDS = ("name", "original_name", "metadata", "tags")
INJECTION = re.compile(r"<script|javascript:|\bunion\s+select\b|\bdrop\s+table\b|--\s|;\s*delete\b|\bxp_", re.I)


class RequestError(ValueError):
    pass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise RequestError(message)


@dataclass(frozen=True)
class SearchFilters:
    """Filters of a search; ``tags`` match if any of them does."""

    mime_types: tuple[str, ...] = ()
    min_quality: float | None = None
    created_after: datetime | None = None
    created_before: datetime | None = None
    tags: tuple[str, ...] = ()
    document_ids: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        unknown = set(self.mime_types) - MIME_TYPES
        _require(not unknown, f"unknown document types: {sorted(unknown)}")
        _require(self.min_quality is None or 0 <= self.min_quality <= 1, "min_quality must lie in [0, 1]")
        _require(not (self.created_after and self.created_before) or self.created_after <= self.created_before, "created_after lies behind created_before")

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.mime_types:
            out &= F.col("mime_type").isin(*self.mime_types)
        if self.min_quality is not None:
            out &= F.col("quality") >= self.min_quality
        if self.created_after:
            out &= F.col("created_at") >= F.lit(self.created_after)
        if self.created_before:
            out &= F.col("created_at") <= F.lit(self.created_before)
        if self.tags:
            out &= F.arrays_overlap("tags", F.array(*map(F.lit, self.tags)))
        if self.document_ids:
            out &= F.col("doc_id").isin(*self.document_ids)
        return out


@dataclass(frozen=True)
class DocumentList:
    """A page of documents; ``tags`` must all match, ranges are inclusive, deleted rows are left out unless asked for."""

    page: int = 1
    page_size: int = 20
    sort_by: str = "created_at"
    sort_order: str = "desc"
    status: str | None = None
    mime_type: str | None = None
    file_extension: str | None = None
    tags: tuple[str, ...] = ()
    created_after: datetime | None = None
    created_before: datetime | None = None
    min_size: int | None = None
    max_size: int | None = None
    storage_provider: str | None = None
    include_deleted: bool = False

    def __post_init__(self) -> None:
        _require(self.page >= 1, "page must be 1 or more")
        _require(1 <= self.page_size <= 100, "page_size must lie in [1, 100]")
        _require(self.sort_by in SORT_COLUMNS, f"sort_by must be one of {SORT_COLUMNS}")
        _require(self.sort_order in ("asc", "desc"), "sort_order must be asc or desc")
        _require(self.status is None or self.status in STATUSES, f"status must be one of {STATUSES}")
        _require(not (self.created_after and self.created_before) or self.created_after <= self.created_before, "created range is reversed")
        _require(self.min_size is None or self.max_size is None or self.min_size <= self.max_size, "size range is reversed")

    def matching(self, docs: DataFrame) -> DataFrame:
        for column, value in (("status", self.status), ("mime_type", self.mime_type), ("file_extension", self.file_extension), ("storage_provider", self.storage_provider)):
            if value is not None:
                docs = docs.where(F.col(column) == value)
        for tag in self.tags:
            docs = docs.where(F.array_contains("tags", tag))
        for column, low, high in (("created_at", self.created_after, self.created_before), ("file_size", self.min_size, self.max_size)):
            if low is not None:
                docs = docs.where(F.col(column) >= F.lit(low))
            if high is not None:
                docs = docs.where(F.col(column) <= F.lit(high))
        return docs if self.include_deleted else docs.where(~F.col("is_deleted"))

    def rows(self, docs: DataFrame) -> DataFrame:
        order = F.col(self.sort_by).desc() if self.sort_order == "desc" else F.col(self.sort_by).asc()
        return self.matching(docs).orderBy(order, "doc_id").offset((self.page - 1) * self.page_size).limit(self.page_size)

    def page_info(self, docs: DataFrame) -> DataFrame:
        """One row: total, pages, has_next, has_previous."""
        total = self.matching(docs).agg(F.count("*").alias("total"))
        pages = F.ceil(F.col("total") / self.page_size)
        return total.select("total", pages.alias("total_pages"), (pages > self.page).alias("has_next"), F.lit(self.page > 1).alias("has_previous"))


@dataclass(frozen=True)
class NameSearch:
    """Case-insensitive substring search; ``%`` and ``_`` are ordinary characters."""

    query: str
    search_fields: tuple[str, ...] = SEARCH_FIELDS
    status: str | None = None

    def __post_init__(self) -> None:
        _require(3 <= len(self.query.strip()) <= 200, "query must have 3 to 200 characters")
        unknown = set(self.search_fields) - set(SEARCH_FIELDS)
        _require(not unknown, f"unknown fields: {sorted(unknown)}")

    def rows(self, docs: DataFrame) -> DataFrame:
        needle = self.query.strip().lower()
        hit = F.lit(False)
        for name in self.search_fields:
            value = F.to_json("tags") if name == "tags" else F.col(name)
            hit |= F.coalesce(F.lower(value).contains(needle), F.lit(False))
        docs = docs.where(~F.col("is_deleted") & hit)
        return docs if self.status is None else docs.where(F.col("status") == self.status)


@dataclass(frozen=True)
class SearchRequest:
    """A retrieval request with the limits that its stages set each other."""

    query: str
    strategy: str = "hybrid"
    filters: SearchFilters = field(default_factory=SearchFilters)
    limit: int = 10
    offset: int = 0
    keyword_weight: float = 0.5
    vector_weight: float = 0.5
    keyword_top_k: int = 100
    vector_top_k: int = 100
    rerank: bool = False
    rerank_top_k: int = 50
    mmr: bool = True
    dedup: bool = True
    mmr_lambda: float = 0.7
    semantic_dedup_threshold: float = 0.95
    similarity_threshold: float = 0.0

    def __post_init__(self) -> None:
        _require(bool(self.query.strip()) and len(self.query) <= 1000, "query must have 1 to 1000 characters")
        _require(not INJECTION.search(self.query), "query holds a forbidden pattern")
        _require(self.strategy in ("keyword", "vector", "hybrid"), "unknown strategy")
        _require(self.limit >= 1 and self.offset >= 0, "limit must be positive, offset not negative")
        _require(self.keyword_weight + self.vector_weight > 0 and min(self.keyword_weight, self.vector_weight) >= 0, "weights must not both be zero")
        _require(0 <= self.mmr_lambda <= 1, "mmr_lambda must lie in [0, 1]")
        _require(self.semantic_dedup_threshold >= 0.85, "semantic_dedup_threshold must be 0.85 or more")
        if self.rerank:
            most = max(self.keyword_top_k, self.vector_top_k)
            _require(self.strategy == "hybrid" and most >= 50, "reranking needs the hybrid strategy and 50 candidates")
            _require(self.limit <= self.rerank_top_k <= most, "limit <= rerank_top_k <= candidates must hold")


def validate_vector(vector: list[float], dim: int) -> list[float]:
    _require(len(vector) == dim, f"expected {dim} dimensions, got {len(vector)}")
    _require(all(map(math.isfinite, vector)), "vector holds NaN or infinity")
    return vector


def validate_messages(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns with an unknown role or without text, by conversation."""
    bad = ~F.col("role").isin("system", "user", "assistant") | F.coalesce(F.trim("text") == "", F.lit(True)) | F.col("role").isNull()
    return messages.where(bad).groupBy(id_col).agg(F.count("*").alias("bad_turns"))


def visible(docs: DataFrame) -> DataFrame:
    """Completed documents that are not deleted."""
    return docs.where((F.col("status") == "completed") & ~F.col("is_deleted"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as an API returns them: size in MB, empty values instead of nulls."""
    return docs.select("doc_id", "name", "mime_type", "status", F.round(F.coalesce("file_size", F.lit(0)) / 1048576, 2).alias("size_mb"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", "updated_at")


def payload(df: DataFrame, equal: dict[str, Any]) -> DataFrame:
    """Conjunction of exact matches."""
    for column, value in equal.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def describe(request: Any) -> dict[str, Any]:
    return {f.name: getattr(request, f.name) for f in fields(request)}
