"""Token-budget chunks of sentences, with overlap, structure flags and quality scores.

Closing a chunk depends on all sentences before it, so the fold runs over one document's
sentences in Python, Arrow batch by batch; everything after it is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure
from ..functions import text as T
from ..session import scratch_path
from .intervals import first_from, last_before, overlapping

TARGET, MOST, OVERLAP, LEAST_CHARS = 512, 600, 50, 50
SCHEMA = "doc_id long, chunk_index int, chunk_text string, start_position int, end_position int, token_count int, n_sentences int, is_list boolean, is_heading boolean"
KEY = ["doc_id", "chunk_index"]
FLAGS = ("table", "list", "code", "equation", "figure", "citation", "footnote")
COUNTS = ("table", "list", "code", "equation", "figure", "citation")
_SENTENCE = re.compile(r"[^.!?]+[.!?]*")
_LIST_ITEM = re.compile(r"^\s*([-*•+]|\d+[.)\]])\s")


def default_tokens(text: str) -> int:
    return -(-len(text) // 4)


def split_sentences(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end), by the library's sentence rule."""
    out = []
    for m in _SENTENCE.finditer(text):
        body = m[0].strip()
        if body:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((body, start, start + len(body)))
    return out


def looks_like_heading(s: str) -> bool:
    return len(s) < 100 and s[:1].isupper() and s[-1] not in ".!?," and sum(map(str.isupper, s)) > 0.3 * len(s)


def fold(sizes: list[int], list_item: list[bool], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[from, to) sentence ranges of chunks.

    A chunk closes before it would pass ``most``, and from ``target`` on unless its last sentence is a list
    item.  The next one begins with the whole sentences that fit into ``overlap`` tokens.
    """
    out: list[tuple[int, int]] = []
    begin, held = 0, 0

    def carry(end: int) -> tuple[int, int]:
        k, kept = end, 0
        while k > begin and kept + sizes[k - 1] <= overlap:
            k -= 1
            kept += sizes[k]
        return k, kept

    for k, size in enumerate(sizes):
        if held and held + size > most:
            out.append((begin, k))
            begin, held = carry(k)
        held += size
        if held >= target and not list_item[k]:
            out.append((begin, k + 1))
            begin, held = carry(k + 1)
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


def chunk_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[str], int] = default_tokens, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each text of ``LEAST_CHARS`` characters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text is None or len(text.strip()) < LEAST_CHARS:
                        continue
                    found = split_sentences(text)
                    items = [bool(_LIST_ITEM.match(s)) for s, _, _ in found]
                    for index, (a, b) in enumerate(fold([tokens(s) for s, _, _ in found], items, target, most, overlap)):
                        body = " ".join(s for s, _, _ in found[a:b])
                        lo, hi = found[a][1], found[b - 1][2]
                        rows.append((doc, index, body, lo, hi, sum(tokens(s) for s, _, _ in found[a:b]), b - a, any(items[a:b]), any(looks_like_heading(s) for s, _, _ in found[a:b])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)


_NAMES = ["doc_id", "chunk_index", "chunk_text", "start_position", "end_position", "token_count", "n_sentences", "is_list", "is_heading"]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]


def document_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each structure span of a text (doc_id, n, kind, from, to, level, text) in their order, paragraphs left out."""
    one = structure.extract(df, id_col=id_col, text_col=text_col).select("doc_id", F.posexplode("spans").alias("n", "s")).where("s.kind <> 'paragraph'")
    return one.select("doc_id", "n", "s.kind", F.col("s.start").alias("from"), F.col("s.end").alias("to"), "s.level", "s.text")


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows from a table in the shared folder, so that the Python work behind them runs once."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_flags(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Headings, density, content flags and type of each chunk.

    ``spans``: rows of :func:`document_spans`.  Spans meet chunks by an interval join and headings by as-of joins, so no
    chunk carries its document's spans.  A chunk's heading is the first of level 4 or less that starts in it or within its
    first 50 characters, else the last one before it.  A document is named by its identifier, so both tables hold it once.
    """
    chunks, spans = _stored(chunks, "chunks"), _stored(spans, "spans")  # each is read several times
    lo, hi = F.col("start_position"), F.col("end_position")
    places = chunks.select(*KEY, "start_position", "end_position")
    met = overlapping(places, spans.where(F.col("kind").isin(*FLAGS)).select("doc_id", "kind", "from", "to"), ["doc_id"], ends=("start_position", "end_position"))
    counted = met.groupBy(*KEY).agg(*(F.count(F.when(F.col("kind") == k, 1)).cast("int").alias(f"{k}_count") for k in FLAGS))
    heads = spans.where("kind = 'heading'")
    mark = lambda order, name: heads.select("doc_id", F.col("from").alias("mark_at"), F.struct(order.alias("order"), F.col("from").alias("start"), "level", "text").alias(name))
    # of headings at one place the first counts behind a chunk's start, and the last before it
    following = first_from(places, mark(-F.col("n"), "next"), ["doc_id"], at="start_position", mark="next")
    around = last_before(following, mark(F.col("n"), "before"), ["doc_id"], at="start_position", mark="before")
    inside = (F.col("next.start") <= F.greatest(hi, lo + 50)) & (F.col("next.level") <= 4)
    headed = around.select(*KEY, F.when(inside, F.col("next")).when(F.col("before.level") <= 4, F.col("before")).alias("head"))
    terms = spans.where("kind = 'definition' AND text IS NOT NULL").select("doc_id", F.lower("text").alias("term")).distinct()
    defined = chunks.select(*KEY, "chunk_text").join(terms, "doc_id").where(F.contains(F.lower("chunk_text"), F.col("term"))).select(*KEY).distinct().withColumn("contains_definition", F.lit(True))
    df = chunks.join(headed, KEY, "left").join(counted, KEY, "left").join(defined, KEY, "left").fillna(0, [f"{k}_count" for k in FLAGS]).fillna({"contains_definition": False})
    w = T.words(F.col("chunk_text"))
    density = F.when(F.size(w) == 0, 0.5).otherwise(F.size(F.filter(w, lambda x: (F.length(x) > 3) & x.rlike(r"^\p{L}+$"))) / F.size(w))
    df = df.withColumns({f"contains_{k}": F.col(f"{k}_count") > 0 for k in FLAGS}).withColumn("semantic_density", density)
    kind = (
        F.when(F.col("contains_code"), "code")
        .when(F.col("contains_table"), "table")
        .when(F.col("contains_equation"), "equation")
        .when(F.col("contains_figure"), "figure")
        .when(F.col("contains_definition"), "definition")
        .when(F.col("is_list") | F.col("contains_list"), "list")
        .when(F.col("is_heading"), "heading")
        .when(F.col("contains_citation"), "citation")
        .when(F.col("contains_footnote"), "footnote")
        .otherwise("paragraph")
    )

    counts = F.to_json(F.struct(*(f"{k}_count" for k in COUNTS)))
    return df.withColumns({
        "section_heading": F.when(F.col("head.level") <= 2, F.col("head.text")),
        "subsection_heading": F.when(F.col("head.level") > 2, F.col("head.text")),
        "chunk_type": kind,
        "chunk_metadata": counts,
    }).drop("head", *(f"{k}_count" for k in FLAGS))


def rule_score(chunks: DataFrame) -> DataFrame:
    """Additive score by document: size .3, headings .3, density .2, no small chunk .2."""
    agg = chunks.groupBy("doc_id").agg(F.avg("token_count").alias("t"), F.avg((F.trim(F.coalesce("section_heading", F.lit(""))) != "").cast("int")).alias("h"), F.avg("semantic_density").alias("d"), F.min("token_count").alias("least"))
    score = F.when(F.col("t").between(400, 600), 0.3).otherwise(0.0) + F.when(F.col("h") > 0.8, 0.3).otherwise(0.0) + F.when(F.col("d").between(0.5, 0.8), 0.2).otherwise(0.0) + F.when(F.col("least") >= 100, 0.2).otherwise(0.0)
    return agg.select("doc_id", F.round(score, 2).alias("rule_score"))


def weighted_score(chunks: DataFrame) -> DataFrame:
    """Piecewise-linear score by document: tokens .4, headings .3, density .3."""
    agg = chunks.groupBy("doc_id").agg(F.avg("token_count").alias("t"), F.avg(F.col("section_heading").isNotNull().cast("int")).alias("h"), F.avg("semantic_density").alias("d"))
    t, h, d = F.col("t"), F.col("h"), F.col("d")
    ts = F.when(t.between(400, 600), 1.0).when((t >= 300) & (t < 400), 0.7 + (t - 300) / 100 * 0.3).when((t > 600) & (t <= 800), 0.7 + (800 - t) / 200 * 0.3).otherwise(0.5)
    hs = F.when(h >= 0.8, 1.0).when(h >= 0.5, 0.6 + (h - 0.5) / 0.3 * 0.4).otherwise(h / 0.5 * 0.6)
    ds = F.when(d >= 0.5, 1.0).when(d >= 0.3, 0.6 + (d - 0.3) / 0.2 * 0.4).otherwise(d / 0.3 * 0.6)
    return agg.select("doc_id", F.round(ts * 0.4 + hs * 0.3 + ds * 0.3, 2).alias("weighted_score"))
