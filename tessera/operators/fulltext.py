"""Full-text search over a stored inverted index: stems, positions, ranks by closeness, fragments.

``FullTextIndex.build`` writes two tables: posting lists (``postings``), in buckets of terms, and the chunks' own columns.
A row of the postings is one term of a block of chunks, with each chunk that holds it and the term's places in it.  A
search reads the buckets of its terms only (partitions are pruned and row groups skipped by term), gathers what a chunk
holds of the asked terms, and keeps the chunks that hold all terms of a query.  Texts are read for the ranked page alone.

The number of files comes from the measured size of the texts, and the number of buckets is bounded, so that there are
as many files as the size asks for, not its square.  Chunks are dealt over the files before their words are taken, so
texts move once, postings do not move at all, and a term that most chunks hold is no single task's work.

A chunk is named by (doc_id, chunk_index); equal rows of one are one hit.  Null and empty texts have no terms, and a
query without a term (only stop words, or nothing) has no hit.

The rank is the cover-density rank of a conjunction: each pair of places of two terms counts by their distance, and a
single term's places by their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem as S
from . import retrieval
from .filters import SearchFilters

# fixed values of the rank: weight of a plain word, the sum of 1 / n^2, and the distance beyond which places are strangers
WEIGHT, BASEL, FAR = 0.1, 1.64493406685, 100
MOST_PLACES = 256  # places of one term that a rank looks at, as in the surveyed index
WORD_GAPS = r"[^\p{L}\p{N}_]+"
BLOCK = 4096  # chunks whose postings are put together at a time
TERM_BYTES = 7  # of text for each posting, about
MOST_BUCKETS = 32


def _lexemes(language: str | None) -> dict:
    return S.Stems() if language == "english" else S.Plain()


def _low(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def _parted(low: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-case texts one after the other, and the row and the place (from 1) of each."""
    lists = pc.split_pattern_regex(low, WORD_GAPS)
    words = lists.flatten()
    row = np.repeat(np.arange(len(low)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # a text's ends leave empty parts
    row = row[full]
    first = np.searchsorted(row, np.arange(len(low)))
    return words.filter(pa.array(full)), row, np.arange(len(row)) - first[row] + 1


def postings(chunks: DataFrame, *, language: str | None = "english", text_col: str = "chunk_text", block: int = BLOCK) -> DataFrame:
    """(term, doc_id, chunk_index, places): the terms of each block of chunks, with arrays of the chunks that hold the term and of its places there, counted in words from 1.

    A block's words are numbered and sorted as arrays, and each different one is stemmed once.  Nothing is shuffled.
    """
    kinds = dict(chunks.dtypes)
    schema = f"term string, doc_id array<{kinds['doc_id']}>, chunk_index array<{kinds['chunk_index']}>, places array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _lexemes(language)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                words, row, place = _parted(part.column(2))
                coded = words.dictionary_encode()
                terms: dict[str, int] = {}
                number = [-1 if (term := stems[w]) is None else terms.setdefault(term, len(terms)) for w in coded.dictionary.to_pylist()]
                of = np.array(number, np.int32)[coded.indices.to_numpy()]
                order = np.argsort(of, kind="stable")
                order = order[np.searchsorted(of[order], 0) :]  # stop words come first
                of, row, place = of[order], row[order], place[order]
                new_term = np.diff(of, prepend=-1) != 0
                lists = np.flatnonzero(new_term | (np.diff(row, prepend=-1) != 0))
                each = pa.ListArray.from_arrays(pa.array(np.append(lists, len(of)), pa.int32()), pa.array(place, pa.int32()))
                starts = np.flatnonzero(new_term[lists])
                ends = pa.array(np.append(starts, len(lists)), pa.int32())
                held = [pa.ListArray.from_arrays(ends, x) for x in (*(part.column(c).take(pa.array(row[lists])) for c in (0, 1)), each)]
                yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(of[lists[starts]])), *held], names=["term", "doc_id", "chunk_index", "places"])

    return chunks.select("doc_id", "chunk_index", _low(text_col)).mapInArrow(run, schema)


def query_terms(queries: DataFrame, language: str | None = "english") -> DataFrame:
    """(query_id, terms): distinct terms of each query in their order, without stop words; queries without a term are left out."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, terms array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _lexemes(language)
        for batch in batches:
            words, row, _ = _parted(batch.column(1))
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            for k, w in zip(row.tolist(), words.to_pylist(), strict=True):
                if (term := stems[w]) is not None:
                    found[k][term] = None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[*f] for f in found], pa.list_(pa.string()))], names=["query_id", "terms"])

    return queries.select("query_id", _low("text")).mapInArrow(run, schema).where(F.size("terms") > 0)


def closeness(distance: Column) -> Column:
    """How much two places at a distance count, from 1 (next to each other) to 0."""
    return F.when(distance > FAR, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def rank(places: Column) -> Column:
    """Rank of a chunk from an array with the places of each of its query's terms.

    Of several terms: one less the product of (1 - c) over all pairs of places of two terms, where c grows with their
    closeness.  Of one term: its places weigh 1, 1/4, 1/9 and so on.
    """
    first = lambda p: F.slice(p, 1, MOST_PLACES)
    pair = lambda x, y: F.log(1 - WEIGHT * F.sqrt(closeness(F.abs(x - y).cast("double"))))
    two = lambda p, q: F.aggregate(first(p), F.lit(0.0), lambda s, x: s + F.aggregate(first(q), F.lit(0.0), lambda t, y: t + pair(x, y)))
    others = lambda p, k: F.aggregate(F.slice(places, k + 2, F.size(places)), F.lit(0.0), lambda s, q: s + two(p, q))
    several = 1 - F.exp(F.aggregate(F.transform(places, others), F.lit(0.0), lambda s, x: s + x))
    alone = WEIGHT / BASEL * F.aggregate(F.sequence(F.lit(1), F.least(F.size(places[0]), F.lit(MOST_PLACES))), F.lit(0.0), lambda s, n: s + 1 / (n * n))
    return F.when(F.size(places) == 1, alone).otherwise(several)


@dataclass(frozen=True)
class FullTextIndex:
    """A stored index; ``language`` None keeps words as they are."""

    spark: SparkSession
    path: str
    buckets: int
    language: str | None
    schema: str  # of the postings

    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, language: str | None = "english", bucket_rows: int = 4_000_000, least_buckets: int = 16) -> FullTextIndex:
        """Write the index of ``chunks`` (doc_id, chunk_index, chunk_text and columns for filters) to ``path``; a file range holds about ``bucket_rows`` postings."""
        spark = chunks.sparkSession
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        kept = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
        n = (kept.agg(F.sum(F.octet_length("chunk_text"))).first()[0] or 0) // TERM_BYTES
        files = max(1, -(-n // bucket_rows))
        buckets = max(least_buckets, min(MOST_BUCKETS, files))
        # files of a range of chunks: a frequent term is spread over all of them
        dealt = kept.select(*retrieval.KEY, "chunk_text").repartition(max(files, min(spark.sparkContext.defaultParallelism, n // 100_000)), *retrieval.KEY)
        found = postings(dealt, language=language)
        found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        return cls(spark, path, buckets, language, ", ".join(f"{c} {t}" for c, t in found.dtypes) + ", bucket int")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Postings, of ``terms`` only where they are given: their buckets, and in those their row groups."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")
        if terms is not None:
            numbers = self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int")).distinct().collect()
            found = found.where(F.col("bucket").isin([r[0] for r in numbers]) & F.col("term").isin(terms))
        return found.select("term", F.inline(F.arrays_zip(*retrieval.KEY, "places")))

    def matches(self, queries: DataFrame, filters: SearchFilters | None = None) -> DataFrame:
        """(query_id, doc_id, chunk_index, raw): chunks that hold all terms of a query, with their rank.

        What a chunk holds of all asked terms is gathered once, whatever the number of queries.  It meets a query by one
        term, the query's longest; whether it holds the others is a test of its own row.
        """
        asked, rows = retrieval.pinned(query_terms(queries, self.language))
        found = self.postings(sorted({t for r in rows for t in r["terms"]}) if rows is not None else None)
        if rows is None:
            found = found.join(asked.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        held = found.groupBy(*retrieval.KEY).agg(F.array_sort(F.collect_set(F.struct("term", "places"))).alias("held"))
        if filters:
            held = held.join(self.chunks().where(filters.predicate()).select(*retrieval.KEY), retrieval.KEY, "left_semi")
        lead = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("term"))))["term"]
        named = held.withColumn("names", F.array_distinct(F.transform("held", lambda h: h["term"])))
        met = named.withColumn("term", F.explode("names")).join(asked.withColumn("term", lead), "term").where(F.forall("terms", lambda t: F.array_contains("names", t)))
        whole = met.withColumn("places", F.transform("terms", lambda t: F.get(F.filter("held", lambda h: h["term"] == t), 0)["places"]))
        return whole.select("query_id", *retrieval.KEY, F.round(rank(F.col("places")), 9).alias("raw"))

    def count(self, queries: DataFrame, filters: SearchFilters | None = None) -> DataFrame:
        return self.matches(queries, filters).groupBy("query_id").agg(F.count("*").alias("matches"))

    def search(self, queries: DataFrame, *, filters: SearchFilters | None = None, limit: int = 10, offset: int = 0, snippets: bool = False) -> DataFrame:
        """The page of each query by rank; scores lie in [0.6, 1].  ``snippets`` adds the best fragment of each hit's text."""
        page = retrieval.page_score(retrieval.top(self.matches(queries, filters), F.col("raw"), limit, offset), base=0.6, scale=0.4)
        if not snippets:
            return page
        texts = self.chunks().select(*retrieval.KEY, "chunk_text")
        shown = retrieval.few_hits(page, queries, limit).join(texts, retrieval.KEY).dropDuplicates(["query_id", *retrieval.KEY]).join(retrieval.small(query_terms(queries, self.language)), "query_id")
        return headlines(shown, self.language).drop("chunk_text", "terms")


def best_fragment(terms: list[str | None], wanted: set[str], most: int = 50, least: int = 30) -> tuple[int, int]:
    """[from, to) of the words to show: around the cover that holds most different wanted terms, then the shortest, then the first.

    A cover ends and begins with a wanted term and has ``most`` words at most.  It is widened evenly to both sides
    until it has ``most`` words or the text ends; without any hit the first ``least`` words are shown.
    """
    hits = [k for k, t in enumerate(terms) if t in wanted]
    if not hits:
        return 0, min(least, len(terms))
    best, low, held = (0, 0, 0, 0), 0, {}
    for k in hits:
        held[terms[k]] = held.get(terms[k], 0) + 1
        # what is too far away, or is held again further on, leaves the window
        while k - hits[low] >= most or held[terms[hits[low]]] > 1:
            one = terms[hits[low]]
            held[one] -= 1
            if not held[one]:
                del held[one]
            low += 1
        best = max(best, (len(held), hits[low] - k, -k, hits[low]))
    _, length, end, begin = best
    stop = -end + 1
    room = max(0, most - (stop - begin))
    begin = max(0, begin - room // 2)
    stop = min(len(terms), begin + most)
    return max(0, min(begin, stop - most)), stop


def headlines(hits: DataFrame, language: str | None = "english", most: int = 50, least: int = 30) -> DataFrame:
    """Adds ``snippet`` to rows with ``chunk_text`` and ``terms``: the best fragment with its hits between ``**``."""
    import re

    word = re.compile(r"\w+")
    schema = ", ".join(f"`{c}` {t}" for c, t in hits.dtypes) + ", snippet string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _lexemes(language)
        for batch in batches:
            out = []
            for text, terms in zip(batch.column("chunk_text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                spans = [m.span() for m in word.finditer(text or "")]
                lexemes = [stems[text[a:b].lower()] for a, b in spans]
                begin, stop = best_fragment(lexemes, set(terms), most, least)
                parts, at = [], spans[begin][0] if spans else 0
                for k in range(begin, stop):
                    a, b = spans[k]
                    parts += [text[at:a], f"**{text[a:b]}**" if lexemes[k] in terms else text[a:b]]
                    at = b
                out.append(" ".join("".join(parts).split()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "snippet"])

    return hits.mapInArrow(run, schema)


def rank_of(places: list[list[int]]) -> float:
    """The same rank in plain Python."""
    near = lambda d: 1e-30 if d > FAR else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
    places = [p[:MOST_PLACES] for p in places]
    if len(places) == 1:
        return WEIGHT / BASEL * sum(1 / (n * n) for n in range(1, len(places[0]) + 1))
    rest = 1.0
    for k, p in enumerate(places):
        for q in places[k + 1 :]:
            for x in p:
                for y in q:
                    rest *= 1 - WEIGHT * math.sqrt(near(abs(x - y)))
    return 1 - rest
