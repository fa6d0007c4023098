"""Keyword, BM25 and vector search over tables of queries.

Queries are a table, so any number of them is one plan.  Their number is what a caller
asks for, not the corpus; the query side is broadcast only up to ``BROADCAST_QUERIES`` rows.

Common input columns: queries ``query_id, text[, vector]``; chunks ``doc_id, chunk_index, chunk_text``
with the document's columns for filters.  Results carry an explicit ``rank``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from .filters import SearchFilters

BROADCAST_QUERIES = 10_000
BROADCAST_HITS = 100_000
KEY = ["doc_id", "chunk_index"]
K1, B = 1.5, 0.75


def pinned(queries: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """The query table, computed once and with a broadcast hint, and its rows; as it is and None beyond ``BROADCAST_QUERIES`` rows."""
    rows = queries.limit(BROADCAST_QUERIES + 1).collect()
    if len(rows) > BROADCAST_QUERIES:
        return queries, None
    return F.broadcast(queries.sparkSession.createDataFrame(rows, queries.schema)), rows


def small(queries: DataFrame) -> DataFrame:
    return pinned(queries)[0]


def few_hits(page: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """A page with a broadcast hint, so that texts which it meets are not shuffled; as it is where queries times ``limit`` exceed ``BROADCAST_HITS``."""
    return F.broadcast(page) if queries.limit(BROADCAST_HITS // limit + 1).count() * limit <= BROADCAST_HITS else page


def top(df: DataFrame, score: Column, limit: int, offset: int = 0, by: str = "query_id", ties: list[str] | None = None) -> DataFrame:
    """The page ``offset, limit`` of each query, with ``rank`` from 1; partial top-k runs before the shuffle."""
    order = Window.partitionBy(by).orderBy(score.desc(), *(ties or KEY))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= offset + limit).where(F.col("rank") > offset)


def matches(queries: DataFrame, chunks: DataFrame, terms: str = "terms") -> DataFrame:
    """Chunks that hold every term of a query as a whole word.

    Chunks are exploded to distinct words, cut down to the queries' words where they are read, and counted.
    """
    wanted = queries.select("query_id", F.col(terms).alias("terms")).where(F.size("terms") > 0)
    asked = wanted.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("word"))
    held = chunks.select(*KEY, F.explode(F.array_distinct(T.tokens(F.col("chunk_text")))).alias("word"))
    return held.join(small(asked), "word").groupBy("query_id", *KEY).agg(F.count("*").alias("hit"), F.max("n").alias("n")).where("hit = n").select("query_id", *KEY)


def asked_terms(queries: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """(query_id, terms) of queries that have a term, pinned if they are few."""
    return pinned(queries.select("query_id", T.query_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0))


def candidates(queries: DataFrame, chunks: DataFrame, filters: SearchFilters | None = None) -> DataFrame:
    """Query x matching chunk, in one pass over the chunks; adds ``terms``, ``low``, ``pad`` and ``dl``.

    A chunk meets a query by one word, the query's longest, in an equi-join; whether it holds the other terms is
    a test of its own row, so nothing is counted by a shuffle.  Texts are lower-cased, padded and measured once.
    """
    q, rows = asked_terms(queries)
    lead = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("word"))))["word"]
    pool = chunks.where(filters.predicate()) if filters else chunks
    pool = pool.withColumn("low", F.lower("chunk_text")).withColumns({"pad": T.padded(F.col("low")), "dl": T.word_count(F.col("chunk_text"))})
    return pool.withColumn("word", F.explode(_present(rows, F.col("pad")))).join(q.withColumn("word", lead), "word").where(F.forall("terms", lambda t: F.contains(F.col("pad"), T.word_mark(t)))).drop("word")


def _present(asked: list[Row] | None, pad: Column, by_search: int = 64) -> Column:
    """Distinct words of a padded text that can be a query's; a few known words are searched for, else the text is split."""
    held = F.array_distinct(F.split(F.trim(pad), " +"))
    if asked is None:
        return held
    words = sorted({w for r in asked for w in r["terms"]})
    known = F.lit(words) if words else F.array().cast("array<string>")
    return F.filter(known, lambda w: F.contains(pad, T.word_mark(w))) if len(words) <= by_search else F.array_intersect(held, known)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of non-empty chunks and their average length, in characters over five."""
    full = chunks.where(F.length("chunk_text") > 0)
    return full.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_chunks"), (F.coalesce(F.avg(F.length("chunk_text")), F.lit(1000.0)) / 5).alias("avgdl"))


def document_frequency(chunks: DataFrame, asked: list[Row] | None = None) -> DataFrame:
    """(word, df) over all chunks, of all words or only of the terms in ``asked`` (which are picked before the shuffle)."""
    return chunks.select(F.explode(_present(asked, T.padded(F.lower("chunk_text")))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("df"))


def robertson_idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def bm25_expr(weights: Column, k1: float = K1, b: float = B) -> Column:
    """Sum over terms of candidates; ``weights`` is an array of structs (term, idf).  Term frequency counts substrings."""
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))

    def add(acc: Column, t: Column) -> Column:
        tf = T.occurrences(F.col("low"), t["term"])
        return acc + t["idf"] * tf * (k1 + 1) / (tf + norm)

    return F.aggregate(weights, F.lit(0.0), add)


def bm25(queries: DataFrame, chunks: DataFrame, *, filters: SearchFilters | None = None, limit: int = 10, offset: int = 0, idf: str = "constant", k1: float = K1, b: float = B, normalized: bool = True) -> DataFrame:
    """Ranked chunks.  ``idf`` is ``constant`` (1.0) or ``robertson``; scores are divided by the page's largest."""
    queries = small(queries.select("query_id", "text"))
    stats = F.broadcast(corpus_stats(chunks))  # one row
    found = candidates(queries, chunks, filters).crossJoin(stats)
    if idf == "robertson":
        asked, rows = asked_terms(queries)
        known = asked.withColumn("word", F.explode("terms")).join(document_frequency(chunks, rows), "word", "left").crossJoin(stats)
        weighed = known.groupBy("query_id").agg(F.collect_list(F.struct(F.col("word").alias("term"), robertson_idf(F.col("n_chunks"), F.coalesce("df", F.lit(0))).alias("idf"))).alias("weights"))
        found = found.join(small(weighed), "query_id")
    else:
        found = found.withColumn("weights", F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("idf"))))
    scored = found.withColumn("raw", F.round(bm25_expr(F.col("weights"), k1, b), 9)).where("raw > 0").drop("weights", "avgdl", "n_chunks", "low", "pad", "dl")
    page = top(scored, F.col("raw"), limit, offset)
    return page_score(page, base=0.0, scale=1.0) if normalized else page.withColumn("score", F.col("raw"))


def page_score(page: DataFrame, base: float, scale: float) -> DataFrame:
    """``base + scale * raw / max`` over the page of each query, rounded to 4 digits."""
    most = F.max("raw").over(Window.partitionBy("query_id"))
    return page.withColumn("score", F.round(F.round(F.when(most > 0, base + scale * F.col("raw") / most).otherwise(base), 9), 4))


def keyword(queries: DataFrame, chunks: DataFrame, *, filters: SearchFilters | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Chunks with all terms, ranked by the sum of whole-word occurrences; scores lie in [0.6, 1]."""
    found = candidates(queries, chunks, filters)
    raw = F.aggregate("terms", F.lit(0), lambda n, t: n + T.occurrences(F.col("pad"), T.word_mark(t))).cast("double")
    page = top(found.withColumn("raw", raw).drop("low", "pad", "dl"), F.col("raw"), limit, offset)
    return page_score(page, base=0.6, scale=0.4)


def keyword_documents(queries: DataFrame, chunks: DataFrame, texts: DataFrame, *, limit: int = 10, offset: int = 0) -> DataFrame:
    """Hits of whole documents and of chunks, the best one of each document kept; the document's hit wins ties."""
    whole = texts.select("doc_id", F.lit(-1).alias("chunk_index"), F.col("text").alias("chunk_text"))
    both = [keyword(queries, part, limit=limit + offset).select("query_id", *KEY, "score", F.lit(k).alias("part")) for k, part in enumerate((whole, chunks.select(*KEY, "chunk_text")))]
    one = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "part", "chunk_index")
    best = both[0].unionByName(both[1]).withColumn("rn", F.row_number().over(one)).where("rn = 1").drop("rn")
    return top(best, F.col("score"), limit, offset, ties=["doc_id"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def invalid_vector(vector: Column, dim: int) -> Column:
    return (F.size(vector) != dim) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Identifiers and unit vectors of the queries, ``BROADCAST_QUERIES`` at a time, one dimension in each block."""
    ids, vectors = [], []

    def block() -> tuple[list, np.ndarray]:
        q = np.array(vectors, dtype=np.float64)
        norm = np.linalg.norm(q, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        return [i for i, k in zip(ids, ok, strict=True) if k], q[ok] / norm[ok, None]

    for row in queries.select("query_id", "vector").where("vector is not null and size(vector) > 0").toLocalIterator():
        if ids and (len(ids) == BROADCAST_QUERIES or len(row["vector"]) != len(vectors[0])):
            yield block()
            ids, vectors = [], []
        ids.append(row["query_id"])
        vectors.append([float("nan") if x is None else x for x in row["vector"]])
    if ids:
        yield block()


def products(queries: DataFrame, pool: DataFrame, *, limit: int, threshold: float = 0.0, vector_col: str = "embedding", block: int = 512) -> DataFrame:
    """Rows of ``pool`` (without their vector) near each query, with ``query_id`` and ``similarity``.

    Each batch of vectors meets the queries in matrix products and gives its own best ``limit`` of each, so vectors are
    never shuffled and only hits leave Python.  More queries than ``BROADCAST_QUERIES`` are asked in blocks of that
    many, each a pass over the vectors.  Vectors of another dimension or without a length are like nothing.
    """
    others = [c for c in pool.columns if c != vector_col]
    schema = StructType([queries.schema["query_id"], *(pool.schema[c] for c in others), StructField("similarity", DoubleType())])
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    names = schema.names

    def near(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(0)), q.shape[1]), False)
                batch = batch.filter(fits)
                if not batch.num_rows:
                    continue
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(v, axis=1)
                own = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                v = v[own] / norm[own, None]
                k = min(limit, len(own))
                for a in range(0, len(q) if k else 0, block):
                    sim = np.round(q[a : a + block] @ v.T, 6)
                    good = sim >= -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]  # ties stay
                    who, which = np.nonzero(good & (sim > threshold) if threshold > 0 else good)
                    rows = batch.take(pa.array(own[which]))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a + i] for i in who], kind), *rows.columns[1:], pa.array(sim[who, which])], names=names)

        return run

    source = pool.where(F.col(vector_col).isNotNull()).select(vector_col, *others)
    found = [source.mapInArrow(near(pool.sparkSession.sparkContext.broadcast(q)), schema) for q in _query_blocks(queries) if q[0]]
    return reduce(DataFrame.unionByName, found) if found else pool.sparkSession.createDataFrame([], schema)


def knn(queries: DataFrame, vectors: DataFrame, *, limit: int = 10, offset: int = 0, threshold: float = 0.0, filters: SearchFilters | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact nearest neighbours by cosine; a threshold above 0 is strict."""
    pool = vectors.where(filters.predicate()) if filters else vectors
    found = products(queries, pool, limit=limit + offset, threshold=threshold, vector_col=vector_col)
    return top(found, F.col("similarity"), limit, offset, ties=[id_col, *(c for c in KEY if c in pool.columns and c != id_col)])


def knn_batch(queries: DataFrame, vectors: DataFrame, *, limit: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 512) -> DataFrame:
    """Exact neighbours of many queries: identifiers and similarities only."""
    found = products(queries, vectors.select(F.col(id_col).cast("long").alias(id_col), vector_col), limit=limit, vector_col=vector_col, block=block)
    return top(found, F.col("similarity"), limit, ties=[id_col])


def ivf_assign(vectors: DataFrame, lists: int = 16, *, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 5000, rounds: int = 8, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Inverted lists: spherical k-means on a sample of ``sample_rows`` vectors; every vector gets its list."""
    rows = vectors.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        for k in range(len(centers)):
            if (near == k).any():
                c = x[near == k].sum(axis=0)
                centers[k] = c / max(np.linalg.norm(c), 1e-300)
    table = centers.tolist()
    best = F.array_max(F.array(*(F.struct(dot(F.col(vector_col), F.array(*map(F.lit, c))).alias("s"), F.lit(k).alias("list")) for k, c in enumerate(table))))
    return vectors.withColumn("list", best["list"]), centers


class IvfIndex:
    """A stored inverted-list index: vectors partitioned by list, and the lists' centres, both as Parquet.

    Every vector is indexed, those without a direction in no list.  A search reads only the partitions of the lists
    that some query probes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, lists: int = 16, **options) -> IvfIndex:
        assigned, centers = ivf_assign(vectors, lists, **options)
        assigned.repartition("list", F.pmod(F.xxhash64(*[c for c in vectors.columns if c != options.get("vector_col", "embedding")]), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/vectors")
        rows = [(k, [float(x) for x in c]) for k, c in enumerate(centers)]
        self.spark.createDataFrame(rows, "list int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")
        return self

    def search(self, queries: DataFrame, *, probes: int = 12, limit: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/centers").orderBy("list").collect()  # a row for each list
        return knn_ivf(queries, self.spark.read.parquet(f"{self.path}/vectors"), np.array([r["center"] for r in rows]), probes=probes, limit=limit, id_col=id_col, vector_col=vector_col)


def knn_ivf(queries: DataFrame, assigned: DataFrame, centers: np.ndarray, *, probes: int = 4, limit: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Approximate neighbours: only the ``probes`` lists nearest to each query are read.

    Up to ``BROADCAST_QUERIES`` queries meet each batch of vectors list by list, as matrix products; more are joined.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = queries.select("query_id", "vector").where("vector is not null").limit(BROADCAST_QUERIES + 1).collect()
    if len(rows) > BROADCAST_QUERIES or not rows:
        near = F.slice(F.sort_array(F.array(*(F.struct(dot(F.col("vector"), F.array(*map(F.lit, c))).alias("s"), F.lit(k).alias("list")) for k, c in enumerate(centers.tolist()))), asc=False), 1, probes)
        probed = queries.withColumn("p", F.explode(near)).select("query_id", F.col("vector").alias("q"), "p.list")
        sim = assigned.join(small(probed), "list").withColumn("similarity", F.round(cosine(F.col(vector_col), F.col("q")), 6)).drop("q", vector_col)
        return top(sim.where("similarity is not null"), F.col("similarity"), limit, ties=[id_col])
    q = np.array([r["vector"] for r in rows], dtype=np.float64)
    norm = np.linalg.norm(q, axis=1)
    q, ids = q[norm > 0] / norm[norm > 0, None], [r["query_id"] for r, n in zip(rows, norm, strict=True) if n > 0]
    lists = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :probes]
    shared = queries.sparkSession.sparkContext.broadcast((q, ids, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, lists = shared.value
        asks = {k: np.flatnonzero((lists == k).any(axis=1)) for k in range(lists.max(initial=-1) + 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(v, axis=1)
            of = np.where(norm > 0, np.asarray(batch.column(2)), -1)
            for k, asked in asks.items():
                own = np.flatnonzero(of == k)
                unit = v[own] / norm[own, None]
                for a in range(0, len(asked) if len(own) else 0, 512):
                    some = asked[a : a + 512]
                    sim = np.round(q[some] @ unit.T, 6)
                    n = min(limit, sim.shape[1])
                    who, which = np.nonzero(sim >= -np.partition(-sim, n - 1, axis=1)[:, n - 1 : n])  # ties stay
                    yield pa.record_batch([pa.array([ids[i] for i in some[who]], batch_kind), batch.column(0).take(pa.array(own[which])), pa.array(sim[who, which])], names=["query_id", id_col, "similarity"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(queries.schema["query_id"].dataType)
    asked = sorted(set(lists.ravel().tolist()))
    pool = assigned.where((F.size(vector_col) == q.shape[1]) & F.col("list").isin(asked)).select(id_col, vector_col, "list")
    near = pool.mapInArrow(run, f"query_id {kind}, {id_col} {pool.schema[id_col].dataType.simpleString()}, similarity double")
    return top(near, F.col("similarity"), limit, ties=[id_col])
