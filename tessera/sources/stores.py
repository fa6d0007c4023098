"""Stores as Parquet tables: latest-wins upserts, deletes, chunk sinks, document layout, vector-store registry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import retrieval
from ..operators.filters import payload
from ..operators.lifecycle import latest
from ..session import shared_dir



def upsert(current: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows, the newest of each key."""
    both = new if current is None else current.unionByName(new, allowMissingColumns=True)
    return latest(both, keys, F.col(order).desc())


def delete(current: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(ids.select(*keys).distinct(), keys, "left_anti")


def bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def _bucket_count(chunks: DataFrame, path: str, n: int | None, bucket_rows: int) -> int:
    """The table's number of buckets: what its first write has noted, else ``n`` or one for each ``bucket_rows`` rows."""
    spark = chunks.sparkSession
    note = f"{path}/_buckets"  # readers of the table pass over names that begin so
    try:
        return spark.read.schema("n int").json(note).first()["n"]
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = n or max(1, -(-chunks.count() // bucket_rows))
    spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("overwrite").json(note)
    return n


def write_chunks(chunks: DataFrame, path: str, *, n: int | None = None, bucket_rows: int = 1_000_000) -> None:
    """Replace the chunks of the given documents and leave all others: only the buckets that hold those documents are rewritten.

    The first write measures the table and notes how many buckets it has; a table that has outgrown them is written
    anew to another place.  The rewritten buckets are complete before they replace the old ones (dynamic partition
    overwrite).
    """
    spark = chunks.sparkSession
    buckets = _bucket_count(chunks, path, n, bucket_rows)
    new = chunks.withColumn("bucket", bucket(F.col("doc_id"), buckets))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first write
        if not any(mark in str(e) for mark in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        old = None
    if old is not None:
        touched = new.select("bucket").distinct()
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        # checkpoint() cuts the read of files that this job replaces
        shared_dir(spark)
        new = new.unionByName(kept.select(*new.columns)).checkpoint()
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def store_documents(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to store: checksum, path without conflicts (``name_k``), and whether a live document has the same bytes.

    Input files: doc_id, workspace, name, content, at; existing: checksum, storage_path.
    """
    from pyspark.sql import Window

    df = files.withColumns({"checksum": F.sha2("content", 256), "file_size": F.octet_length("content"), "base": paths.document_path(F.col("workspace"), F.col("doc_id").cast("string"), F.col("name"), F.col("at"))})
    taken = existing.groupBy(F.col("storage_path").alias("base")).agg(F.count("*").alias("taken"))
    df = df.join(taken, "base", "left").withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("doc_id")) - 1 + F.coalesce("taken", F.lit(0)))
    dup = existing.select("checksum").distinct().withColumn("is_duplicate", F.lit(True))
    folder = F.regexp_extract("base", r"^(.*/)[^/]+$", 1)
    return df.join(dup, "checksum", "left").withColumns({"is_duplicate": F.coalesce("is_duplicate", F.lit(False)), "storage_path": F.concat(folder, paths.numbered(F.regexp_extract("base", r"([^/]+)$", 1), F.col("k")))}).drop("base", "k", "taken", "content")


def write_documents(docs: DataFrame, path: str) -> None:
    """Partitioned by workspace, year and month."""
    out = docs.withColumns({"year": F.date_format("at", "yyyy"), "month": F.date_format("at", "MM")})
    out.write.mode("append").partitionBy("workspace", "year", "month").parquet(path)


def legacy_matches(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files of an old tree matched with rows by name and size; of rows that agree in both, the first identifier."""
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    known = docs.groupBy("name", F.col("file_size").alias("length")).agg(F.min("doc_id").alias("doc_id"))
    return named.join(known, ["name", "length"], "left")


def migration_plan(files: DataFrame, docs: DataFrame, workspace: str) -> DataFrame:
    """Where each file of the old tree would go; files without a row are skipped."""
    df = legacy_matches(files, docs)
    target = paths.document_path(F.lit(workspace), F.col("doc_id").cast("string"), F.col("name"), F.col("modificationTime"))
    return df.select("path", "doc_id", F.when(F.col("doc_id").isNotNull(), target).alias("target"), F.when(F.col("doc_id").isNull(), "skip").otherwise("move").alias("action"))


class ParquetVectorStore:
    """A vector store on one table: index, search, delete, count."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path, dim

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def index(self, vectors: DataFrame) -> None:
        """Upsert ``vec_id, embedding, version, ...``; malformed vectors are refused."""
        if not vectors.where(retrieval.invalid_vector(F.col("embedding"), self.dim)).isEmpty():
            raise ValueError(f"vectors need {self.dim} finite numbers")
        vectors.write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        """The newest version of every vector that is not deleted."""
        df = latest(self.read(), ["vec_id"], F.col("version").desc())
        return df.where(F.col("embedding").isNotNull())

    def delete(self, ids: DataFrame, version: int) -> None:
        """Append a mark without a vector, so that no file is rewritten."""
        empty = F.lit(None).cast("array<float>").alias("embedding")
        ids.select("vec_id", empty, F.lit(version).cast("long").alias("version")).write.mode("append").parquet(self.path)

    def search(self, queries: DataFrame, top_k: int = 10, equal: dict[str, Any] | None = None) -> DataFrame:
        return retrieval.knn(queries, payload(self.current(), equal or {}), limit=top_k)

    def count(self, equal: dict[str, Any] | None = None) -> int:
        return payload(self.current(), equal or {}).count()


_STORES: dict[str, Callable[..., Any]] = {"parquet": ParquetVectorStore}


def register_store(name: str, factory: Callable[..., Any]) -> None:
    _STORES[name] = factory


def get_store(name: str = "parquet", **options: Any) -> Any:
    if name not in _STORES:
        raise KeyError(f"unknown vector store {name!r}; known: {sorted(_STORES)}")
    return _STORES[name](**options)


class BlobStore:
    """Save, read, move, delete and list files below a root, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        parts = name.split("/")
        if name.startswith("/") or ".." in parts or "\x00" in name or "//" in name:
            raise ValueError(f"unsafe path {name!r}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def save(self, content: bytes, name: str) -> str:
        """Write beside the target and rename, so that readers never see a part of a file."""
        target, part = self._path(name), self._path(f"{name}.part")
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        self.fs.delete(target, False)
        if not self.fs.rename(part, target):
            raise OSError(f"cannot write {name}")
        return hashlib.sha256(content).hexdigest()

    def read(self, names: list[str] | None = None) -> DataFrame:
        """(path, length, modificationTime, content) of the given files, or of all."""
        at = [self._path(n).toString() for n in names] if names else self.root
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)

    def move(self, name: str, to: str) -> bool:
        self.fs.mkdirs(self._path(to).getParent())
        return bool(self.fs.rename(self._path(name), self._path(to)))

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self._path(name), True))

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))


def index_batches(vectors: DataFrame, sink: Callable[[list[dict[str, Any]]], None], size: int = 500) -> None:
    """Hand rows to a remote index in batches, from each partition; ``sink`` must be idempotent, as a lost task runs again."""

    def send(rows: Any) -> None:
        held: list[dict[str, Any]] = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == size:
                sink(held)
                held = []
        if held:
            sink(held)

    vectors.foreachPartition(send)
