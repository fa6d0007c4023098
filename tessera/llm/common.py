"""Shared helpers: scratch tables in the cluster's shared folder, Arrow maps, folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where none is set, a session in one process (tests) gets a temporary one; on a cluster that is an error, since
    executors do not see the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and executors can be lost.

    A table that a returned DataFrame still reads has to stay; others are removed
    with :meth:`drop` as soon as they have been used.  Who has written out a DataFrame for
    good removes all that was made for it with :meth:`drop_since`.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    @classmethod
    def mark(cls) -> int:
        return len(cls.made)

    @classmethod
    def drop_since(cls, mark: int) -> None:
        """Remove all folders made since ``mark``; nothing may read them any more."""
        for one in cls.made[mark:]:
            one._delete(one.root)
        del cls.made[mark:]


def held_out(doc_id: Column) -> Column:
    """Rows of the test fold: crc32 of the identifier as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, sample_rows: int, sample_bytes: int) -> list[Row]:
    """Rows with ``id`` and ``text`` in the order of a hash of ``id``: at most ``sample_rows``, whose texts take at most ``sample_bytes``.

    Sizes come first, and only then the texts that fit, so what reaches the driver is bounded both ways.
    """
    h, size = F.xxhash64("id"), F.octet_length("text")
    fits = rows.where(size <= sample_bytes)
    sizes = fits.select(h.alias("h"), "id", size.alias("n")).orderBy("h", "id", "n").limit(sample_rows).collect()
    upto = np.cumsum([r["n"] for r in sizes], dtype=np.int64)
    n = int(np.searchsorted(upto, sample_bytes, side="right"))
    return fits.where(h <= F.lit(sizes[n - 1]["h"])).orderBy(h, "id", "text").limit(n).collect() if n else []


_KEPT: dict = {}


def worker_cache(key, make: Callable):
    """A cache that outlives tasks of this Python worker; another key's cache is dropped for it.

    Workers are reused by all stages, so memory would otherwise hold the caches of every operator.
    """
    if key not in _KEPT:
        _KEPT.clear()
        trim()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what :func:`worker_cache` keeps: the running step has no use for it, and its memory is shared by all steps."""
    if _KEPT:
        _KEPT.clear()
        trim()


def trim() -> None:
    """Give memory that is free back to the system, where the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of this session hold about ``most`` bytes, so that long texts take no more memory than short ones; a bound that was set before stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | Iterator[dict] | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions from one batch to one or more dicts of columns.

    The columns are cast to ``schema``, and an empty result keeps its schema.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = fn(batch)
            yield from [made] if isinstance(made, dict) else made or ()

    return arrow_stream(df, each, schema)


def arrow_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """:func:`arrow_map` for functions from all batches of a task, none of them empty, to dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batch for batch in batches if batch.num_rows):
            arrays = [_column(cols[f.name], f.type) for f in target]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        trim()

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive [from, to) ranges whose sizes sum to about ``budget``; each has one element at least."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > budget:
            yield at, k
            at, held = k, 0
        held += int(n)
    if at < len(sizes):
        yield at, len(sizes)
