"""Values that occur often among many that hardly recur, counted without moving the rare ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

RANGE_BITS = 24  # hashes in a range, as a power of 2


def frequent(values: DataFrame, column: str, least: int, *, range_bits: int = 4, buffer_rows: int = 4_000_000, broadcast_rows: int = 12_000_000) -> DataFrame:
    """(column, n) of the values that occur ``least`` times or more; counts are exact.

    A first pass moves only hashes of ``RANGE_BITS + range_bits`` bits, as sorted differences of about 2 bytes each, and
    finds those that come ``least`` times or more.  Equal values have equal hashes, so no frequent value is lost; the
    second pass counts the values of these hashes, and a rare one among them fails by its own count.
    There should be a few million values at most for each of the ``2 ** range_bits`` ranges.  Up to
    ``broadcast_rows`` such hashes (8 bytes each) are broadcast; with more of them all values are counted by shuffle.
    """
    spark = values.sparkSession
    hashed = values.select(column, F.shiftrightunsigned(F.xxhash64(column), 64 - RANGE_BITS - range_bits).alias("__h"))
    path = scratch_path(spark, "frequent")
    blocks = hashed.select("__h").mapInArrow(_packed(least, range_bits, buffer_rows), BLOCK)
    blocks.groupBy("route").applyInArrow(_recurring(least), "__h long").write.parquet(path)
    often = spark.read.schema("__h long").parquet(path)
    if often.count() <= broadcast_rows:
        hashed = hashed.join(F.broadcast(often), "__h", "left_semi")
    return hashed.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


BLOCK = "route int, first long, width int, steps binary"
_SCHEMA = pa.schema([("route", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("steps", pa.binary())])


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal elements begin, and how long they are."""
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return begin, np.diff(np.append(begin, len(h)))


def _packed(least: int, range_bits: int, buffer_rows: int):
    """Map tasks' hashes in blocks, one for each range; of a hash that a buffer holds more often, ``least`` are enough."""

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        begin, n = _runs(h)
        h = h[np.arange(len(h)) - np.repeat(begin, n) < least]
        ends = np.searchsorted(h >> RANGE_BITS, np.arange((1 << range_bits) + 1))
        rows = []
        for route in np.flatnonzero(np.diff(ends)):
            part = h[ends[route] : ends[route + 1]]
            steps = np.diff(part)
            width = 2 if len(steps) == 0 or steps.max() < 1 << 16 else 4
            rows.append((route, part[0], width, steps.astype(f"<u{width}").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.array(batch.column(0)))
                n += batch.num_rows
            if n >= buffer_rows:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return run


def _recurring(least: int):
    """Hashes of a range that come ``least`` times or more."""

    def merge(table: pa.Table) -> pa.Table:
        found = []
        for row in table.to_pylist():
            steps = np.frombuffer(row["steps"], f"<u{row['width']}").astype(np.int64)
            found.append(row["first"] + np.append(0, np.cumsum(steps)))
        h = np.sort(np.concatenate(found))
        begin, n = _runs(h)
        return pa.table({"__h": h[begin[n >= least]]})

    return merge
