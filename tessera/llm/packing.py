"""Bound-certified best-fit packing of documents into fixed-length training sequences.

1. ``cut``: each document is encoded once; one longer than a sequence is cut into full
   pieces, of which only the first may be shorter.  Only lengths travel from here on.
2. Pieces are dealt to buckets of a bounded expected size, packed best-fit decreasing,
   and each bucket's bin count is compared with the largest of its lower bounds by
   dual-feasible functions.  Without a gap the bucket is certified and closed.  The deal
   counts a row's place in its batch, so repeated rows and rows without an identifier
   spread over all buckets.
3. Buckets with a gap close their full bins and release the rest; released pieces of
   ``fan_in`` neighbouring buckets meet and are packed again.  A repacking counts only
   if it needs fewer bins.  A single bucket has no one to exchange with, so it closes.

Defined cases: null text is the empty text (one piece holding the end id); equal rows are
packed as many times as they occur; very long texts are cut into pieces; pieces of equal
length are ordered by identifier, piece and place; an empty table yields no piece; only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, texts_of
from .tokens import END_ID, encoder

CACHE = 500_000  # pieces that the encoder keeps
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
DEALT = PIECES + ", deal long"
PACKED = DEALT + ", bucket long, bin long, fill long, offset long, closed boolean, bins long, bound long"


def cut(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents."""
    return _cut(df, tokenizer, id_col, text_col, capacity, end_id).drop("deal")


def _cut(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int = END_ID, cache_entries: int = CACHE) -> DataFrame:
    tail = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batch: pa.RecordBatch) -> dict:
        enc, out = encoder(tokenizer, cache_entries), []
        for place, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)):
            ids = enc.encode(text) + tail
            n = len(ids) // 4
            end = (n - 1) % capacity + 1
            start, piece = 0, 0
            while start < n:
                out.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), place))
                start, end, piece = end, end + capacity, piece + 1
        return dict(zip((c.split()[0] for c in DEALT.split(", ")), zip(*out, strict=True), strict=True))

    return arrow_map(df.select(F.col(id_col).cast("long"), text_col), pieces, DEALT)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item.  Free spaces are bits of one integer, so the tightest fit is its lowest usable bit."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    mask, n = 0, 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = open_bins[free]
            b = held.pop()
            if not held:
                mask &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        bins[k], offsets[k] = b, capacity - free
        if free > size:
            open_bins[free - size].append(b)
            mask |= 1 << (free - size)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound by two families of dual-feasible functions, in whole-number arithmetic.

    The first rounds sizes near the capacity up and small ones down to 0 (for each
    threshold); the second scales to k steps, for k up to 64.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for eps in sizes[sizes <= capacity // 2]:
        value = np.where(sizes > capacity - eps, capacity, np.where(sizes >= eps, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    big = int(counts[2 * sizes > capacity].sum())
    best = max(best, big)
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        value = np.where(whole, k * sizes, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _pack(pdf: pd.DataFrame, capacity: int, last: bool, repack: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "deal"], ascending=[False, True, True, True, True, True], ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    if repack:
        old = pd.factorize(pd.MultiIndex.from_frame(pdf[["old_bucket", "bin"]]))[0] if len(pdf) else bins
        if (before := int(old.max()) + 1) <= n:
            bins, offsets, n = old, pdf["offset"].to_numpy(), before
    bound = lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)[bins]
    return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "deal"]].assign(bucket=pdf["bucket"], bin=bins, fill=fill, offset=offsets, closed=(fill == capacity) | (n <= bound) | last, bins=n, bound=bound)[[c.split()[0] for c in PACKED.split(", ")]]


def _packer(capacity: int, last: bool, repack: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, capacity, last, repack)

    return run


def pack(pieces: DataFrame, scratch: Scratch, *, capacity: int = 1024, bucket_pieces: int = 20_000, fan_in: int = 8, exchanges: int = 2) -> DataFrame:
    """Place pieces; each of the ``exchanges + 1`` rounds is one shuffle of lengths."""
    n = pieces.count()
    buckets = max(1, -(-n // bucket_pieces))
    todo = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), F.lit(buckets)))
    done = []
    for r in range(exchanges + 1):
        last = r == exchanges or buckets == 1
        packed = scratch.put(todo.groupBy("bucket").applyInPandas(_packer(capacity, last, r > 0), PACKED), f"round{r}")
        done.append(packed.where("closed").withColumn("sequence_id", F.lit(r << 58).cast("long") + F.col("bucket") * (1 << 26) + F.col("bin")))
        if last:
            break
        todo = packed.where("not closed").withColumn("old_bucket", F.col("bucket")).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        buckets = -(-buckets // fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.col("bins").alias("bucket_bins"), F.col("bound").alias("bucket_bound"))


def pack_documents(df: DataFrame, tokenizer: str, *, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = CACHE, **options) -> DataFrame:
    """Cut, encode and pack; ``cache_entries`` bounds the encoder's memory and changes nothing else."""
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.put(_cut(df, tokenizer, id_col, text_col, capacity, cache_entries=cache_entries), "pieces")
    out = pack(pieces, scratch, capacity=capacity, **options)
    scratch.drop("pieces")
    return out
