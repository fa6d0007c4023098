"""Token-ID output as sorted-string-table shards.

Documents are range-partitioned by identifier; each partition becomes one immutable
file of prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

File layout (little endian)::

    block*  index  bloom  footer
    block   entries, restart offsets (u32 each), restart count (u32), crc32 (u32), "\\n"
    entry   shared key length (u8), other key length (u8), value length (u32), key bytes, value
    key     identifier as big-endian u64 with its sign bit flipped (byte order = numeric order)
    value   id width in bytes (u8: 2 or 4), ids
    index   per block: last key (8 bytes), offset (u64), length (u32); then "\\n"
    bloom   hash count (u8), bits; then "\\n"
    footer  index offset, index length, bloom offset, bloom length, entries, ids (u64 each), "TSSTv01\\n"

Every part ends with a line feed that belongs to the format.  The text writer of Spark
adds exactly that byte after each row, so a partition's rows are written as one file in
any file system that Spark can write to, with its commit protocol; memory is bounded by
a block plus 8 bytes for each key of the shard.

Defined cases: null text is the empty text (its entry holds only the end id); very long
texts are one entry each; rows that repeat an identifier become adjacent entries, in the
order of their texts; rows without an identifier have no key and are left out; an empty
table makes no shard; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, mix64, texts_of
from .tokens import END_ID, encoder

MAGIC = b"TSSTv01\n"
FOOTER = struct.Struct("<6Q8s")
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<8sQI")
RESTART = 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
DOC_SCHEMA = "doc_id long, shard string, local_start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - 2**63


def pack_ids(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 65536
    return (b"\x02" + ids.astype("<u2").tobytes()) if narrow else (b"\x04" + ids.astype("<u4").tobytes())


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def bloom_slots(doc_ids: np.ndarray, n_bits: int) -> np.ndarray:
    h = mix64(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix64(h) | np.uint64(1)
    k = np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None]
    return ((h + k * step) % np.uint64(n_bits)).astype(np.int64)


class ShardWriter:
    """Takes (identifier, value) in key order and yields the file's parts without their final line feed."""

    def __init__(self, block_bytes: int = 64 << 10):
        self.block_bytes = block_bytes
        self.offset, self.entries, self.ids = 0, 0, 0
        self.index: list[bytes] = []
        self.keys: list[int] = []
        self._reset()

    def _reset(self) -> None:
        self.buf, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def _close(self) -> bytes:
        body = bytes(self.buf) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        part = body + struct.pack("<I", zlib.crc32(body))
        self.index.append(INDEX.pack(self.last, self.offset, len(part) + 1))
        self.offset += len(part) + 1
        self._reset()
        return part

    def add(self, doc_id: int, value: bytes) -> bytes | None:
        key = key_of(doc_id)
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.buf))
        else:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        self.buf += ENTRY.pack(shared, 8 - shared, len(value)) + key[shared:] + value
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += (len(value) - 1) // value[0]
        self.keys.append(doc_id)
        return self._close() if len(self.buf) >= self.block_bytes else None

    def finish(self) -> Iterator[bytes]:
        if self.in_block:
            yield self._close()
        if not self.entries:
            return
        index = b"".join(self.index)
        n_bits = max(64, -(-self.entries * BLOOM_BITS_PER_KEY // 8) * 8)
        bits = np.zeros(n_bits, dtype=np.uint8)
        bits[bloom_slots(np.array(self.keys, dtype=np.int64), n_bits).ravel()] = 1
        bloom = bytes([BLOOM_HASHES]) + np.packbits(bits, bitorder="little").tobytes()
        at = self.offset
        yield index
        yield bloom
        yield FOOTER.pack(at, len(index) + 1, at + len(index) + 1, len(bloom) + 1, self.entries, self.ids, MAGIC)[:-1]


class Shard:
    """Reads a shard's bytes: full scans, and point lookups by Bloom filter and binary search."""

    def __init__(self, content: bytes):
        if len(content) < FOOTER.size or content[-8:] != MAGIC:
            raise ValueError("not a shard: its footer is missing")
        self.content = content
        index_at, index_len, bloom_at, bloom_len, self.entries, self.n_ids, _ = FOOTER.unpack(content[-FOOTER.size :])
        self.blocks = list(INDEX.iter_unpack(content[index_at : index_at + index_len - 1]))
        self.bloom = np.unpackbits(np.frombuffer(content, np.uint8, bloom_len - 2, bloom_at + 1), bitorder="little")

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, offset, length = self.blocks[k]
        part = self.content[offset : offset + length - 1]
        body, (crc,) = part[:-4], struct.unpack("<I", part[-4:])
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {k} is damaged")
        (n,) = struct.unpack("<I", body[-4:])
        end = len(body) - 4 - 4 * n
        return body[:end], list(struct.unpack(f"<{n}I", body[end : end + 4 * n]))

    @staticmethod
    def _entries(data: bytes, at: int = 0, until: int | None = None) -> Iterator[tuple[bytes, bytes]]:
        key, until = b"", len(data) if until is None else until
        while at < until:
            shared, other, length = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + length]
            at += length

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._entries(self._block(k)[0]):
                yield id_of(key), unpack_ids(value)

    def get(self, doc_id: int) -> np.ndarray | None:
        if not self.bloom[bloom_slots(np.array([doc_id]), len(self.bloom)).ravel()].all():
            return None
        key, lo, hi = key_of(doc_id), 0, len(self.blocks)
        while lo < hi:  # first block whose last key is not smaller
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.blocks[mid][0] < key else (lo, mid)
        if lo == len(self.blocks):
            return None
        data, restarts = self._block(lo)
        a, b = 0, len(restarts) - 1
        while a < b:  # last restart whose key is smaller
            mid = (a + b + 1) // 2
            at = restarts[mid] + ENTRY.size
            a, b = (mid, b) if data[at : at + 8] < key else (a, mid - 1)
        for found, value in self._entries(data, restarts[a]):
            if found >= key:
                return unpack_ids(value) if found == key else None
        return None


def write_shards(df: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", shard_text_bytes: int = 16 << 20, block_bytes: int = 64 << 10, end_id: int = END_ID) -> None:
    """Encode ``text_col`` and write shards under ``path``; their count follows the corpus size."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    shards = max(1, -(-total // shard_text_bytes))
    tail = np.array([end_id], dtype="<u4").tobytes()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ShardWriter(block_bytes)
        enc = encoder(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                part = out.add(doc_id, pack_ids(np.frombuffer(enc.encode(text) + tail, dtype="<u4")))
                if part is not None:
                    yield pa.record_batch([pa.array([part], pa.binary())], names=["part"])
        for part in out.finish():
            yield pa.record_batch([pa.array([part], pa.binary())], names=["part"])

    ranged = docs.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = ranged.mapInArrow(build, "part binary").select(F.col("part").cast("string").alias("value"))
    parts.write.mode("overwrite").option("lineSep", "\n").option("compression", "none").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry, decoded from the files: ids are checked and summarised, not kept."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")

    def decode(batch: pa.RecordBatch):
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            name = shard.rsplit("/", 1)[-1]
            rows, start = [], 0
            for doc_id, ids in Shard(content.as_py()).scan():
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            ids_, starts, ns, crcs = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield {"doc_id": ids_, "shard": [name] * len(rows), "local_start": starts, "n_tokens": ns, "ids_crc32": crcs}

    return arrow_map(files, decode, DOC_SCHEMA)


def with_starts(docs: DataFrame) -> DataFrame:
    """Turn shard-local starts into corpus-wide ones.

    One row per shard reaches the running sum; shards are ordered by their smallest identifier.
    """
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    before = Window.orderBy("low", "high", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard")


def export(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write shards of ``df`` to the shared folder and return what reading them back yields."""
    spark = df.sparkSession
    scratch = Scratch(spark, "sst")
    write_shards(df, scratch.path("shards"), tokenizer, **options)
    return with_starts(scratch.put(read_shards(spark, scratch.path("shards")), "entries"))
