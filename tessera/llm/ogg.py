"""Media columns: Ogg container bytes to and from 8-bit samples.

``mux`` writes the pages of several logical streams; ``demux`` verifies the checksum of
every page, separates the streams by serial number, reassembles packets from lacing
values (also over page borders) and derives timestamps from granule positions.

Defined cases: a payload is never empty (it is padded to a positive multiple of
``unit``); a null text is the empty text; very long texts are stored whole, in as many
pages as they need; repeated rows give equal media, each its own row; a damaged, truncated
or out-of-order page raises :class:`OggError`, and the column reader returns that as
``error`` instead of failing the job; a null media value gives a null payload; an empty
table gives no row; only the named columns are read, so others (even ``media`` or
``feature``) cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

HEADER = struct.Struct("<4sBBqIIIB")
# fixed values of the container format: capture pattern, header-type flags
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
RATE, PACKET_SAMPLES, PAGE_PACKETS = 8000, 4096, 12
HEAD = struct.Struct("<8sBBIQ")
PCM_MAGIC, NOTE_MAGIC = b"PCM8HEAD", b"NOTEHEAD"
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


class OggError(ValueError):
    pass


def page_crc(data: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, most significant bit first, no inversions.

    It mirrors the common reflected CRC, so bits of each byte and of the result are reversed around it.
    """
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def write_page(packets: bytes, lacing: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + packets)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + packets


@dataclass
class Stream:
    """A logical stream: its packets, each with the granule position at its end."""

    serial: int
    packets: list[bytes]
    granules: list[int]
    rate: int = 0
    timestamps: list[float] = field(default_factory=list)


def pages_of(stream: Stream, page_packets: int) -> list[bytes]:
    """Pages of one stream: its first packet alone, then up to ``page_packets`` a page; long packets span pages."""
    pages, number, k, n = [], 0, 0, len(stream.packets)
    lacing, body, flags, granule, count = bytearray(), bytearray(), FIRST, -1, 0

    def flush(final: bool) -> None:
        nonlocal lacing, body, flags, granule, count, number
        pages.append(write_page(bytes(body), bytes(lacing), flags | (LAST if final else 0), granule, stream.serial, number))
        lacing, body, flags, granule, count, number = bytearray(), bytearray(), 0, -1, 0, number + 1

    for k, packet in enumerate(stream.packets):
        at, sizes = 0, [255] * (len(packet) // 255) + [len(packet) % 255]
        for i, size in enumerate(sizes):
            if len(lacing) == 255:
                flush(False)
                flags = CONTINUED if i else 0
            lacing.append(size)
            body += packet[at : at + size]
            at += size
        granule, count = stream.granules[k], count + 1
        if k == 0 or count == page_packets or k == n - 1:
            flush(k == n - 1)
    return pages


def mux(streams: list[Stream], page_packets: int = PAGE_PACKETS) -> bytes:
    """All first pages, then the streams' pages in turn."""
    paged = [pages_of(s, page_packets) for s in streams]
    out = [p[0] for p in paged]
    for k in range(1, max(map(len, paged), default=0)):
        out += [p[k] for p in paged if k < len(p)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, Stream]:
    streams: dict[int, Stream] = {}
    state: dict[int, list] = {}  # serial: [next page number, unfinished packet or None, ended]
    at = 0
    while at < len(data):
        if len(data) < at + HEADER.size:
            raise OggError("truncated header")
        capture, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + segments]
        start = at + HEADER.size + segments
        end = start + sum(lacing)
        if end > len(data) or len(lacing) < segments:
            raise OggError("truncated page")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial], state[serial] = Stream(serial, [], []), [0, None, False]
        if serial not in streams:
            raise OggError(f"stream {serial} has no first page")
        expected, rest, ended = state[serial]
        if ended or number != expected or bool(flags & CONTINUED) != (rest is not None):
            raise OggError(f"stream {serial} is broken at page {number}")
        stream, pos, begun = streams[serial], start, start
        for size in lacing:
            pos += size
            if size < 255:
                stream.packets.append((rest or b"") + data[begun:pos])
                stream.granules.append(-1)
                rest, begun = None, pos
        if lacing and lacing[-1] == 255:
            rest = (rest or b"") + data[begun:pos]
        if granule >= 0 and stream.granules:
            stream.granules[-1] = granule
        state[serial] = [number + 1, rest, bool(flags & LAST)]
        at = end
    for serial, (_, rest, ended) in state.items():
        if rest is not None or not ended:
            raise OggError(f"stream {serial} is unfinished")
    for stream in streams.values():
        _timestamps(stream)
    return streams


def _timestamps(stream: Stream) -> None:
    """Seconds at the end of each packet; a packet inside a page counts back from the page's granule by sample counts."""
    if not stream.packets or stream.packets[0][:8] != PCM_MAGIC:
        return
    stream.rate = HEAD.unpack(stream.packets[0][: HEAD.size])[3]
    granules, known = stream.granules, 0
    for k in range(len(granules) - 1, 0, -1):
        if granules[k] < 0:
            known = granules[k + 1] - len(stream.packets[k + 1]) if k + 1 < len(granules) else sum(map(len, stream.packets[1:]))
            granules[k] = known
    granules[0] = 0
    stream.timestamps = [g / stream.rate for g in granules]


def store(payload: bytes, note: str = "") -> bytes:
    """8-bit mono samples, with a second logical stream for a note."""
    serial = zlib.crc32(payload)
    head = HEAD.pack(PCM_MAGIC, 1, 1, RATE, len(payload))
    cuts = range(0, len(payload), PACKET_SAMPLES)
    samples = Stream(serial, [head] + [payload[k : k + PACKET_SAMPLES] for k in cuts], [0] + [min(k + PACKET_SAMPLES, len(payload)) for k in cuts])
    other = Stream(serial ^ 0xFFFFFFFF, [NOTE_MAGIC, note.encode()], [0, 0])
    return mux([samples, other])


def load(media: bytes) -> tuple[bytes, str, Stream]:
    payload, note, found = None, "", None
    for stream in demux(media).values():
        if stream.packets[0][:8] == PCM_MAGIC:
            payload, found = b"".join(stream.packets[1:]), stream
            if len(payload) != HEAD.unpack(stream.packets[0][: HEAD.size])[4]:
                raise OggError("samples are missing")
        elif stream.packets[0] == NOTE_MAGIC:
            note = b"".join(stream.packets[1:]).decode()
    if found is None:
        raise OggError("no sample stream")
    return payload, note, found


def features(payload: bytes, stream: Stream) -> str:
    """Duration from the last granule position, level, zero crossings around the middle and a coarse histogram."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64))))
    crossings = float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
    hist = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
    return f"dur={stream.timestamps[-1]:.6f};rms={rms:.4f};peak={int(np.abs(x).max())};zcr={crossings:.6f};packets={len(stream.packets) - 1};hist={'/'.join(map(str, hist))}"


def encode_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8 (null: empty), zero-padded to a positive multiple of ``unit``."""

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for k in range(0, len(ids), 256):
            sizes, media = [], []
            for text in texts[k : k + 256]:
                raw = text.encode()
                sizes.append(len(raw))
                media.append(store(raw + bytes(-len(raw) % unit if raw else unit), f"bytes={len(raw)}"))
            yield {"doc_id": ids[k : k + 256], "n_bytes": sizes, "media": media}

    return arrow_map(df.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, n_bytes long, media binary")


SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def decode_media(df: DataFrame, *, tail: int = 64) -> DataFrame:
    """Read the stored bytes back: digests of payload and container, and features; damage goes to ``error``."""

    def run(batch: pa.RecordBatch):
        rows = []
        for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = media.as_py()
            if raw is None:
                rows.append((doc_id, n, None, None, None, None, None, None, None))
                continue
            digest = hashlib.sha256(raw).hexdigest()
            try:
                payload, _, stream = load(raw)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(raw), digest, features(payload, stream), None))
            except OggError as e:
                rows.append((doc_id, n, None, None, None, len(raw), digest, None, str(e)))
        return dict(zip([c.split()[0] for c in SUMMARY.split(", ")], zip(*rows, strict=True), strict=True))

    return arrow_map(df.select("doc_id", "n_bytes", "media"), run, SUMMARY)
