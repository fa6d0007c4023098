"""WARC derivative builder: response records to linked metadata and conversion records.

Each response gives one ``metadata`` record (fields of the source and its HTTP headers)
and one ``conversion`` record (plain text).  Both name their source in
``WARC-Refers-To`` with its target URI and date, carry labelled SHA-1 digests of their
own blocks, and the metadata record keeps the source's headers and digests verbatim.
Record identifiers are name-based UUIDs of source and kind, so a rerun gives the same ones.

The payload is decoded before it becomes text: transfer codings (``chunked``) and content
codings (``gzip``, ``deflate``) are undone in the reverse of their order, and only textual
media types are converted.

Defined cases: a null body is an empty one (its conversion record is empty); a null URL
leaves out ``WARC-Target-URI``; control characters in a URL are percent-encoded, so that no
URL can end a header; a record that is no HTTP response, has a wrong length, digest, or a
coding that is unknown or damaged, or holds no text, gives only a metadata record whose
``error`` says so; equal pages give equal records, and two bodies of one page differ in
their identifiers; very long texts are converted whole, in time proportional to their
length; an empty table gives no record; only the named columns are read, so others
(even one called ``record``) cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import htmltext
from .common import arrow_map

CRLF = b"\r\n"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:warc")
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
_TEXTUAL = re.compile(r"text/|application/(?:[\w.-]+\+)?(?:xml|json|xhtml)|application/(?:xhtml\+xml|javascript|ecmascript)", re.I)
_MARKUP = re.compile(r"text/html|application/(?:[\w.-]+\+)?(?:xhtml|xml)|text/xml|\Z", re.I)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri(url: str) -> str:
    """The URL as a header value: blanks and control characters are percent-encoded."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def _inflate(data: bytes, kind: str) -> bytes:
    """A gzip (of one or more members), zlib or raw deflate stream; a damaged or cut one raises ValueError."""
    out = []
    try:
        while data:
            d = zlib.decompressobj(31 if kind == "gzip" else 15 if data[0] & 15 == 8 and int.from_bytes(data[:2]) % 31 == 0 else -15)
            out.append(d.decompress(data) + d.flush())
            if not d.eof:
                raise ValueError(f"{kind} body is cut off")
            data = d.unused_data if kind == "gzip" else b""
    except zlib.error as e:
        raise ValueError(f"{kind} body is damaged") from e
    return b"".join(out)


def _unchunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        size = data[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("chunked body is damaged")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if len(data) < at + n + 2 or data[at + n : at + n + 2] != CRLF:
            raise ValueError("chunked body is damaged")
        out.append(data[at : at + n])
        at += n + 2


def decoded(payload: bytes, codings: list[str]) -> bytes:
    """The payload without its codings, the last applied first."""
    for coding in reversed(codings):
        if coding == "chunked":
            payload = _unchunk(payload)
        elif coding in ("gzip", "x-gzip", "deflate"):
            payload = _inflate(payload, coding.removeprefix("x-"))
        elif coding != "identity":
            raise ValueError(f"unknown coding {coding}")
    return payload


def record(kind: str, headers: list[tuple[str, str]], block: bytes, own: str | None = None) -> bytes:
    """A record; ``own`` is the block's digest, where it is known."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", own or digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + CRLF + block + CRLF + CRLF


def response(url: str | None, body: str | None, name: str, date: str) -> bytes:
    """A response record as a crawler would have stored it."""
    payload = (body or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = digest(payload)
    rid = f"<urn:uuid:{uuid.uuid5(SPACE, f'response {name} {url} {own}')}>"
    head = [("WARC-Record-ID", rid), *([("WARC-Target-URI", uri(url))] if url else []), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", own)]
    return record("response", head, http + payload)


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Header fields in order; a line that starts with a blank continues the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    head, split, rest = raw.partition(CRLF + CRLF)
    if not split or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = _fields(head.partition(CRLF)[2])
    length = dict((k.lower(), v) for k, v in fields).get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("wrong Content-Length")
    return fields, rest[: int(length)]


def plain_text(source: str, mime: str = "text/html") -> str:
    """What a reader of the page sees, by the tree builder and visibility rules of :mod:`.htmltext`; other texts stay as they are."""
    return htmltext.render(source) if _MARKUP.match(mime.strip()) else source


def derive(raw: bytes) -> list[dict]:
    """The records derived from one response record, metadata first."""
    error, http, payload, fields, charset, mime = None, [], b"", [], "utf-8", "text/html"
    try:
        fields, block = parse(raw)
        look = {k.lower(): v for k, v in fields}
        if look.get("warc-type") != "response":
            raise ValueError("not a response record")
        if "warc-block-digest" in look and look["warc-block-digest"] != digest(block):
            raise ValueError("block digest differs")
        head, split, payload = block.partition(CRLF + CRLF)
        if not split or not head.startswith(b"HTTP/"):
            raise ValueError("no HTTP response")
        if "warc-payload-digest" in look and look["warc-payload-digest"] != digest(payload):
            raise ValueError("payload digest differs")
        http = [("status", head.partition(CRLF)[0].decode("latin-1")), *_fields(head.partition(CRLF)[2])]
        said: dict[str, str] = {}
        for k, v in http[1:]:
            said[k.lower()] = f"{said[k.lower()]},{v}" if k.lower() in said else v
        mime = said.get("content-type", "text/html")
        if not _TEXTUAL.match(mime.strip()):
            raise ValueError(f"no text: {mime}")
        codings = [c.strip().lower() for name in ("content-encoding", "transfer-encoding") for c in said.get(name, "").split(",") if c.strip()]
        if found := _CHARSET.search(mime):
            charset = found[1]
        text = decoded(payload, codings).decode(charset, "replace")
    except (ValueError, LookupError) as e:
        error, text = str(e), ""
    look = {k.lower(): v for k, v in fields}
    source, target, date = look.get("warc-record-id", ""), look.get("warc-target-uri"), look.get("warc-date", "")
    out = []
    for kind in ("metadata",) if error else ("metadata", "conversion"):
        if kind == "metadata":
            lines = [("source-" + k.lower(), v) for k, v in fields] + [("http-" + k.lower(), v) for k, v in http] + ([("error", error)] if error else [])
            block, kept = "".join(f"{k}: {v}\r\n" for k, v in lines).encode(), "application/warc-fields"
        else:
            block, kept = plain_text(text, mime).encode(), "text/plain; charset=utf-8"
        rid = f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {source}')}>"
        head = [("WARC-Record-ID", rid), *([("WARC-Target-URI", target), ("WARC-Refers-To-Target-URI", target)] if target else []), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Date", date), ("Content-Type", kept)]
        out.append({"record_type": kind, "record_id": rid, "refers_to": source or None, "target_uri": target, "warc_date": date or None, "content_type": kept, "content_length": len(block), "block_digest": (own := digest(block)), "source_block_digest": look.get("warc-block-digest"), "source_payload_digest": look.get("warc-payload-digest"), "source_headers": json.dumps(fields, ensure_ascii=False), "error": error, "record": record(kind, head, block, own)})
    return out


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, error string, record binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pages_to_responses(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    def run(batch: pa.RecordBatch):
        ids, urls, bodies = (c.to_pylist() for c in batch.columns)
        for k in range(0, len(ids), 256):
            part = range(k, min(k + 256, len(ids)))
            yield {"page_id": ids[k : k + 256], "record": [response(urls[i], bodies[i], str(ids[i]), date) for i in part]}

    return arrow_map(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, "page_id long, record binary")


def build_derivatives(responses: DataFrame) -> DataFrame:
    """(page_id, record) of responses to rows of derived records; no shuffle, one pass."""

    def run(batch: pa.RecordBatch):
        ids = batch.column(0).to_pylist()
        for k in range(0, len(ids), 256):
            rows = [{"page_id": i, **r} for i, raw in zip(ids[k : k + 256], batch.column(1)[k : k + 256], strict=True) for r in derive(raw.as_py() or b"")]
            yield {c: [r[c] for r in rows] for c in _NAMES}

    return arrow_map(responses.select("page_id", "record"), run, SCHEMA)
