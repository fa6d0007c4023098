"""Files: listing, reading with encoding fall-through, upload checks, parser routing and registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")
METADATA_ENCODINGS = ("utf-8", "utf-16", "latin-1", "cp1252", "ascii")
MAX_BYTES = 30 * 1024 * 1024
# fixed values: what may be uploaded, by extension
ALLOWED = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
}
TEXT_EXTENSIONS = ("txt", "md", "html", "csv", "json", "xml")


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", "modificationTime")


def read_texts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, text, encoding): each file whole, in the first encoding that fits; NUL characters are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, used = decode(raw.as_py() or b"", encodings)
                yield pa.record_batch([pa.array([name]), pa.array([text], pa.string()), pa.array([used], pa.string())], names=["path", "text", "encoding"])

    return files.mapInArrow(run, "path string, text string, encoding string")


def decode(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str | None, str | None]:
    for name in encodings:
        try:
            return raw.decode(name).replace("\x00", ""), name
        except UnicodeDecodeError:
            continue
    return None, None


def sniffed_mime(content: Column, extension: Column) -> Column:
    """MIME type by magic bytes, else by extension."""
    head = F.hex(F.substring(content, 1, 8))
    by_name = F.create_map(*(F.lit(x) for pair in ALLOWED.items() for x in pair))
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), F.try_element_at(by_name, extension)).otherwise(F.when(extension.isin(*TEXT_EXTENSIONS), F.try_element_at(by_name, extension)))


def check_uploads(files: DataFrame, *, name: str = "name", size: str = "length", mime: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``errors`` lists why an upload is refused; accepted rows have none."""
    ext = paths.extension(F.col(name))
    rules = [F.when(~F.coalesce(ext.isin(*ALLOWED), F.lit(False)), "extension not allowed"), F.when(F.col(size) > max_bytes, "file too large"), F.when(F.col(size) == 0, "file empty")]
    if mime:
        rules.append(F.when(~F.coalesce(F.col(mime).isin(*ALLOWED.values()), F.lit(False)), "type not allowed"))
    return files.withColumn("errors", F.array_compact(F.array(*rules)))


def mime_limits(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Files over the limit of their type; ``limits``: mime_type, max_bytes."""
    return files.join(F.broadcast(limits), "mime_type").where(F.col("length") > F.col("max_bytes"))  # a row for each type


def page_analysis(pages: DataFrame) -> DataFrame:
    """Page, image and text counts by document; input: doc_id, page, n_images, n_chars."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("n_images").alias("images"), (F.sum("n_chars") > 0).alias("has_text"), F.count_if(F.col("n_chars") == 0).alias("ocr_pages"))


def parsers_for(images: Column, has_text: Column) -> Column:
    """The text parser always; the vision parser for 3 to 10 images, or for images without text."""
    vision = images.between(3, 10) | (~has_text & (images > 0))
    return F.when(vision, F.array(F.lit("text"), F.lit("vision"))).otherwise(F.array(F.lit("text")))


def fallback_analysis(name: Column) -> Column:
    """Guess by extension: (has_images, has_text)."""
    ext = paths.extension(name)
    return F.struct(ext.isin("pdf", "pptx", "docx").alias("has_images"), (~ext.isin("png", "jpg", "jpeg")).alias("has_text"))


def merge_parses(text: DataFrame, vision: DataFrame) -> DataFrame:
    """Both parses of a document; confidence is .7 of the text's and .3 of the vision's, or that of the only one."""
    t, v = text.alias("t"), vision.alias("v")
    df = t.join(v, "doc_id", "full_outer")
    both = F.col("t.confidence").isNotNull() & F.col("v.confidence").isNotNull()
    conf = F.when(both, 0.7 * F.col("t.confidence") + 0.3 * F.col("v.confidence")).otherwise(F.coalesce("t.confidence", "v.confidence"))
    return df.select("doc_id", F.concat_ws("\n\n--- Visual content ---\n\n", F.nullif("t.text", F.lit("")), F.nullif("v.text", F.lit(""))).alias("text"), F.round(conf, 4).alias("confidence"))


def page_text(pages: DataFrame) -> DataFrame:
    """Pages in order, each under its mark; input: doc_id, page, text."""
    marked = F.concat(F.lit("\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))), lambda s: s["t"]), "").alias("text"))


def page_ranges(docs: DataFrame, batch: int = 50, over: int = 100) -> DataFrame:
    """One row per batch of pages for long documents, else one; input: doc_id, pages."""
    step = F.when(F.col("pages") > over, batch).otherwise(F.greatest("pages", F.lit(1)))
    starts = F.sequence(F.lit(1), F.greatest("pages", F.lit(1)), step)
    return docs.select("doc_id", F.explode(starts).alias("first_page"), "pages", step.alias("step")).select("doc_id", "first_page", F.least(F.col("first_page") + F.col("step") - 1, F.greatest("pages", F.lit(1))).alias("last_page"))


def with_fallback(primary: DataFrame, fallback: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata of the first service, else of the second, column by column."""
    a, b = primary.alias("a"), fallback.alias("b")
    return a.join(b, "doc_id", "full_outer").select("doc_id", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns))


Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Parser] = {}


def register_parser(name: str, parser: Parser) -> None:
    """A parser maps (path, content) rows to (path, text) rows."""
    _PARSERS[name] = parser


def get_parser(name: str = "text") -> Parser:
    if name not in _PARSERS:
        raise KeyError(f"unknown parser {name!r}; known: {sorted(_PARSERS)}")
    return _PARSERS[name]


register_parser("text", lambda files: files.select("path", F.decode("content", "UTF-8").alias("text")))


def route(files: DataFrame) -> dict[str, DataFrame]:
    """Files by reader: text by extension, documents for a registered parser, and what neither takes."""
    ext = paths.extension(F.col("path"))
    return {"text": files.where(ext.isin(*TEXT_EXTENSIONS)), "document": files.where(ext.isin("pdf", "docx", "pptx", "xlsx")), "other": files.where(~F.coalesce(ext.isin(*ALLOWED), F.lit(False)))}
