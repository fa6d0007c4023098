"""Storage paths ``workspace/yyyy/MM/document/file`` and file names."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@cache
def _ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: those that become one character, and those that become several."""
    one, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.decomposition(c):
            plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            if plain:
                (one if len(plain) == 1 else several)[c] = plain
    return one, several


def ascii_form(text: Column) -> Column:
    """The ASCII characters of the compatibility decomposition: marks go, ligatures and numbers in signs are written out.

    Characters that become one other are translated at once; the rare ones that become several are looked up letter
    by letter, in texts that hold any.
    """
    one, several = _ascii_forms()
    forms = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(forms, c), c)), "")
    written = F.when(text.rlike("[" + "".join(several) + "]"), spelled).otherwise(text)
    return F.regexp_replace(F.translate(written, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")


def extension(name: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(name, r"\.([^./\\]+)$", 1), F.lit("")))


def sanitize(name: Column, limit: int = 200) -> Column:
    """ASCII letters, digits, ``._-``; no path parts or double dots; at most ``limit`` characters."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    plain = F.regexp_replace(ascii_form(base), r"[^\x20-\x7E]", "")
    safe = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9._-]+", "_"), r"\.{2,}", ".")
    trimmed = F.regexp_replace(safe, r"^[._]+|[._]+$", "")
    return F.when(F.length(trimmed) == 0, "unnamed").otherwise(F.substring(trimmed, 1, limit))


def document_path(workspace: Column, document: Column, name: Column, at: Column) -> Column:
    return F.concat_ws("/", workspace, F.date_format(at, "yyyy"), F.date_format(at, "MM"), document, sanitize(name))


def temp_path(name: Column, session: Column) -> Column:
    return F.concat_ws("/", F.lit("temp"), session, sanitize(name))


def versioned_path(path: Column, version: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"^(.*)/[^/]+$", 1), F.lit("/v"), version.cast("string"), F.lit("/"), F.regexp_extract(path, r"([^/]+)$", 1))


def components(path: Column) -> Column:
    p = F.split(path, "/")
    at = lambda k: F.try_element_at(p, F.lit(k))
    return F.struct(at(1).alias("workspace"), at(2).try_cast("int").alias("year"), at(3).try_cast("int").alias("month"), at(4).alias("document"), at(-1).alias("file"))


def is_safe(path: Column) -> Column:
    return ~(path.contains("\x00") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.contains("//") | (path == ""))


def is_document_path(path: Column) -> Column:
    c = components(path)
    return (F.size(F.split(path, "/")) == 5) & c["workspace"].rlike(f"^{UUID}$") & c["document"].rlike(f"^{UUID}$") & c["year"].between(2000, 2100) & c["month"].between(1, 12) & (F.length(c["file"]) > 0)


def numbered(name: Column, k: Column) -> Column:
    """``name_k.ext`` for the k-th file of a name; the first keeps its name."""
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(k == 0, name).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext))
