"""Document structure: typed spans found by patterns.

An element is a row of :data:`RULES`: a pattern and what a match of it says.  One loop runs the
rules over a text, and questions by position (which heading is before, which block is around)
are binary searches.  :func:`extract` does this in one Arrow map; counts and texts without
offsets are plain column expressions.

Time is in proportion to the text.  Patterns whose search would look at the same stretch from many
starts (runs of blank lines before a list, fences and images that never close, rows of bars) are
read by scanners instead, which go forward only: a position that one start has ruled out is not
tried again, and what no later start can find ends the search.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,level:int,text:string,detail:string,parent:int>"
SCHEMA = f"doc_id long, spans array<{SPAN}>"

# fixed values: the patterns that define each element
PATTERNS = {
    "atx": r"^(#{1,6})\s+(.+)$",
    "setext1": r"^(.+)\n(=+)$",
    "setext2": r"^(.+)\n(-{3,})$",
    "caps": r"^([A-Z][A-Z\s]{5,80})$",
    "indented": r"((?:^(?:    |\t).+\n?)+)",
    "figure": r"Figure\s+(\d+):\s*(.+?)(?:\n|$)",
    "display": r"\$\$(.+?)\$\$",
    "inline": r"\$(.+?)\$",
    "author_year": r"\(([A-Z][a-z]+(?:\s+(?:et\s+al\.|&|and)\s+[A-Z][a-z]+)?),\s*(\d{4})\)",
    "numbered": r"\[(\d+)\]",
    "note_ref": r"\[\^(\d+)\]",
    "note_def": r"^\[\^(\d+)\]:\s*(.+)$",
    "term": r"^([A-Z][a-zA-Z\s]{2,50}):\s*(.+)$",
    "bold_term": r"\*\*([A-Z][a-zA-Z\s]{2,50})\*\*\s*[-–—]\s*(.+?)(?:\n|$)",
    "caption": r"(?:Table \d+:|Caption:)\s*(.+)",
}
_DOTALL, _CASELESS = ("display",), ("figure", "caption")
_RE = {k: re.compile(p, re.M | (re.S if k in _DOTALL else 0) | (re.I if k in _CASELESS else 0)) for k, p in PATTERNS.items()}
_ITEM_MARK, _CODE_INDENT = re.compile(r"^(?:[-*•+]|\d+[.)\]])\s+"), re.compile(r"(?m)^(?:    |\t)")
_BLANK_LINES = re.compile(r"\n\s*\n")


# Scanners: they find what a pattern describes, first match first, without overlap -----------


class Hit:
    """What a scanner has found; it is asked like a match of a pattern."""

    def __init__(self, text: str, start: int, end: int, *groups: str | None):
        self.string, self._span, self._groups = text, (start, end), groups

    def start(self) -> int:
        return self._span[0]

    def end(self) -> int:
        return self._span[1]

    def __getitem__(self, k: int) -> str | None:
        return self._groups[k - 1] if k else self.string[slice(*self._span)]


_VISIBLE, _FENCE = re.compile(r"\S"), re.compile(r"```(\w+)?\n")
# an item from its mark on: white space after the mark may hold line ends, then the rest of a line
_ITEMS = {"unordered": re.compile(r"[-*•+]\s+.+\n?"), "ordered": re.compile(r"\d+[.)\]]\s+.+\n?")}


def _lists(kind: str) -> Callable[[str], Iterator[Hit]]:
    """Blocks of items; an item begins at a line, after any white space and blank lines."""

    def scan(text: str) -> Iterator[Hit]:
        at, begin = 0, None
        while at <= len(text):
            seen = _VISIBLE.search(text, at)
            item = seen and _ITEMS[kind].match(text, seen.start())
            if item:
                begin = at if begin is None else begin
                at = item.end()
                if at < len(text) and text[at - 1] == "\n":  # another item may follow
                    continue
            if begin is not None:
                yield Hit(text, begin, at, text[begin:at])
                begin = None
            if not seen:
                return
            # every line start up to the character that was seen is ruled out with it
            found = text.find("\n", max(at - 1, 0) if item else seen.start())
            if found < 0:
                return
            at = max(found + 1, at)

    return scan


def _tables(text: str) -> Iterator[Hit]:
    """A row, a row of dashes under it and rows of their own lines."""
    at = 0
    while at < len(text):
        bar, stop = text.find("|", at), -1
        if bar < 0:
            return
        stop = text.find("\n", bar)
        if stop < 0:
            return
        end = _table_end(text, stop + 1) if text[stop - 1] == "|" and stop - 1 - bar >= 2 else None
        if end:
            yield Hit(text, bar, end, text[bar:end])
        at = end or stop + 1


def _table_end(text: str, at: int) -> int | None:
    """Where the table ends whose row of dashes begins at ``at``; None if there is none or no row under it."""
    stop = text.find("\n", at)
    rule = text[at:stop]
    if stop < 0 or len(rule) < 3 or rule[0] != "|" or rule[-1] != "|" or rule.strip("-:| "):
        return None
    end, at = None, stop + 1
    while text.startswith("|", at):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        last = text.rfind("|", at, stop)
        if last < at + 2:
            break
        end = at = last + 2 if last + 1 == stop < len(text) else last + 1
    return end


def _fences(text: str) -> Iterator[Hit]:
    at = 0
    while opened := _FENCE.search(text, at):
        close = text.find("\n```", opened.end())
        if close < 0:  # nor does any later one close
            return
        at = close + 4
        yield Hit(text, opened.start(), at, opened[1], text[opened.end() : close])


def _images(text: str) -> Iterator[Hit]:
    at = bracket = paren = 0
    while (at := text.find("![", at)) >= 0:
        if bracket < at + 2:
            bracket = text.find("]", at + 2)
        if bracket < 0:
            return
        if text.startswith("(", bracket + 1):
            if paren < bracket + 2:
                paren = text.find(")", bracket + 2)
            if paren < 0:
                return
            if paren > bracket + 2:
                yield Hit(text, at, paren + 1, text[at + 2 : bracket], None)
                at = paren + 1
                continue
        at += 1


_SCANNERS: dict[str, Callable[[str], Iterator[Hit]]] = {"unordered": _lists("unordered"), "ordered": _lists("ordered"), "table": _tables, "fence": _fences, "image": _images}


# Readings: what a match of a pattern says, as (text, level, detail); None if it says nothing.  ``nth`` counts matches.


def _setext(level: int):
    return lambda m, nth: (m[1].strip(), level, None) if len(m[1].strip()) < 100 else None


def _caps(m: re.Match, nth: int):
    line = m[1].strip()
    letters = len(line) - line.count(" ")
    return (line, 2, None) if letters and sum(c.isupper() for c in line) > 0.9 * letters else None


def _table(m: Hit, nth: int):
    grid = [[cell.strip() for cell in line.strip().split("|")[1:-1]] for line in m[1].splitlines() if line.strip()]
    if len(grid) < 2:
        return None
    around = m.string[max(0, m.start() - 100) : m.start()] + m.string[m.end() : m.end() + 100]
    caption = _RE["caption"].search(around)
    return " | ".join(grid[0]), sum(len(row) == len(grid[0]) for row in grid[2:]), caption and caption[1].strip()


def _list(kind: str):
    def read(m: Hit, nth: int):
        items = [_ITEM_MARK.sub("", line.strip()) for line in m[1].split("\n") if line.strip()]
        return ("\n".join(items), len(items), kind) if items else None

    return read


@dataclass(frozen=True)
class Rule:
    """One pattern of an element.  ``unless`` names a pattern whose matches hide those that begin within them (ends count),
    and then a match that begins where the one before it ends is hidden as well."""

    kind: str
    pattern: str
    read: Callable
    unless: str | None = None


RULES = (
    Rule("heading", "atx", lambda m, nth: (m[2].strip(), len(m[1]), None)),
    Rule("heading", "setext1", _setext(1)),
    Rule("heading", "setext2", _setext(2)),
    Rule("heading", "caps", _caps),
    Rule("table", "table", _table),
    Rule("list", "unordered", _list("unordered")),
    Rule("list", "ordered", _list("ordered")),
    Rule("code", "fence", lambda m, nth: (m[2], None, m[1])),
    Rule("code", "indented", lambda m, nth: (_CODE_INDENT.sub("", m[1]), None, None), unless="fence"),
    Rule("figure", "image", lambda m, nth: (m[1], nth, m[2])),
    Rule("figure", "figure", lambda m, nth: (m[2].strip(), int(m[1]), None)),
    Rule("equation", "display", lambda m, nth: (m[1].strip(), None, "display")),
    Rule("equation", "inline", lambda m, nth: (m[1].strip(), None, "inline"), unless="display"),
    Rule("citation", "author_year", lambda m, nth: (m[0], int(m[2]), m[1])),
    Rule("citation", "numbered", lambda m, nth: (m[0], None, f"Reference {m[1]}")),
    Rule("note", "note_def", lambda m, nth: (m[2].strip(), int(m[1]), None)),
    Rule("footnote", "note_ref", lambda m, nth: (None, int(m[1]), None)),
    Rule("definition", "term", lambda m, nth: (m[1].strip(), None, m[2].strip())),
    Rule("definition", "bold_term", lambda m, nth: (m[1].strip(), None, m[2].strip())),
)
# what a text has to hold for a pattern to match at all, so that most patterns never run on plain prose
NEEDS = {"atx": "#", "setext1": "\n=", "setext2": "\n---", "table": "|", "fence": "```", "image": "![", "display": "$$", "inline": "$", "author_year": "(", "numbered": "[", "note_ref": "[^", "note_def": "[^", "term": ":", "bold_term": "**"}


class _Spans:
    """Disjoint or nested spans in the order of their starts, asked by position."""

    def __init__(self, found: list[dict]):
        self.found = sorted(found, key=lambda s: s["start"])
        self.starts = [s["start"] for s in self.found]
        self.reach = list(accumulate((s["end"] for s in self.found), max))

    def before(self, at: int) -> int | None:
        """The last span that starts before ``at``."""
        return bisect_left(self.starts, at) - 1 if self.starts and self.starts[0] < at else None

    def around(self, at: int) -> int | None:
        """The first span that holds ``at``."""
        k = bisect_left(self.reach, at)
        return k if k < len(self.found) and self.starts[k] <= at else None


def _matches(text: str) -> dict[str, list[dict]]:
    """Spans of every pattern, in the order of the text."""
    out: dict[str, list[dict]] = {}
    for rule in RULES:
        found = out[rule.pattern] = []
        if NEEDS.get(rule.pattern, "") not in text:
            continue
        hidden = _Spans(out[rule.unless]) if rule.unless else None
        for nth, m in enumerate(_SCANNERS[rule.pattern](text) if rule.pattern in _SCANNERS else _RE[rule.pattern].finditer(text), 1):
            at = m.start()
            if hidden and (hidden.around(at) is not None or found and found[-1]["end"] >= at):
                continue
            if said := rule.read(m, nth):
                found.append({"kind": rule.kind, "start": m.start(), "end": m.end(), "level": said[1], "text": said[0], "detail": said[2], "parent": None})
    return out


def _nest(heads: list[dict]) -> None:
    """Each heading's parent: the nearest one before it of a smaller level."""
    path: list[tuple[int, int]] = []
    for k, h in enumerate(heads):
        path = [p for p in path if p[0] < h["level"]]
        h["parent"] = path[-1][1] if path else None
        path.append((h["level"], k))


def _paragraphs(text: str, least: int = 10) -> list[dict]:
    """Blocks between blank lines of ``least`` characters or more."""
    cuts = [(0, 0), *(m.span() for m in _BLANK_LINES.finditer(text)), (len(text), len(text))]
    out = []
    for (_, a), (b, _) in zip(cuts, cuts[1:], strict=False):
        body = text[a:b].strip()
        if len(body) >= least:
            at = a + text[a:b].index(body[0])
            out.append({"kind": "paragraph", "start": at, "end": at + len(body), "level": None, "text": body, "detail": None, "parent": None})
    return out


def spans(text: str | None) -> list[dict]:
    """All elements of a text: headings, then paragraphs, then the rest by kind."""
    if not text:
        return []
    found = _matches(text)
    by_kind: dict[str, list[dict]] = {}
    for rule in RULES:
        by_kind.setdefault(rule.kind, []).extend(found[rule.pattern])
    heads, paras = _Spans(by_kind.pop("heading")), _Spans(_paragraphs(text))
    _nest(heads.found)
    for p in paras.found:
        p["parent"] = heads.before(p["start"])
    for d in by_kind["definition"]:
        d["parent"] = paras.around(d["start"])
    notes = {n["level"]: n["text"] for n in by_kind.pop("note")}
    by_kind["footnote"] = [f | {"end": f["start"], "text": notes[f["level"]]} for f in by_kind["footnote"] if f["level"] in notes]
    return heads.found + paras.found + [s for kind in by_kind.values() for s in kind]


def extract(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [spans(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found, type=_ARROW)], names=["doc_id", "spans"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("level", pa.int32()), ("text", pa.string()), ("detail", pa.string()), ("parent", pa.int32())]))


# Column forms without offsets ------------------------------------------------------------


def atx_headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}[ \t]+[^\n]+)$"), F.lit(1))


def caps_headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^([A-Z][A-Z \t]{5,80})$"), F.lit(1))


def list_items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:[-*•+]|\d+[.)\]])[ \t]+([^\n]+)$"), F.lit(1))


def citation_marks(text: Column) -> Column:
    numbered = F.regexp_extract_all(text, F.lit(r"(\[\d+\])"), F.lit(1))
    dated = F.regexp_extract_all(text, F.lit(r"(\([A-Z][a-z]+(?:\s+(?:et\s+al\.|&|and)\s+[A-Z][a-z]+)?,\s*\d{4}\))"), F.lit(1))
    return F.concat(numbered, dated)


def footnote_numbers(text: Column) -> Column:
    refs = F.regexp_extract_all(text, F.lit(r"\[\^(\d+)\]"), F.lit(1))
    defs = F.regexp_extract_all(text, F.lit(r"(?m)^\[\^(\d+)\]:\s*[^\n]+$"), F.lit(1))
    return F.array_intersect(refs, defs)
