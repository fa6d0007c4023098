"""Layout-aware HTML rendering to text.

A scanner feeds a tree builder that supplies implied tags (``p``, ``li``, ``td``,
``tr``, ``option``, ...); visibility rules remove what a browser does not show (elements
without a box, ``hidden``, closed ``dialog`` and ``details``, ``display`` and ``visibility``
of style attributes and of the page's own style rules, with combinators); the renderer keeps block
spacing, list markers, preformatted text, and tables with aligned cells, whose
``colspan`` and ``rowspan`` keep columns in place.

Scanning, building and rendering take time in proportion to the page and no recursion, at
any depth of nesting.  Matching style rules takes, for each element, the parts of selectors
that its tag, identifier and classes name: rules that repeat a selector cost nothing more,
and only a page whose many different selectors all name the same elements costs their
product.  Only layout is bounded (:class:`Layout`), never text.

Defined cases: null or empty HTML gives the empty text; broken markup is read as text or
closed at the end, but a tag that the page's end cuts off is no text, as in a browser;
repeated rows are rendered alike; very long pages are rendered whole; an empty table gives
no row; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of



@dataclass(frozen=True)
class Layout:
    """Bounds on layout; text is never bounded."""

    indent: int = 60  # letters of indentation; deeper lists and quotes go on at this depth
    grids: int = 6  # tables inside of each other that are aligned; deeper ones are laid out as blocks
    padding: int = 16  # a table whose padding takes more than so many times its text (and ``spare``) is not padded
    spare: int = 10_000
    columns: int = 4096  # columns that are padded


# fixed values of the HTML standard: element classes that a renderer has to know
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas title".split())
# inside of svg and math: elements that are not painted, and those that stand apart from their neighbours
ISLANDS = frozenset(("svg", "math"))
UNPAINTED = {"svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
APART = {"svg": frozenset(("text",)), "math": frozenset(("mtd",))}
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# for each element: open elements that its start tag closes, and the elements that such closing stops at
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
SCOPE = ("table", "td", "th", "caption", "html", "button", "object")
TABLE_PARTS = frozenset(("table", "tr", "tbody", "thead", "tfoot", "body", "html"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>]*+)))?)?+")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ISLAND = re.compile(r"<(?:svg|math)[\s/>]", re.I)
_CLOSE_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_WHOLE = re.compile(r"\s*([-+]?[0-9]+)")
_LINKS = re.compile(r"(\s*[>+~]\s*|\s+)")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")


def _tag_end(source: str, at: int, attrs: dict[str, str] | None) -> tuple[int, bool]:
    """(place behind the tag's ``>``, whether it closes itself); -1 if the page ends inside of the tag."""
    n, last = len(source), at
    while at < n:
        if source[at] == ">":
            return at + 1, source[at - 1] == "/" and at > last
        m = _ATTR.match(source, at)
        if m[1] is None:
            if m.end() == at:
                return -1, False
            at = m.end()
            continue
        if m[2] is not None and not m[3] or m[4] is not None and not m[5]:
            return -1, False  # a quote that is never closed
        if attrs is not None:
            name = m[1].lower()
            if name not in attrs:
                value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6] or ""
                attrs[name] = _html.unescape(value) if "&" in value else value
        at = last = m.end()
    return -1, False


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str] | None, bool]]:
    """("text", text, None, False), ("start", tag, attributes, self-closing), ("end", tag, None, False)."""
    at, held, n, island = 0, 0, len(source), 0
    while True:
        lt = source.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        mark = source[lt + 1]
        if mark == "/":
            name = _NAME.match(source, lt + 2)
            if not name:
                if lt + 2 >= n:
                    break
                stop = source.find(">", lt + 2)  # no tag: a comment in the standard
                if lt > held:
                    yield "text", source[held:lt], None, False
                if stop < 0:
                    return
                held = at = stop + 1
                continue
        elif mark in "!?":
            if lt > held:
                yield "text", source[held:lt], None, False
            if source.startswith("<!--", lt):
                if source.startswith((">", "->"), lt + 4):
                    stop = source.find(">", lt + 4) + 1
                else:
                    found = _COMMENT_END.search(source, lt + 4)
                    stop = found.end() if found else 0
            else:
                stop = source.find(">", lt + 2) + 1
            if not stop:
                return
            held = at = stop
            continue
        else:
            name = _NAME.match(source, lt + 1)
            if not name:
                at = lt + 1
                continue
        if lt > held:
            yield "text", source[held:lt], None, False
        tag = name[0].lower()
        end = name.end()
        if mark == "/":
            stop, _ = (end + 1, False) if source.startswith(">", end) else _tag_end(source, end, None)
            if stop < 0:
                return
            held = at = stop
            if tag in ISLANDS:
                island = max(0, island - 1)
            yield "end", tag, None, False
            continue
        if source.startswith(">", end):
            attrs, stop, own = None, end + 1, False
        else:
            attrs = {}
            stop, own = _tag_end(source, end, attrs)
            if stop < 0:
                return
        held = at = stop
        if tag in ISLANDS and not own:
            island += 1
        yield "start", tag, attrs or None, own
        if tag in RAW and not (island and own):
            close = _CLOSE_RAW[tag].search(source, at)
            stop = close.start() if close else n
            if stop > at:
                yield "text", source[at:stop], None, False
            if not close:
                return
            held, _ = _tag_end(source, close.end(), None)
            if held < 0:
                return
            at = held
            yield "end", tag, None, False
    if held < n:
        yield "text", source[held:], None, False


class Node:
    __slots__ = ("tag", "attrs", "kids", "css")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []
        self.css: dict[str, str] | None = None  # what rules or its own style declare


class Page(Node):
    """The root of a page's tree, with its style elements and the depth of its deepest element."""

    __slots__ = ("styles", "depth")

    def __init__(self):
        super().__init__("#root")
        self.styles, self.depth = [], 0


class _Open:
    """The stack of open elements, with the places of each tag, so that no question walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        found, places = 0, self.places
        for t in tags:
            if (p := places.get(t)) and p[-1] > found:
                found = p[-1]
        return found

    def close(self, closes, stops) -> None:
        while (k := self.last(closes)) > self.last(stops):
            self.cut(k)


def build(source: str) -> Page:
    """The element tree; text children are strings with character references resolved."""
    root = Page()
    tree = _Open(root)
    stack, islands = tree.stack, _ISLAND.search(source)
    for kind, tag, attrs, own in tokens(source):
        if kind == "text":
            stack[-1].kids.append(tag if "&" not in tag or stack[-1].tag in ("script", "style") else _html.unescape(tag))
        elif kind == "start":
            if tag in CLOSES_P:
                tree.close(("p",), SCOPE)
            if tag in IMPLIED:
                tree.close(*IMPLIED[tag])
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                tree.cut(len(stack) - 1)
            if tag in ("td", "th") and (table := tree.last(("table",))) and tree.last(("tr",)) < table:
                row = Node("tr")
                stack[-1].kids.append(row)
                tree.push(row)
            node = Node(tag, attrs)
            island = stack[tree.last(ISLANDS)].tag if islands and tree.last(ISLANDS) else None
            if island and (tag in UNPAINTED[island] or node.attrs.get("display") == "none"):
                node.attrs["hidden"] = ""
            if island and node.attrs.get("visibility") in ("hidden", "collapse"):
                node.attrs.setdefault("style", "visibility:hidden")
            apart = [" "] if island and tag in APART[island] else []
            stack[-1].kids += [*apart, node, *apart]
            if tag not in VOID and not ((island or tag in ISLANDS) and own):
                tree.push(node)
                root.depth = max(root.depth, len(stack))
                if tag == "style":
                    root.styles.append(node)
        elif tag == "br" or (tag == "p" and not tree.last(("p",))):
            stack[-1].kids.append(Node(tag))
        elif at := tree.last((tag,)):
            if at >= tree.last(("table", "td", "th")) or tag in TABLE_PARTS:
                tree.cut(at)
    return root


class Part:
    """One compound of selectors (tag, identifiers, classes) behind another part; selectors with a common beginning share its parts."""

    __slots__ = ("above", "link", "tag", "ids", "classes", "more", "found")

    def __init__(self, above: Part | None, link: str, tag: str, ids: frozenset[str], classes: frozenset[str]):
        self.above, self.link, self.tag, self.ids, self.classes = above, link, tag, ids, classes
        self.more = False  # whether a longer selector goes on from here
        self.found: dict[str, tuple] = {}  # name -> ((important, specificity, order), value) of selectors that end here

    def fits(self, node: Node, classes: frozenset[str]) -> bool:
        return (not self.tag or self.tag == node.tag) and self.classes <= classes and (not self.ids or self.ids == {node.attrs.get("id")})


class Styles:
    """Rules of a page's own style elements that show or hide, outside of at-rules: compounds of tag, identifiers and
    classes behind each other (blank), as a child (>), as the next (+) or a later (~) sibling.

    Equal compounds are one part, which keeps its winning declarations only, and a part is looked up by its rarest
    name and by the part before it; so an element meets the parts that name it, however many rules there are.
    """

    def __init__(self, sheets: list[Node]):
        self.parts: dict[tuple, Part] = {}
        for n, (selector, body) in enumerate(b for node in sheets for b in self._blocks("".join(k for k in node.kids if isinstance(k, str)))):
            found = self.declared(body)
            for one in selector.split(",") if found else ():
                self._add(one.strip(), n, found)
        names: Counter[str] = Counter(name for p in self.parts.values() for name in self._names(p))
        self.by_name: dict[str, dict[Part | None, list[Part]]] = defaultdict(lambda: defaultdict(list))
        for part in self.parts.values():
            own = [*self._names(part)] or [part.tag or "*"]
            self.by_name[min(own, key=lambda name: names[name])][part.above].append(part)

    @staticmethod
    def _names(part: Part) -> Iterator[str]:
        yield from ("#" + i for i in part.ids)
        yield from ("." + c for c in part.classes)

    def _add(self, selector: str, order: int, found: dict[str, tuple[str, bool]]) -> None:
        part, weight, link = None, (0, 0, 0), ""
        for word in _LINKS.split(selector):
            if not word:
                continue
            if word.strip() in ("", ">", "+", "~"):
                link = word.strip() or " "
                continue
            m = _SELECTOR.match(word)
            if not m or not (m[1] or m[2]):
                return  # states, attributes and the like are not known here
            ids, classes = frozenset(re.findall(r"#([\w-]+)", m[2])), frozenset(re.findall(r"\.([\w-]+)", m[2]))
            tag = m[1].lower() if m[1] and m[1] != "*" else ""
            key = (part, link if part else "", tag, ids, classes)
            if part:
                part.more = True
            part = self.parts.setdefault(key, Part(*key))
            weight = (weight[0] + len(ids), weight[1] + len(classes), weight[2] + bool(tag))
        if part:
            for name, (value, strong) in found.items():
                part.found[name] = max(part.found.get(name, ((),)), ((strong, False, weight, order), value))

    def apply(self, root: Node) -> None:
        """Give every element that rules or its own style name its declared ``display`` and ``visibility``.

        One walk over the tree.  What has been matched so far goes down with it: parts whose selectors go on below an
        element (``within``), right below it (``inside``) and after it among its siblings (``beside``, ``after``).
        """
        empty: frozenset[Part] = frozenset()
        todo = [(iter(root.kids), empty, empty, [empty, empty])]
        while todo:
            kids, within, inside, besides = todo[-1]
            node = next((k for k in kids if not isinstance(k, str)), None)
            if node is None:
                todo.pop()
                continue
            beside, after = besides
            css, met = self._of(node, {" ": within, ">": inside, "+": beside, "~": after})
            if css:
                node.css = css
            more = frozenset(p for p in met if p.more)
            besides[0] = more
            besides[1] = after if more <= after else after | more
            if node.kids:
                todo.append((iter(node.kids), within if more <= within else within | more, more, [empty, empty]))

    def _of(self, node: Node, known: dict[str, frozenset[Part]]) -> tuple[dict[str, str], list[Part]]:
        a = node.attrs
        classes = frozenset(a["class"].split()) if "class" in a else frozenset()
        met, won = [], {}
        for name in (node.tag, "*", *("." + c for c in classes), *(["#" + a["id"]] if "id" in a else [])):
            if not (by_above := self.by_name.get(name)):
                continue
            candidates = list(by_above.get(None, ()))
            for link, parts in known.items():
                if len(parts) < len(by_above):
                    candidates += (p for above in parts if above in by_above for p in by_above[above] if p.link == link)
                else:
                    candidates += (p for above, ps in by_above.items() if above in parts for p in ps if p.link == link)
            for part in candidates:
                if part.fits(node, classes):
                    met.append(part)
                    for prop, one in part.found.items():
                        won[prop] = max(won.get(prop, ((),)), one)
        if "style" in a:
            for name, (value, strong) in self.declared(a["style"]).items():
                won[name] = max(won.get(name, ((),)), ((strong, True, (0, 0, 0), 0), value))
        return {k: v[1] for k, v in won.items()}, met

    @staticmethod
    def _blocks(css: str) -> Iterator[tuple[str, str]]:
        css, at = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S), 0
        while (brace := css.find("{", at)) >= 0:
            selector = css[at:brace].rsplit(";", 1)[-1].strip()
            if selector.startswith("@"):  # its block may hold blocks
                depth, at = 1, brace + 1
                for m in re.compile(r"[{}]").finditer(css, at):
                    depth += 1 if m[0] == "{" else -1
                    at = m.end()
                    if not depth:
                        break
                else:
                    return
                continue
            stop = css.find("}", brace)
            if stop < 0:
                return
            yield selector, css[brace + 1 : stop]
            at = stop + 1

    @staticmethod
    def declared(body: str) -> dict[str, tuple[str, bool]]:
        out: dict[str, tuple[str, bool]] = {}
        for name, value, strong in _DECLARED.findall(body):
            if not (name.lower() in out and out[name.lower()][1] and not strong):
                out[name.lower()] = (value.lower(), bool(strong))
        return out


def squeeze(s: str) -> str:
    """White space runs become one space; most texts have none that would change, which five searches tell."""
    return _SPACE.sub(" ", s) if "  " in s or "\n" in s or "\t" in s or "\r" in s or "\f" in s else s


class _Lines:
    """Collects inline text into lines; margins collapse."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.cur: list[str] = []
        self.blank = False
        self.prefix = ""
        self.kept = False  # whether some of the lines are preformatted

    def text(self, s: str) -> None:
        s = squeeze(s)
        if s != " " or self.cur:
            self.cur.append(s)

    def end_line(self) -> None:
        if self.cur:
            line = squeeze("".join(self.cur)).strip(" ")
            self.cur = []
            if line or self.prefix.strip():
                self.put(self.prefix + line)
                self.prefix = " " * len(self.prefix)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def margin(self) -> None:
        self.end_line()
        self.blank = True

    def pre_line(self, last: bool = False) -> None:
        line = "".join(self.cur).rstrip(" \t\r")
        self.cur = []
        if not (last and not line):
            self.put(self.prefix + line)


class Renderer:
    """Writes a tree to lines.  Its methods are generators that yield the work below them; :func:`_run` drives them."""

    def __init__(self, page: Page, layout: Layout):
        self.layout = layout
        self.styles = Styles(page.styles)
        self.ruled = bool(self.styles.parts)
        if self.ruled:
            self.styles.apply(page)

    def shown(self, node: Node, seen: bool) -> tuple[bool, bool]:
        """(has a box, its text is visible)."""
        a = node.attrs
        if node.tag in HIDDEN:
            return False, False
        if not a and not self.ruled:
            return node.tag != "dialog", seen
        if node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
            return False, False
        css = node.css
        if css is None:
            css = {k: v[0] for k, v in Styles.declared(a["style"]).items()} if not self.ruled and "style" in a else {}
        if css.get("display", "none" if "hidden" in a else "") == "none":
            return False, False
        visibility = css.get("visibility")
        return True, seen if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")

    def children(self, kids: list, out: _Lines, pre: bool, seen: bool, grids: int):
        for kid in kids:
            if isinstance(kid, str):
                if not seen:
                    continue
                if pre:
                    first, *rest = kid.split("\n")
                    out.cur.append(first)
                    for line in rest:
                        out.pre_line()
                        out.cur.append(line)
                else:
                    out.text(kid)
                continue
            box, visible = self.shown(kid, seen)
            if box:
                if kid.kids or kid.tag in BLOCK:
                    yield self.element(kid, out, pre, visible, grids)
                else:
                    self.leaf(kid, out, pre, visible)

    def leaf(self, node: Node, out: _Lines, pre: bool, seen: bool) -> None:
        tag, a = node.tag, node.attrs
        if tag == "br":
            if pre:
                out.pre_line()
            elif out.cur:
                out.end_line()
            else:
                out.blank = True
        elif tag == "img" and seen and a.get("alt"):
            out.text(a["alt"])
        elif tag == "input" and seen and a.get("value") and a.get("type", "text").lower() in ("submit", "button", "reset", "text"):
            out.text(a["value"])
        elif tag in ("td", "th"):
            out.text(" ")

    def element(self, node: Node, out: _Lines, pre: bool, seen: bool, grids: int):
        tag, kids = node.tag, node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"][:1]
        if tag == "table" and grids < self.layout.grids:
            out.margin()
            lines: list[str] = []
            yield self.table(node, lines, seen, grids + 1)
            for line in lines:
                out.put(out.prefix + line)
            out.margin()
        elif tag in ("ul", "ol", "menu", "dir"):
            yield self.list(node, out, seen, grids)
        elif tag in ("pre", "textarea", "xmp"):
            out.margin()
            out.kept = True
            yield self.children(kids, out, True, seen, grids)
            out.pre_line(last=True)
            out.margin()
        elif tag in BLOCK or tag == "tr":
            end = out.margin if tag in SPACED else out.end_line
            end()
            keep = out.prefix
            if tag in ("dd", "blockquote") and len(keep) < self.layout.indent:
                out.prefix += "    "
            yield self.children(kids, out, pre, seen, grids)
            end()
            if tag in ("dd", "blockquote"):
                out.prefix = keep
        else:
            yield self.children(kids, out, pre, seen, grids)
            if tag in ("td", "th"):
                out.text(" ")

    def list(self, node: Node, out: _Lines, seen: bool, grids: int):
        nested = bool(out.prefix.strip()) or out.prefix.startswith("  ")
        end = out.end_line if nested else out.margin
        end()
        step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
        number = _whole(node.attrs.get("start"), 1 if step > 0 else sum(not isinstance(k, str) and k.tag == "li" for k in node.kids))
        keep = out.prefix
        for kid in node.kids:
            if isinstance(kid, str):
                if seen and kid.strip():
                    out.text(kid)
                continue
            box, visible = self.shown(kid, seen)
            if not box:
                continue
            if kid.tag == "li":
                out.end_line()
                number = _whole(kid.attrs.get("value"), number)
                marker = f"{number}. " if node.tag == "ol" else "- "
                number += step
                out.prefix = (keep.replace("-", " ") if len(keep) < self.layout.indent else " " * self.layout.indent) + marker
                before = len(out.lines)
                yield self.children(kid.kids, out, False, visible, grids)
                out.end_line()
                if len(out.lines) == before:
                    out.put(out.prefix.rstrip())
                out.blank = False
                out.prefix = keep
            else:
                yield self.children([kid], out, False, seen, grids)
                out.end_line()
        out.prefix = keep
        end()

    def table(self, table: Node, lines: list[str], seen: bool, grids: int):
        """Rows with cells padded to common column widths; spans keep later columns and rows in place."""
        rows: list[list[tuple[str, int, int]]] = []
        todo = [(iter(table.kids), seen)]
        while todo:
            kid = next(todo[-1][0], None)
            if kid is None:
                todo.pop()
                continue
            seen = todo[-1][1]
            if isinstance(kid, str):
                if seen and kid.strip():
                    lines.append(_SPACE.sub(" ", kid).strip())
                continue
            box, visible = self.shown(kid, seen)
            if not box:
                continue
            if kid.tag in ("tbody", "thead", "tfoot"):
                todo.append((iter(kid.kids), visible))
            elif kid.tag == "tr":
                cells = []
                for cell in kid.kids:
                    if isinstance(cell, str):
                        if visible and cell.strip():
                            cells.append((_SPACE.sub(" ", cell).strip(), 1, 1))
                        continue
                    box, plain = self.shown(cell, visible)
                    if not box:
                        continue
                    inner = _Lines()
                    if cell.tag in ("td", "th"):
                        yield self.children(cell.kids, inner, False, plain, grids)
                    else:
                        yield self.children([cell], inner, False, visible, grids)
                    inner.end_line()
                    kept = "\n".join(x.rstrip() for x in inner.lines) if inner.kept else " ".join(x for x in map(str.strip, inner.lines) if x)
                    cells.append((kept, _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)))
                rows.append(cells)
            else:
                inner = _Lines()
                yield self.children([kid], inner, False, seen, grids)
                inner.end_line()
                lines.extend(x for x in inner.lines if x)
        lines.extend(grid(rows, self.layout))


def _whole(value: str | None, other: int) -> int:
    """A whole number as an attribute's value begins with it; ``other`` if there is none."""
    m = _WHOLE.match(value or "")
    return int(m[1]) if m and len(m[1]) < 4000 else other


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip().lstrip("0")
    if not (value.isascii() and value.isdigit()):
        return 1
    return int(value) if len(value) < 6 and int(value) < most else most


def grid(rows: list[list[tuple[str, int, int]]], layout: Layout = Layout()) -> list[str]:  # noqa: B008
    """Lines of (text, columns, rows) cells; a cell that spans rows leaves its place blank in those below."""
    placed, down, widths = [], {}, defaultdict(int)  # down: column -> (end column, row that is free again)
    blanks = layout.padding * sum(map(len, rows)) + layout.spare  # places left blank; a table with more is not kept in place below
    for r, cells in enumerate(rows):
        line, at = [], 0
        for text, cols, deep in cells:
            while blanks and at in down and down[at][1] > r:
                blanks -= 1
                line.append(("", at, down[at][0]))
                at = down[at][0]
            line.append((text, at, at + cols))
            if cols == 1:
                widths[at] = max(widths[at], max(map(len, text.split("\n"))) if "\n" in text else len(text))
            if deep > 1:
                down[at] = (at + cols, r + deep)
            at += cols
        placed.append(line)
    upto = [0]
    for c in range(min(max(widths, default=-1) + 1, layout.columns)):
        upto.append(upto[-1] + widths.get(c, 0) + 3)
    width = lambda a, b: max(0, upto[min(b, len(upto) - 1)] - upto[min(a, len(upto) - 1)] - 3)
    text = sum(len(t) + 3 for line in placed for t, _, _ in line)
    aligned = sum(width(a, b) for line in placed for _, a, b in line) <= layout.padding * text + layout.spare
    out = []
    for line in placed:
        deep = [t.split("\n") for t, _, _ in line] if any("\n" in t for t, _, _ in line) else None
        for k in range(max(map(len, deep)) if deep else 1):  # preformatted cells have several lines
            texts = [t[k] if k < len(t) else "" for t in deep] if deep else [t for t, _, _ in line]
            joined = " | ".join(t.ljust(width(a, b)) if aligned else t for t, (_, a, b) in zip(texts, line, strict=True)).rstrip()
            if joined.strip(" |"):
                out.append(joined)
    return out


def _run(work) -> None:
    stack = [work]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)


def render(source: str | None, layout: Layout = Layout()) -> str:  # noqa: B008
    if not source:
        return ""
    out, root = _Lines(), build(source)
    _run(Renderer(root, layout).children([root], out, False, True, 0))
    out.end_line()
    if root.depth > 500:
        _unlink(root)
    return "\n".join(line.rstrip() for line in out.lines)


def _unlink(root: Node) -> None:
    """Take a tree apart, so that a very deep one is not freed by recursion."""
    todo = [root]
    while todo:
        node = todo.pop()
        todo.extend(k for k in node.kids if not isinstance(k, str))
        node.kids = []


def extract(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines): the visible text of every page."""

    def run(batch: pa.RecordBatch):
        ids, sources = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for k in range(0, len(ids), 256):
            texts = [render(s) for s in sources[k : k + 256]]
            yield {"page_id": ids[k : k + 256], "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}

    return arrow_map(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")), run, "page_id long, text string, n_lines int")
