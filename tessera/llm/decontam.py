"""Benchmark decontamination by canonical templates.

Words are reduced to templates: numbers, units behind numbers and names (capitalised words
inside a sentence) become typed placeholders, other words lose case and punctuation.  Hashed
windows of template words are joined with those of the benchmark.  A document is
contaminated by an item if an occurrence in it holds enough of the item's windows and the
values in its placeholders are consistent both ways: each value of the item always turns
into the same value there, and no two of them into one, as in a re-parameterised question.
Scripts that are written without blanks (Chinese, Japanese, Thai, ...) count one word for
each character.

Items that are mostly numbers and names have few literal windows; their plain words are
searched as well, in windows of the same length, so that a verbatim copy is always found.
Items of fewer than ``short_words`` words would be found in any text; with ``short_alone``
they are searched as one window of plain words that stands alone: a line, a sentence, or
the text between two ends of either.

Defined cases: null or empty texts and items match nothing; items of fewer than
``short_words`` words are only searched as ``short_alone`` says; those below a window
(where ``short_words`` lets them in) are one window of their own length; equal documents are
each reported; several items may hit one document, and each pair is one row; of several
occurrences the verbatim, then the fullest, then the first is reported; very long texts are
read whole, in slices of documents; an empty table on either side gives no row; only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, mix64, slices, texts_of, worker_cache

WINDOW = SHORT = 5
# fixed values: unit words that follow a number
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hours minutes seconds days weeks months years percent % usd eur gbp dollars euros cents degrees c f k w kw v a hz mb gb tb".split())
_NUMBER = re.compile(r"^[^\w]*[-+$€£]?\d[\d.,:/]*([^\W\d_]*|%)[^\w]*$")
_CORE = re.compile(r"[\W_]+")
NUM, NAME, UNIT, OTHER = 1, 2, 3, 0
_TAGS = np.array([0, 0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547], dtype=np.uint64)
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
ALONE = 100  # added to the length of windows that have to stand alone
_POWERS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Index(dict):
    """Places of words; a new word is added when it is first asked for."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: str) -> int:
        return self.add(word)


class Lexicon:
    """Per distinct word: hash of its plain form, and whether it is a number, a unit, capitalised, or ends a sentence."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self.most, self._hash = most, xxhash.xxh3_64_intdigest
        self.index = _Index(self._add)
        self.hashes, self.flags = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint8)

    def _add(self, word: str) -> int:
        bare = word if word.isalpha() else word[:-1]
        if bare.isalpha() and (bare is word or word[-1] in ".,;!?:"):  # letters and at most a mark: most words
            plain = bare.lower()
            flag = (2 if plain in UNITS else 0) | (4 if word[0].isupper() else 0) | (8 if word[-1] in ".!?:" else 0)
        else:
            plain, flag = self._judge(word)
        k = self.index[word] = len(self.index)
        if k == len(self.hashes):
            self.hashes, self.flags = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hashes, self.flags))
        self.hashes[k], self.flags[k] = self._hash(plain), flag
        return k

    @staticmethod
    def _judge(word: str) -> tuple[str, int]:
        number = _NUMBER.match(word)
        plain = _CORE.sub("", word).lower()
        unit = bool(number and number[1] and number[1].lower() in UNITS)
        return plain, (1 if number and (not number[1] or unit) else 0) | (2 if plain in UNITS or word == "%" else 0) | (4 if word[:1].isupper() or word.lstrip("\"'([{«„“‘¿¡")[:1].isupper() else 0) | (8 if word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":") else 0) | (16 if not plain else 0) | (32 if unit else 0)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.most:
            self.index.clear()
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        return self.hashes[at], self.flags[at]


@dataclass
class Templates:
    """Template words of several texts in one array; ``owner`` and ``word`` lead back to text and source word."""

    hashes: np.ndarray
    plain: np.ndarray  # hashes of the words themselves
    kinds: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    starts: np.ndarray  # of texts, with the end at last
    part: np.ndarray  # running number of the sentence that a word is in, where it was asked for


def canonical(words: list[list[str]], lexicon: Lexicon, parts: bool = False) -> Templates:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for ws in words for w in ws]
    starts = np.append(0, np.cumsum(sizes))
    if not flat:
        e = np.zeros(0, dtype=np.int64)
        return Templates(e.astype(np.uint64), e.astype(np.uint64), e, e, e, starts, e)
    hashes, flags = lexicon.look(flat)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.zeros(len(flat), dtype=bool)
    first[starts[:-1][sizes > 0]] = True
    before = np.append(0, flags[:-1])
    opens = first | ((before & 8) > 0)
    kinds = np.where(flags & 1, NUM, np.where(((flags & 2) > 0) & ((before & 1) > 0) & ~first, UNIT, np.where(((flags & 4) > 0) & ~opens, NAME, OTHER)))
    keep = (flags & 16) == 0
    plain, hashes = hashes[keep], np.where(kinds == OTHER, hashes, _TAGS[kinds])
    kept = np.append(0, np.cumsum(keep))
    return Templates(hashes[keep], plain, kinds[keep], owner[keep], (np.arange(len(flat)) - starts[owner])[keep], kept[starts], np.cumsum(opens)[keep] if parts else owner[:0])


def windows(t: Templates, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of each window within one text.

    Windows of ``size`` template words are half literal words at least; a negative size stands for all windows of
    so many plain words, placeholders not used, and one below ``-ALONE`` for those that are whole sentences.
    """
    alone = size < -ALONE
    words, size, exact = (t.hashes, size, False) if size > 0 else (t.plain, -size - ALONE if alone else -size, True)
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h += words[k : k + n] * _POWERS[k]
    ok = t.owner[:n] == t.owner[size - 1 :]
    if not exact:
        literal = np.append(0, np.cumsum(t.kinds == OTHER))
        ok &= 2 * (literal[size:] - literal[:-size]) >= size
    if alone:
        edge = np.append(True, t.part[1:] != t.part[:-1])
        ok &= edge[:n] & np.append(edge, True)[size:]
    at = np.flatnonzero(ok)
    return mix64(h[at] + np.uint64(size + (1 << 21 if alone else 1 << 20 if exact else 0))), at


def _split(texts: list[str], lines: bool = False) -> list[list[str]]:
    """Words of each text; with ``lines``, a mark that is no word ends the sentence of every line."""
    if lines:
        texts = [t.replace("\n", " . ") for t in texts]
    return [(t if t.isascii() or not _SPACELESS.search(t) else _SPACELESS.sub(r" \g<0> ", t)).split() for t in texts]


def _lexicon() -> Lexicon:
    return worker_cache("lexicon", Lexicon)


BENCH = "item_id long, n_windows int, item_pos int, item_end int, size int, hash long, slots array<string>"
HITS = "doc_id long, hash long, doc_pos int, slots array<string>"


def _slot_values(words: list[str], t: Templates, at: int, size: int) -> list[str]:
    """Values in the placeholders of a window; windows of plain words (negative size) have none."""
    return [_CORE.sub("", words[t.word[k]]).lower() for k in range(at, at + size) if t.kinds[k] in (NUM, NAME)]


def bench_windows(bench: DataFrame, *, id_col: str = "item_id", text_col: str = "text", short_words: int = SHORT, short_alone: bool = False) -> DataFrame:
    """Windows of the items: of templates, and of plain words where under half of the template windows are literal enough."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0).to_pylist()
        words = _split(texts_of(batch.column(1)))
        t = canonical(words, _lexicon())
        for k, item in enumerate(ids):
            a, b = int(t.starts[k]), int(t.starts[k + 1])
            size = min(WINDOW, b - a)
            if size < (1 if short_alone else max(1, short_words)):
                continue
            own = Templates(t.hashes[a:b], t.plain[a:b], t.kinds[a:b], t.owner[a:b], t.word[a:b], np.array([0, b - a]), np.zeros(b - a))
            routes = {size: windows(own, size)} if size >= SHORT else {}
            if size < short_words:
                routes = {-ALONE - size: windows(own, -ALONE - size)}
            elif size < SHORT or 2 * len(routes[size][1]) < b - a - size + 1:
                routes[-size] = windows(own, -size)
            for route, (h, at) in routes.items():
                n = len(at)
                yield {"item_id": [item] * n, "n_windows": [n] * n, "item_pos": at, "item_end": [b - a] * n, "size": [route] * n, "hash": h.view(np.int64), "slots": [_slot_values(words[k], own, p, route) for p in at]}

    return arrow_map(bench.select(F.col(id_col).cast("long"), text_col), run, BENCH)


BITMAP = 1 << 27  # bits; 16 MB


def hash_bitmap(items: DataFrame) -> np.ndarray:
    """Bits of all window hashes, built by the executors; its size does not depend on the benchmark's."""
    bit = (F.col("hash").bitwiseAND(F.lit(BITMAP - 1)) + 1).alias("b")
    rows = items.select(bit).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()  # 4096 at most
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        at = (r["k"] - 1) * 4096
        out[at : at + len(part)] = part
    return out


def _marked(bitmap: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bit = h & np.uint64(BITMAP - 1)
    ok = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return at[ok], h[ok]


def doc_windows(docs: DataFrame, *, wanted, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = tuple(range(SHORT, WINDOW + 1))) -> DataFrame:
    """Windows of all documents; with ``wanted`` (broadcast; hashes by size, or a bitmap of them) only those that the benchmark has or may have."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for a, b in slices(np.array([len(x) for x in texts]), 1 << 20):
            words = _split(texts[a:b])
            t = canonical(words, _lexicon())
            by_line = canonical(_split(texts[a:b], True), _lexicon(), True) if min(sizes, default=0) < -ALONE else t  # the same words, in more sentences
            for size in sizes:
                h, at = windows(by_line if size < -ALONE else t, size)
                if isinstance(wanted.value, np.ndarray):
                    at, h = _marked(wanted.value, h, at)
                else:
                    table, bits = wanted.value[size]
                    near = np.flatnonzero(bits[h & np.uint64(len(bits) - 1)])
                    h, at = h[near], at[near]
                    spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    same = table[spot] == h
                    h, at = h[same], at[same]
                for c in range(0, len(at), 50_000):
                    hc, ac = h[c : c + 50_000], at[c : c + 50_000]
                    yield {"doc_id": [ids[a + o] for o in t.owner[ac]], "hash": hc.view(np.int64), "doc_pos": ac - t.starts[t.owner[ac]], "slots": [_slot_values(words[o], t, p, size) for o, p in zip(t.owner[ac], ac, strict=True)]}

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, HITS)


SLACK, BLOCK = 200, 1024  # words that an occurrence may shift by; diagonals judged together, over twice SLACK
JUDGED = "doc_id long, item_id long, coverage double, consistency double, reparameterised boolean, matched long, n_windows int, first_pos int, last_pos int"


def _figures(hits: list[tuple], n: int) -> tuple:
    """(matched, coverage, consistency, reparameterised, first, last) of hits (item_pos, doc_pos, item_slots, slots)."""
    values: dict[str, set[str]] = {}
    sources: dict[str, set[str]] = {}
    for _, _, own, got in hits:
        for a, b in zip(own, got, strict=True):
            values.setdefault(a, set()).add(b)
            sources.setdefault(b, set()).add(a)
    same = min((sum(len(v) == 1 for v in way.values()) / len(way) for way in (values, sources) if way), default=1.0)
    matched, at = len({h[0] for h in hits}), [h[1] for h in hits]
    return matched, matched / n, same, any(v != {a} for a, v in values.items()), min(at), max(at)


def best_occurrence(hits: list[tuple], n: int, passes) -> tuple | None:
    """Figures of the best occurrence that passes.

    An occurrence lies along a diagonal (place in the document less place in the item).  Around each one, hits of
    near diagonals count where words were put in or left out; each place of the document and the item serves once,
    and the nearest diagonal has it, so that an item's resemblance to itself does not count.
    The diagonal alone is judged too.
    """
    lines: dict[int, list[tuple]] = {}
    for h in hits:
        lines.setdefault(h[1] - h[0], []).append(h)
    slack, order = min(SLACK, max(2, n // 2)), sorted(lines)
    best, lo, hi, held = None, 0, 0, 0
    for d in order:
        while hi < len(order) and order[hi] <= d + slack:
            held += len(lines[order[hi]])
            hi += 1
        while order[lo] < d - slack:
            held -= len(lines[order[lo]])
            lo += 1
        if not passes(min(held, n), 1.0):
            continue
        tried = [lines[d]]
        if hi - lo > 1:
            near, docs, items = [], set(), set()
            for o in sorted(order[lo:hi], key=lambda o: (abs(o - d), o)):
                for h in lines[o]:
                    if h[0] not in items and h[1] not in docs:
                        near.append(h)
                        items.add(h[0])
                        docs.add(h[1])
            tried.append(near)
        for some in tried:
            f = _figures(some, n)
            if passes(f[0], f[2]) and (best is None or (not f[3], f[0], f[2], -f[4]) > (not best[3], best[0], best[2], -best[4])):
                best = f
        if best and best[1] == 1.0 and not best[3]:
            break
    return best


def _occurrences(hits: DataFrame, coverage: float, least_windows: int, consistency: float) -> DataFrame:
    """The best passing occurrence of each pair and block of diagonals; blocks overlap by half, so none is cut."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = []
        for doc, item, n, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            f = best_occurrence([tuple(h.values()) for h in hits], n, lambda m, c, n=n: m / n >= coverage and m >= min(least_windows, n) and c >= consistency)
            if f:
                out.append((doc, item, f[1], f[2], f[3], f[0], n, f[4], f[5]))
        if out:
            yield dict(zip((c.split()[0] for c in JUDGED.split(", ")), zip(*out, strict=True), strict=True))

    at = F.col("doc_pos") - F.col("item_pos")
    blocks = F.explode(F.array(F.floor(at / BLOCK) * 2, F.floor(at / BLOCK + 0.5) * 2 - 1))
    one = hits.withColumn("block", blocks).groupBy("doc_id", "item_id", "size", "n_windows", "block").agg(F.collect_list(F.struct("item_pos", "doc_pos", "item_slots", "slots")).alias("hits"))
    return arrow_map(one.select("doc_id", "item_id", "n_windows", "hits"), run, JUDGED)


def find(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.3, least_windows: int = 2, consistency: float = 0.8, broadcast_windows: int = 500_000, short_words: int = SHORT, short_alone: bool = False, salts: int = 16) -> DataFrame:
    """One row per contaminated (document, item): coverage of the item's windows and slot consistency.

    Each occurrence in the document is judged by itself, and the best that passes is the row; an item that passes
    only over the whole document, as when it is quoted in pieces, is a row as well.

    A changed word spoils all windows over it, so ``coverage`` is well below 1: with every tenth word changed,
    9 words between two changes keep 5 of 10 windows; with the two ends of a text, items of 12 words and more keep
    three in ten wherever the first change is.

    Up to ``broadcast_windows`` benchmark windows (about 100 bytes each) are broadcast and filter documents
    where they are read; a larger benchmark is joined by a shuffle, of the windows that a bitmap of its hashes (16 MB)
    lets through.  Both ways give the same rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = scratch.put(bench_windows(bench, id_col=item_col, text_col=item_text_col, short_words=short_words, short_alone=short_alone), "items")
    sizes = items.groupBy("size").count().collect()  # a row for each of a few sizes
    used = tuple(sorted(r["size"] for r in sizes))
    few = sum(r["count"] for r in sizes) <= broadcast_windows
    if few:
        tables = {}
        for r in items.groupBy("size").agg(F.collect_set("hash").alias("h")).collect():
            table = np.sort(np.array(r["h"], dtype=np.int64).view(np.uint64))
            bits = np.zeros(1 << 18, dtype=bool)
            bits[table & np.uint64(len(bits) - 1)] = True
            tables[r["size"]] = (table, bits)
    wanted = spark.sparkContext.broadcast(tables if few else hash_bitmap(items))
    found = doc_windows(docs, id_col=id_col, text_col=text_col, wanted=wanted, sizes=used)
    known = items.withColumnRenamed("slots", "item_slots")
    if few:
        met = found.join(F.broadcast(known), "hash")
    else:  # a window that a third of the documents hold is dealt over ``salts`` keys
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_pos"), F.lit(salts)))
        met = found.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["hash", "salt"])
    hits = met.where(F.size("slots") == F.size("item_slots"))
    hits = scratch.put(hits.select("doc_id", "item_id", "size", "n_windows", "item_pos", "doc_pos", "slots", "item_slots"), "hits")
    cover = hits.groupBy("doc_id", "item_id", "size").agg(
        F.count_distinct("item_pos").alias("matched"), F.max("n_windows").alias("n_windows"), F.min("doc_pos").alias("first_pos"), F.max("doc_pos").alias("last_pos")
    )
    pairs = hits.select("doc_id", "item_id", "size", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    changed = F.max((F.col("s.slots") != F.col("s.item_slots")).cast("int")).alias("changed")
    ways = [
        pairs.groupBy("doc_id", "item_id", "size", f"s.{a}").agg((F.min(f"s.{b}") == F.max(f"s.{b}")).alias("same"), changed).groupBy("doc_id", "item_id", "size").agg(F.avg(F.col("same").cast("double")).alias("consistency"), F.max("changed").alias("changed"))
        for a, b in (("item_slots", "slots"), ("slots", "item_slots"))
    ]
    slots = ways[0].unionByName(ways[1]).groupBy("doc_id", "item_id", "size").agg(F.min("consistency").alias("consistency"), F.max("changed").alias("changed"))
    out = cover.join(slots, ["doc_id", "item_id", "size"], "left").withColumn("coverage", F.col("matched") / F.col("n_windows")).fillna({"consistency": 1.0, "changed": 0})
    whole = out.where((F.col("coverage") >= coverage) & (F.col("matched") >= F.least(F.lit(least_windows), F.col("n_windows"))) & (F.col("consistency") >= consistency)).withColumn("reparameterised", F.col("changed") == 1)
    names = [c.split()[0] for c in JUDGED.split(", ")]
    both = _occurrences(hits, coverage, least_windows, consistency).withColumn("single", F.lit(True)).unionByName(whole.select(*names).withColumn("single", F.lit(False)))
    rank = F.struct("single", ~F.col("reparameterised"), "matched", "consistency", -F.col("first_pos"), "last_pos")
    return both.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*names[2:]), rank).alias("b")).select("doc_id", "item_id", "b.*")
