"""Jaccard join on word shingles by vertical partitioning, and its link classes.

All shingles have one global order, by the number of sets that hold them and then by hash.
Documents travel as sorted segments of it, never as single shingles: a map task packs its
documents' shingles of one hash range into one block.

1. ``fingerprints``: equal shingle sets form a class whose smallest document stands for all.
2. ``segments``: each hash range counts in how many sets its shingles occur and keeps those
   that occur twice or more; only they can add to an overlap.  A shingle that a map task sees
   in a large share of its documents is *hot*: its documents are written out there, the range
   gets one mark for it, and it comes last in the order.
3. ``entries``: the global order is cut at the frequencies ``CUTS`` into vertical fragments,
   and each document into one segment for every fragment.
4. ``prefixes``: with rare shingles first, two linked sets share a shingle among their first
   ``m - ceil(t m) + 1``; sizes, positions and the sizes of the segments in each fragment
   (what two segments share is no more than the smaller one) rule out most pairs.
5. Each shingle's sets are compared with a few pivots among them, and linked.  While sets of
   different classes still share many shingles, and pivots still link them, further rounds take
   new pivots; at last all pairs of different classes that are left are taken, in blocks of a
   counted size.  So nothing is lost, and large groups of near copies, which are one class by
   then, cost no quadratic number of pairs.  The sets of a frequent shingle are dealt over
   several tasks (``salt``).
6. ``overlaps``: each candidate pair meets its segments fragment by fragment; the partial
   overlap of each fragment is counted by itself, and the counts are summed per pair.  The
   threshold is tested in whole numbers.

Shingles are known by 56-bit hashes and sets by 128-bit fingerprints of them; counts and
links are exact but for collisions of those.

Defined cases: a text without words (or null) has an empty set, links with nothing and is its
own class; a text of fewer than ``n`` words is one shingle; rows that repeat an identifier are
each returned, and count as one document; a row without an identifier is returned with its
size and no class; very long texts are read whole; ties need no order, as counts are exact;
an empty table gives no row; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, arrow_stream, forget, mix64, texts_of, trim, worker_cache

BITS = 56
LAST = 2**31 - 1  # the frequency of hot shingles
CUTS = (2, 4, 16)  # frequencies at which the global order is cut; each ends a fragment
VERTICAL = len(CUTS) + 1
_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _WordHashes(dict):
    """Hash of a word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000 and len(word) < 64:
            self[word] = h
        return h


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; words are split at ASCII blanks, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = worker_cache("word hashes", _WordHashes)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h += w[k : k + len(h)] * _MULTIPLIERS[k]
    return np.unique(mix64(h) >> np.uint64(64 - BITS))


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, m, f1, f2): size and 128-bit fingerprint of each document's shingle set."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, n) for t in texts_of(batch.column(1))]
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
        return {"doc_id": batch.column(0), "m": [len(s) for s in sets], "f1": prints[:, 0], "f2": prints[:, 1]}

    return arrow_map(docs, run, "doc_id long, m int, f1 long, f2 long")


BLOCK = "route long, frag int, first long, steps binary, which binary, docs binary, hot binary"


def _pack(route: int, frag: int, h: np.ndarray, doc: np.ndarray, hot: np.ndarray, ids: np.ndarray) -> dict:
    """A block: hashes as differences of as few bytes as they need, documents by their place in a table."""
    steps = np.diff(h, prepend=h[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    used = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
    place = np.zeros(len(ids), dtype=np.uint32)
    place[used] = np.arange(len(used), dtype=np.uint32)
    which, small = place[doc], np.uint16 if len(used) <= 65536 else np.uint32
    return {
        "route": [route],
        "frag": [frag],
        "first": [int(h[0])],
        "steps": [bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()],
        "which": [which.astype(small).tobytes()],
        "docs": [ids[used].astype("<i8").tobytes()],
        "hot": [np.packbits(hot).tobytes() if hot.any() else b""],
    }


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = row["steps"][0]
    raw = np.frombuffer(row["steps"], np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, :width] = raw
    h = np.cumsum(full.view("<u8").ravel(), dtype=np.uint64) + np.uint64(row["first"])
    ids = np.frombuffer(row["docs"], "<i8")
    which = np.frombuffer(row["which"], np.uint16 if len(ids) <= 65536 else np.uint32)
    hot = np.unpackbits(np.frombuffer(row["hot"], np.uint8), count=len(h)).astype(bool) if row["hot"] else np.zeros(len(h), dtype=bool)
    return h, ids[which], hot


def blocks(docs: DataFrame, n: int, fragments: int, slice_bytes: int, hot_share: float, hot_least: int) -> DataFrame:
    """Blocks of (fragment, slice of documents); equal sets of a slice count once, by their smallest document."""
    edges = np.array([-(-(k << BITS) // fragments) for k in range(1, fragments)], dtype=np.uint64)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, list]]:
        """Sets of about ``slice_bytes`` of text each, over all batches of the task; no text is held."""
        sets: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if held and held + len(text) > slice_bytes:
                    yield sets
                    sets, held = {}, 0
                held += len(text)
                s = shingles(text, n)
                if len(s) and doc is not None:
                    one = sets.setdefault(xxhash.xxh3_128_digest(s.tobytes()), [doc, s])
                    one[0] = min(one[0], doc)
        yield sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for sets in sliced(batches):
            if not sets:
                continue
            n_sets = len(sets)
            h = np.concatenate([s for _, s in sets.values()])
            known = np.array([d for d, _ in sets.values()], dtype=np.int64)
            doc = np.repeat(np.arange(n_sets, dtype=np.int32), [len(s) for _, s in sets.values()])
            sets.clear()
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            del order
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            runs = np.diff(np.append(begin, len(h)))
            many = np.repeat(runs > max(hot_least, hot_share * n_sets), runs)
            mark = np.zeros(len(h), dtype=bool)
            mark[begin] = many[begin]
            del begin, runs
            keep = ~many | mark
            for route, rows in ((0, keep), (1, many)):
                hh, dd, mm = (h[rows], doc[rows], mark[rows] & (route == 0)) if not rows.all() or route else (h, doc, mark)
                cuts = np.concatenate([[0], np.searchsorted(hh, edges), [len(hh)]])
                for f in range(fragments):
                    x, y = cuts[f], cuts[f + 1]
                    if y > x:
                        yield _pack(f if not route else -1 - (int(known[dd[x]]) ^ f) % (1 << 20), f, hh[x:y], dd[x:y], mm[x:y], known)

    return arrow_stream(docs, run, BLOCK)


GROUPED = "part int, doc array<long>, s array<long>, df array<int>"
ENTRIES = "doc long, listed int, head array<struct<df:int,s:long>>, parts array<array<long>>"


def segments(packed: DataFrame, parts: int) -> DataFrame:
    """Per fragment: shingles of two sets or more with their frequencies, one row for each of ``parts`` groups of documents."""
    schema = pa.schema([("part", pa.int32()), ("doc", pa.list_(pa.int64())), ("s", pa.list_(pa.int64())), ("df", pa.list_(pa.int32()))])

    def out(h: np.ndarray, doc: np.ndarray, df: np.ndarray) -> pa.Table:
        part = (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((doc, part))
        part = part[order]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.append(begin, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (doc, h.astype(np.int64), df.astype(np.int32))]
        return pa.table([pa.array(part[begin]), *lists], schema=schema)

    def fragment(table: pa.Table) -> pa.Table:
        forget()
        trim()
        rows = table.to_pylist()
        unpacked = [_unpack(r) for r in rows]
        h, doc, hot = (np.concatenate(c) for c in zip(*unpacked, strict=True))
        if rows[0]["route"] < 0:  # documents of hot shingles, as the map task has them
            return out(h, doc, np.full(len(h), LAST))
        order = np.argsort(h)
        h, doc, hot = h[order], doc[order], hot[order]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        runs = np.diff(np.append(begin, len(h)))
        df = np.repeat(np.where(np.maximum.reduceat(hot, begin), LAST, runs), runs)
        keep = (df > 1) & ~hot
        return out(h[keep], doc[keep], df[keep])

    return packed.groupBy("route").applyInArrow(fragment, GROUPED)


def entries(grouped: DataFrame, percent: int) -> DataFrame:
    """Each document's shared shingles: their number, the rarest ones that a prefix can reach, and its segment of each fragment."""
    pair = pa.struct([("df", pa.int32()), ("s", pa.int64())])
    schema = pa.schema([("doc", pa.int64()), ("listed", pa.int32()), ("head", pa.list_(pair)), ("parts", pa.list_(pa.list_(pa.int64())))])

    def gather(table: pa.Table) -> pa.Table:
        forget()
        trim()
        doc, s, df = (np.asarray(pa.concat_arrays([c.flatten() for c in table[name].chunks])) for name in ("doc", "s", "df"))
        order = np.lexsort((s, df, doc))
        own = doc[order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
        listed = np.diff(np.append(begin, len(own)))
        near = np.arange(len(own)) - np.repeat(begin, listed) < np.repeat(-(-(100 - percent) * listed // 100) + 1, listed)
        heads = pa.StructArray.from_arrays([pa.array(df[order][near], pa.int32()), pa.array(s[order][near], pa.int64())], fields=list(pair))
        ends = np.append(0, np.cumsum(near))[np.append(begin, len(own))].astype(np.int32)
        cell = np.repeat(np.arange(len(begin)), listed) * VERTICAL + np.searchsorted(CUTS, df[order])
        inner = pa.ListArray.from_arrays(pa.array(np.searchsorted(cell, np.arange(len(begin) * VERTICAL + 1)).astype(np.int32)), pa.array(s[order], pa.int64()))
        outer = pa.ListArray.from_arrays(pa.array((np.arange(len(begin) + 1) * VERTICAL).astype(np.int32)), inner)
        return pa.table([pa.array(own[begin]), pa.array(listed.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), heads), outer], schema=schema)

    return grouped.groupBy("part").applyInArrow(gather, ENTRIES)


SIZES = [f"z{k}" for k in range(VERTICAL)]  # sizes of a document's segments


def _alpha(a: str, b: str, percent: int) -> F.Column:
    """The overlap that two sizes need: the smallest o with 100 o >= percent (|a| + |b| - o)."""
    return F.ceil(F.expr(f"({percent}L * ({a} + {b})) / {100 + percent}"))


def _fits(percent: int) -> F.Column:
    """Sizes, places of a common shingle (if it is the pair's first) and sizes of segments leave room for the overlap."""
    need = _alpha("a.m", "b.m", percent)
    shared = sum((F.least(f"a.{z}", f"b.{z}") for z in SIZES[1:]), F.least(f"a.{SIZES[0]}", f"b.{SIZES[0]}"))
    return (shared >= need) & (100 * F.col("a.m") >= percent * F.col("b.m")) & (100 * F.col("b.m") >= percent * F.col("a.m")) & (F.col("a.m") - F.col("a.pos") >= need) & (F.col("b.m") - F.col("b.pos") >= need)


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct (x, mx, y, my) with x < y."""
    low, high = F.least(F.struct("a.doc", "a.m"), F.struct("b.doc", "b.m")), F.greatest(F.struct("a.doc", "a.m"), F.struct("b.doc", "b.m"))
    return joined.select(low.alias("lo"), high.alias("hi")).select(F.col("lo.doc").alias("x"), F.col("lo.m").alias("mx"), F.col("hi.doc").alias("y"), F.col("hi.m").alias("my")).distinct()


def cells(lists: DataFrame) -> DataFrame:
    """(doc, frag, seg): a document's segment of each fragment, where it has one."""
    return lists.select("doc", F.posexplode("parts").alias("frag", "seg")).where(F.size("seg") > 0)


def overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """(x, y, mx, my, overlap): the partial overlap of each fragment, summed per pair."""
    left = pairs.join(segs.select(F.col("doc").alias("x"), "frag", F.col("seg").alias("sx")), "x")
    both = left.join(segs.select(F.col("doc").alias("y"), "frag", F.col("seg").alias("sy")), ["y", "frag"])
    partial = both.select("x", "y", "mx", "my", F.size(F.array_intersect("sx", "sy")).alias("n")).where("n > 0")
    return partial.groupBy("x", "y", "mx", "my").agg(F.sum("n").alias("overlap"))


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, comp) for every node of a link: the smallest node of its class.

    Each round takes the smallest label among neighbours and then jumps to that label's own
    label, so rounds grow with the logarithm of a class's diameter rather than with its size.
    """
    edges = scratch.put(links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct(), f"{tag}_edges")
    labels = scratch.put(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), f"{tag}_0")
    k = 0
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        nearer = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        k += 1
        new = scratch.put(nearer.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), f"{tag}_{k}")
        scratch.drop(f"{tag}_{k - 1}")
        labels = new.select("node", "comp")
        if new.where("old != comp").isEmpty():
            return labels


def join(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, fragment_shingles: int = 2_000_000, slice_bytes: int = 12 << 20, hot_share: float = 0.02, hot_least: int = 64, rounds: int = 6, pivots: int = 8, cross_factor: int = 4, least_gain: float = 0.05, hot_rows: int = 256, block_pairs: int = 50_000_000) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    Two documents link when ``100 * |intersection| >= percent * |union|``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = scratch.put(fingerprints(docs, n), "prints")
    reps = scratch.put(prints.where("m > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("m").alias("m")), "reps")
    total = reps.agg(F.sum(F.col("m").cast("long"))).first()[0] or 0
    fragments = max(1, -(-total // fragment_shingles))
    found = segments(blocks(docs, n, fragments, slice_bytes, hot_share, hot_least), fragments)
    sets = reps.groupBy(F.col("rep").alias("doc")).agg(F.max("m").alias("m"))
    lists = scratch.put(entries(found, percent), "lists")

    alone = F.col("m") - F.col("listed")
    reach = F.expr(f"m - cast(ceil({percent}L * m / 100) as int) + 1 - (m - listed)")
    sized = lists.select("doc", "listed", "head", *(F.size(F.col("parts")[k]).alias(z) for k, z in enumerate(SIZES)))
    prefix = sized.join(sets, "doc").select("doc", "m", alone.alias("alone"), *SIZES, F.slice("head", 1, F.greatest(F.lit(0), reach)).alias("head"))
    prefix = prefix.select("doc", "m", "alone", *SIZES, F.posexplode("head").alias("at", "e")).select(F.col("e.s").alias("s"), "doc", "m", (F.col("alone") + F.col("at")).alias("pos"), *SIZES)
    plain = scratch.put(prefix, "pool0")
    n_rows = plain.count()
    pool, room = _salted(plain, max(hot_rows, n_rows // 10_000), scratch), cross_factor * n_rows

    tried, classes = None, None
    for r in range(rounds + 1):
        pairs = _pivoted(pool, percent, pivots if r else 2, r)
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        new = scratch.put(pairs, f"tried{r}")
        found = scratch.put(_linked(new, lists, scratch, r, percent), f"links{r}")
        gain = found.count()
        if r == 0 or gain:
            classes = _merged(classes, found, scratch, f"classes{r}")
        tried = new.select("x", "y") if tried is None else tried.unionByName(new.select("x", "y"))
        pool = _mixed(pool, classes, scratch, r + 1)
        cross = _cross_pairs(pool)
        if cross <= room or gain <= new.count() * least_gain:
            break
    last = None
    for b in range(n_blocks := math.ceil(cross / max(room, block_pairs))):
        pairs = scratch.put(_all_pairs(pool, percent, b, n_blocks).join(tried, ["x", "y"], "left_anti"), f"rest{b}")
        found = scratch.put(_linked(pairs, lists, scratch, f"_rest{b}", percent), f"rest_links{b}")
        last = found if last is None else last.unionByName(found)
        scratch.drop(f"rest{b}")
    if last is not None:
        classes = _merged(classes, last, scratch, "classes_rest")
    scratch.drop("lists", "hot", *(f"{t}{k}" for k in range(r + 2) for t in ("pool", "tried", "links")), *(f"rest_links{b}" for b in range(n_blocks)))

    named = prints.join(reps.select("f1", "f2", "rep"), ["f1", "f2"], "left")
    out = named.join(classes.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    return out.select("doc_id", F.col("m").cast("long").alias("n_shingles"), F.when(F.col("m") > 0, F.coalesce("comp", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _salted(pool: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Rows of shingles with more than ``most`` sets are dealt over ``k`` tasks: their join key is (s, salt).

    There are at most as many such shingles as ``most`` goes into the rows of the pool; ``join`` keeps that below 10 000.
    """
    hot = pool.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > most).select("s", F.ceil(F.col("n") / most).cast("int").alias("k"))
    dealt = pool.join(F.broadcast(scratch.put(hot, "hot")), "s", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    return dealt.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("k")).cast("int"))


def _each_salt(df: DataFrame) -> DataFrame:
    """Every row once for each salt of its shingle."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")


def _pivoted(pool: DataFrame, percent: int, pivots: int, seed: int) -> DataFrame:
    """Pairs of each shingle's sets with at most ``pivots`` of them, drawn by hashes that all shingles share."""
    own = ["doc", "m", "pos", *SIZES, *_comp(pool)]
    drawn = pool.groupBy("s").agg(*(F.min(F.struct(F.xxhash64("doc", F.lit(97 * seed + k)).alias("h"), *own)).alias(f"p{k}") for k in range(pivots)), F.count("*").alias("n"), F.max("k").alias("k")).where("n > 1")
    chosen = F.array_distinct(F.array(*(F.struct(*(F.col(f"p{k}.{c}") for c in own)) for k in range(pivots))))
    held = _each_salt(drawn.select("s", "k", F.explode(chosen).alias("p")).select("s", "k", "p.*"))
    other = F.col("a.comp") != F.col("b.comp") if _comp(pool) else F.col("a.doc") != F.col("b.doc")
    return _pairs(pool.drop("k").alias("a").join(held.alias("b"), ["s", "salt"]).where(other & _fits(percent)))


def _comp(pool: DataFrame) -> list[str]:
    return ["comp"] if "comp" in pool.columns else []


def _all_pairs(pool: DataFrame, percent: int, block: int, n_blocks: int) -> DataFrame:
    """What pivots have left: pairs of different classes that sizes and places do not rule out; one block of left sides.

    Of two classes at most one is a shingle's largest, so the rows of its other classes (``minor``) meet all rows; only
    they are repeated for each salt, and two of them meet once.
    """
    main = pool.groupBy("s", "comp").agg(F.count("*").alias("n"), F.max("k").alias("k")).groupBy("s").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.max("k").alias("k"))
    minor = _each_salt(pool.join(_each_salt(main), ["s", "salt"]).where(F.col("comp") != F.col("main")).drop("salt"))
    left = pool.drop("k").where(F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(n_blocks)) == block) if n_blocks > 1 else pool.drop("k")
    once = (F.col("a.comp") == F.col("b.main")) | (F.col("a.doc") < F.col("b.doc"))
    return _pairs(left.alias("a").join(minor.alias("b"), ["s", "salt"]).where(once & (F.col("a.comp") != F.col("b.comp")) & _fits(percent)))


def _merged(classes: DataFrame | None, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Classes after new links: links are contracted to classes, so only those that meet are labelled anew."""
    if classes is None:
        return components(links, scratch, tag)
    own = classes.select("node", "comp")
    cx = links.join(own.withColumnRenamed("node", "x"), "x", "left").select(F.coalesce("comp", "x").alias("x"), "y")
    met = cx.join(own.withColumnRenamed("node", "y"), "y", "left").select("x", F.coalesce("comp", "y").alias("y")).where("x != y").distinct()
    moved = components(met, scratch, tag)
    new = moved.select("node", F.col("comp").alias("to"))
    known = own.join(new.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.put(known.unionByName(new.join(own, "node", "left_anti").select("node", F.col("to").alias("comp"))), f"{tag}_all")


def _mixed(pool: DataFrame, classes: DataFrame, scratch: Scratch, r: int) -> DataFrame:
    """Prefix rows of shingles whose sets are still in different classes; classes only grow, so the pool only shrinks."""
    placed = pool.drop("comp").join(classes.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = placed.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("k").alias("k")).where("c0 < c1").select("s", "k")
    return scratch.put(placed.join(_each_salt(mixed), ["s", "salt"]), f"pool{r}")


def _cross_pairs(pool: DataFrame) -> int:
    """Pairs of different classes in the pool, as often as they share a shingle: what the last round would look at."""
    n = pool.groupBy("s", "comp").agg(F.count("*").alias("n")).groupBy("s").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    return n.agg(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2)).first()[0] or 0


def _linked(pairs: DataFrame, lists: DataFrame, scratch: Scratch, r: int | str, percent: int) -> DataFrame:
    """Pairs that reach the threshold; only documents of a pair take part in the joins."""
    asked = pairs.select(F.col("x").alias("doc")).unionByName(pairs.select(F.col("y").alias("doc"))).distinct()
    active = scratch.put(cells(lists.select("doc", "parts").join(asked, "doc", "left_semi")), f"active{r}")
    return overlaps(pairs, active).where(f"{100 + percent}L * overlap >= {percent}L * (mx + my)").select("x", "y")


def keep_one(df: DataFrame, classes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` without those whose class has a smaller document; repeated rows of one document become one.

    The identifiers to drop are broadcast if they are counted to be at most ``broadcast_rows`` (8 bytes each), so that
    texts stay where they are; more are joined by shuffle.  Texts are grouped by identifier only if ``classes``
    shows that identifiers repeat, and then the row of the smallest text stays.  Rows without an identifier stay.
    """
    first = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    if not first.where("n > 1").isEmpty():
        one = Window.partitionBy(id_col).orderBy(text_col)
        named = df.where(F.col(id_col).isNotNull()).withColumn("__place", F.row_number().over(one)).where("__place = 1").drop("__place")
        df = named.unionByName(df.where(F.col(id_col).isNull()))
    others = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    few = others.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(others) if few else others, id_col, "left_anti")
