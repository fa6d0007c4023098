"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often corpus-wide.

1. ``align``: texts are taken in blocks of a bounded size.  Both vocabularies' tokens of a block become arrays of byte
   lengths; running sums are token ends, ends that both have are cuts (``intersect1d``), and ``searchsorted`` labels
   each token with its group.  For each A token the first and last B token that it overlaps are found by
   ``searchsorted``, and repeated indices list all links.  Texts of a block stand behind each other; a text's end is an
   end of both, so no group or link crosses it.
2. A block is written with its distinct id pairs and their numbers of links, and with each document's distinct pairs as
   places in that list.  Pairs are summed over blocks in two shuffles, first by pair and salt, then by pair.  The
   largest count of each B id has at most one row an id of that vocabulary, so it is broadcast.
3. Counts go back to the blocks by a join that is salted alike, and each block meets its own list of pairs: one
   document's sums are dot products.

A text is encoded by pieces (a run of blanks and the run of other characters after it), which both vocabularies encode
alike alone and inside a text; texts with other white space, or vocabularies with tokens that reach from a character
into a blank, are encoded whole.  A text's joined bytes are compared with the text.

Defined cases: null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens:
zeros and ``''``; strings of special tokens are plain text; equal rows and rows without an identifier count as often as
they occur; a text longer than a block is a block by itself; an empty table gives an empty result; only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, slices, texts_of, worker_cache
from .tokens import Encoder, byte_letters, local_path

MARK = "▁"  # fixed value: stands for a space in pieces
PLAIN = re.compile(r"[ \n\t]*\S+|[ \n\t]+")
BLOCK = "block long, docs binary, a array<int>, b array<int>, n array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both vocabularies, their tokens' byte lengths, and caches of the ids of pieces."""

    def __init__(self, path_a: str, path_b: str, cache_letters: int = 3_000_000):
        import sentencepiece

        encoder = Encoder(local_path(path_a), 0, plain=True)
        self.tokenizer = encoder.tokenizer
        self.model = sentencepiece.SentencePieceProcessor(model_file=local_path(path_b))
        letters = {c: b for b, c in byte_letters().items()}
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        added = {k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = (self.tokenizer.id_to_token(k) for k in range(size))
        self.bytes_a = [b"" if t is None else t.encode() if k in added else bytes(letters[c] for c in t) for k, t in enumerate(names)]
        m = self.model
        self.bytes_b = [bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace(MARK, " ").encode() for k in range(m.get_piece_size())]
        self.len_a, self.len_b = (np.array([*map(len, of)], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        crossing = re.compile(rf"[^\s{MARK}][\s{MARK}]")
        inner = (m.id_to_piece(k) for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_byte(k) or m.is_unknown(k)))
        # a carriage return is never part of a piece, so tokens with one do not matter
        self.by_piece = encoder.by_piece and not any(crossing.search(t) and "\r" not in t or set(t) & set("\n\t") for t in inner)
        self.blank = m.piece_to_id(MARK)
        self.kept: dict[str, tuple[bytes, bytes]] = {}  # ids of pieces; emptied between blocks when it holds many letters
        self.held, self.most = 0, cache_letters
        na, nb = len(self.bytes_a), len(self.bytes_b)
        # a token's digits with the sign after it: within its group, at the end of its side
        self.signs = [b"%d%c" % (k // 2, b",|"[k % 2]) for k in range(2 * na)] + [b"%d%c" % (k // 2, b",;"[k % 2]) for k in range(2 * nb)]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces that were not met before, all in one call of each library."""
        new = list(pieces)
        by_a = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        # the library puts a space first: the piece's own, or a token of its own, which is dropped; an empty text gets none
        by_b = self.model.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        for piece, a, b in zip(new, by_a, by_b, strict=True):
            b = (b or [self.blank]) if piece[0] == " " else b[1:]
            self.kept[piece] = array("I", a.ids).tobytes(), array("I", b).tobytes()
            self.held += len(piece)

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of both vocabularies for a text with its leading space."""
        return tuple(array("I", ids).tobytes() for ids in (self.tokenizer.encode(text, add_special_tokens=False).ids, self.model.encode(text[1:])))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id arrays of space and text; None for empty texts and where a vocabulary does not give the text back."""
        parted: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            pieces = PLAIN.findall(" " + text) if text and self.by_piece else []
            parted.append(pieces if sum(map(len, pieces)) == len(text) + 1 else None)  # else it has other white space
            if parted[-1]:
                new.update(set(pieces).difference(self.kept))
        self._learn(new)
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, pieces in zip(texts, parted, strict=True):
            if not text:
                out.append(None)
                continue
            if pieces:
                found = [*map(self.kept.__getitem__, pieces)]
                both = b"".join([x for x, _ in found]), b"".join([y for _, y in found])
            else:
                both = self._whole(" " + text)
            ids = tuple(np.frombuffer(x, dtype="<u4") for x in both)
            raw = (" " + text).encode()
            out.append(ids if all(b"".join(map(of.__getitem__, k.tolist())) == raw for of, k in zip((self.bytes_a, self.bytes_b), ids, strict=True)) else None)
        if self.held > self.most:
            self.kept.clear()
            self.held = 0
        return out


def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair of vocabularies per Python worker."""
    return worker_cache(("pair", path_a, path_b), lambda: Pair(path_a, path_b))


def groups_and_links(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, cuts, A index and B index of each link) from tokens' byte lengths."""
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first = np.searchsorted(ends_b, ends_a - len_a, side="right")
    last = np.searchsorted(ends_b - len_b, ends_a, side="left")
    many = last - first
    link_a = np.repeat(np.arange(len(len_a)), many)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return group_a, group_b, cuts, link_a, link_b


def _block(pair: Pair, ids: list, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of one block (Arrow bytes), and its distinct pairs with their numbers of links."""
    coded = pair.encode(texts)
    good = [k for k, c in enumerate(coded) if c is not None]
    none = np.zeros(0, dtype=np.uint32)
    a, b = (np.concatenate([coded[k][side] for k in good] or [none]).astype(np.int64) for side in (0, 1))
    n_a, n_b = (np.array([len(coded[k][side]) for k in good], dtype=np.int64) for side in (0, 1))
    del coded
    group_a, group_b, cuts, link_a, link_b = groups_and_links(pair.len_a[a], pair.len_b[b])
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    # links and groups stand in the order of A tokens, so a document's last A token ends them
    stop_link = np.searchsorted(link_a, stop_a)
    n_links = np.diff(stop_link, prepend=0)
    stop_group = group_a[stop_a - 1] + 1 if len(stop_a) else stop_a
    n_groups = np.diff(stop_group, prepend=0)

    # signs of a group: its A tokens, then its B tokens
    many_a, many_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
    signs = np.empty(len(a) + len(b), dtype=np.int64)
    at = np.arange(len(a))
    signs[at + (upto_b - many_b)[group_a]] = 2 * a + (at + 1 == upto_a[group_a])
    at = np.arange(len(b))
    signs[at + upto_a[group_b]] = 2 * len(pair.len_a) + 2 * b + (at + 1 == upto_b[group_b])
    digests, begin = [], 0
    for stop in (stop_a + stop_b).tolist():
        digests.append(hashlib.sha256(b"".join(map(pair.signs.__getitem__, signs[begin:stop].tolist()))[:-1]).hexdigest())
        begin = stop

    # distinct pairs of each document, then of the block
    width = len(pair.len_b)
    doc = np.repeat(np.arange(len(good)), n_links)
    span = len(pair.len_a) * width
    key, times = np.unique(doc * span + a[link_a] * width + b[link_b], return_counts=True)
    found, place = np.unique(key % span, return_inverse=True)
    upto = np.searchsorted(key, np.arange(1, len(good) + 1) * span)
    total = np.bincount(place, weights=times, minlength=len(found)).astype(np.int64)

    row = np.zeros((4, len(ids)), dtype=np.int64)
    row[:, good] = n_a, n_b, n_groups, n_links
    sha, ends = np.array([""] * len(ids), dtype=object), np.zeros(len(ids), dtype=np.int64)
    sha[good] = digests
    ends[good] = upto
    docs = pa.record_batch({
        "doc_id": pa.array([ids], pa.list_(pa.int64())),
        **{name: pa.array([row[k]], pa.list_(pa.int64())) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "sha": pa.array([sha], pa.list_(pa.string())),
        "ends": pa.array([np.maximum.accumulate(ends) if len(ids) else ends], pa.list_(pa.int64())),
        "place": pa.array([place.astype(np.int32)], pa.list_(pa.int32())),
        "times": pa.array([times.astype(np.int32)], pa.list_(pa.int32())),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(docs)
    return sink.getvalue().to_pybytes(), found // width, found % width, total


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Rows (block, docs, a, b, n): blocks of documents with their distinct pairs of ids and numbers of links."""

    def blocks(batch: pa.RecordBatch) -> Iterator[dict]:
        pair = pair_of(path_a, path_b)
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        at = TaskContext.get().partitionId() << 32
        for begin, end in slices(np.array([*map(len, texts)], dtype=np.int64), block_bytes):
            pair.turn = getattr(pair, "turn", 0) + 1
            made, a, b, n = _block(pair, ids[begin:end], texts[begin:end])
            yield {"block": [at + pair.turn % (1 << 32)], "docs": [made], "a": [a], "b": [b], "n": [n]}

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_col), blocks, BLOCK)


def pair_counts(blocks: DataFrame, salts: int = 16) -> DataFrame:
    """Rows (a, b, n, best): links of each pair of ids in all blocks, and whether no pair of the same B id has more."""
    pairs = blocks.select(F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.inline(F.arrays_zip("a", "b", "n")))
    return pairs.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """Pairs with ``best``.  The broadcast side has a row for each B id that occurs: the vocabulary's size bounds it."""
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _sums(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with their links' counts."""
    n, best = np.zeros(pairs.num_rows, dtype=np.int64), np.zeros(pairs.num_rows, dtype=bool)
    place = pairs.column("place").to_numpy()
    n[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
    out = []
    for raw in blocks.column("docs").to_pylist():
        docs = pa.ipc.open_stream(raw).read_next_batch()
        col = {name: docs.column(k).values for k, name in enumerate(docs.schema.names)}
        at, times, ends = (col[c].to_numpy() for c in ("place", "times", "ends"))
        begins = np.r_[0, ends[:-1]]
        weighed = [np.r_[0, np.cumsum(times * of)] for of in (best[at], n[at])]
        out.append(pa.table([col["doc_id"], *(col[c] for c in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(w[ends] - w[begins], pa.int64()) for w in weighed), col["sha"]], names=[c.split()[0] for c in DIGEST.split(", ")]))
    return pa.concat_tables(out)


def digest(blocks: DataFrame, counts: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each document; ``counts`` is what :func:`with_best` gives."""
    mine = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.posexplode(F.arrays_zip("a", "b"))).select("block", "salt", F.col("pos").alias("place"), "col.a", "col.b")
    dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = mine.join(dealt, ["a", "b", "salt"]).select(F.col("block").alias("of_block"), "place", "n", "best")
    return blocks.select("block", "docs").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_sums, DIGEST)


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, salts: int = 16, **options) -> DataFrame:
    """Digest of every document's alignment; see the module's text."""
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = scratch.put(align(docs, path_a, path_b, **options), "blocks")
    counts = scratch.put(pair_counts(blocks, salts), "counts")
    return digest(blocks, with_best(counts), salts)
