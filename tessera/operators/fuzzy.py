"""Exact fuzzy matching of texts: all pairs whose Indel ratio reaches a threshold, by filters that lose none.

The ratio of two strings is 2 L / (|a| + |b|), L their longest common subsequence.  A pair passes four bounds before L is
computed:

* length: the shorter string is the longest L can be, so lengths lie in a window around each other;
* pairs of neighbouring letters: of a string's bigrams every letter outside of L spoils two at most, and every letter of
  the other string outside of L one, so both hold 3 L - |a| - |b| - 1 bigrams in common.  Bigrams with their running
  number in the string are hashed to a bit row; common bits of many pairs are one matrix product, and what two bigrams
  of a string lost by falling on one bit is added to the bound;
* letters: L counts no letter more often than both strings have it;
* triples of letters: 5 L - 2 |a| - 2 |b| - 2 in common, by the same reasoning, with bit rows compared pair by pair.

Claims are a stated set of queries: they are matched in blocks of a bounded number, each against all rows, in Arrow
batches.  Rows carry identifiers and one sentence; texts of whole passages never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BITS = 1024


def sorted_tokens(text: Column) -> Column:
    """The normalised text with its words in order: what a token-sort ratio compares."""
    return F.array_join(F.sort_array(T.words(T.normalize(text))), " ")


def letter_places(a: str) -> dict[str, int]:
    """For each letter the bits of its places."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    return places


def common_length(n: int, places: dict[str, int], b: str) -> int:
    """Length of the longest common subsequence of a string of ``n`` letters, given by its places, and ``b``; bit-parallel."""
    full = (1 << n) - 1
    state, get = full, places.get
    for c in b:
        hit = state & get(c, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / (len a + len b)."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2.0 * common_length(len(a), letter_places(a), b) / (len(a) + len(b))


def gram_bits(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit rows, q-grams lost to shared bits) of each text.  Letters count by their low bits, which can only join grams."""
    lengths = np.array([*map(len, texts)], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64) & 0x3FF
    row = np.repeat(np.arange(len(texts)), lengths)
    last = len(codes) - q + 1
    gram = row[: max(last, 0)].copy()
    for k in range(q if last > 0 else 0):
        gram = gram << 10 | codes[k : k + last]
    gram = np.sort(gram[row[:last] == row[q - 1 :]]) if last > 0 else gram
    # equal grams of a text stand together, which gives each its running number
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, dtype=np.int64)
    number = np.arange(len(gram)) - np.repeat(first, np.diff(np.r_[first, len(gram)]))
    mixed = ((gram & ((1 << 10 * q) - 1)).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.zeros((len(texts), BITS), dtype=bool)
    bits[gram >> 10 * q, (mixed >> np.uint64(54)).astype(np.int64)] = True
    return bits, np.maximum(lengths - q + 1, 0) - bits.sum(axis=1)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often letters occur, by their low five bits."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64) & 31
    row = np.repeat(np.arange(len(texts)), [*map(len, texts)])
    return np.bincount(row * 32 + codes, minlength=32 * len(texts)).reshape(len(texts), 32).astype(np.int32)


class Claims:
    """A block of claims prepared for matching, in order of length."""

    def __init__(self, texts: list[str], least: float):
        self.least = least
        self.order = np.argsort([*map(len, texts)], kind="stable")
        self.texts = [texts[k] for k in self.order]
        self.lengths = np.array([*map(len, self.texts)], dtype=np.int64)
        pairs, self.lost2 = gram_bits(self.texts, 2)
        triples, self.lost3 = gram_bits(self.texts, 3)
        self.bits, self.triples, self.letters = pairs.astype(np.float32), packed(triples), letter_counts(self.texts)
        self.words = -(-self.lengths // 64)
        # places of each letter of the claims, as bits; letter 0 is any other
        self.alphabet = {c: k for k, c in enumerate(sorted(set("".join(self.texts))), 1)}
        self.places = [self._places(t, int(w)) for t, w in zip(self.texts, self.words, strict=True)]

    def _places(self, text: str, words: int) -> np.ndarray:
        out = np.zeros((len(self.alphabet) + 1, words), dtype=np.uint64)
        for k, c in enumerate(text):
            out[self.alphabet[c], k // 64] |= np.uint64(1 << k % 64)
        return out

    def match(self, texts: list[str], rows: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of text, index of claim, ratio) of all pairs with a ratio of ``least`` or more."""
        order = np.array(sorted(range(len(texts)), key=lambda k: len(texts[k])), dtype=np.int64)
        found = [self._match([texts[k] for k in order[at : at + rows]]) for at in range(0, len(order), rows)]
        base = np.repeat(np.arange(len(found)) * rows, [len(f[0]) for f in found])
        i, j, ratio = (np.concatenate([f[k] for f in found] or [np.zeros(0)]) for k in range(3))
        return order[i.astype(np.int64) + base], self.order[j.astype(np.int64)], ratio

    def _match(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least, lengths = self.least, np.array([*map(len, texts)], dtype=np.int64)
        # 2 min / (x + y) >= least
        low, high = np.searchsorted(self.lengths, [lengths[0] * least / (2 - least) - 1e-9, lengths[-1] * (2 - least) / least + 1e-9])
        pairs, lost = gram_bits(texts, 2)
        common = pairs.astype(np.float32) @ self.bits[low:high].T + np.minimum(lost[:, None], self.lost2[None, low:high])
        both = lengths[:, None] + self.lengths[None, low:high]
        i, j = np.nonzero(common >= (1.5 * least - 1) * both - 1.001)  # 3 L - |a| - |b| - 1 and L >= least (|a| + |b|) / 2
        j += low
        both = lengths[i] + self.lengths[j]
        need = np.ceil(least * both / 2 - 1e-9).astype(np.int64)  # letters in common

        def keep(fits: np.ndarray) -> None:
            nonlocal i, j, need, both
            i, j, need, both = i[fits], j[fits], need[fits], both[fits]

        keep(np.minimum(lengths[i], self.lengths[j]) >= need)
        keep(np.minimum(letter_counts(texts)[i], self.letters[j]).sum(axis=1) >= need)
        triples, lost = gram_bits(texts, 3)
        triples = packed(triples)
        keep(np.bitwise_count(triples[i] & self.triples[j]).sum(axis=1, dtype=np.int64) + np.minimum(lost[i], self.lost3[j]) >= 5 * need - 2 * both - 2)
        ratio = 2.0 * self._common(texts, i, j, need) / np.maximum(both, 1)
        fits = ratio >= least
        return i[fits], j[fits], ratio[fits]

    def _common(self, texts: list[str], i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Lengths of longest common subsequences of all pairs at once, bit-parallel; -1 for pairs that are given up as too unlike."""
        out = np.full(len(i), -1, dtype=np.int64)
        if not len(i):
            return out
        width = max(len(texts[k]) for k in i)
        coded = np.zeros((len(texts), width), dtype=np.int64)
        number = self.alphabet.get
        for k in set(i.tolist()):
            coded[k, : len(texts[k])] = [number(c, 0) for c in texts[k]]
        for words in np.unique(self.words[j]):
            at = np.flatnonzero(self.words[j] == words)
            claims, row = np.unique(j[at], return_inverse=True)
            places = np.stack([self.places[k] for k in claims])
            b, least = coded[i[at]], need[at]
            state = np.full((len(at), int(words)), np.uint64(0xFFFFFFFFFFFFFFFF))
            for step in range(width):
                hit = places[row, b[:, step]] & state
                carry = np.zeros(len(state), dtype=bool)
                for w in range(int(words)):
                    old = state[:, w]
                    total = old + hit[:, w]
                    over = total < old
                    total += carry
                    carry = over | (carry & (total == 0))
                    state[:, w] = total | (old & ~hit[:, w])
                if step % 8 == 7 or step == width - 1:  # bits that fell are letters found; each letter left can add one
                    found = np.bitwise_count(~state).sum(axis=1, dtype=np.int64)
                    out[at] = found
                    alive = found + (width - 1 - step) >= least
                    if not alive.all():
                        out[at[~alive]] = -1
                        at, row, b, least, state = at[alive], row[alive], b[alive], least[alive], state[alive]
                    if not len(at):
                        break
        return out


def match(sentences: DataFrame, claims: list[str], least: float, text_col: str = "b") -> DataFrame:
    """All rows of ``sentences`` whose ``text_col`` reaches ``least`` with a claim: their other columns, ``claim`` and ``similarity``.

    ``claims`` travel with the task, so the caller bounds their number.
    """
    others = [c for c in sentences.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in sentences.dtypes if c != text_col) + ", claim int, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Claims(claims, least)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows, which, ratio = block.match(["" if x is None else x for x in table.column(text_col).to_pylist()])
            if len(rows):
                kept = table.select(others).take(pa.array(rows)).combine_chunks()
                kept = kept.append_column("claim", pa.array(which, pa.int32())).append_column("similarity", pa.array(ratio, pa.float64()))
                yield from kept.to_batches()

    return sentences.mapInArrow(run, schema)
