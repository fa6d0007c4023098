"""Sentence boundaries learned from the corpus itself, without labels.

A full stop ends a sentence unless it belongs to an abbreviation.  Whether a word is one shows in the corpus: it nearly
always has a stop behind it, it is short, and it may hold stops inside.  Likewise some words begin sentences far more
often than chance has it, and these part even after an abbreviation.  Both are log-likelihood ratios of counts, which
are sums over all texts: every task counts its own batches, and words with their counts are added up by a shuffle.

Only the model reaches the driver: the ``most`` strongest abbreviations and sentence starters (a documented bound; a
language has some thousands).  Texts are then split where they are read.

Defined cases: a null or empty text has no sentence; ``!`` and ``?`` always end one, with the quotes and brackets behind
them; a stop inside of a token (decimals, addresses, ``e.g``) never does; initials and numbers with a stop do not, where
the next word is no known starter (initials) or is not capitalised (numbers); very long texts are split whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the share of abbreviations that have their stop, and the thresholds of both ratios
WITH_STOP, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
_TOKEN = re.compile(r"\S+")
_CLOSING = re.compile(r"(?<!\S)\S*[.!?][\"'’”»)\]]*(?!\S)")  # a token that may end a sentence
_END = re.compile(r"([.!?]+)([\"'’”»)\]]*)\Z")
_INITIAL, _NUMBER, _OPENING = re.compile(r"[^\W\d_]\.\Z"), re.compile(r"[-+]?\d[\d.,]*\.\Z"), "\"'‘“«(["


def token_type(token: str) -> str:
    """A token without the signs around it, lower-cased; numbers are one type."""
    core = token.strip(_OPENING + "\"'’”»)]!?,;:").lower().rstrip(".")
    return "##number##" if core and core.replace(".", "").replace(",", "").isdigit() else core


def counted(texts: list[str | None], abbreviations: frozenset[str] = frozenset()) -> dict[str, list[int]]:
    """For each type: how often it stands without a stop, with one, and directly behind a sentence's end; "" counts all tokens.

    A stop behind one of ``abbreviations`` or an initial is no sentence's end.
    """
    seen: Counter[str] = Counter()
    behind: Counter[str] = Counter()
    ending = _Ending(abbreviations)
    for text in texts:
        tokens = (text or "").split()
        seen.update(tokens)
        behind.update(b for a, b in pairwise(tokens) if ending[a])
    # what a token is does not depend on its place, so it is looked at once
    out: dict[str, list[int]] = {"": [0, 0, 0]}
    for token, n in seen.items():
        end = _END.search(token)
        stop = bool(end) and end[1] == "."
        for kind in {token_type(token), ""}:
            row = out.setdefault(kind, [0, 0, 0])
            row[stop if kind else 0] += n
            row[2] += behind[token]
        out[""][1] += n if stop else 0
    return out


class _Ending(dict):
    """Whether a token ends a sentence, kept for each token."""

    def __init__(self, abbreviations: frozenset[str]):
        super().__init__()
        self.abbreviations = abbreviations

    def __missing__(self, token: str) -> bool:
        end = _END.search(token)
        out = self[token] = bool(end) and not (end[1] == "." and (token_type(token) in self.abbreviations or bool(_INITIAL.match(token))))
        return out


def abbreviation_score(kind: Column | str, without, with_, tokens, stops, fn=math):
    """Log-likelihood ratio of "has its stop" against chance, less for long words and for occurrences without a stop."""
    log, exp, power, larger = (F.log, F.exp, F.pow, F.greatest) if fn is F else (math.log, math.exp, math.pow, max)
    chance = stops / tokens
    low = F.lit(1e-12) if fn is F else 1e-12
    null = with_ * log(larger(chance, low)) + without * log(larger(1 - chance, low))
    own = with_ * math.log(WITH_STOP) + without * math.log(1 - WITH_STOP)
    inner = F.length(kind) - F.length(F.replace(kind, F.lit("."))) if fn is F else kind.count(".")
    letters = F.length(kind) - inner if fn is F else len(kind) - inner
    return 2 * (own - null) * exp(-1.0 * letters) * (inner + 1) * power(1.0 * letters, -1.0 * without)


def starter_score(behind, n, ends, tokens, fn=math):
    """Log-likelihood ratio of "stands behind a sentence's end" against independence."""
    log, larger = (F.log, F.greatest) if fn is F else (math.log, max)
    low = F.lit(1e-12) if fn is F else 1e-12

    def fit(k, m, p):
        return k * log(larger(p, low)) + (m - k) * log(larger(1 - p, low))

    p, p1, p2 = n / tokens, behind / ends, (n - behind) / (tokens - ends)
    return 2 * (fit(behind, ends, p1) + fit(n - behind, tokens - ends, p2) - fit(behind, ends, p) - fit(n - behind, tokens - ends, p))


@dataclass(frozen=True)
class Boundaries:
    abbreviations: frozenset[str]
    starters: frozenset[str]

    def ends(self, token: str, following: str | None) -> bool:
        """Whether a sentence ends with this token."""
        end = _END.search(token)
        if not end:
            return False
        if following is None or "!" in end[1] or "?" in end[1]:
            return True
        body = token[: len(token) - len(end[2])].lstrip(_OPENING)
        first = following.lstrip(_OPENING)[:1]
        begins = first.isupper() and token_type(following) in self.starters
        if len(end[1]) > 1:  # an ellipsis
            return not first.islower()
        if _NUMBER.match(body):
            return not first.islower()
        if _INITIAL.match(body) or token_type(token) in self.abbreviations:
            return begins
        return True

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """[start, end) of every sentence."""
        text = text or ""
        first = _TOKEN.search(text)
        if first is None:
            return []
        out, begin = [], first.start()
        for m in _CLOSING.finditer(text):
            following = _TOKEN.search(text, m.end())
            if following is None:
                break
            if self.ends(m[0], following[0]):
                out.append((begin, m.end()))
                begin = following.start()
        return [*out, (begin, len(text.rstrip()))]


COUNTS = "kind string, without long, with_stop long, behind long"


def counts(df: DataFrame, text_col: str = "text", abbreviations: frozenset[str] = frozenset()) -> DataFrame:
    """(kind, without, with_stop, behind) over all texts; ``''`` is the row of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = counted(batch.column(0).to_pylist(), abbreviations)
            rows = [*zip(*held.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *(pa.array(c, pa.int64()) for c in rows)], names=[c.split()[0] for c in COUNTS.split(", ")])

    return df.select(text_col).mapInArrow(run, COUNTS).groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("without", "with_stop", "behind")))


def learn(df: DataFrame, text_col: str = "text", most: int = 50_000) -> Boundaries:
    """The model of a corpus; at most ``most`` abbreviations and as many starters reach the driver, the strongest first."""
    def strongest(found: DataFrame, least: float) -> frozenset[str]:
        rows = found.where(F.col("score") >= least).orderBy(F.col("score").desc(), "kind").limit(most).collect()
        return frozenset(r["kind"] for r in rows)

    def whole(seen: DataFrame) -> list[float]:
        row = seen.where("kind = ''").first()
        return [float(row[c] or 0) for c in ("without", "with_stop", "behind")] if row else [0.0, 0.0, 0.0]

    held = []

    def kept(seen: DataFrame) -> DataFrame:
        held.append(seen.persist())  # read twice; texts are counted once
        return seen

    try:
        return _learned(df, text_col, kept, whole, strongest)
    finally:
        for seen in held:
            seen.unpersist()


def _learned(df: DataFrame, text_col: str, kept: Callable, whole: Callable, strongest: Callable) -> Boundaries:
    seen = kept(counts(df, text_col))
    tokens, stops, _ = whole(seen)
    if not 0 < stops < tokens:
        return Boundaries(frozenset(), frozenset())
    lettered = F.col("kind").rlike(r"\p{L}")
    score = abbreviation_score(F.col("kind"), F.col("without"), F.col("with_stop"), F.lit(tokens), F.lit(stops), F)
    short = strongest(seen.where(lettered & (F.col("with_stop") > 0)).select("kind", score.alias("score")), ABBREVIATION)
    # once they are known, what stands behind an abbreviation is no sentence's first word
    seen = kept(counts(df, text_col, short))
    tokens, _, ends = whole(seen)
    if not 0 < ends < tokens:
        return Boundaries(short, frozenset())
    n = F.col("without") + F.col("with_stop")
    often = seen.where(lettered & (F.col("behind") > 0) & (F.col("behind") / ends > (n - F.col("behind")) / (tokens - ends)))
    return Boundaries(short, strongest(often.select("kind", starter_score(F.col("behind"), n, F.lit(ends), F.lit(tokens), F).alias("score")), STARTER))


def split(df: DataFrame, model: Boundaries, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, pos, start, end[, sentence]) of every text."""
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, pos int, start int, end int" + (", sentence string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = part.column(1).to_pylist()
                found = [model.split(t) for t in bodies]
                row = [k for k, f in enumerate(found) for _ in f]
                cols = [part.column(0).take(pa.array(row, pa.int32())), pa.array([p for f in found for p in range(len(f))], pa.int32()), *(pa.array([s[k] for f in found for s in f], pa.int32()) for k in (0, 1))]
                if texts:
                    cols.append(pa.array([bodies[k][a:b] for k, f in enumerate(found) for a, b in f], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return df.select(id_col, text_col).mapInArrow(run, schema)
