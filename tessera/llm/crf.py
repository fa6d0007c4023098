"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its neighbouring
lines.  Unary and transition weights are trained by gradient ascent on the chain
likelihood, with the document's label standing for its lines; a second pass relabels each
bad document's lines by their own marginals, so that its good lines stop counting as bad.
Forward-backward marginals, weighted by line length, give the document's quality, which a
one-dimensional logistic fit turns into a calibrated score.

Defined cases: a null or empty text is one empty line; very long lines are read whole, in one
pass; documents without labels are only scored; one with conflicting labels counts as bad; a
score of exactly 0.5 is predicted good; repeated rows get equal scores, each its own row;
without labelled rows every score is 0.5; an empty table gives no row; only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, forget, held_out, slices, texts_of, trim

_WORD = re.compile(r"\S+")
N_BASE = 12


def line_features(lines: list[str]) -> np.ndarray:
    """One row of ``N_BASE`` numbers per line, all of order one."""
    out = np.zeros((len(lines), N_BASE))
    seen: set[str] = set()
    for k, line in enumerate(lines):
        n = len(line)
        if not n:
            out[k, 11] = 1
            continue
        words = line.split()
        m = max(1, len(words))
        raw = line.encode("utf-8", "replace")
        plain = len(raw.translate(None, _LETTERS_SPACE))
        repeated = sum(map(str.__eq__, words, words[1:])) / m
        upper = sum(map(str.isupper, words)) / m
        digits = n - len(line.translate(_NO_DIGITS))
        marks = len(raw) - len(raw.translate(None, _SENTENCE))
        bars = line.count("|") + line.count("\t")
        out[k] = (
            np.log1p(n) / 8,
            np.log1p(m) / 6,
            min(2.0, (n - m + 1) / m / 8),
            upper,
            repeated,
            1 - len(set(words)) / m if m > 3 else 0,
            min(2.0, 8 * (plain - marks) / n),
            min(2.0, 20 * marks / n),
            digits / n,
            min(2.0, 3 * bars / m),
            line in seen,
            0,
        )
        seen.add(line)
    return out


_LETTERS_SPACE = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c).isspace())
_SENTENCE = b".,;:!?'\"()-"
_NO_DIGITS = {c: None for c in range(48, 58)}


def chain_features(base: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it in its document, and a constant."""
    n = len(base)
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[starts] = 0
    ends = np.append(starts[1:], n) - 1
    after[ends] = 0
    return np.hstack([base, before, after, np.ones((n, 1))])


def marginals(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected label pairs, by forward-backward in log space.

    Documents advance together, longest first, so each step is one vector operation
    over the chains that are still alive.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        at = starts[: alive[t]] + t
        if t == 0:
            alpha[at] = scores[at]
        else:
            a = alpha[at - 1][:, :, None] + trans
            alpha[at] = np.logaddexp(a[:, 0], a[:, 1]) + scores[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        b = trans[None] + (scores[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    pairs = np.zeros((2, 2))
    inner = np.ones(len(scores), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    if len(at):
        p = alpha[at - 1][:, :, None] + trans + (scores[at] + beta[at])[:, None, :]
        p -= np.logaddexp(both[at, 0], both[at, 1])[:, None, None]
        pairs = np.exp(np.minimum(p, 0)).sum(axis=0)
    return good, pairs


@dataclass
class LineModel:
    weights: np.ndarray  # features x labels (bad, good)
    trans: np.ndarray
    slope: float = 4.0
    offset: float = -2.0

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of all lines, their weights, and each text's first line and line count."""
        split = [t.split("\n") for t in texts]
        lengths = np.array([len(s) for s in split])
        starts = np.cumsum(lengths) - lengths
        base = np.vstack([line_features(s) for s in split])
        good, _ = marginals(chain_features(base, starts) @ self.weights, starts, lengths, self.trans)
        size = np.array([len(x) + 1.0 for s in split for x in s])
        return good, size, starts, lengths

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of P(good)."""
        good, size, starts, _ = self.lines(texts)
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(np.array([len(t) for t in texts]), 2 << 20):
            out[a:b] = self.quality(texts[a:b])
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -700, 700)))


def fit(texts: list[str], labels: list[int], *, rounds: int = 2, steps: int = 150, l2: float = 1e-3) -> LineModel:
    model = LineModel(np.zeros((3 * N_BASE + 1, 2)), np.zeros((2, 2)))
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        model.slope, model.offset = 0.0, (3.0 if labels and labels[0] else -3.0 if labels else 0.0)
        return model
    split = [t.split("\n") for t in texts]
    lengths = np.array([len(s) for s in split])
    starts = np.cumsum(lengths) - lengths
    x = chain_features(np.vstack([line_features(s) for s in split]), starts)
    doc_y = np.repeat(y, lengths)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    weight = np.repeat(balance / lengths, lengths)  # every document counts alike, both labels count alike
    target = doc_y.astype(float)
    inner = np.ones(len(x), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    for r in range(rounds):
        m, v = [np.zeros_like(model.weights), np.zeros((2, 2))], [np.zeros_like(model.weights), np.zeros((2, 2))]
        soft = np.stack([1 - target, target], axis=1)
        seen = soft[at - 1].T @ soft[at] / max(1, len(at))
        for step in range(1, steps + 1):
            good, pairs = marginals(x @ model.weights, starts, lengths, model.trans)
            diff = (soft - np.stack([1 - good, good], axis=1)) * weight[:, None]
            grads = [x.T @ diff / weight.sum() - l2 * model.weights, 0.1 * (seen - pairs / max(1, len(at))) - l2 * model.trans]
            for k, (g, w) in enumerate(zip(grads, (model.weights, model.trans), strict=True)):  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        if r + 1 < rounds:
            good, _ = marginals(x @ model.weights, starts, lengths, model.trans)
            target = np.where(doc_y == 1, 1.0, (good > 0.5).astype(float))
            lowest = np.minimum.reduceat(np.where(doc_y == 0, good, 1.0), starts)
            target[(doc_y == 0) & (good <= np.repeat(lowest, lengths) + 1e-12)] = 0.0  # a bad document has a bad line
    q = np.concatenate([model.quality(texts[a:b]) for a, b in slices(np.array([len(t) for t in texts]), 2 << 20)])
    w = np.zeros(2)
    design = np.stack([q, np.ones_like(q)], axis=1)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        w += np.linalg.solve(h, design.T @ (y - p) - 0.05 * w)
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 1500, sample_bytes: int = 64 << 20, **options) -> LineModel:
    """Fit on at most ``sample_rows`` labelled documents of the training fold of ``sample_bytes`` together, chosen by a hash of their identifiers."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # at most sample_rows rows
    got = bounded_sample(rows, sample_rows, sample_bytes)
    model = fit([r["text"] for r in got], [r["label"] for r in got], **options)
    del got
    trim()  # the sample and its features are not needed on the driver any more
    return model


def score(df: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted, n_lines), and the columns of ``keep``; one pass, no shuffle; a text that is kept travels once."""
    rest = [c for c in keep if c != text_col]
    place = {text_col: 1} | {c: 2 + k for k, c in enumerate(rest)}
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "doc_id long, score double, predicted int, n_lines int" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(batch: pa.RecordBatch):
        forget()
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = texts_of(part.column(1))
            p = shared.value.score(texts)
            yield {"doc_id": part.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32), "n_lines": [t.count("\n") + 1 for t in texts]} | {c: part.column(place[c]) for c in keep}

    return arrow_map(df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *rest), run, schema)


def label_lines(df: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, p_good, good) for every line."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for a, b in slices(np.array([len(t) for t in texts]), 2 << 20):
            good, _, starts, lengths = shared.value.lines(texts[a:b])
            yield {"doc_id": np.repeat(np.array(ids[a:b]), lengths), "line_no": np.arange(len(good)) - np.repeat(starts, lengths), "p_good": good, "good": good >= 0.5}

    return arrow_map(df.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, line_no int, p_good double, good boolean")
