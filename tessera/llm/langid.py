"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (bytes of
lower-cased words with border marks).  Embeddings and softmax weights are trained together
by stochastic gradient descent in numpy.  Since the model is linear after averaging, scoring
folds both into one table of logits per bucket.  Temperature scaling and a rejection
threshold are fitted on training documents that the gradient never saw.

Defined cases: a null text or one without a letter (``str.isalpha``; number characters such
as a half are none) is ``und`` with score 0 and rejected; very long texts are averaged over
all their n-grams, in slices; ties go to the alphabetically first language; repeated rows
get equal results, each its own row; without labelled rows every text is ``und``; an empty
table gives no row; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, forget, held_out, mix64, slices, texts_of, trim

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ORDERS = (1, 2, 3, 4)


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def ngram_buckets(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: bucket of every n-gram of all texts, and the text it belongs to, in text order.

    Only letters and word borders count: other characters are read as a border.
    """
    raw = [re.sub(r"[\W\d_]+", " ", t.lower()).strip().encode() for t in texts]
    sizes = np.array([len(r) + 3 for r in raw])
    data = np.frombuffer(b"".join(b"\0 " + r + b" " for r in raw), dtype=np.uint8)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    blank, none = data == 32, data == 0
    for n in _ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        ok = ~(blank[:m] & blank[n - 1 :]) if n <= 2 else np.ones(m, dtype=bool)
        for k in range(n):
            h *= np.uint64(257)
            h += data[k : k + m]
            ok &= ~none[k : k + m]
            if 0 < k < n - 1:
                ok &= ~blank[k : k + m]  # a blank only at either border
        yield (mix64(h[ok]) % np.uint64(buckets)).astype(np.int32), owner[:m][ok]


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str], slice_bytes: int = 1 << 18) -> np.ndarray:
        """Calibrated probabilities, one row per text; long texts are summed in slices at word borders."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        parts: list[tuple[int, str]] = []
        for k, t in enumerate(texts):
            while len(t) > slice_bytes:
                cut = t.rfind(" ", 1, slice_bytes)
                cut = cut if cut > 0 else slice_bytes
                parts.append((k, t[:cut]))
                t = t[cut:]
            parts.append((k, t))
        for a, b in slices(np.array([len(t) for _, t in parts]), slice_bytes):
            who = [k for k, _ in parts[a:b]]
            for keys, owners in ngram_buckets([t for _, t in parts[a:b]], len(self.logits)):
                for c in range(len(self.langs)):
                    np.add.at(total[:, c], who, np.bincount(owners, weights=self.logits[keys, c], minlength=b - a))
                np.add.at(count, who, np.bincount(owners, minlength=b - a))
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        p = self.scores([t or "" for t in texts])
        best = p.argmax(axis=1)
        letters = np.array([has_letter(t) for t in texts], dtype=bool)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score, ~letters | (score < self.threshold)


def fit(texts: list[str], langs: list[str], *, buckets: int = 1 << 16, dim: int = 16, epochs: int = 5, rate: float = 0.4, rejected_share: float = 0.001, seed: int = 7) -> LanguageModel:
    """SGD over documents; every fifth one is kept for calibration.

    ``rejected_share`` of the calibration documents fall under the rejection threshold,
    which never exceeds one half: clean documents stay.
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    grams = []
    for a, b in slices(np.array([len(t) for t in texts]), 1 << 20):
        keys, owners = (np.concatenate(c) for c in zip(*ngram_buckets(texts[a:b], buckets), strict=True))
        order = np.argsort(owners, kind="stable")
        keys, owners = keys[order], owners[order]
        ends = np.searchsorted(owners, np.arange(b - a + 1))
        for k in range(b - a):
            uniq, n = np.unique(keys[ends[k] : ends[k + 1]], return_counts=True)
            grams.append((uniq, n / max(1, n.sum())))
    emb = rng.normal(0, 0.1, (buckets, dim))
    out = rng.normal(0, 0.1, (dim, len(names)))
    bias = np.zeros(len(names))
    train = [k for k in range(len(texts)) if k % 5 or len(texts) < 20]
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            keys, w = grams[k]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = w @ emb[keys] if len(keys) else np.zeros(dim)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            emb[keys] -= lr * 20 * np.outer(w, back)
    model = LanguageModel(names, emb @ out, bias, 1.0, 0.0)
    held = [k for k in range(len(texts)) if k % 5 == 0] if len(texts) >= 20 else train
    sample, truth = [texts[k] for k in held], y[held]
    best = None
    for temperature in np.geomspace(0.05, 2.0, 25):
        model.temperature = float(temperature)
        p = model.scores(sample)
        loss = -np.log(np.maximum(p[np.arange(len(p)), truth], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(temperature), p)
    model.temperature = best[1]
    model.threshold = float(min(0.5, np.quantile(best[2].max(axis=1), rejected_share)))
    return model


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000, sample_bytes: int = 64 << 20, **options) -> LanguageModel:
    """Fit on at most ``sample_rows`` labelled rows of the training fold of ``sample_bytes`` together, chosen by a hash of their identifiers."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = bounded_sample(rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample_rows, sample_bytes)
    model = fit([r["text"] for r in got], [r["lang"] for r in got], **options)
    del got
    trim()  # the sample and its features are not needed on the driver any more
    return model


def predict(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, rejected), and the columns of ``keep``; one pass, no shuffle; a text that is kept travels once."""
    rest = [c for c in keep if c != text_col]
    place = {text_col: 1} | {c: 2 + k for k, c in enumerate(rest)}
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "doc_id long, lang_pred string, score double, rejected boolean" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(batch: pa.RecordBatch):
        forget()
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lang, score, rejected = shared.value.predict(part.column(1).to_pylist())
            yield {"doc_id": part.column(0), "lang_pred": lang, "score": score, "rejected": rejected} | {c: part.column(place[c]) for c in keep}

    return arrow_map(df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *rest), run, schema)
