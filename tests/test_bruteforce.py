"""Queries without SQL against plain versions in Python, on the smallest tables."""

import collections
import re

import numpy as np
import pytest

from tessera.operators import evidence, lifecycle
from tessera.plans import search, stores
from tessera.session import table


def unit(v):
    x = np.array(v, dtype=float)
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def ranked(spark, sf_dir):
    lists = collections.defaultdict(list)
    for r in search._ranked(spark, sf_dir).collect():
        lists[r.query_id].append(r)
    return {q: sorted(rows, key=lambda r: r["rank"]) for q, rows in lists.items()}


def test_mmr(spark, sf_dir, ranked):
    want = {}
    for q, rows in ranked.items():
        left, chosen = list(rows), []
        while left and len(chosen) < 10:
            value = lambda r: 0.7 * r.score - 0.3 * max((max(0.0, unit(r.embedding) @ unit(c.embedding)) for c in chosen), default=0.0) if chosen else r.score  # noqa: E731, B023
            best = max(left, key=value)
            left.remove(best)
            chosen.append(best)
        want[q] = [r.doc_id for r in chosen]
    got = collections.defaultdict(list)
    for r in sorted(search.QUERIES["mmr_topk"](spark, sf_dir).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.doc_id)
    assert dict(got) == want


def test_dedup_semantic(spark, sf_dir, ranked):
    want = set()
    for q, rows in ranked.items():
        kept = []
        for r in rows:
            if all(unit(r.embedding) @ unit(k.embedding) <= 0.95 for k in kept):
                kept.append(r)
        want |= {(q, r["rank"]) for r in kept}
    assert {(r.query_id, r["rank"]) for r in search.QUERIES["dedup_semantic"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("query", [search.QUERIES["knn_ivf"], stores.QUERIES["ivf_index"]])
def test_inverted_lists_find_nine_in_ten(spark, sf_dir, query):
    rows = table(spark, sf_dir, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([unit(r.embedding) for r in rows])
    got = collections.defaultdict(set)
    for r in query(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    assert set(got) == {int(ids[k]) for k in asked}
    found = sum(len(got[int(ids[k])] & set(ids[np.argsort(-(x @ x[k]), kind="stable")[:10]].tolist())) for k in asked)
    assert found / (10 * len(asked)) >= 0.9


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for k, d in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
    return row[-1]


def test_quote_matches_over_all_documents(spark, sf_dir):
    """Every claim against every sentence of every document, not only of those that share words with it."""
    norm = lambda s: " ".join(sorted(re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0B-\x1F]", "", s.lower())).split()))
    sentences = lambda t, n: [s for s in (re.sub(r"\s+", " ", x).strip() for x in re.findall(r"[^.!?]+[.!?]*", t or "")) if len(s.split()) >= n]
    items = table(spark, sf_dir, "benchmark").collect()
    docs = table(spark, sf_dir, "documents").collect()
    pool = [(f"p{d.doc_id}", s) for d in docs for s in sentences(d.text, 3)]
    bags = [(i, norm(s)) for i, s in pool]
    bags = [(i, s, collections.Counter(s)) for i, s in bags]
    want = collections.defaultdict(set)
    for item in items:
        for k, claim in enumerate(sentences(item.text, 3)):
            a = norm(claim)
            bag = collections.Counter(a)
            for i, b, other in bags:
                n = len(a) + len(b)
                if 2 * min(len(a), len(b)) >= 0.85 * n and 2 * sum((bag & other).values()) >= 0.8495 * n and (a == b or round(2 * lcs(a, b) / n, 3) >= 0.85):
                    want[item.item_id, k].add(i)
            for j in items:  # the items' own texts are passages of their own answer
                if j.item_id == item.item_id:
                    want[item.item_id, k].add(f"b{j.item_id}")
    got = collections.defaultdict(set)
    for r in evidence.quote_matches(search._claims(spark, sf_dir), search._passages(spark, sf_dir), top_k=10_000).collect():
        got[r.answer_id, r.prop].add(r.passage_id)
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items()}
    assert any(p.startswith("p") for v in got.values() for p in v)


def test_breaker_over_many_calls(spark):
    rng = np.random.default_rng(4)
    calls = [(f"s{k % 3}", float(t), bool(rng.random() < 0.45)) for k, t in enumerate(np.cumsum(rng.integers(1, 12, 900)))]
    want, held = {}, {}
    for store, at, ok in calls:
        state, bad, good, opened = held.get(store, ("CLOSED", 0, 0, 0.0))
        if state == "OPEN" and at - opened >= 30:
            state, good = "HALF_OPEN", 0
        allowed = state != "OPEN"
        if allowed:
            bad, good = (0, good + 1) if ok else (bad + 1, good)
            if ok and state == "HALF_OPEN" and good >= 3:
                state = "CLOSED"
            elif not ok and (state == "HALF_OPEN" or bad >= 5):
                state, opened = "OPEN", at
        held[store] = (state, bad, good, opened)
        want[store, at] = (state, allowed)
    got = lifecycle.breaker(spark.createDataFrame(calls, "store string, at double, ok boolean")).collect()
    assert {(r.store, r.at): (r.state, r.allowed) for r in got} == want
    assert {s for s, _ in want.values()} == {"CLOSED", "OPEN", "HALF_OPEN"}


def test_flagged_sentences_are_gone(spark, sf_dir):
    from tessera.plans import extras

    got = extras.QUERIES["flagged_removed"](spark, sf_dir).collect()
    flagged = collections.defaultdict(list)
    for r in search._judged(spark, sf_dir).where("n_quotes = 0").collect():
        flagged[r.answer_id].append(r.text.lower())
    for r in got:
        assert all(evidence.token_set_ratio(r.sentence.lower(), c) <= 0.7005 for c in flagged[r.answer_id])
