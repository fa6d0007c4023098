"""op11: exact targets, sources near them, copies within bounds, reruns, and the odds of single transfers."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import mixing
from tessera.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(rows):
    """Targets of sources by the rule itself: shares by weight, caps, excess shared again."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return size, target | share
        for s in over:
            target[s] = Fraction(3 * size[s])
            left -= target[s]
            open_.discard(s)
    return size, target


def held(rows, got):
    size, target = brute_targets(rows)
    words = {(i, s): len(WORD.findall(t or "")) for i, t, s in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sources = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = sources[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(float(target[s]), rel=1e-12)
        assert r.taken <= 3 * r.size and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], words[r.doc_id, s])
    for s in size:
        assert abs(taken[s] - target[s]) <= Fraction(largest[s], 2) + Fraction(1, 1000)


def columns(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_given_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = mixing.mix(docs, bucket_units=7, fan_in=3).collect()
    held(columns(docs), got)
    again = mixing.mix(docs.repartition(5), bucket_units=7, fan_in=3).collect()
    assert sorted(got) == sorted(again)


def test_caps_nulls_and_ties(spark):
    rows = [(k, "w " * (k % 9), ("a", "b", None, "ä", "Z", "\U0001f600")[k * k % 6]) for k in range(400)]
    rows += [(1000 + k, "x " * 3, "hot") for k in range(300)] + [(2000, "y " * 40_000, "one"), (2001, None, "none"), (2002, "", "none")]
    df = spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, size string, target int")
    held(rows, mixing.mix(df, bucket_units=10, fan_in=2).collect())


def test_equal_rows_share_their_copies(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 7 + [(None, "d e", "t")] * 5 + [(2, "a", "u")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 13
    for size, source in ((3, "s"), (2, "t"), (1, "u")):
        mine = [r for r in got if r.size == size]
        assert max(r.taken for r in mine) - min(r.taken for r in mine) <= size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2


def test_many_sources_by_shuffle(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 5), f"s{k % 37}") for k in range(300)], "doc_id long, text string, source string")
    units = mixing.sizes(docs)
    sources = docs.select("source").distinct().selectExpr("source", "1 AS target")
    a = mixing.with_targets(units, sources, 37)
    b = mixing.with_targets(units, sources, 37, broadcast_sources=1)
    cols = ["doc_id", "source", "size", "target"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_empty(spark, empty):
    assert mixing.mix(empty).collect() == []


def test_transfers_keep_sums_and_means():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 50, 40))[::-1].astype(float)
    mass = size * rng.random(40)
    group = np.repeat([0, 1], 20)
    total = np.zeros(40)
    for _ in range(4000):
        out = mixing.round_masses(group, size, mass, rng.random(40))
        for g in (0, 1):
            mine = group == g
            assert out[mine].sum() == pytest.approx(mass[mine].sum())
            assert ((out[mine] > 1e-9) & (out[mine] < size[mine] - 1e-9)).sum() <= 1
        total += out / size
    assert np.abs(total / 4000 - mass / size).max() < 0.04
