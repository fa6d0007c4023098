"""op12 against each filter applied row by row in each order, beside its SQL on the given tables."""

import re
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import audit
from tessera.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """All orders, one document and filter at a time."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    judged = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        if len(w) < 100:
            fails.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and smallest[t] < i:
            fails.add("E")
        judged.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        mine = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                failing = sum(f in j[1] for j in mine)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(j[1] == {f} for j in mine), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def as_dict(rows):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in rows}


def test_against_single_filters(spark, rows):
    long = " ".join(f"word{k}" for k in range(120))
    extra = [(k, long + " tail" * (k % 3) + (" #" if k % 5 == 0 else ""), ("en", "de", None)[k % 3]) for k in range(10, 60)] + [(None, long, "en"), (None, long, "en"), (9, long, ""), (61, "A B C", "de"), (62, "A B C", "en"), (63, "", None), (64, None, "xx")]
    docs = [(r.doc_id, r.text, r.lang) for r in rows().collect()] + extra
    labels = [(k, k % 2, (k // 2) % 2) for k in range(5, 65)] + [(10, 1, 1), (10, 0, 0), (11, None, None), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 7, "clash") for d in docs], "doc_id long, text string, lang string, n long, mask string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(df, marks).collect()
    assert as_dict(got) == brute(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})


def test_sql_on_given_tables(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    want = con.sql(audit.ORACLE_SQL).fetchall()
    got = audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, labels).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=32, max_size=32))
def test_zeta(counts):
    counts = np.array(counts, dtype=np.int64)
    left = audit.survivors(counts)
    for s in range(32):
        assert left[s] == sum(int(n) for m, n in enumerate(counts) if m & s == 0)
