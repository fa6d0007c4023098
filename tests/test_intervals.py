"""Interval and as-of joins against all pairs, and chunk flags against spans looked up one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import structure
from tessera.operators import chunking, intervals


@pytest.fixture(scope="module")
def places():
    rnd = random.Random(8)
    spans = lambda n: [(rnd.choice([1, 2, None]), k, a, a + rnd.choice([-3, 0, 1, 5, 40, 300])) for k in range(n) for a in [rnd.randrange(400)]]
    return spans(120), spans(120) + [(1, 500, None, 5), (2, 501, 3, None)]


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_overlapping(spark, places, width):
    left, right = places
    a = spark.createDataFrame(left, "key int, i int, start int, end int")
    b = spark.createDataFrame(right, "key int, j int, `from` int, `to` int")
    got = sorted((r.i, r.j) for r in intervals.overlapping(a, b, ["key"], width=width).collect())
    ok = lambda x, y: x is not None and y is not None and x <= y
    want = sorted((i, j) for k, i, s, e in left for m, j, f, t in right if k == m and ok(s, e) and ok(f, t) and s <= t and f <= e)
    assert got == want and len(want) > 500


@pytest.mark.parametrize("width", [1, 10, 10_000])
@pytest.mark.parametrize("strict", [True, False])
def test_last_before(spark, width, strict):
    rnd = random.Random(width)
    marks = [(rnd.choice([1, 2, None]), rnd.randrange(-30, 200), k) for k in range(60)] + [(1, None, 999)]
    points = [(rnd.choice([1, 2, 3, None]), rnd.randrange(-40, 220), k) for k in range(150)]
    m = spark.createDataFrame(marks, "key int, mark_at int, mark int")
    p = spark.createDataFrame(points, "key int, at int, id int")

    def wanted(forward):
        out = {}
        for k, a, i in points:
            if forward:
                fit = [(-b, v) for n, b, v in marks if n == k and b is not None and b >= a]
            else:
                fit = [(b, v) for n, b, v in marks if n == k and b is not None and (b < a or not strict and b == a)]
            out[i] = max(fit)[1] if fit else None
        return out

    assert {r.id: r.mark for r in intervals.last_before(p, m, ["key"], strict=strict, width=width).collect()} == wanted(False)
    assert {r.id: r.mark for r in intervals.first_from(p, m, ["key"], width=width).collect()} == wanted(True)
    assert intervals.last_before(p.where("id < 0"), m, ["key"]).collect() == []
    assert {r.mark for r in intervals.last_before(p, m.where("key = 77"), ["key"]).collect()} == {None}


PAGE = "# Top\n\nIntro. Alpha Beta: the first term is defined here well.\n\n##### Deep\n\n" + "Some words stand in this sentence [1] and $x+y$ too. " * 80 + "\n\nBIG TITLE\n=========\n\n- a b\n- c d\n\n```py\nx\n```\n\n" + "More alpha beta words here. " * 120 + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nThe tail is here and long enough."


def test_chunk_flags_against_a_look_up(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace("html", "<h([1-6])>", "\n## "), "<[^>]*>", "\n").alias("text"))
    docs = pages.unionByName(spark.createDataFrame([(-1, PAGE), (-2, PAGE * 3)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = {i: structure.spans(t) for i, t in texts.items()}
    got = chunking.with_flags(chunking.chunk_texts(docs), chunking.document_spans(docs)).collect()
    assert len(got) == chunking.chunk_texts(docs).count()
    for r in got:
        lo, hi = r.start_position, r.end_position
        mine = spans[r.doc_id]
        for kind in chunking.FLAGS:
            assert r[f"contains_{kind}"] == any(s["kind"] == kind and s["end"] >= lo and s["start"] <= hi for s in mine)
        assert r.contains_definition == any(s["kind"] == "definition" and s["text"].lower() in r.chunk_text.lower() for s in mine)
        heads = [s for s in mine if s["kind"] == "heading"]
        ahead = [s for s in heads if lo <= s["start"] <= max(hi, lo + 50)][:1]
        behind = [s for s in heads if s["start"] < lo][-1:]
        head = next((s for s in ahead + behind if s["level"] <= 4), None)
        assert (r.section_heading or r.subsection_heading) == (head and head["text"])
    assert any(r.contains_table for r in got) and any(r.section_heading for r in got)
