"""Edge cases of single operators, with literal rows."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, profile, structure
from tessera.functions import text as T
from tessera.operators import analytics, chunking, evidence, fusion, lifecycle, retrieval
from tessera.operators.filters import DocumentList, NameSearch, RequestError, SearchFilters, SearchRequest, validate_messages, validate_vector


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    row = spark.createDataFrame([tuple(values.values()) or (1,)], schema)
    return row.select(column).first()[0]


# Text -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (T.normalize, " A\x01  b\tC\n", "a b c"),
        (T.word_count, "", 0),
        (T.word_count, "  a  b ", 2),
        (T.regex_word_count, "Hällo wörld x", 3),
        (T.ngrams, "a b c d", ["a b c", "b c d"]),
        (T.ngrams, "a b", ["a b"]),
        (T.ngrams, "", []),
        (T.strip_citations, "a [1] b [23]", "a b"),
        (T.sentences, "One. Two!  Three", ["One.", "Two!", "Three"]),
        (T.sentences, "", []),
        (T.is_heading, "INTRODUCTION", True),
        (T.is_heading, "Introduction", False),
        (T.is_heading, "IT ENDS.", False),
        (T.is_list_item, " 2) x", True),
        (T.is_list_item, "2x", False),
        (T.query_terms, "The the A of-x", ["the", "of"]),
        (T.content_hash, "A  b", "eeb5f9e3e4a8e14ab7a3a5a03d0d1c0c" if False else None),
        (T.normalize_path, "/docs/12/x/0b0e1c9a-1111-2222-3333-444455556666/y", "/docs/{id}/x/{id}/y"),
        (T.language_code, "German", "de"),
        (T.language_code, "pt-BR", "pt"),
        (T.language_code, "klingon", None),
        (T.has_control, "a\x02b", True),
        (T.has_control, "a\n\tb", False),
        (T.boolean_query, ' a "b"  c ', "a & b & c"),
        (T.html_escape, "<a href='x'>&", "&lt;a href=&#x27;x&#x27;&gt;&amp;"),
    ],
)
def test_text(spark, fn, text, want):
    if want is None and fn is T.content_hash:
        assert one(spark, fn(F.col("t")), t=text) == one(spark, fn(F.col("t")), t="a b")
        return
    got = one(spark, fn(F.col("t")), t=text)
    assert got == want


def test_overlap_and_occurrences(spark):
    assert one(spark, T.word_overlap(F.col("a"), F.col("b")), a="x y z", b="Y z w") == 0.5
    assert one(spark, T.word_overlap(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert one(spark, T.occurrences(F.col("a"), F.col("b")), a="banana anana", b="ana") == 2


def test_answer_propositions(spark):
    text = "Paris is the capital of France. Yes. " + "word " * 30 + "and " + "more " * 15 + "end."
    got = one(spark, T.answer_propositions(F.col("t")), t=text)
    assert got[0] == "Paris is the capital of France. Yes." and len(got) == 3
    assert one(spark, T.answer_propositions(F.col("t")), t="") == []


def test_truncate(spark):
    assert one(spark, T.truncate_at_sentence(F.col("t"), 12), t="One. Two three. Four.") == "One."
    assert one(spark, T.truncate_at_sentence(F.col("t"), 3), t="Longer.") == "Lon"
    assert one(spark, T.truncate_at_sentence(F.col("t"), 30), t="Short.") == "Short."


def test_snippets(spark):
    text = "x" * 150 + " Hit here " + "y" * 300
    got = one(spark, T.snippet_around(F.col("t"), F.array(F.lit("hit"))), t=text)
    assert got.startswith("...") and "**hit**" in got and got.endswith("...")
    assert one(spark, T.snippet_around(F.col("t"), F.array(F.lit("none"))), t="short text") == "short text"
    assert one(spark, T.clean_snippet(F.col("t")), t="a <b>b</b>  c") == "a **b** c"


def test_variations(spark):
    assert one(spark, T.variations(F.col("t"), 2), t="Here:\n1. first one\n2) second\n- third\nx") == ["first one", "second"]


# Profile and paths ------------------------------------------------------------------------


def test_profile(spark):
    en = "the and is to a in that have i it " * 5
    es = "el la de que y en un se las los por " * 5
    assert one(spark, profile.language_vote(F.col("t")), t=en) == "en"
    assert one(spark, profile.language_vote(F.col("t")), t="short") is None
    assert one(spark, profile.language_vote(F.col("t")), t=es) == "es"
    assert one(spark, profile.fallback_quality(F.col("t")), t="") == 0.0
    assert one(spark, profile.title(F.col("t"), F.col("f")), t="import x\nA fine title\n", f="a_b-c.txt") == "A fine title"
    assert one(spark, profile.title(F.col("t"), F.col("f")), t="", f="a_b-c.txt") == "a b c"
    assert one(spark, profile.document_type(F.col("f"), F.lit("text/plain"), F.col("t")), f="x.txt", t="Dear Sir, yes") == "email"
    assert one(spark, profile.has_table(F.col("t"), F.lit("text/plain")), t="a,b,c\n" * 5) is True
    assert one(spark, profile.has_table(F.col("t"), F.lit("text/plain")), t="a b\n" * 5) is False
    assert one(spark, profile.band(F.lit(0.7))) == "high" and one(spark, profile.band(F.lit(0.1))) == "poor"
    merged = one(spark, profile.merge_json(F.col("a"), F.col("b")), a='{"x":"1","y":"2"}', b='{"y":"3"}')
    assert merged == '{"x":"1","y":"3"}'


def test_paths(spark):
    assert one(spark, paths.sanitize(F.col("n")), n="../../Ünï côdé..file (1).pdf") == "Uni_code.file_1_.pdf"
    assert one(spark, paths.sanitize(F.col("n")), n="...") == "unnamed"
    assert one(spark, paths.is_safe(F.col("p")), p="a/b.txt") is True
    for bad in ("/a", "a/../b", "a//b", ""):
        assert one(spark, paths.is_safe(F.col("p")), p=bad) is False
    u = "0b0e1c9a-1111-2222-3333-444455556666"
    assert one(spark, paths.is_document_path(F.col("p")), p=f"{u}/2024/02/{u}/f.txt") is True
    assert one(spark, paths.is_document_path(F.col("p")), p=f"{u}/1999/02/{u}/f.txt") is False
    assert one(spark, paths.is_document_path(F.col("p")), p=f"{u}/2024/xx/{u}/f.txt") in (False, None)
    assert one(spark, paths.versioned_path(F.col("p"), F.lit(3)), p="w/d/f.txt") == "w/d/v3/f.txt"
    assert one(spark, paths.numbered(F.col("n"), F.lit(2)), n="a.tar") == "a_2.tar"


# Structure and chunks -----------------------------------------------------------------------

MARKDOWN = """# Title

First paragraph with a citation (Smith, 2020) and [1] and a note[^1].

## Part

| a | b |
|---|---|
| 1 | 2 |

- item one
- item two

```py
x = 1
```

![alt](u.png) Figure 2: A caption
$$e = mc^2$$

with $x$ in line

Term: its meaning

[^1]: the note
"""


def test_structure():
    kinds = {}
    for s in structure.spans(MARKDOWN):
        kinds.setdefault(s["kind"], []).append(s)
    assert [(h["text"], h["level"], h["parent"]) for h in kinds["heading"]] == [("Title", 1, None), ("Part", 2, 0)]
    assert kinds["table"][0]["text"] == "a | b" and kinds["table"][0]["level"] == 1
    assert kinds["code"][0]["detail"] == "py" and kinds["list"][0]["level"] == 2
    assert {e["detail"] for e in kinds["equation"]} == {"display", "inline"}
    assert len(kinds["citation"]) == 2 and kinds["footnote"][0]["text"] == "the note"
    assert len(kinds["figure"]) == 2 and any(d["text"] == "Term" for d in kinds["definition"])
    for s in structure.spans(MARKDOWN):
        assert 0 <= s["start"] <= s["end"] <= len(MARKDOWN)
    assert structure.spans("") == [] and structure.spans(None) == []


def test_fold():
    assert chunking.fold([], []) == []
    assert chunking.fold([10], [False]) == [(0, 1)]
    assert chunking.fold([512, 40], [False, False]) == [(0, 1), (1, 2)]
    assert chunking.fold([512, 40], [True, False]) == [(0, 2), (1, 2)]
    assert chunking.fold([500, 200], [False, False]) == [(0, 1), (1, 2)]
    parts = chunking.fold([30] * 40, [False] * 40)
    assert parts[0][0] == 0 and parts[-1][1] == 40
    assert all(b > a and 30 * (b - a) <= 600 for a, b in parts)
    assert all(n[0] == p[1] - 1 for p, n in zip(parts, parts[1:], strict=False))  # one sentence of 30 tokens is carried


def test_chunks(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, "x" * 49), (3, None), (4, "Word " * 2000)], "doc_id long, text string")
    got = chunking.with_flags(chunking.chunk_texts(df), chunking.document_spans(df)).collect()
    assert {r.doc_id for r in got} == {1, 4}
    first = next(r for r in got if r.doc_id == 1)
    assert first.contains_table and first.contains_code and first.chunk_type == "code" and first.section_heading == "Title"
    plain = next(r for r in got if r.doc_id == 4)
    assert plain.chunk_type == "paragraph" and plain.section_heading is None and plain.semantic_density == 1.0


# Requests -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "make",
    [
        lambda: DocumentList(page=0),
        lambda: DocumentList(page_size=101),
        lambda: DocumentList(sort_by="text"),
        lambda: DocumentList(status="gone"),
        lambda: DocumentList(min_size=2, max_size=1),
        lambda: NameSearch("ab"),
        lambda: NameSearch("abc", ("text",)),
        lambda: SearchFilters(mime_types=("image/png",)),
        lambda: SearchFilters(created_after=datetime(2024, 2, 1), created_before=datetime(2024, 1, 1)),
        lambda: SearchRequest(query=" "),
        lambda: SearchRequest(query="<script>x"),
        lambda: SearchRequest(query="q", keyword_weight=0, vector_weight=0),
        lambda: SearchRequest(query="q", rerank=True, rerank_top_k=200),
        lambda: SearchRequest(query="q", strategy="keyword", rerank=True),
        lambda: SearchRequest(query="q", semantic_dedup_threshold=0.5),
        lambda: validate_vector([1.0, math.nan], 2),
        lambda: validate_vector([1.0], 2),
    ],
)
def test_requests_are_checked(make):
    with pytest.raises(RequestError):
        make()


def test_messages(spark):
    df = spark.createDataFrame([(1, "user", "x"), (1, "robot", "x"), (2, "user", " ")], "conv_id long, role string, text string")
    assert {r.conv_id: r.bad_turns for r in validate_messages(df).collect()} == {1: 1, 2: 1}


# Fusion ---------------------------------------------------------------------------------

HITS = "query_id int, doc_id long, chunk_index int, score double, rank int"


def hits(spark, rows, schema=HITS):
    return spark.createDataFrame(rows, schema)


def test_rrf(spark):
    a = hits(spark, [(1, 1, 0, 0.9, 1), (1, 2, None, 0.8, 2), (1, 1, 0, 0.7, 3)])
    b = hits(spark, [(1, 2, 0, 0.9, 1)])
    got = {r.key: r for r in fusion.rrf(a, b).collect()}
    assert got["1_0"].keyword_rank == 3 and got["2_0"].vector_rank == 1
    assert got["2_0"].score == 1.0 and got["2_0"].rank == 1
    assert fusion.rrf(a.where("false"), b.where("false")).collect() == []


def test_multi_query(spark):
    rows = [(1, 1, 5, 0, 1), (1, 2, 5, 0, 9), (1, 1, 6, 0, 2), (1, 2, 7, 0, 1)]
    got = fusion.multi_query(hits(spark, rows, "group_id int, query_id int, doc_id long, chunk_index int, rank int")).orderBy("rank").collect()
    assert [(r.doc_id, r.frequency) for r in got] == [(5, 2), (7, 1), (6, 1)] and got[0].score == 1.0


def test_dedup(spark):
    got = fusion.dedup_key(hits(spark, [(1, 1, 0, 0.9, 1), (1, 1, 0, 0.95, 4), (1, 2, 0, 0.5, 2)])).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.rank) for r in got] == [(1, 0.95, 1), (2, 0.5, 2)]
    named = hits(spark, [(1, 1, 0, "A  b", "n", 1), (1, 2, 0, "a B", "n", 2), (1, 3, 0, None, "n", 3)], "query_id int, doc_id long, chunk_index int, snippet string, name string, rank int")
    assert sorted(r.doc_id for r in fusion.dedup_content(named).collect()) == [1, 3]


def test_mmr_and_diversity(spark):
    schema = HITS + ", embedding array<float>"
    near, far = [1.0, 0.0], [0.0, 1.0]
    df = hits(spark, [(1, 1, 0, 0.9, 1, near), (1, 2, 0, 0.89, 2, near), (1, 3, 0, 0.5, 3, far)], schema)
    assert [r.doc_id for r in fusion.mmr(df, top_k=2).orderBy("rank").collect()] == [1, 3]
    assert [r.doc_id for r in fusion.mmr(df, top_k=2, trade=1.0).orderBy("rank").collect()] == [1, 2]
    assert [r.doc_id for r in fusion.mmr(df, top_k=3).orderBy("rank").collect()] == [1, 2, 3]
    assert fusion.diversity(df).first().diversity == pytest.approx(1 - 1 / 3, abs=1e-6)
    assert fusion.diversity(df.where("doc_id = 1")).first().diversity == 1.0
    assert sorted(r.doc_id for r in fusion.dedup_semantic(df).collect()) == [1, 3]
    lost = hits(spark, [(1, 1, 0, 0.9, 1, None), (1, 2, 0, 0.8, 2, near), (1, 3, 0, 0.7, 3, near)], schema)
    assert sorted(r.doc_id for r in fusion.dedup_semantic(lost).collect()) == [1, 2]
    assert fusion.diversity(lost).first().diversity == 0.5
    assert len(fusion.mmr(lost, top_k=2).collect()) == 2


def test_sigmoid(spark):
    assert one(spark, fusion.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, fusion.sigmoid(F.lit(math.nan))) == 0.5 and one(spark, fusion.sigmoid(F.lit(math.inf))) == 0.5


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<float>")
    exact = [(r.vec_id, r.similarity) for r in retrieval.knn(q, v).orderBy("rank").collect()]
    assert exact == [(1, 1.0), (4, 1.0), (3, -1.0)]
    assert [(r.vec_id, r.similarity) for r in retrieval.knn_batch(q, v).orderBy("rank").collect()] == exact
    assert [r.vec_id for r in retrieval.knn(q, v, threshold=0.5).orderBy("rank").collect()] == [1, 4]
    bad = spark.createDataFrame([(1, [1.0, math.nan]), (2, [1.0]), (3, [1.0, 2.0]), (4, [math.inf, 1.0])], "vec_id long, embedding array<double>")
    assert [r[0] for r in bad.where(retrieval.invalid_vector(F.col("embedding"), 2)).select("vec_id").orderBy("vec_id").collect()] == [1, 2, 4]


def test_ivf_recall(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assigned, centers = retrieval.ivf_assign(v, lists=8)
    near = {(r.query_id, r.vec_id) for r in retrieval.knn_ivf(q, assigned, centers, probes=6).collect()}
    want = {(r.query_id, r.vec_id) for r in retrieval.knn_batch(q, v).collect()}
    assert len(near & want) >= 0.85 * len(want)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_ivf_recall(spark, sf_dir, size):
    from tessera.plans import search

    at = f"{sf_dir}/../{size}"
    v = spark.read.parquet(f"{at}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = {(r.query_id, r.vec_id) for r in search.QUERIES["knn_ivf"](spark, at).collect()}
    want = {(r.query_id, r.vec_id) for r in retrieval.knn_batch(q, v).collect()}
    assert {i for i, _ in near} == {r.query_id for r in q.collect()}
    assert len(near & want) >= 0.9 * len(want)


def test_ivf_reading_all_lists_is_exact(spark, sf_dir, monkeypatch):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    assigned, centers = retrieval.ivf_assign(v)
    found = lambda probes: {(r.query_id, r.vec_id, r.rank) for r in retrieval.knn_ivf(q, assigned, centers, probes=probes).collect()}
    assert found(16) == {(r.query_id, r.vec_id, r.rank) for r in retrieval.knn(q, v).collect()}
    by_product = found(4)
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    assert found(4) == by_product


def test_texts_of_one_opening_are_not_copies(spark, tmp_path):
    from tessera.plans import extras, search

    opening = "This line of a licence stands over many documents. " * 4
    texts = {1: opening + "the one", 2: opening + "of the other", 3: opening + "the one", 4: "something else"}
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i == k) + 0.1 for k in range(5)]) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for query in (extras.QUERIES["dedup_full"], search.QUERIES["rerank_pipeline"]):
        got = {}
        for r in query(spark, str(tmp_path)).collect():
            got.setdefault(r.query_id, set()).add(r.doc_id)
        assert got and all(len(g) == 3 and {2, 4} < g for g in got.values())


def test_bm25_grows_with_frequency(spark):
    c = spark.createDataFrame([(1, 0, "cat dog bird fish"), (2, 0, "cat cat bird fish"), (3, 0, "party cart x y"), (4, 0, "")], "doc_id long, chunk_index int, chunk_text string")
    q = spark.createDataFrame([(1, "cat"), (2, "art"), (3, ""), (4, "zebra")], "query_id int, text string")
    got = [(r.query_id, r.doc_id, r.score) for r in retrieval.bm25(q, c).orderBy("query_id", "rank").collect()]
    assert [g[:2] for g in got] == [(1, 2), (1, 1)] and got[0][2] == 1.0


# Evidence -------------------------------------------------------------------------------


def test_ratios():
    assert evidence.indel_ratio("", "") == 1.0 and evidence.indel_ratio("a", "") == 0.0
    assert evidence.indel_ratio("abcd", "abxd") == pytest.approx(0.75)
    assert evidence.token_sort_ratio("b a", "a b") == 1.0
    assert evidence.token_set_ratio("a b c", "a b") == 1.0

    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(1, 90))) for _ in range(2))
        assert evidence.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)))


def test_quotes(spark):
    claims = spark.createDataFrame([(1, 0, "Paris is the capital of France.")], "answer_id int, prop int, text string")
    passages = spark.createDataFrame([(1, "p1", "It rains. Paris is the capital of France. Berlin is far.", 0.9), (1, "p2", None, 0.1), (2, "p3", "Paris is the capital of France.", 0.9)], "answer_id int, passage_id string, text string, score double")
    (m,) = evidence.quote_matches(claims, passages).collect()
    assert (m.passage_id, m.similarity, m.start_pos, m.sentence_index) == ("p1", 1.0, 10, 0)


def test_abstention(spark):
    rows = [(1, 0.9, 0.1, 3, "verified"), (2, 0.1, 0.9, 0, "failed"), (3, 0.2, 0.1, 1, "verified")]
    got = {r.answer_id: r for r in evidence.abstention(spark.createDataFrame(rows, "answer_id int, verified_confidence double, probability double, n_quotes int, status string")).collect()}
    assert not got[1].should_abstain and got[1].abstention_confidence == 0.0
    assert got[2].reason == "verification_failed" and got[2].abstention_confidence == 1.0
    assert got[3].factors == ["low_confidence"] and got[3].abstention_confidence == 0.6


@pytest.mark.parametrize(("answer", "want"), [(None, 0.5), ("Yes.", 1.0), ("It is incorrect", 0.0), ("no", 0.0), ("I know a little", 0.0), ("unclear", 0.5)])
def test_agreement(spark, answer, want):
    assert one(spark, evidence.agreement(F.lit("red green blue"), F.col("a")), a=answer) == want


def test_profiles():
    assert evidence.profile("medium")["quote_threshold"] == 0.75
    assert evidence.profile("nonsense")["level"] == "HIGH"


def test_highlight(spark):
    assert one(spark, evidence.highlight(F.col("t"), F.col("p")), t="a <Cap> b", p="<cap>") == "a <mark>&lt;Cap&gt;</mark> b"
    assert one(spark, evidence.highlight(F.col("t"), F.col("p")), t="abc", p="x") == "abc"


# Lifecycle ------------------------------------------------------------------------------


def test_transitions(spark):
    rows = [(1, "s", "in_progress", 1, 1), (1, "s", "completed", 2, 2), (1, "s", "in_progress", 3, 3), (2, "s", "completed", 1, 4)]
    df = spark.createDataFrame(rows, "doc_id int, stage string, status string, at int, event_id int")
    assert sorted(r.event_id for r in lifecycle.transition_violations(df).collect()) == [3, 4]


def test_breaker(spark):
    rows = [("a", float(k), False) for k in range(5)] + [("a", 10.0, True), ("a", 40.0, True), ("a", 41.0, True), ("a", 42.0, True)]
    got = lifecycle.breaker(spark.createDataFrame(rows, "store string, at double, ok boolean")).orderBy("at").collect()
    assert [r.state for r in got] == ["CLOSED"] * 4 + ["OPEN", "OPEN", "HALF_OPEN", "HALF_OPEN", "CLOSED"]
    assert [r.allowed for r in got][5] is False


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert {r.n for r in analytics.histogram(df, "v", (1.0, 2.0)).collect()} <= {0}


def test_overlaps_leaves_out_sizes_that_cannot_fit(spark):
    from tessera.operators import analytics

    texts = {1: "a b c", 2: "a b c d e f g h i j", 3: " ".join(f"w{k}" for k in range(40)) + " a b c", 4: "", 5: None, 6: "A  b"}
    left = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    right = spark.createDataFrame([(1, "c b a"), (2, ""), (3, "a b")], "item_id long, text string")
    found = analytics.overlaps(left, right, "doc_id", "item_id", least=0.3)
    assert {(r.doc_id, r.item_id): r.overlap for r in found.collect()} == {(1, 1): 1.0, (1, 3): 0.666667, (2, 1): 0.3, (6, 1): 0.666667, (6, 3): 1.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join Inner" in x and "n_doc_id" in x and "n_item_id" in x]
