"""The stored full-text index against scans in plain Python, its stems, ranks and fragments."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import stem as S
from tessera.operators import fulltext
from tessera.plans import search
from tessera.plans import views as V

# fixed values: words and stems of the published vocabulary
STEMS = {
    "consigned": "consign", "consistency": "consist", "consistently": "consist", "consolatory": "consolatori", "knackeries": "knackeri", "knaves": "knave", "generally": "general", "communication": "communic",
    "hopping": "hop", "hoping": "hope", "flies": "fli", "dies": "die", "agreed": "agre", "relational": "relat", "happily": "happili", "happy": "happi", "enjoy": "enjoy", "cries": "cri", "by": "by", "say": "say",
    "probate": "probat", "rate": "rate", "roll": "roll", "gas": "gas", "this": "this", "geology": "geolog", "skies": "sky", "succeeding": "succeed", "decisiveness": "decis", "hopefulness": "hope", "university": "univers",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stem(word):
    assert S.stem(word) == STEMS[word]


def test_stop_words_and_other_scripts():
    stems = S.Stems(most=2)
    assert [stems[w] for w in ("the", "rivers", "日本語", "über")] == [None, "river", "日本語", "über"] and len(stems) <= 2


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def scanned(queries, chunks, language):
    """All hits of a scan: every chunk against every query."""
    stems = S.Stems() if language else S.Plain()
    held = []
    for c in chunks:
        places = collections.defaultdict(list)
        for k, w in enumerate(words(c.chunk_text), 1):
            if stems[w] is not None:
                places[stems[w]].append(k)
        held.append(((c.doc_id, c.chunk_index), places))
    out = {}
    for q in queries:
        terms = [*dict.fromkeys(t for w in words(q.text) if (t := stems[w]) is not None)]
        for key, places in held:
            if terms and all(t in places for t in terms):
                out[q.query_id, *key] = fulltext.rank_of([places[t] for t in terms])
    return out


@pytest.mark.parametrize("language", ["english", None])
def test_index_against_a_scan(spark, sf_dir, tmp_path, language):
    chunks = V.chunks(spark, sf_dir, False)
    questions = search._questions(spark, sf_dir)
    index = fulltext.FullTextIndex.build(chunks, f"{tmp_path}/index", language=language, bucket_rows=20_000)
    want = scanned(questions.collect(), chunks.collect(), language)
    got = {(r.query_id, r.doc_id, r.chunk_index): r.raw for r in index.matches(questions).collect()}
    assert want and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
    counts = collections.Counter(k[0] for k in want)
    assert {r.query_id: r.matches for r in index.count(questions).collect()} == dict(counts)
    page = index.search(questions, limit=3).collect()
    for r in page:
        better = sum((-round(v, 9), k[1:]) < (-round(want[r.query_id, r.doc_id, r.chunk_index], 9), (r.doc_id, r.chunk_index)) for k, v in want.items() if k[0] == r.query_id)
        assert better == r["rank"] - 1 or abs(r.raw - want[r.query_id, r.doc_id, r.chunk_index]) < 2e-9
    assert len(page) == sum(min(3, n) for n in counts.values())


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    chunks = spark.createDataFrame([(k, 0, f"word{k} river cold word{k + 1}") for k in range(200)], "doc_id long, chunk_index int, chunk_text string")
    index = fulltext.FullTextIndex.build(chunks, f"{tmp_path}/i", bucket_rows=50)
    assert index.buckets == 16
    found = index.postings(["word7"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert len(found.select(F.input_file_name()).distinct().collect()) < index.postings().select(F.input_file_name()).distinct().count()
    assert {r.doc_id for r in found.collect()} == {6, 7}
    # a term of all chunks is spread over files
    assert index.postings(["river"]).select(F.input_file_name()).distinct().count() > 4


def test_defined_cases(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, None), (2, 0, ""), (3, 0, "The rivers ran"), (3, 0, "The rivers ran"), (4, 1, "a river runs, a river")], "doc_id long, chunk_index int, chunk_text string")
    index = fulltext.FullTextIndex.build(chunks, f"{tmp_path}/i")
    queries = spark.createDataFrame([(1, "River"), (2, "the of"), (3, ""), (4, None), (5, "zebra river"), (6, "ran rivers")], "query_id int, text string")
    got = {(r.query_id, r.doc_id) for r in index.search(queries, snippets=True).collect()}
    assert got >= {(1, 3), (1, 4), (6, 3)} and {q for q, _ in got} == {1, 6}
    assert index.search(queries.where("query_id = 2")).collect() == []
    empty = fulltext.FullTextIndex.build(chunks.where("doc_id < 0"), f"{tmp_path}/e")
    assert empty.search(queries).collect() == []


@pytest.mark.parametrize(
    ("terms", "wanted", "most", "shown"),
    [
        ("x x x x x x", "a", 4, (0, 3)),
        ("a x x b x x x x a b", "a b", 4, (6, 10)),
        ("a x x x x x b", "a b", 4, (0, 4)),
        ("x x x x x a x x x x x", "a", 5, (3, 8)),
        ("a b", "a b", 5, (0, 2)),
    ],
)
def test_best_fragment(terms, wanted, most, shown):
    assert fulltext.best_fragment(terms.split(), set(wanted.split()), most, 3) == shown


def test_fragment_holds_the_most_terms(spark, sf_dir):
    for r in search.QUERIES["fulltext_search"](spark, sf_dir).limit(50).collect():
        assert "**" in r.snippet and len(r.snippet.split()) <= 120


def test_files_grow_with_the_size_and_chunks_are_gathered_once(spark, tmp_path):
    chunks = spark.createDataFrame([(k, 0, f"word{k} river cold word{k + 1}") for k in range(200)], "doc_id long, chunk_index int, chunk_text string")
    index = fulltext.FullTextIndex.build(chunks, f"{tmp_path}/i", bucket_rows=5)
    assert index.buckets <= fulltext.MOST_BUCKETS  # as many buckets as files would make their square
    queries = spark.createDataFrame([(q, "cold river") for q in range(30)], "query_id int, text string")
    found = index.matches(queries)
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30 * 200


def test_words_of_a_block(spark):
    chunks = spark.createDataFrame([(1, 0, "..The END, the_end!"), (2, 0, None), (3, 0, "¿Él é1 él?"), (1, 0, "end")], "doc_id long, chunk_index int, chunk_text string").coalesce(1)
    got = {r.term: (r.doc_id, r.chunk_index, r.places) for r in fulltext.postings(chunks, language=None, block=3).where("term <> 'end'").collect()}
    assert got == {"the": ([1], [0], [[1]]), "the_end": ([1], [0], [[3]]), "él": ([3], [0], [[1, 3]]), "é1": ([3], [0], [[2]])}
