import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import crf, decontam, jaccard, langid
from tessera.llm.common import held_out


def brute_classes(rows, n=5, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def got_classes(df, **o):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, **o).collect()}


def near_copies(count=40, words=60):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(count):
        t = list(base)
        for _ in range(i % 5):
            t[rng.integers(words)] = f"x{i}"
        out.append((100 + i, " ".join(t)))
    return out


def test_jaccard_awkward_rows(rows):
    df = rows(near_copies())
    assert got_classes(df) == brute_classes([(r.doc_id, r.text) for r in df.collect()])
    assert df.count() == jaccard.join(df).count()


@pytest.mark.parametrize("options", [{"hot_share": 0.0, "hot_least": 1}, {"fragment_shingles": 50, "slice_bytes": 500}, {"rounds": 1, "pivots": 1}, {"rounds": 1, "pivots": 1, "hot_share": 0.1, "hot_least": 2, "fragment_shingles": 100, "slice_bytes": 3000}])
def test_jaccard_any_setting_is_exact(spark, options):
    passage = " ".join(f"shared{k}" for k in range(55))
    data = near_copies() + [(i, f"{passage} " + " ".join(f"own{i}_{k}" for k in range(i % 25))) for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got_classes(df, **options) == brute_classes(data)


def test_jaccard_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got_classes(df) == brute_classes([(r.doc_id, r.text) for r in df.collect()])


def test_jaccard_empty(empty):
    assert jaccard.join(empty).collect() == []


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (3, "")], "doc_id long, text string")
    for rows in (1_000_000, 0):
        assert sorted(r.doc_id for r in jaccard.keep_one(df, jaccard.join(df), broadcast_rows=rows).collect()) == [1, 3]


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = crf.train(docs, labels)
    got = crf.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_awkward_rows(rows, empty, labelled):
    model = crf.fit(["fine words here.", "BAD!! BAD!! BAD!! BAD!!"] * 10, [1, 0] * 10)
    df = rows()
    got = crf.score(df, model, keep=("lang",)).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7}
    assert crf.score(empty, model).collect() == []
    lines = crf.label_lines(df, model).where("doc_id = 3").orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [0, 1]
    nothing = crf.train(df, labelled[1].where("false"))
    assert crf.score(df, nothing).select("score").distinct().collect()[0][0] == 0.5


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 3])
    starts = np.array([0, 1, 5])
    scores, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    good, pairs = crf.marginals(scores, starts, lengths, trans)
    want, want_pairs = [], np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        total, mass, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(scores[s + k, y[k]] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            mass += w * np.array(y)
            for k in range(n - 1):
                both[y[k], y[k + 1]] += w
        want.extend(mass / total)
        want_pairs += both / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_language_held_out(labelled):
    docs, _ = labelled
    model = langid.train(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.97
    assert np.mean([r.rejected for r in got]) <= 0.02


def test_language_awkward_rows(spark, rows, empty):
    model = langid.fit(["the cat and the dog sat here", "der hund und die katze waren da"] * 20, ["en", "de"] * 20, buckets=1 << 12)
    got = {r.doc_id: r for r in langid.predict(rows([(8, "12 34 !!")]), model, keep=("source",)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 8}
    assert all(r.rejected and r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert got[4].lang_pred in ("en", "de") and 0 < got[4].score <= 1
    assert langid.predict(empty, model).collect() == []
    none = langid.fit([], [])
    assert none.predict(["some text"])[0] == ["und"]


def test_language_long_text_is_read_whole():
    model = langid.fit(["the cat and the dog sat here", "der hund und die katze waren da"] * 20, ["en", "de"] * 20, buckets=1 << 12)
    text = "the cat " * 100 + "der hund und die katze waren da " * 3000
    assert model.predict([text])[0] == ["de"]
    assert np.allclose(model.scores([text], slice_bytes=1000), model.scores([text]), atol=0.02)


ITEMS = [
    (1, "A train leaves Paris at 7 km per hour and later meets 12 other trains that came from the northern station before noon."),
    (2, "The committee of Berlin counted 40 apples and 40 pears, then gave the apples to children living near the river bank."),
    (3, "short one"),
    (4, None),
]


def found(spark, docs, **o):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.find(d, b, **o).collect()}


DOCS = [
    (1, "Some words come first. " + ITEMS[0][1] + " And some more words follow here."),
    (2, "intro. " + ITEMS[1][1].lower()),
    (3, "x. " + ITEMS[1][1].replace("40", "55")),
    (4, "x. " + ITEMS[1][1].replace("40 apples", "55 apples")),
    (5, "Nothing of it is in here, only other words that nobody has asked for in any of the questions."),
    (6, None),
    (7, ""),
    (1, "Some words come first. " + ITEMS[0][1]),
    (8, "The committee of Berlin counted 40 apples and left."),
    (9, "short one"),
]


def test_decontamination(spark):
    got = found(spark, DOCS)
    assert set(got) == {(1, 1), (2, 2), (3, 2)}
    assert got[(3, 2)].reparameterised and got[(3, 2)].consistency == 1.0
    assert not got[(1, 1)].reparameterised and got[(1, 1)].coverage == 1.0
    strict = found(spark, DOCS, consistency=1.0)
    assert (4, 2) not in strict and (3, 2) in strict


def test_decontamination_by_shuffle_is_the_same(spark):
    assert set(found(spark, DOCS)) == set(found(spark, DOCS, broadcast_windows=0))


def pairs(spark, docs, items, **o):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.find(d, b, **o).collect()}


def test_decontamination_judges_each_occurrence(spark):
    sheet = "A farmer sells {} apples and {} pears at the market before he walks home to his family again."
    own = "What is the value of x when y is 3? What is the value of x when y is 7?"
    items = [(1, sheet.format(12, 30)), (2, sheet.format(9, 41)), (3, own)]
    filler = "and then other words that nobody has asked for come here. " * 3
    docs = [
        (1, filler + items[0][1] + " " + filler + sheet.format(5, 8) + " " + sheet.format(6, 6)),
        (2, items[0][1] + " " + items[1][1]),
        (3, filler + own + " " + filler),
        (4, "Intro. " + sheet.format(12, 30).replace("at the market", "at the very old market") + " " + sheet.format(4, 4)),
        (5, filler * 400 + items[1][1] + " " + filler * 400),
    ]
    for broadcast in (500_000, 0):
        got = pairs(spark, docs, items, broadcast_windows=broadcast)
        assert {(1, 1), (2, 1), (2, 2), (3, 3), (4, 1), (5, 2)} <= set(got)
        assert all(got[k].coverage == 1.0 and got[k].consistency == 1.0 and not got[k].reparameterised for k in ((1, 1), (2, 1), (2, 2), (3, 3), (5, 2)))


def test_decontamination_finds_items_of_numbers_and_names(spark):
    items = [
        (1, "12 + 7 = 19, 8 + 5 = 13, 40 + 2 = 42"),
        (2, "Anna Berg Carl Dahl Eva Falk Gustav Holm Ida Jansson"),
        (3, "The Quick Brown Fox Jumps Over The Lazy Dog"),
        (4, "what is it called"),
    ]
    docs = [(k, f"some words before it, then {t} and some words after it") for k, t in items] + [(5, "sums: 11 + 8 = 19, 7 + 6 = 13, 39 + 3 = 42 and Olaf Berg"), (6, items[2][1].lower())]
    for broadcast in (500_000, 0):
        assert set(pairs(spark, docs, items, broadcast_windows=broadcast)) == {(1, 1), (2, 2), (3, 3), (6, 3)}
    assert (4, 4) in pairs(spark, docs, items, short_words=4)


def test_decontamination_with_every_tenth_word_changed(spark):
    items = [(n, " ".join(f"i{chr(97 + n % 26)}{'xyz'[n // 26]}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))) for n in range(12, 75)]
    docs = []
    for n, text in items:
        for shift in range(10):
            w = text.split()
            w[shift::10] = ["changed"] * len(w[shift::10])
            if 10 * w.count("changed") <= n:
                docs.append((100 * n + shift, "before it " + " ".join(w) + " after it"))
    assert {d for d, _ in pairs(spark, docs, items)} == {d for d, _ in docs}


def test_decontamination_empty(spark, empty):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find(empty, b).collect() == []
    assert decontam.find(spark.createDataFrame(DOCS, "doc_id long, text string"), b.where("false")).collect() == []


def test_decontamination_finds_verbatim_passages(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()}
    items = bench.collect()
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text and len(b.text.split()) >= decontam.SHORT}
    assert want <= got


def test_held_out(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", held_out(F.col("id"))).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(50)}
    assert collections.Counter(got.values())[True] > 5
