"""Learned sentence boundaries: examples, and the model against counts and formulas taken in plain Python."""

import math
from collections import Counter

import pytest

from tessera.operators import sentences as S
from tessera.session import table

MODEL = S.Boundaries(frozenset({"dr", "etc", "e.g", "approx"}), frozenset({"the", "he"}))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It rains. So it is.", ["It rains.", "So it is."]),
        ("Dr. Smith has 3.5 litres, e.g. of water. He drinks.", ["Dr. Smith has 3.5 litres, e.g. of water.", "He drinks."]),
        ("Apples, pears etc. The rest is gone.", ["Apples, pears etc.", "The rest is gone."]),
        ("J. S. Bach wrote it. Why? Because!", ["J. S. Bach wrote it.", "Why?", "Because!"]),
        ('He said "Stop." Then he left (at last.) It ends', ['He said "Stop."', "Then he left (at last.)", "It ends"]),
        ("On the 3. of May it began. 4. It ends", ["On the 3. of May it began.", "4.", "It ends"]),
        ("Well ... it goes on. See www.a.example for it.", ["Well ... it goes on.", "See www.a.example for it."]),
        ("  \n ", []),
        (None, []),
    ],
)
def test_split(text, want):
    assert [text[a:b] for a, b in MODEL.split(text)] == want


def plain(texts):
    """The same model by its definition: all tokens of all texts in one list."""
    texts = [[(t, S.token_type(t), S._END.search(t)) for t in (text or "").split()] for text in texts]
    every = [x for text in texts for x in text]
    stop = lambda end: bool(end) and end[1] == "."
    alone, stopped = Counter(k for _, k, e in every if not stop(e)), Counter(k for _, k, e in every if stop(e))
    chance, tokens = sum(stop(e) for _, _, e in every) / len(every), len(every)
    short = set()
    for kind, b in stopped.items():
        if any(c.isalpha() for c in kind):
            ratio = 2 * (b * math.log(0.99 / chance) + alone[kind] * math.log(0.01 / (1 - chance)))
            letters = len(kind.replace(".", ""))
            if ratio * math.exp(-letters) * (kind.count(".") + 1) * letters ** -float(alone[kind]) >= 0.3:
                short.add(kind)
    ends_one = lambda t, k, e: bool(e) and not (stop(e) and (k in short or S._INITIAL.match(t)))
    firsts = [b for text in texts for a, b in zip(text, text[1:], strict=False) if ends_one(*a)]
    behind, ends = Counter(k for _, k, _ in firsts), len(firsts)
    fit = lambda x, m, p: x * math.log(p) + (m - x) * math.log(1 - p) if 0 < p < 1 else 0.0
    begin = set()
    for kind, k in behind.items():
        n = alone[kind] + stopped[kind]
        if any(c.isalpha() for c in kind) and k / ends > (n - k) / (tokens - ends):
            if 2 * (fit(k, ends, k / ends) + fit(n - k, tokens - ends, (n - k) / (tokens - ends)) - fit(k, ends, n / tokens) - fit(n - k, tokens - ends, n / tokens)) >= 30:
                begin.add(kind)
    return short, begin


def test_model_against_its_definition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = S.learn(docs.repartition(3))
    short, begin = plain([r.text for r in docs.collect()])
    assert model.abbreviations == short and model.starters == begin


def test_abbreviations_are_learned(spark):
    rows = [(k, f"We saw Dr. Miller and {k} others near St. Mary today. The weather was fine. They met Dr. Jones at approx. {k}.5 metres, i.e. close. The end was good.") for k in range(200)]
    rows += [(300 + k, f"Close to it we had good and fine weather today, and she {k} went to see it.") for k in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = S.learn(docs)
    assert {"dr", "st", "i.e"} <= model.abbreviations and "the" in model.starters and not {"today", "fine", "good", "close"} & model.abbreviations and not {"miller", "mary", "jones"} & model.starters
    got = S.split(docs, model).where("doc_id = 7").orderBy("pos").collect()
    assert [r.sentence for r in got][:2] == ["We saw Dr. Miller and 7 others near St. Mary today.", "The weather was fine."]
    text = rows[7][1]
    assert all(text[r.start : r.end] == r.sentence for r in got) and len(got) == 4
    assert S.split(docs.where("doc_id >= 900"), model).collect() == []
    assert S.learn(docs.where("doc_id > 5000")) == S.Boundaries(frozenset(), frozenset())


def test_the_model_is_bounded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    whole, two = S.learn(docs), S.learn(docs, most=2)
    assert two.abbreviations <= whole.abbreviations and two.starters <= whole.starters and len(two.starters) <= 2


def test_texts_are_counted_once_for_each_model(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([("He met Dr. Low. The end is near. " * 20,)] * 3, "text string").mapInArrow(noted, "text string").where(F.col("text") != "")
    S.learn(docs)
    assert seen.value <= 6  # once for abbreviations, once for starters
