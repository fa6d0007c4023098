"""The exact fuzzy join against all pairs."""

import random

import pytest

from tessera.operators import evidence, fuzzy


def changed(rnd, text):
    letters = list(text)
    for _ in range(rnd.randrange(1, max(2, len(letters) // 5))):
        k, what = rnd.randrange(len(letters)), rnd.random()
        if what < 0.4 and len(letters) > 1:
            del letters[k]
        elif what < 0.7:
            letters.insert(k, rnd.choice("abcxyz é"))
        else:
            letters[k] = rnd.choice("etaoin")
    return "".join(letters)


@pytest.mark.parametrize("least", [0.5, 0.8495])
def test_all_pairs(least):
    rnd = random.Random(3)
    words = ["river", "rivers", "cold", "water", "north", "ünder", "日本", "1984", "a", "of", "carry"]
    claims = [" ".join(sorted(rnd.choice(words) for _ in range(rnd.randrange(1, 16)))) for _ in range(40)] + ["a", "ab", "x" * 200, ""]
    texts = [changed(rnd, c) if c else "" for c in claims for _ in range(8)] + claims + ["b a", "", "x" * 197]
    i, j, ratio = fuzzy.Claims(claims, least).match(texts, rows=50)
    got = {(a, b): round(r, 9) for a, b, r in zip(i.tolist(), j.tolist(), ratio.tolist(), strict=True)}
    want = {(a, b): round(r, 9) for a, t in enumerate(texts) for b, c in enumerate(claims) if t and c and (r := fuzzy.indel_ratio(c, t)) >= least}
    assert {k: v for k, v in got.items() if texts[k[0]] and claims[k[1]]} == want


def test_shared_and_own_passages(spark):
    claims = spark.createDataFrame([(1, 0, "cold rivers silver north carry water"), (2, 0, "Nothing like that at all here.")], "answer_id long, prop int, text string")
    rows = [(None, "p1", "It rains. Silver rivers carry cold water north. So it is.", 0.5), (None, "p2", None, 0.9), (2, "p3", "silver rivers carry cold water north", 0.9), (1, "p4", "Silver rivers carry cold waters north!", 0.9)]
    passages = spark.createDataFrame(rows, "answer_id long, passage_id string, text string, score double")
    got = {(r.answer_id, r.passage_id): r for r in evidence.quote_matches(claims, passages, threshold=0.8).collect()}
    assert set(got) == {(1, "p1"), (1, "p4")}
    first = got[1, "p1"]
    assert (first.matched_text, first.start_pos, first.end_pos, first.sentence_index) == ("Silver rivers carry cold water north.", 10, 47, 0)


def test_claims_in_blocks(spark):
    texts = [f"claim number {k} says word{k} thing{k % 7} over there" for k in range(25)]
    claims = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "answer_id long, prop int, text string")
    passages = spark.createDataFrame([(None, f"p{k}", f"{t}. Other words stand here.", 0.1) for k, t in enumerate(texts)], "answer_id long, passage_id string, text string, score double")
    whole = evidence.quote_matches(claims, passages, threshold=0.95).drop("rank").collect()
    parts = evidence.quote_matches(claims, passages, threshold=0.95, claim_block=4).drop("rank").collect()
    assert sorted(whole) == sorted(parts) and {(r.answer_id, r.passage_id) for r in whole} >= {(k, f"p{k}") for k in range(25)}
