"""Scanners of document structure against the patterns that describe them, and their time on degenerate texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import structure
from tessera.functions import text as T

# fixed values: what the scanners find, as patterns that search again from every start
DESCRIBED = {
    "table": re.compile(r"(\|.+\|\n\|[-:| ]+\|\n(?:\|.+\|\n?)+)", re.M),
    "unordered": re.compile(r"((?:^[\s]*[-*•+]\s+.+\n?)+)", re.M),
    "ordered": re.compile(r"((?:^[\s]*\d+[.)\]]\s+.+\n?)+)", re.M),
    "fence": re.compile(r"```(\w+)?\n(.*?)\n```", re.M | re.S),
    "image": re.compile(r'!\[([^\]]*)\]\([^\)]+(?:\s+"([^"]+)")?\)', re.M),
}
PARTS = {
    "table": ["|", "|", "\n", "a", "-", ":", " ", "|a|", "|-|\n", "| x | y |\n", "|---|---|\n"],
    "unordered": ["- ", "-", "* ", "\n", "\n\n", " ", "\t", "a", "b c", "- x\n", "  + y\n"],
    "ordered": ["1. ", "2) ", "3", "]", "\n", " ", "a", "1. x\n", "\n\n"],
    "fence": ["```", "`", "\n", "py", "a", "```\n", "\n```", " "],
    "image": ["![", "]", "(", ")", "a", " ", '"', "!", "[", "](", "![x](y)"],
}


@pytest.mark.parametrize("kind", sorted(DESCRIBED))
def test_scanner(kind):
    rnd = random.Random(kind)
    for _ in range(6000):
        text = "".join(rnd.choice(PARTS[kind]) for _ in range(rnd.randrange(16)))
        want = [(m.span(), m.groups()) for m in DESCRIBED[kind].finditer(text)]
        assert [((h.start(), h.end()), h._groups) for h in structure._SCANNERS[kind](text)] == want, text


@pytest.mark.parametrize(
    "text",
    ["\n" * 1_000_000 + "x - y", "a```\n" * 200_000, "$" * 1_000_000, "|" * 1_000_000 + "\n", "![" * 300_000 + "]", "![](" * 250_000, "- \n" * 300_000, " \n" * 500_000 + "A: b", "#\n" * 500_000],
    ids=["newlines", "fences", "dollars", "bars", "brackets", "images", "dashes", "blanks", "marks"],
)
def test_time_is_linear(text):
    began = time.process_time()
    structure.spans(text)
    assert time.process_time() - began < 5


def test_ngrams_split_a_text_once(spark):
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(20_000)),)], "t string")
    began = time.time()
    assert df.select(F.size(T.ngrams(F.col("t"), 3))).first()[0] == 19_998
    assert time.time() - began < 10


def test_ascii_form_of_every_character(spark):
    """Alone and inside of a word, over all planes that have decompositions, against the library's own normal form."""
    import unicodedata

    from tessera.functions import paths

    letters = [chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]]
    rows = [(c, f"a{c}b{c}") for c in letters]
    got = spark.createDataFrame(rows, "c string, t string").repartition(4).select("c", "t", paths.ascii_form(F.col("c")).alias("x"), paths.ascii_form(F.col("t")).alias("y")).collect()
    plain = lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    assert len(got) == len(rows) and all((r.x, r.y) == (plain(r.c), plain(r.t)) for r in got)
