import pytest


@pytest.fixture()
def rows(spark):
    """A table with awkward rows: null, empty, blank, repeated and very long texts, and a clashing extra column."""

    def make(extra=()):
        long = " ".join(f"w{k % 977} tail" for k in range(30_000))
        data = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, long), (7, "Ünïcode wörds – 日本語 text\u00a0here"), *extra]
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, score double")

    return make


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
