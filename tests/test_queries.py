"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import documents, extras, search, stores, texts

QUERIES = documents.QUERIES | texts.QUERIES | search.QUERIES | extras.QUERIES | stores.QUERIES
SQL = documents.SQL | texts.SQL | search.SQL | extras.SQL | stores.SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows(df, columns):
    return sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_names_match():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_judged_queries_on_other_letters(spark, tmp_path):
    texts = ["que noñado está", "señor no más", "está noé", "ñno", " no ", "   ", "İncorrect", "plain text", "", None]
    talk = pd.DataFrame([(i, t, "assistant", texts[(i * 3 + t * 7) % len(texts)]) for i in range(150) for t in range(2)], columns=["conv_id", "turn", "role", "text"])
    talk.to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    for name in ("proposition_confidence", "confidence_breakdown", "proposition_details", "hallucination_score", "profile_sweep"):
        got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
        columns = sorted(want.columns)
        assert rows(got, columns) == rows(want, columns), name


@pytest.mark.parametrize("text", ["la ñcause", "causeñ la", "la cause est"])
def test_question_by_ascii_words(spark, text):
    from pyspark.sql import functions as F

    from tessera.operators import evidence

    got = spark.createDataFrame([(text,)], "t string").select(evidence.question(F.col("t"))).first()[0]
    assert got.startswith("Do the sources name this cause: ")


@pytest.mark.parametrize("name", ["fallback_quality", "fallback_metadata"])
def test_words_are_taken_once(spark, sf_dir, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(") == 1


def test_fallback_of_edge_texts(spark, tmp_path):
    texts = [None, "", " ", "A b. C d! " * 20, "x,y\n" * 30 + "z", "\n" * 30, "Él está. " * 40, "ÄÖÜ", "a|b|c\n" * 4 + "\n\n\n"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "web", "n_chars": [len(t or "") for t in texts]})
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet' WHERE text <> ''")
    for name in ("fallback_quality", "table_detect", "language_vote"):
        got, want = QUERIES[name](spark, str(tmp_path)).where("doc_id > 1").toPandas(), con.sql(SQL[name]).df()
        columns = sorted(want.columns)
        assert rows(got, columns) == rows(want, columns), name
    empty = QUERIES["fallback_quality"](spark, str(tmp_path)).where("doc_id < 2").toPandas()
    assert list(empty["score"]) == [0.0, 0.0] and list(empty["band"]) == ["poor", "poor"]


def odd_documents(folder):
    """Null and empty texts, blanks of other scripts, capitals whose small letters depend on the engine, ties in the sixth decimal."""
    odd = [None, "", " ", "\u00a0Title line\u3000\nmore", "\u00a0 \u2003" * 50, "\u0130MPORT this\nA title", "\u0130\u0130\u0130 \u0130T in the and " * 9, "\u03a3\u0391\u03a3 \u03c3\u03b1\u03c3 \u03c3\u03b1\u03c2 la de " * 12, "S\u0130NCERELY yours"]
    ties = [" ".join(f"w{i % d}" for i in range(6400)) for d in range(1, 400, 3)]
    texts = odd + odd[:1] * 4 + ties
    docs = pd.DataFrame({"doc_id": range(1, len(texts) + 1), "text": texts, "lang": "en", "source": "web", "n_chars": [len(t or "") for t in texts]})
    docs.to_parquet(folder / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", ["fallback_metadata", "title_rule", "table_detect", "language_vote", "doc_type_rule"])
def test_odd_documents_as_in_sql(spark, tmp_path, name):
    con = odd_documents(tmp_path)
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_completeness_counts_a_page_of_empty_texts(spark, tmp_path):
    con = odd_documents(tmp_path)
    name = "metadata_completeness"
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
    assert list(got.sort_values("doc_id")["completeness"][:2]) == [1.0, 1.0]


def test_fallback_quality_of_odd_documents(spark, tmp_path):
    """All but the score of a null text, which is 0."""
    con = odd_documents(tmp_path)
    name = "fallback_quality"
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
    nulls = {i for (i,) in con.sql("SELECT doc_id FROM documents WHERE text IS NULL").fetchall()}
    keep = lambda df: df[~df["doc_id"].isin(nulls)]
    assert rows(keep(got), sorted(want.columns)) == rows(keep(want), sorted(want.columns))
    assert rows(got, ["band", "doc_id", "pages"]) == rows(want, ["band", "doc_id", "pages"])


def test_best_quotes_match_once(spark, sf_dir):
    plan = QUERIES["best_quotes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapCoGroupsInArrow" not in plan


def test_hybrid_texts_meet_vectors_once(spark, sf_dir):
    """Chunks are read as they were stored, and the best hits go to the texts instead of the texts to them."""
    plan = QUERIES["hybrid_reranked"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "LeftOuter" not in plan
