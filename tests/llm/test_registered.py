"""The registered queries themselves: their columns, rows and folds on the smallest tables."""

import zlib

import pytest

from tessera.llm import queries
from tessera.llm.common import table

# the columns that a contract names, in any order; more may follow
COLUMNS = {
    "op1_warc_derivatives": {"page_id": "bigint", "record_type": "string", "record_id": "string", "refers_to": "string"},
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": None, "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_ogg_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4_line_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_token_shards": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_html_rendering": {"page_id": "bigint", "text": "string"},
    "op11_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op12_filter_audit": {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")},
    "op13_tokenizer_alignment": {"doc_id": "bigint", **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"},
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    kept = {}

    def get(name):
        if name not in kept:
            df = queries.QUERIES[name](spark, sf_dir)
            kept[name] = (dict(df.dtypes), df.collect())
        return kept[name]

    return get


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, spark, sf_dir, name):
    kinds, rows = results(name)
    for column, kind in COLUMNS[name].items():
        assert column in kinds and (kind is None or kinds[column] == kind), (column, kinds.get(column))
    documents, pages = table(spark, sf_dir, "documents").count(), table(spark, sf_dir, "pages").count()
    if name == "op1_warc_derivatives":
        assert len(rows) == 2 * pages
    elif name in ("op6_url_filter", "op10_html_rendering"):
        assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in table(spark, sf_dir, "pages").select("page_id").collect())
    elif name == "op2_best_fit_packing":
        assert sum(r.piece == 0 for r in rows) == documents
    elif name == "op12_filter_audit":
        assert len(rows) == 600 * table(spark, sf_dir, "documents").select("lang").distinct().count()
    elif name != "op8_decontamination":
        assert len(rows) == documents


@pytest.mark.parametrize("name", ["op4_line_quality", "op9_language_id"])
def test_folds(results, name):
    _, rows = results(name)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows if name == "op4_line_quality")


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(COLUMNS) == set(queries.QUERIES) and set(queries.QUERIES) <= set(e.queries())
