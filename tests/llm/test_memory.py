"""What the pipeline's stages hold in memory at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, crf, jaccard, langid
from tessera.llm.common import table

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("module, name, model", [(crf, "score", crf.fit([], [])), (langid, "predict", langid.fit([], []))])
def test_kept_text_travels_once_and_other_caches_go(spark, monkeypatch, module, name, model):
    sent = []
    monkeypatch.setattr(module, "arrow_map", lambda df, run, schema: sent.append((df, run)))
    docs = spark.createDataFrame([(7, "some words\nand more", "en")], "doc_id long, text string, lang string")
    getattr(module, name)(docs, model, keep=("doc_id", "text", "lang"))
    df, run = sent[0]
    row = df.first()
    assert list(row).count("some words\nand more") == 1
    common.worker_cache("another step's", dict)
    got = list(run(pa.RecordBatch.from_pydict({k: [v] for k, v in row.asDict().items()})))[0]
    assert "another step's" not in common._KEPT
    assert [got[c].to_pylist() for c in ("doc_id", "text", "lang")] == [[7], ["some words\nand more"], ["en"]]


def test_slices_of_blocks_go_over_batches(spark, sf_dir):
    """Small Arrow batches make no more blocks, and no other classes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").coalesce(1)
    blocks = lambda: jaccard.blocks(docs, 5, 3, 1 << 20, 0.02, 64).drop("steps", "which", "docs").orderBy(F.col("route"), "first").collect()
    classes = lambda: sorted(map(tuple, jaccard.join(docs).collect()))
    want = blocks(), classes()
    spark.conf.set(BYTES, "20000")
    try:
        assert (blocks(), classes()) == want
    finally:
        spark.conf.unset(BYTES)


def test_stages_bound_arrow_batches(spark, sf_dir):
    spark.conf.unset(BYTES)
    docs = table(spark, sf_dir, "documents")
    rows = common.arrow_map(docs.select("text").coalesce(1).repartition(1), lambda b: {"n": [b.nbytes]}, "n long")
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            stage(spark, docs, sf_dir)
        assert spark.conf.get(BYTES) == str(4 << 20)
        spark.conf.set(BYTES, "50000")
        corpus_pipeline.quality(spark, docs, sf_dir)  # what a user has set stays
        assert spark.conf.get(BYTES) == "50000"
        assert max(r.n for r in rows.collect()) < 100_000
    finally:
        spark.conf.unset(BYTES)
