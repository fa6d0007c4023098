import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import crf, decontam, langid, packing
from tessera.llm.common import table
from tests.llm.test_documents import brute_classes


def test_pipeline_against_brute_force(spark, sf_dir):
    """Stages rerun over rows in Python; learned models are the same objects, exact steps are brute force."""
    docs = table(spark, sf_dir, "documents")
    kept = docs.toPandas()
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    kept = kept[model.score(list(kept.text)) >= 0.5]
    after = corpus_pipeline.quality(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept.doc_id)
    model = langid.train(after)
    kept = kept[~model.predict(list(kept.text))[2]]
    classes = brute_classes(list(zip(kept.doc_id, kept.text, strict=True)))
    kept = kept[[classes[i][1] == i for i in kept.doc_id]]
    hits = {r.doc_id for r in decontam.find(spark.createDataFrame(kept), table(spark, sf_dir, "benchmark")).collect()}
    kept = kept[[i not in hits for i in kept.doc_id]]
    want = packing.cut(spark.createDataFrame(kept), corpus_pipeline.TOKENIZER).collect()
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted(map(tuple, want))
    assert 0 < len(kept) < docs.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").withColumn("score", F.lit("x")).withColumn("rejected", F.lit(1))
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    known = set(map(tuple, docs.collect()))
    assert all(tuple(r) in known for r in out.collect())


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    data = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a few plain words stand in this line", "en", "s", 36), (3, "a few plain words stand in this line", "en", "s", 36)]
    schema = table(spark, sf_dir, "documents").schema
    for df in (spark.createDataFrame(data, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf_dir).collect()
