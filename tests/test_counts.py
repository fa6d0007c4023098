"""Frequent values against plain counts, and what their first pass moves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import counts


@pytest.mark.parametrize("options", [{}, {"range_bits": 0, "buffer_rows": 7}, {"broadcast_rows": 1}])
def test_frequent_is_exact(spark, options):
    values = [f"v{k * k % 61}" for k in range(500)] + [f"own{k}" for k in range(300)] + ["", None] * 3 + ["nine"] * 9 + ["ten"] * 10
    df = spark.createDataFrame([(v,) for v in values], "gram string").repartition(5)
    for least in (1, 2, 10):
        got = {r.gram: r.n for r in counts.frequent(df, "gram", least, **options).collect()}
        assert got == {v: n for v, n in Counter(values).items() if n >= least}


def test_rare_values_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(counts, "RANGE_BITS", 2)  # 8 hashes only, so all of them come often
    df = spark.range(400).select(F.concat(F.lit("v"), F.when(F.col("id") < 12, 0).otherwise(F.col("id"))).alias("gram"))
    assert [tuple(r) for r in counts.frequent(df, "gram", 10, range_bits=1).collect()] == [("v0", 12)]


def test_frequent_of_nothing(spark):
    assert counts.frequent(spark.createDataFrame([], "gram string"), "gram", 10).collect() == []


def test_rare_values_move_as_blocks(spark):
    df = spark.range(0, 200_000, 1, 2).select(F.concat(F.lit("a gram that comes once "), "id").alias("gram"))
    hashes = df.select(F.shiftrightunsigned(F.xxhash64("gram"), 64 - counts.RANGE_BITS - 2).alias("h"))
    moved = hashes.mapInArrow(counts._packed(10, 2, 4_000_000), counts.BLOCK).agg(F.sum(F.octet_length("steps")), F.count("*")).first()
    assert moved[0] <= 2 * 200_000 and moved[1] <= 8
