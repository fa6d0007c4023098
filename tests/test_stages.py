"""The stateful stage chain against the same reports in one batch, over micro-batches, a restart, late and repeated reports."""

import datetime
import random

from tessera.operators import lifecycle
from tessera.streaming import stages

SCHEMA = "doc_id long, stage string, status string, at timestamp, event_id long"


def rows(df):
    cols = ["doc_id", "stage", "status", "updated_at", "started_at", "failures", "duration_ms", "attempt_number"]
    return sorted(map(tuple, df.select(cols).collect()), key=str)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    made = [(rnd.randrange(6), rnd.choice(["extraction", "chunking"]), rnd.choice(["in_progress", "completed", "failed"]), start + datetime.timedelta(seconds=rnd.randrange(50)), k) for k in range(90)]
    told = made + made[10:40]  # some come twice
    rnd.shuffle(told)
    for k in range(3):  # three files, three micro-batches; late ones among them
        spark.createDataFrame(told[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stages.run_stages(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    for k in (3, 4):  # and two more after a restart
        spark.createDataFrame(told[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stages.run_stages(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = lifecycle.stage_status(spark.createDataFrame(made, SCHEMA))
    assert rows(stages.current(spark, f"{tmp_path}/out")) == rows(want)
    assert len({p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")}) >= 5
    for r in stages.current(spark, f"{tmp_path}/out").collect():
        due = r.updated_at + datetime.timedelta(seconds=60) if r.status == "failed" and r.failures <= 3 else None
        assert r.retry_at == due


def test_a_finished_stage_is_not_tried_again(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    for k, status in enumerate(("failed", "completed")):
        spark.createDataFrame([(1, "chunking", status, at + datetime.timedelta(seconds=k), k)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stages.run_stages(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    (r,) = stages.current(spark, f"{tmp_path}/out").select("status", "attempt_number", "retry_at").collect()
    assert tuple(r) == ("completed", 2, None)


def test_no_python_in_a_micro_batch(spark, tmp_path):
    spark.createDataFrame([(1, "chunking", "failed", datetime.datetime(2024, 1, 1), 1)], SCHEMA).write.parquet(f"{tmp_path}/in")
    plan = stages.stage_updates(stream(spark, f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_repeated_failures_in_later_batches_count_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    for _ in range(3):
        spark.createDataFrame([(1, "chunking", "failed", at, 7), (1, "chunking", "failed", at, 8), (None, "chunking", "failed", at, 9)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stages.run_stages(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(stages.current(spark, f"{tmp_path}/out").select("doc_id", "failures", "attempt_number").collect(), key=str) == [(1, 2, 3), (None, 1, 2)]
