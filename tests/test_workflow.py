import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerfold.operators import workflow as wf


def tasks(spark, minutes, **extra):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, None, None, t0 + dt.timedelta(minutes=m), "f", 1 + (m > 25)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "task_id long, parent_id long, created_by string, created_at timestamp, flavor string, version int")


def test_bursts_merge_up_to_the_gap(spark):
    assert wf.enqueue_bursts(tasks(spark, [0, 5, 10, 21, 25, 30, 35])).collect() == []
    two = wf.enqueue_bursts(tasks(spark, [0, 1, 2, 60, 61, 62, 72, 73, 74, 200, 201, 202, 203, 204])).collect()
    assert [r["root_tasks"] for r in two] == [5, 6]


def test_bursts_equal_session_windows(spark):
    rng = random.Random(5)
    at = [0]
    for _ in range(400):
        at.append(at[-1] + rng.choice([0, 1, 3, 9, 10, 11, 25]))
    t = tasks(spark, at).withColumn("flavor", F.concat(F.lit("f"), F.col("task_id") % 3))
    plain = t.groupBy(F.session_window("created_at", "10 minutes")).agg(F.min("created_at").alias("s"), F.max("created_at").alias("e"), F.count("task_id").alias("n"), F.countDistinct("flavor").alias("f")).where("n >= 5").drop("session_window")
    got = wf.enqueue_bursts(t).collect()
    assert [tuple(r) for r in got] == sorted((tuple(r) for r in plain.collect()), reverse=True) and len(got) > 20
    assert wf.enqueue_bursts(t.where("task_id < 0")).collect() == []


def test_definition_change_in_its_burst(spark):
    t = tasks(spark, [0, 1, 2, 3, 4, 60, 61, 62, 63, 64])
    got = wf.definition_changes(t, wf.enqueue_bursts(t)).collect()
    assert [(r["flavor"], r["version"], r["during"]) for r in got] == [("f", 2, False)]


def test_matrix_leaves_outside_failures_out_of_medians(spark):
    rows = [(i, "f", "c", "advanced", None, None, 1.0 + i) for i in range(5)] + [(9, "f", "c", "error", "worker_died", "infrastructure", 0.0)]
    df = spark.createDataFrame(rows, "attempt_id long, flavor string, configuration string, disposition string, error_class string, attribution string, cost_usd double")
    df = df.select("*", *[F.lit(10).cast("long").alias(c) for c in ("duration_ms", "total_tokens", "input_tokens", "cache_read_input_tokens")])
    r = wf.workflow_matrix(df).first()
    assert r["median_cost_usd"] == 3.0 and r["cost_usd"] == 15.0 and r["agent_error_rate"] == 0.0 and r["cost_per_advance_usd"] == 3.0
    assert r["attempts"] == 6 and r["infrastructure_errors"] == 1


def test_attempt_ids_of_transcripts(spark):
    u = spark.createDataFrame([("i:a1:f", 5, 0.5), ("i:a1:g", 6, None), ("plain", 9, 1.0)], "native_id string, total_tokens long, cost_usd double")
    assert [(r["attempt_id"], r["total_tokens"], r["token_cost"]) for r in wf.attempt_usage(u).collect()] == [("a1", 11, 0.5)]
