import random

from pyspark.sql import functions as F

from ledgerfold.functions import text as T
from ledgerfold.operators import tools

def test_cube_equals_calls(spark):
    rng = random.Random(7)
    rows = [(rng.choice("wxyz"), rng.choice(["a", "b"]), rng.choice(["ok", "error"]), rng.choice([None, "", "p"]), rng.choice([None, rng.randint(0, 99)])) for _ in range(500)]
    calls = spark.createDataFrame(rows, "workspace_id string, tool string, status string, path string, duration_ms long")
    cube = tools.tool_call_cube(calls, ["workspace_id", "tool", "status"], ["path"], ["duration_ms"])
    for keys in ([], ["tool"], ["tool", "status"]):
        a = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("m"), F.min("duration_ms").alias("lo")).collect()
        b = cube.groupBy(*keys).agg(tools.cube_measure("count").alias("n"), tools.cube_measure("avg", "duration_ms").alias("m"), tools.cube_measure("min", "duration_ms").alias("lo")).collect()
        key = lambda r: tuple(r[k] for k in keys)
        assert {key(r): (r["n"], round(r["m"], 7), r["lo"]) for r in a} == {key(r): (r["n"], round(r["m"], 7), r["lo"]) for r in b}


def test_answers_from_cube_and_calls_agree(spark):
    calls = spark.createDataFrame([("a", "ok", 3, 1), ("a", "error", None, 2), ("b", "ok", 5, None), ("b", None, 7, 4)], "tool string, status string, duration_ms long, extra long")
    cube = tools.tool_call_cube(calls, ["tool", "status"], [], ["duration_ms"])
    asked = {"n": ("count", None), "sum": ("sum", "duration_ms"), "avg": ("avg", "duration_ms")}
    for keys in ([], ["tool"], ["tool", "status"]):
        both = [sorted(map(str, tools.answer_metrics(calls, c, keys, asked).collect())) for c in (cube, calls.limit(0))]
        assert both[0] == both[1]
    assert tools.route_to_cube({"tool"}, {"extra"}, cube, calls) is calls and tools.answer_stats(calls, cube, "extra").first()["most"] == 4
    assert {(r["value"], r["calls"]) for r in tools.answer_distinct(calls, cube, "status").collect()} == {("ok", 2), ("error", 1)}


def test_failure_classes(spark):
    rows = {
        "worker w7 died": ("worker_died", "worker died", "infrastructure"),
        "codex exited with code 1: reading prompt from stdin\nmodel not found": ("executor_exit", "codex exited with code 1: model not found", "configuration"),
        "contract_repair_exhausted: missing_output_fields: x; marker_missing": ("output_contract", "contract_repair_exhausted: missing_output_fields: marker_missing", "contract"),
        "timed out after 300 s in /srv/run/a1": ("timeout", "timed out after <n> s in <path>", "agent"),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", T.failure(F.col("t")).alias("f"))
    for r in df.collect():
        f = r["f"]
        assert ((f["error_class"], f["signature"], f["attribution"]) if f else (None, None, None)) == rows[r["t"]]


def test_benign_exit_of_grep(spark):
    df = spark.createDataFrame([("grep", 1), ("make", 1), ("make", 0)], "p string, c int")
    o = T.tool_outcome(F.lit(""), F.lit(False), F.to_json(F.struct(F.col("c").alias("exitCode"))), F.lit(True), F.col("p"), F.lit("command"))
    assert [r["s"] for r in df.select(o["status"].alias("s")).collect()] == ["ok", "error", "ok"]


def test_anonymous_requests_merge(spark):
    r = spark.createDataFrame([("c", "main", f"k{i}", i, None, "m", inp, out, inp + out, None) for i, inp, out in ((1, 10, 1), (2, 10, 5), (5, 10, 2), (6, 12, 1))], "conversation_id string, stream string, request_key string, first_idx int, requested_at timestamp, model string, input_tokens long, output_tokens long, total_tokens long, native_id string")
    turns = spark.createDataFrame([("c", "main", 4)], "conversation_id string, stream string, idx int")
    got = sorted((x["request_key"], x["output_tokens"]) for x in tools.merge_anonymous(r, turns).collect())
    assert got == [("k1", 5), ("k5", 2), ("k6", 1)]
