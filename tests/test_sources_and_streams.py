import json

from pyspark.sql import functions as F

from ledgerfold.sources import tables, transcripts
from ledgerfold.streaming import incremental as inc


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\n")


def test_claude_sessions_with_subagents(spark, tmp_path):
    usage = {"input_tokens": 5, "output_tokens": 2}
    lines(tmp_path / "s1.jsonl", [
        {"type": "user", "uuid": "u1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "uuid": "u2", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "assistant", "model": "m1", "usage": usage, "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": "u3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out", "is_error": True}]}},
        {"type": "system", "subtype": "compact_boundary", "uuid": "u4"},
    ])
    lines(tmp_path / "s1" / "subagents" / "agent-a.jsonl", [{"type": "user", "uuid": "v1", "message": {"role": "user", "content": "sub"}}])
    m = {(r["native_id"]): r for r in transcripts.read_claude(spark, str(tmp_path)).collect()}
    assert [m[k]["kind"] for k in ("u1:0", "u2:0", "u2:1", "u3:0", "u4")] == ["text", "text", "tool_call", "tool_result", "compaction"]
    assert m["u1:0"]["text"] == "hello" and m["u3:0"]["is_error"] and m["u3:0"]["call_id"] == "t1" and m["u3:0"]["model"] == "m1"
    assert m["v1:0"]["conversation_id"] == "s1" and m["v1:0"]["parent_native_id"] == "agent-a" and m["u2:0"]["raw_text"] and not m["u2:1"]["raw_text"]


def test_codex_rollouts(spark, tmp_path):
    lines(tmp_path / "r.jsonl", [
        {"type": "session_meta", "payload": {"id": "sess"}}, {"type": "turn_context", "payload": {"model": "g5"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "call_id": "c1", "name": "shell", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "ok"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 5}}}},
    ])
    m = transcripts.read_codex(spark, str(tmp_path)).orderBy("source_order").collect()
    assert [r["kind"] for r in m] == ["metadata", "metadata", "text", "tool_call", "tool_result", "metadata"]
    assert {r["conversation_id"] for r in m} == {"sess"} and m[3]["model"] == "g5" and m[2]["text"] == "do" and m[5]["raw_text"]


def test_chatgpt_and_canonical_exports(spark, tmp_path):
    node = lambda i, t: {"message": {"id": i, "author": {"role": "user"}, "create_time": t, "content": {"parts": [i]}}}
    (tmp_path / "c.json").write_text(json.dumps([{"conversation_id": "x", "title": "t", "mapping": {"a": node("m2", 2.0), "b": node("m1", 1.0), "root": {"message": None}}}]))
    assert [r["text"] for r in transcripts.read_chatgpt(spark, str(tmp_path / "c.json")).orderBy("source_order").collect()] == ["m1", "m2"]
    work = {"id": "w", "source_kind": "codex", "title": "T", "conversations": [{"id": "c", "provider": "p", "messages": [{"id": "1", "role": "user", "kind": "text", "text": "hey", "created_at": "2026-01-01"}]}], "changes": [{"classification": "k", "files": [{"path": "a.py", "status": "added"}]}]}
    for i, doc in enumerate((work, {"workspaces": [work]})):
        (tmp_path / f"e{i}.json").write_text(json.dumps(doc))
        t = transcripts.read_canonical(spark, str(tmp_path / f"e{i}.json"))
        assert t["messages"].first()["text"] == "hey" and t["changes"].first()["path"] == "a.py" and t["workspaces"].count() == 1


def test_longest_message_field(spark):
    df = spark.createDataFrame([("a", "longer", None), (None, None, None), ("xx", "yy", "")], "content string, full string, short string")
    got = [(r["text"], r["text_field"]) for r in transcripts.pick_message_field(df, ["content", "full", "short"]).collect()]
    assert got == [("longer", "full"), (None, None), ("xx", "content")]


def test_pricing_document(spark, tmp_path):
    change = {"provider": "p", "model": "Claude-M", "effective_from": "2026-01-01", "input": -1, "output": 2, "status": "confirmed"}
    (tmp_path / "p.json").write_text(json.dumps({"changes": [change, change], "aliases": [{"alias": "x", "model": "m", "effective_from": "2026-01-01", "status": "confirmed"}]}))
    prices, aliases = tables.read_pricing(spark, str(tmp_path / "p.json"))
    assert prices.first()["model_key"] == "m" and aliases.first()["target"] == "m"
    assert {r["problem"] for r in tables.validate_pricing(prices, aliases, "2026-02-01").collect()} == {"negative rate", "no source", "doubled entry"}


def test_only_held_partitions_are_replaced(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.write_table(df, at, ["k"])
    tables.write_table(df.where("k = 1").withColumn("v", F.lit("new")), at, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(at).collect()) == [(1, "new"), (2, "b")]


def test_installations_of_a_snapshot_keep_no_old_rows(spark, tmp_path):
    put = lambda n, name, rows: spark.createDataFrame(rows, "installation_id string, v string").write.mode("overwrite").parquet(str(tmp_path / n / name))
    load = lambda n: tables.load_workflow(spark, str(tmp_path / n), str(tmp_path / "at"))
    stored = lambda name: sorted((r["installation_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "at" / name)).collect())
    assert load("none") == {}
    for name in ("tasks", "events", "findings"):
        put("old", name, [("a", "a1"), ("b", "b1"), ("c", "c1")])
    assert set(load("old")) == {"tasks", "events", "findings"}
    put("new", "tasks", [("a", "a2"), ("b", "b2")])
    put("new", "events", [("a", "a2")])
    load("new")
    assert stored("tasks") == [("a", "a2"), ("b", "b2"), ("c", "c1")]
    assert stored("events") == [("a", "a2"), ("c", "c1")]
    assert stored("findings") == [("a", "a1"), ("b", "b1"), ("c", "c1")]


def test_older_copies_never_overwrite(spark, tmp_path):
    at = str(tmp_path / "u")
    put = lambda rows: inc.upsert_versioned(spark.createDataFrame(rows, "id string, version long, v string, day int"), at, ["id"])
    put([("a", 2, "two", 0), ("b", 1, "one", 1)])
    put([("a", 1, "old", 5), ("b", 3, "three", 2)])
    put([("a", 2, "again", 0)])
    assert sorted((r["id"], r["v"], r["day"]) for r in spark.read.parquet(at).collect()) == [("a", "two", 0), ("b", "three", 2)]


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_new_files_are_read_once(spark, tmp_path):
    src, ck = tmp_path / "src", str(tmp_path / "ck")
    lines(src / "a.jsonl", [{"n": 1}])
    run = lambda: inc.stream_lines(spark, str(src)).writeStream.option("checkpointLocation", ck).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination(120)
    run()
    lines(src / "b.jsonl", [{"n": 2}])
    run()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).where("value <> ''").collect()) == ['{"n": 1}', '{"n": 2}']


def test_hourly_stream_and_bursts(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id session_id", "event_type model", "cast(ts as timestamp) created_at", "cast(value as long) total_tokens", "cast(null as long) parent_id", "cast(null as string) created_by")
    e.coalesce(1).write.parquet(str(tmp_path / "ev"))
    drain(inc.hourly_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))), "hourly")
    batch = e.where("created_at < '2024-01-30'").selectExpr("sum(total_tokens) t").first()["t"]
    got = spark.table("hourly").where("usage_hour < '2024-01-30'").selectExpr("sum(total_tokens) t").first()["t"]
    assert got == batch
    drain(inc.burst_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")), ("model",), "40 minutes", least=2), "bursts")
    assert spark.table("bursts").count() > 0
