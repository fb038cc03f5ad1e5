"""Followed folders against the batch readers over the same files, through growth, rewrites, restarts and failed landings."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerfold.sources import transcripts
from ledgerfold.streaming import transcripts as live


def put(path, rows, mode="w", at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))
    if at:
        os.utime(path, (at, at))


def same(spark, provider, src, home):
    read = {"claude": transcripts.read_claude, "codex": transcripts.read_codex}[provider]
    cols = ["id", "conversation_id", "source_order", "native_id", "parent_native_id", "role", "kind", "model", "text", "raw_text", "created_at"]
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.select(cols).collect()))
    want = rows(read(spark, str(src)))
    assert rows(live.followed_messages(spark, provider, str(home))) == want
    return want


def said(n, model=None, text="hi"):
    message = {"role": "assistant" if model else "user", "content": text} | ({"model": model} if model else {})
    return {"type": "assistant" if model else "user", "uuid": f"u{n}", "timestamp": f"2026-01-01T00:00:{n % 60:02d}Z", "message": message}


def test_claude_folder_that_grows(spark, tmp_path):
    src, home = tmp_path / "src", tmp_path / "home"
    put(src / "s1.jsonl", [said(1), said(2, "m1"), said(3)], at=1_700_000_000)
    put(src / "s1" / "subagents" / "agent-x.jsonl", [said(4)], at=1_700_000_000)
    assert live.follow(spark, "claude", str(src), str(home)) == 2
    same(spark, "claude", src, home)
    assert live.follow(spark, "claude", str(src), str(home)) == 0
    # growth: only the new line is landed, and it takes the model of lines read by an earlier query
    put(src / "s1.jsonl", [said(5)], "a", at=1_700_000_100)
    put(src / "s[2] a.jsonl", [said(6, "m2")], at=1_700_000_100)
    assert live.follow(spark, "claude", str(src), str(home), max_files=1) == 2
    rows = same(spark, "claude", src, home)
    assert [r[7] for r in rows if r[3] == "u5:0"] == ["m1"]
    landed = spark.read.parquet(f"{home}/feed/lines").groupBy("landing").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in landed) == [1, 1, 4]
    # a rewrite, also a shorter one, is read again whole
    put(src / "s1.jsonl", [said(7), said(8)], at=1_700_000_200)
    live.follow(spark, "claude", str(src), str(home))
    rows = same(spark, "claude", src, home)
    assert {r[3]: r[7] for r in rows} == {"u7:0": "None", "u8:0": "None", "u4:0": "None", "u6:0": "m2"}
    # same size and an older time is a change too
    put(src / "s1.jsonl", [said(7), said(9)], at=1_600_000_000)
    live.follow(spark, "claude", str(src), str(home))
    want = same(spark, "claude", src, home)
    # an emptied or removed file keeps what was read of it
    put(src / "s1.jsonl", [], at=1_700_000_300)
    (src / "s[2] a.jsonl").unlink()
    live.follow(spark, "claude", str(src), str(home))
    assert live.followed_messages(spark, "claude", str(home)).count() == len(want)


def test_codex_folder_over_several_landings(spark, tmp_path):
    src, home = tmp_path / "src", tmp_path / "home"
    talk = lambda i: {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": f"t{i}"}]}}
    put(src / "r.jsonl", [talk(0)], at=1_700_000_000)
    live.follow(spark, "codex", str(src), str(home))
    put(src / "r.jsonl", [{"type": "session_meta", "payload": {"id": "sess"}}, {"type": "turn_context", "payload": {"model": "g5"}}, talk(1)], "a", at=1_700_000_010)
    live.follow(spark, "codex", str(src), str(home))
    put(src / "r.jsonl", [talk(2), {"type": "turn_context", "payload": {"model": "g6"}}, talk(3)], "a", at=1_700_000_020)
    put(src / "rollout-x-01234567-89ab-cdef-0123-456789abcdef.jsonl", [{"type": "session_meta", "payload": {"id": "other"}}], at=1_700_000_020)
    live.follow(spark, "codex", str(src), str(home))
    rows = same(spark, "codex", src, home)
    assert {r[1] for r in rows} == {"sess", "01234567-89ab-cdef-0123-456789abcdef"}
    assert [r[7] for r in rows if r[8] in ("t2", "t3")] in (["g5", "g6"], ["g6", "g5"])


def test_failed_landing_and_expired_state(spark, tmp_path, monkeypatch):
    src, home = tmp_path / "src", tmp_path / "home"
    put(src / "a.jsonl", [said(1, "m1")], at=1_700_000_000)
    live.follow(spark, "claude", str(src), str(home), idle="1 hour")
    put(src / "a.jsonl", [said(2)], "a", at=1_700_000_100)
    put(src / "b.jsonl", [said(3, "m3")], at=1_700_000_100)
    # the table of versions can't be written: the landing's lines are there, but count for nothing
    class Broken(Exception):
        pass

    def fail(self, n):
        raise Broken

    with monkeypatch.context() as broken:
        broken.setattr(type(spark.range(1)), "coalesce", fail)
        with pytest.raises(Broken):
            live.land(spark, "claude", str(src), f"{home}/feed")
    live.follow(spark, "claude", str(src), str(home), idle="1 hour")
    same(spark, "claude", src, home)
    # later landings push the watermark on, so a's state expires; its growth is landed whole
    day = lambda n: datetime(2100, 1, n)
    for n, model in ((1, "m4"), (2, None)):
        put(src / f"c{n}.jsonl", [said(4, model)])
        live.follow(spark, "claude", str(src), str(home), idle="1 hour", now=day(n))
    put(src / "a.jsonl", [said(6)], "a")
    live.follow(spark, "claude", str(src), str(home), idle="1 hour", now=day(3))
    rows = same(spark, "claude", src, home)
    assert [r[7] for r in rows if r[3] == "u6:0"] == ["m1"]
    newest = spark.read.parquet(f"{home}/feed/lines").where("landed_at >= '2100-01-03'").where(F.col("file").endswith("/a.jsonl"))
    assert newest.count() == 3 and newest.where("restart").count() == 3
