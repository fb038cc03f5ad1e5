from pyspark.sql import functions as F

from ledgerfold.functions import dates
from ledgerfold.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_timestamps_in_many_shapes(spark):
    rows = ["2026-01-02T03:04:05Z", "2026-01-02T05:04:05+02:00", "2026-01-02T03:04:05", "2026-01-02", "1767323045", "1767323045000", "soon", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(dates.canonical(dates.parse_timestamp(F.col("t"))).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got[:3] == ["2026-01-02T03:04:05.000Z"] * 3 and got[3] == "2026-01-02T00:00:00.000Z" and got[4] == got[5] == "2026-01-02T03:04:05.000Z" and got[6:] == [None, None]
    other = {"2024": None, "123456789": "1973-11-29T21:33:09.000Z", "12345678": None, "1767323045.25": "2026-01-02T03:04:05.250Z", "17673230450000": None, "-1767323045": None, "2026-01-02T03:04": None, "2026-01-02 03:04:05.5+0100": "2026-01-02T02:04:05.500Z"}
    df = spark.createDataFrame([(r,) for r in other], "t string").select("t", dates.canonical(dates.parse_timestamp(F.col("t"))).alias("x"))
    assert {r["t"]: r["x"] for r in df.collect()} == other
    assert one(spark, dates.canonical(dates.epoch_timestamp(F.lit(2024)))) == "1970-01-01T00:33:44.000Z"


def test_weeks_start_on_local_mondays(spark):
    ts = F.lit("2026-09-21 03:00:00").cast("timestamp")
    assert str(one(spark, dates.local_week(ts))) == "2026-09-21" and str(one(spark, dates.local_week(ts, "America/New_York"))) == "2026-09-14"


def test_durations(spark):
    a, z = F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit("2026-01-01 00:00:02.5").cast("timestamp")
    assert tuple(one(spark, T.tool_duration(F.lit(""), F.lit('{"durationMs": 7}'), a, z))) == (7, "reported")
    assert tuple(one(spark, T.tool_duration(F.lit("Wall time: 1.5 seconds"), F.lit(None), a, z))) == (1500, "reported")
    assert tuple(one(spark, T.tool_duration(F.lit(""), F.lit(None), a, z))) == (2500, "timestamps")
    assert tuple(one(spark, T.tool_duration(F.lit(""), F.lit(None), z, a))) == (None, None)


def test_patches_and_paths(spark):
    assert tuple(one(spark, T.patch_lines(F.lit("--- a\n+++ b\n+x\n+y\n-z\n c")))) == (2, 1)
    path = lambda name, given: one(spark, T.call_path(F.lit(name), F.lit(given)))
    assert path("Read", '{"file_path": "/w/a.py"}') == "/w/a.py" and path("x", '{"filename": "a"}') is None and path("x", '{"filePath": "b", "path": ""}') == "b"
    assert path("x", '{"path": "p", "notebook_path": "n"}') == "n" and path("x", '{"path": "' + "q" * 600 + '"}') == "q" * 500 + "…"
    assert path("apply_patch", "*** Begin Patch\n*** Update File: src/b.go\n@@") == "src/b.go" and path("my_patcher", "*** Update File: src/b.go") is None
    assert path("ApplyPatch", '{"input": "*** Add File: c d.go \\n+x"}') == "c d.go"
    got = one(spark, T.changed_files(F.lit("apply_patch"), F.lit("*** Add File: /w/n.py\n+x\n*** Delete File: old.py\n"), F.lit("/w")))
    assert [(r["path"], r["status"]) for r in got] == [("n.py", "added"), ("old.py", "deleted")]
    assert [(r["path"], r["status"]) for r in one(spark, T.changed_files(F.lit("Edit"), F.lit('{"file_path": "/w/a.py"}'), F.lit("/w")))] == [("a.py", "modified")]
    changed = lambda name, given, *roots: [tuple(r) for r in one(spark, T.changed_files(F.lit(name), F.lit(given), *map(F.lit, roots)))]
    assert changed("write", '{"file_path": "/else/x.py"}', "/w") == [] and changed("write", '{"path": "/r/./x.py"}', "/w", "/r/") == [("x.py", "written")]
    assert changed("NotebookEdit", '{"file_path": "/w/x"}', "/w") == [] and changed("dispatch", "*** Add File: x", "/w") == []
    assert changed("edit", '{"path": "../x"}', "/w") == [] and changed("edit", '{"path": "a/../b//c"}', "/w") == [("b/c", "modified")] and changed("edit", '{"path": "/w/../v/x"}', "/w") == []


def test_sizes_links_and_names(spark):
    assert one(spark, T.estimated_tokens(F.lit("é" * 3), F.lit(2))) == 3002
    links = one(spark, T.pull_requests(F.lit("see https://git.example.com/o/r/pull/12 and https://git.example.com/o/r/pull/12.")))
    assert [tuple(x) for x in links] == [("git.example.com", "o", "r", 12)]
    assert one(spark, T.repository_name(F.lit("git@host:team/app.git"), F.lit(None))) == "app"
    assert one(spark, T.repository_name(F.lit(None), F.lit("/home/u/app/.worktrees/x"))) == "app"


def test_snippets_and_clips(spark):
    text = "x" * 200 + " Needle " + "y" * 300
    s = one(spark, T.snippet(F.lit(text), F.lit("needle")))
    assert s.startswith("…") and s.endswith("…") and "Needle" in s and len(s) == 2 + 90 + 6 + 130
    assert one(spark, T.snippet(F.lit("short"), F.lit("none"))) == "short"
    assert one(spark, T.clip(F.lit("abcdef"), 3)) == "abc…" and one(spark, T.clip(F.lit("abc"), 3)) == "abc"


def test_injected_text_and_senders(spark):
    assert one(spark, T.injected_source(F.lit(" <task-notification>x"))) == "task_notification" and one(spark, T.injected_source(F.lit("hello"))) is None
    assert one(spark, T.sender(F.lit("codex_exec"), F.lit(None))) == "automation:codex-exec" and one(spark, T.sender(F.lit(None), F.lit("sdk-cli"))) == "automation:claude-sdk-cli"
    assert one(spark, T.sender(F.lit(None).cast("string"), F.lit(None), F.lit("exec"))) == "automation:codex-exec" and one(spark, T.sender(F.lit("cli"), F.lit(None), F.lit("vscode"))) is None
    said = lambda text, event: one(spark, T.claude_injected(F.lit(text), F.lit(event)))
    assert said("hello", '{"origin": {"kind": "peer"}}') == "peer_message" and said("hello", '{"isCompactSummary": true}') == "compaction_summary" and said("hello", "{}") is None
    assert said("[Image: x]", '{"isMeta": true}') == "image_note" and said("hello", '{"isMeta": true}') == "harness" and said("[Image: x]", '{"isMeta": false}') is None
    assert said("\n<task-notification>", "{}") == "task_notification" and said("<turn_aborted>", "{}") is None
    block = lambda text, kind: one(spark, T.codex_injected(F.lit(text), F.lit(kind).cast("string")))
    assert block("<turn_aborted>", None) == "turn_aborted" and block("<turn_aborted>", "user.text") is None and block("hi", "skills.list") == "skills.list" and block("<task-notification>", "") is None


def test_template_keys_concepts_and_ids(spark):
    assert one(spark, T.template_key(F.lit("<system-reminder>a</system-reminder>\n Fix   @⟦a.py⟧(src/a.py) NOW"))) == "fix @ now"
    assert one(spark, T.concept_word(F.lit("Crash"))) == "failure" and one(spark, T.concept_word(F.lit("sorting"))) == "sort"
    assert one(spark, T.stable_id("n", F.lit("a"), F.lit("b"))) != one(spark, T.stable_id("n", F.lit("ab"), F.lit("")))
    assert len(one(spark, T.shingles(T.word_tokens(F.lit("a b c d e f g h i")), 8))) == 2 and one(spark, T.shingles(T.word_tokens(F.lit("a b")), 8)) == []


def test_session_status(spark):
    assert tuple(one(spark, T.session_status(F.lit(10), F.lit(4)))) == ("reported-partial", 6)
    assert tuple(one(spark, T.session_status(F.lit(10), F.lit(10)))) == ("reported-reconciled", 0)
    assert tuple(one(spark, T.session_status(F.lit(None).cast("int"), F.lit(0)))) == ("unavailable", 0)
