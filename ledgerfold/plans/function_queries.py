"""Queries over the text, call and window rules that the other query modules don't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import dates
from ledgerfold.functions import text as T
from ledgerfold.operators import authorship, tools, workflow
from ledgerfold.plans.book import Book
from ledgerfold.plans.standins import CALLS, LEDGER, MESSAGES, TASKS, ledger, messages, table, tasks, tool_calls

BOOK = Book()

#: Events with their number ``k``, in SQL.
EV = "ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@BOOK.add(f"""WITH {EV} SELECT event_id, CAST(CASE k % 3 WHEN 0 THEN k * 1000 + 500 WHEN 1 THEN k * 7 ELSE k * 1000 END AS BIGINT) AS duration_ms,
CASE WHEN k % 3 = 2 THEN 'timestamps' ELSE 'reported' END AS source FROM ev""")
def tool_duration(spark, sf_dir):
    k = F.col("k")
    content = F.when(k % 3 == 0, F.concat(F.lit("done\nWall time: "), k.cast("string"), F.lit(".5 seconds")))
    details = F.when(k % 3 == 1, F.to_json(F.struct((k * 7).alias("durationMs"))))
    start = F.col("ts").cast("timestamp")
    out = T.tool_duration(content, details, start, F.timestamp_micros(F.unix_micros(start) + k * 1_000_000))
    return events(spark, sf_dir).select("event_id", out.alias("d")).select("event_id", "d.duration_ms", "d.source")


@BOOK.add(f"WITH {EV} SELECT event_id, CAST(k % 5 AS INTEGER) AS added, CAST(k % 4 AS INTEGER) AS removed FROM ev")
def patch_lines(spark, sf_dir):
    part = lambda line, n: F.repeat(F.lit(line), (F.col("k") % n).cast("int"))
    patch = F.concat(F.lit("--- a/f\n+++ b/f\n same\n"), part("+new\n", 5), part("-old\n", 4), F.lit(" end"))
    return events(spark, sf_dir).select("event_id", T.patch_lines(patch).alias("p")).select("event_id", "p.added", "p.removed")


@BOOK.add("SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN concat('n', url) WHEN 2 THEN trim(url) WHEN 4 THEN CASE WHEN length(url) > 100 THEN NULL ELSE concat(repeat('p', 500), '…') END WHEN 5 THEN url END AS path FROM pages")
def call_path(spark, sf_dir):
    """Rows tell the order of the names, empty ones, other names, other patch tools and the clip apart."""
    n, url = F.col("page_id") % 7, F.col("url")
    patch = F.to_json(F.struct(F.concat(F.lit("*** Begin Patch\n*** Update File: "), url, F.lit("\n@@")).alias("input")))
    given = F.when(n == 0, F.to_json(F.struct(url.alias("file_path"), F.lit("x").alias("path")))).when(n == 1, F.to_json(F.struct(F.lit("x").alias("path"), F.concat(F.lit("n"), url).alias("notebook_path"))))
    given = given.when(n.isin(2, 6), patch).when(n == 3, F.to_json(F.struct(url.alias("filename")))).when(n == 4, F.to_json(F.struct(F.when(F.length(url) <= 100, F.concat(F.repeat(F.lit("p"), 500), url)).alias("filePath"))))
    given = given.otherwise(F.to_json(F.struct(F.lit("").alias("file_path"), url.alias("path"))))
    name = F.when(n == 2, "apply_patch").when(n == 6, "my_patcher").otherwise("Read")
    return table(spark, sf_dir, "pages").select("page_id", T.call_path(name, given).alias("path"))


@BOOK.add("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) + 1500 * (doc_id % 3) AS BIGINT) AS tokens FROM documents")
def estimated_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text"), F.col("doc_id") % 3).alias("tokens"))


_N = len(T.INJECTED) + 1
_OPENED = " ".join(f"WHEN {i} THEN '{source}'" for i, (_, source) in enumerate(T.INJECTED))


@BOOK.add(f"""SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, CASE (conv_id * 7 + turn) % {_N} {_OPENED} END AS source,
CASE conv_id % 3 WHEN 0 THEN 'automation:codex-exec' WHEN 1 THEN 'automation:claude-sdk-cli' END AS sender FROM conversations""")
def message_origin(spark, sf_dir):
    n = F.col("conv_id")
    openings = F.array(*[F.lit(o) for o, _ in T.INJECTED], F.lit("said: "))
    text = F.concat(F.lit(" "), F.element_at(openings, ((n * 7 + F.col("turn")) % _N + 1).cast("int")), "text")
    sender = T.sender(F.when(n % 3 == 0, "codex_exec"), F.when(n % 3 == 1, "sdk-cli").otherwise("cli"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), T.injected_source(text).alias("source"), sender.alias("sender"))


@BOOK.add("""SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, lower(trim(regexp_replace(concat(text, ' @'), '\\s+', ' ', 'g'))) AS template_key FROM conversations""")
def template_key(spark, sf_dir):
    text = F.concat(F.lit("<system-reminder>be\nbrief</system-reminder>\n "), "text", F.lit("\n @⟦notes.md⟧(docs/notes.md)"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), T.template_key(text).alias("template_key"))


@BOOK.add("""WITH a AS (SELECT doc_id, text, greatest(1, strpos(lower(text), 'tion')) AS p FROM documents),
b AS (SELECT *, greatest(1, p - 90) AS s, least(length(text), p + 133) AS e FROM a)
SELECT doc_id, concat(CASE WHEN s > 1 THEN '…' ELSE '' END, substr(text, s, e - s + 1), CASE WHEN e < length(text) THEN '…' ELSE '' END) AS snippet FROM b""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("TION")).alias("snippet"))


_CONCEPT_ROWS = ", ".join(f"('{w}', '{c}')" for w, c in T.CONCEPTS.items())
_CONCEPT_WORDS = sorted(T.CONCEPTS)


@BOOK.add(f"""WITH c(word, concept) AS (VALUES {_CONCEPT_ROWS}), n AS (SELECT word, concept, row_number() OVER (ORDER BY word) - 1 AS i FROM c),
w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS word FROM part UNION SELECT word FROM n JOIN (SELECT DISTINCT event_id % {len(_CONCEPT_WORDS)} AS i FROM events) e ON e.i = n.i)
SELECT w.word, coalesce(c.concept, regexp_replace(regexp_replace(regexp_replace(w.word, 'ing$', ''), 'ed$', ''), 's$', '')) AS concept FROM w LEFT JOIN c ON c.word = w.word""")
def concept_words(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    listed = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, _CONCEPT_WORDS)), (F.col("event_id") % len(_CONCEPT_WORDS) + 1).cast("int")).alias("word"))
    return names.union(listed).distinct().select("word", T.concept_word(F.upper("word")).alias("concept"))


@BOOK.add("SELECT doc_id, sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END, lang)) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    some = F.when(F.col("doc_id") % 2 == 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("doc_id"), some, F.col("lang")).alias("hash"))


@BOOK.add("""SELECT page_id, 'git.example' AS host, concat('org', CAST(page_id % 7 AS VARCHAR)) AS owner, 'repo' AS repo, CAST(page_id + n AS BIGINT) AS number FROM pages, (VALUES (0), (1)) v(n)""")
def pull_requests(spark, sf_dir):
    link = lambda n: F.concat(F.lit("https://git.example/org"), (F.col("page_id") % 7).cast("string"), F.lit("/repo/pull/"), (F.col("page_id") + n).cast("string"))
    text = F.concat(F.lit("see "), link(0), F.lit(" and "), link(1), F.lit(", "), link(0), F.lit(" again; not https://git.example/org/pull/x"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.pull_requests(text)).alias("p")).select("page_id", "p.*")


@BOOK.add(f"""WITH {EV}, f AS (SELECT event_id, k % 8 AS n, concat('src/', CAST(k AS VARCHAR), '.py') AS path FROM ev)
SELECT event_id, path, CASE n WHEN 0 THEN 'modified' WHEN 1 THEN 'written' WHEN 5 THEN 'written' ELSE 'deleted' END AS status FROM f WHERE n IN (0, 1, 2, 5) UNION ALL SELECT event_id, concat(path, 'x'), 'added' FROM f WHERE n = 2""")
def changed_files(spark, sf_dir):
    """Edits, writes and patches; writes outside both roots, below the second root, tools with a patch in their name and other tools."""
    n = F.col("k") % 8
    path = F.concat(F.lit("src/"), F.col("k").cast("string"), F.lit(".py"))
    at = F.when(n == 4, "/else/").when(n == 5, "/repo/./lib/../").when(n == 7, "../").otherwise("/work/")
    whole = F.to_json(F.struct(F.concat(at, path).alias("file_path")))
    patch = F.concat(F.lit('{"patch": "*** Begin Patch\\n*** Delete File: '), path, F.lit("\\n*** Add File: /work/"), path, F.lit('x\\n+new"}'))
    name = F.when(n.isin(0, 7), "Edit").when(n.isin(1, 4, 5), "Write").when(n == 2, "apply_patch").when(n == 6, "dispatch_patch").otherwise("NotebookEdit")
    files = T.changed_files(name, F.when(n.isin(2, 6), patch).otherwise(whole), F.lit("/work"), F.lit("/repo"))
    return events(spark, sf_dir).select("event_id", F.explode(files).alias("f")).select("event_id", "f.path", "f.status")


@BOOK.add("""SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, CASE conv_id % 6 WHEN 0 THEN 'peer_message' WHEN 1 THEN 'compaction_summary' WHEN 2 THEN 'skill' WHEN 3 THEN 'harness' WHEN 4 THEN 'interruption' END AS claude,
CASE conv_id % 4 WHEN 0 THEN 'turn_aborted' WHEN 1 THEN 'skills.list' END AS codex, CASE WHEN conv_id % 5 = 0 THEN 'automation:codex-exec' END AS sender FROM conversations""")
def flagged_origin(spark, sf_dir):
    """Where injected text comes from by its event's flags and its item's kind, and scripted sessions by their source."""
    n, m = F.col("conv_id") % 6, F.col("conv_id") % 4
    event = F.when(n == 0, '{"origin":{"kind":"peer"},"isMeta":true}').when(n == 1, '{"isCompactSummary":true,"isMeta":true}').when(n.isin(2, 3), '{"isMeta":true}').otherwise('{"isMeta":false}')
    text = F.concat(F.when(n == 2, "\nBase directory for this skill: ").when(n == 4, "[Request interrupted by user] ").when(n == 5, "[Image: ").otherwise("said "), "text")
    block = F.concat(F.when(m.isin(0, 2), "<turn_aborted>").otherwise("said "), "text")
    kind = F.when(m == 1, "skills.list").when(m == 2, "user.text").when(m == 3, "")
    sender = T.sender(F.lit("cli"), F.lit("cli"), F.when(F.col("conv_id") % 5 == 0, "exec").otherwise("vscode"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), T.claude_injected(text, event).alias("claude"), T.codex_injected(block, kind).alias("codex"), sender.alias("sender"))


@BOOK.add("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def timestamp_shapes(spark, sf_dir):
    """Years, epochs of seconds and milliseconds, dates, zones, and times without seconds."""
    n, ts = F.col("event_id") % 6, F.col("ts").cast("timestamp")
    text = F.when(n == 0, F.date_format(ts, "yyyy")).when(n == 1, F.unix_seconds(ts).cast("string")).when(n == 2, F.concat(F.unix_seconds(ts).cast("string"), F.lit("000")))
    text = text.when(n == 3, F.date_format(ts, "yyyy-MM-dd")).when(n == 4, F.concat(F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200"))).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(dates.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@BOOK.add(f"""WITH {LEDGER} SELECT event_id, CASE WHEN k % 5 = 0 THEN 'unavailable' WHEN total_tokens > input_tokens + outp THEN 'reported-partial' ELSE 'reported-reconciled' END AS status,
CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE greatest(0, total_tokens - input_tokens - outp) END AS BIGINT) AS unclassified FROM led""")
def session_status(spark, sf_dir):
    total = F.when(F.col("k") % 5 != 0, F.col("total_tokens"))
    out = T.session_status(total, F.col("input_tokens") + F.col("output_tokens"))
    return ledger(spark, sf_dir).select("event_id", out.alias("s")).select("event_id", "s.status", F.col("s.unclassified").cast("long").alias("unclassified"))


@BOOK.add(f"WITH {MESSAGES} SELECT id, CAST(secs - lag(secs) OVER (PARTITION BY conversation_id ORDER BY secs, id) AS DOUBLE) AS gap_seconds FROM msg WHERE role = 'user'")
def since_previous(spark, sf_dir):
    return authorship.since_previous(messages(spark, sf_dir).where("role = 'user'")).select("id", "gap_seconds")


@BOOK.add("""WITH d AS (SELECT doc_id AS id, doc_id * 60 AS secs, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
r AS (SELECT id, secs, p, array_to_string(list_slice(ws, p + 1, p + 8), ' ') AS s FROM (SELECT *, unnest(range(len(ws) - 7)) AS p FROM d WHERE len(ws) >= 8))
SELECT u.id, CAST(u.p AS INTEGER) AS pos, max(a.secs) AS agent_secs FROM r u JOIN r a ON a.s = u.s AND a.id % 2 = 1 AND a.secs < u.secs AND a.secs >= u.secs - 172800 WHERE u.id % 2 = 0 GROUP BY 1, 2""")
def copied_documents(spark, sf_dir):
    """Documents of even ids as what people sent, of odd ids as what agents said, a minute apart."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("c").alias("conversation_id"), "text", F.timestamp_seconds(F.col("doc_id") * 60).alias("sent_at"))
    out = authorship.copied_shingles(d.where("id % 2 = 0"), d.where("id % 2 = 1"))
    return out.where("agent_ref is not null").select("id", "pos", F.col("agent_ref.secs").alias("agent_secs"))


@BOOK.add(f"WITH {TASKS} SELECT flavor, count(*) AS tasks FROM tasks WHERE created_at >= TIMESTAMP '2000-01-01' AND created_at < TIMESTAMP '2001-06-01' AND created_at >= TIMESTAMP '2001-07-01' - INTERVAL 300 DAY GROUP BY 1")
def window_filter(spark, sf_dir):
    kept = workflow.window_filter(tasks(spark, sf_dir), "2000-01-01", "2001-06-01", 300, "2001-07-01")
    return kept.groupBy("flavor").agg(F.count(F.lit(1)).alias("tasks"))


@BOOK.add(f"""WITH {TASKS}, n AS (SELECT flavor, version, row_number() OVER (PARTITION BY flavor ORDER BY created_at DESC, version DESC) AS r FROM tasks)
SELECT t.task_id, t.flavor, t.version FROM tasks t JOIN n ON n.flavor = t.flavor AND n.version = t.version AND n.r = 1""")
def current_definitions(spark, sf_dir):
    return workflow.current_definitions(tasks(spark, sf_dir)).select("task_id", "flavor", "version")


@BOOK.add(f"""WITH {TASKS}, d AS (SELECT flavor, version, min(created_at) AS f FROM tasks GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY flavor ORDER BY f, version) AS r FROM d),
b AS (SELECT CAST(make_date(y, 1, 1) AS TIMESTAMP) AS s FROM (SELECT DISTINCT CAST(year(created_at) AS INTEGER) AS y FROM tasks)), l AS (SELECT s, lead(s) OVER (ORDER BY s) AS e FROM b)
SELECT strftime(s, '%Y') AS burst, flavor, version, f > s AS during FROM n JOIN l ON f >= s AND (e IS NULL OR f < e) WHERE r > 1""")
def definition_changes(spark, sf_dir):
    """Definitions new in each year, the years standing in for bursts."""
    t = tasks(spark, sf_dir)
    years = t.select(F.date_trunc("year", "created_at").alias("started_at")).distinct()
    return workflow.definition_changes(t, years).select(F.date_format("started_at", "yyyy").alias("burst"), "flavor", "version", "during")


def _reports(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("conversation_id"), F.lit("main").alias("stream"), (F.col("event_id") % 300).cast("string").alias("request_key"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("model"),
        (F.col("k") % 2).alias("input_tokens"), F.col("k").alias("output_tokens"), (F.col("k") % 2 + F.col("k")).alias("total_tokens"), F.lit(None).cast("string").alias("native_id"))


@BOOK.add(f"""WITH {EV}, g AS (SELECT user_id, CAST(event_id % 300 AS VARCHAR) AS r, min(event_id) AS first_idx, max_by(event_type, event_id) AS model, max_by(k, event_id) AS outp, max_by(k % 2 + k, event_id) AS total FROM ev GROUP BY 1, 2)
SELECT user_id AS conversation_id, r AS request_key, first_idx, model, outp AS output_tokens FROM g WHERE total > 0""")
def model_requests(spark, sf_dir):
    return tools.model_requests(_reports(spark, sf_dir)).select("conversation_id", "request_key", "first_idx", "model", "output_tokens")


@BOOK.add(f"""WITH {EV}, r AS (SELECT user_id AS u, event_id AS i, k % 2 AS inp, k AS outp FROM ev WHERE event_type IN ('view', 'purchase')), t AS (SELECT user_id AS u, event_id AS i FROM ev WHERE event_type = 'error'),
e AS (SELECT r.*, (SELECT count(*) FROM t WHERE t.u = r.u AND t.i < r.i) AS tb FROM r), w AS (SELECT *, lag(inp) OVER p = inp AND lag(tb) OVER p = tb AS same FROM e WINDOW p AS (PARTITION BY u ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY u ORDER BY i) AS island FROM w)
SELECT u AS conversation_id, min(i) AS first_idx, max(inp) AS input_tokens, max(outp) AS output_tokens FROM g GROUP BY u, island""")
def merge_anonymous(spark, sf_dir):
    e = _reports(spark, sf_dir).withColumnsRenamed({"idx": "first_idx", "created_at": "requested_at"}).withColumn("request_key", F.col("first_idx").cast("string"))
    turns = e.where("model = 'error'").select("conversation_id", "stream", F.col("first_idx").alias("idx"))
    return tools.merge_anonymous(e.where("model in ('view', 'purchase')"), turns).select("conversation_id", "first_idx", "input_tokens", "output_tokens")


@BOOK.add(f"WITH {EV} SELECT CAST(user_id % 3 AS VARCHAR) AS installation_id, CAST(k AS VARCHAR) AS attempt_id, CAST(sum(k) AS BIGINT) AS total_tokens, round(sum(value), 4) AS token_cost FROM ev WHERE event_id % 4 > 0 GROUP BY 1, 2")
def attempt_usage(spark, sf_dir):
    parts = F.concat_ws(":", (F.col("user_id") % 3).cast("string"), F.col("k").cast("string"), F.when(F.col("event_id") % 4 > 0, F.lit("run.jsonl")))
    usage = events(spark, sf_dir).select(parts.alias("native_id"), F.col("k").alias("total_tokens"), F.col("value").alias("cost_usd"))
    return workflow.attempt_usage(usage).withColumn("token_cost", F.round("token_cost", 4))


@BOOK.add(f"""WITH {CALLS} SELECT 'metrics' AS asked, tool, status AS value, count(*) AS calls, CAST(sum(duration_ms) AS DOUBLE) AS total, CAST(min(duration_ms) AS DOUBLE) AS least, CAST(max(duration_ms) AS DOUBLE) AS most, round(avg(duration_ms), 4) AS mean FROM calls GROUP BY tool, status
UNION ALL SELECT 'distinct', NULL, error_type, count(*), NULL, NULL, NULL, NULL FROM calls WHERE error_type IS NOT NULL GROUP BY error_type
UNION ALL SELECT 'stats', NULL, 'duration_ms', count(duration_ms), NULL, CAST(min(duration_ms) AS DOUBLE), CAST(max(duration_ms) AS DOUBLE), NULL FROM calls""")
def cube_answers(spark, sf_dir):
    """Metrics, distinct values and statistics, answered by the cube alone."""
    calls = tool_calls(spark, sf_dir)
    cube = tools.tool_call_cube(calls, ["workspace_id", "day", "tool", "status", "error_type"], ["path"], ["duration_ms"])
    metrics = tools.answer_metrics(calls, cube, ["tool", "status"], {"calls": ("count", None), "total": ("sum", "duration_ms"), "least": ("min", "duration_ms"), "most": ("max", "duration_ms"), "mean": ("avg", "duration_ms")})
    values = tools.answer_distinct(calls, cube, "error_type")
    stats = tools.answer_stats(calls, cube, "duration_ms")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    real = lambda c: F.col(c).cast("double").alias(c)
    out = metrics.select(F.lit("metrics").alias("asked"), "tool", F.col("status").alias("value"), "calls", real("total"), real("least"), real("most"), F.round("mean", 4).alias("mean"))
    out = out.unionByName(values.select(F.lit("distinct").alias("asked"), none.alias("tool"), F.col("value"), "calls", *[number.alias(c) for c in ("total", "least", "most", "mean")]))
    return out.unionByName(stats.select(F.lit("stats").alias("asked"), none.alias("tool"), F.lit("duration_ms").alias("value"), F.col("n").alias("calls"), number.alias("total"), real("least"), real("most"), number.alias("mean")))
