"""Queries over tool calls: requests, results, context cost, cube and rollup, commands and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import text as T
from ledgerfold.operators import addresses, shell, tools
from ledgerfold.plans.book import Book
from ledgerfold.plans.standins import CALLS, table, tool_calls

BOOK = Book()


def stream(spark, sf_dir, *kinds):
    """Events of a user as one stream, in order of event_id."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds)) if kinds else table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("conversation_id"), F.lit("main").alias("stream"), F.col("event_id").alias("idx"), F.col("event_id").cast("string").alias("key"), F.floor(F.col("value") * 10).cast("long").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", F.col("ts").alias("created_at"))


def requests(spark, sf_dir):
    r = stream(spark, sf_dir, "view", "purchase")
    return r.select("conversation_id", "stream", F.col("idx").alias("first_idx"), F.col("key").alias("request_key"), F.lit("m").alias("model"), F.col("created_at").alias("requested_at"), F.col("v").alias("input_tokens"), F.col("k").alias("output_tokens"), (F.col("v") + F.col("k")).alias("total_tokens"), F.lit(None).cast("string").alias("native_id"))


R = "r AS (SELECT user_id AS u, event_id AS i, CAST(floor(value * 10) AS BIGINT) AS inp, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS outp FROM events WHERE event_type IN ('view', 'purchase'))"


@BOOK.add("""WITH c AS (SELECT user_id, k, min(event_id) AS i FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events) WHERE event_type = 'click' GROUP BY 1, 2),
r AS (SELECT user_id, k, min(event_id) AS i FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events) WHERE event_type = 'view' GROUP BY 1, 2)
SELECT c.user_id AS conversation_id, c.k AS call_id, c.i AS idx, r.i AS result_idx FROM c LEFT JOIN r ON c.user_id = r.user_id AND c.k = r.k""")
def pair_calls_results(spark, sf_dir):
    s = stream(spark, sf_dir, "click", "view")
    m = s.select("conversation_id", "stream", "idx", F.when(F.col("event_type") == "click", "tool_call").otherwise("tool_result").alias("kind"), F.col("k").cast("int").alias("call_id"))
    return tools.pair_calls_results(m).select("conversation_id", "call_id", "idx", "result_idx")


@BOOK.add(f"""WITH {R}, m AS (SELECT user_id AS u, event_id AS i FROM events WHERE event_type = 'error'), e AS (SELECT r.*, (SELECT count(*) FROM m WHERE m.u = r.u AND m.i < r.i) AS epoch FROM r),
w AS (SELECT *, lag(epoch) OVER (PARTITION BY u ORDER BY i) AS pe, lag(inp) OVER (PARTITION BY u ORDER BY i) AS pi, lag(outp) OVER (PARTITION BY u ORDER BY i) AS po FROM e)
SELECT CAST(i AS VARCHAR) AS request_key, CAST(epoch AS BIGINT) AS epoch, CASE WHEN pe = epoch THEN inp - pi - po END AS context_growth FROM w""")
def context_growth(spark, sf_dir):
    return tools.context_growth(requests(spark, sf_dir), stream(spark, sf_dir, "error")).select("request_key", F.col("epoch").cast("long").alias("epoch"), "context_growth")


@BOOK.add(f"WITH {R}, c AS (SELECT user_id AS u, event_id AS i FROM events WHERE event_type = 'click') SELECT c.i AS idx, CAST(min(r.i) AS VARCHAR) AS request_key FROM c LEFT JOIN r ON r.u = c.u AND r.i >= c.i GROUP BY c.i")
def asof_forward(spark, sf_dir):
    calls = stream(spark, sf_dir, "click").withColumn("event_key", F.lit(None).cast("string"))
    return tools.asof_forward(calls, requests(spark, sf_dir)).select("idx", "request_key")


@BOOK.add(f"""WITH {R}, m AS (SELECT user_id AS u, event_id AS i FROM events WHERE event_type = 'error'), c AS (SELECT user_id AS u, event_id AS i FROM events WHERE event_type = 'click'),
lim AS (SELECT c.u, c.i, min(m.i) AS stop FROM c LEFT JOIN m ON m.u = c.u AND m.i > c.i GROUP BY 1, 2)
SELECT lim.i AS idx, CAST(min(r.i) AS VARCHAR) AS next_key, count(CASE WHEN r.i IS NOT NULL AND (stop IS NULL OR r.i < stop) THEN 1 END) AS carried FROM lim LEFT JOIN r ON r.u = lim.u AND r.i > lim.i GROUP BY lim.i""")
def next_request(spark, sf_dir):
    r = tools.context_growth(requests(spark, sf_dir), stream(spark, sf_dir, "error"))
    c = stream(spark, sf_dir, "click")
    marks = stream(spark, sf_dir, "error").select("conversation_id", "stream", F.col("idx"), F.lit(1).alias("mark"))
    both = c.withColumn("mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    from pyspark.sql import Window

    w = Window.partitionBy("conversation_id", "stream").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    calls = both.withColumn("result_epoch", F.sum("mark").over(w)).where("mark = 0").select("conversation_id", "stream", "idx", F.col("idx").alias("result_idx"), F.lit(None).cast("string").alias("request_key"), "result_epoch")
    return tools.next_request(calls, r).select("idx", "next_key", "carried")


@BOOK.add(f"""WITH {R}, c AS (SELECT c.user_id AS u, c.event_id AS i, (SELECT min(r.i) FROM r WHERE r.u = c.user_id AND r.i >= c.event_id) AS q FROM events c WHERE event_type = 'click')
SELECT c.i AS idx, CASE WHEN q IS NOT NULL THEN count(*) OVER (PARTITION BY c.u, q) END AS parallel, round(CAST(r.outp AS DOUBLE) / count(*) OVER (PARTITION BY c.u, q), 6) AS call_output_tokens FROM c LEFT JOIN r ON r.i = c.q""")
def parallel_share(spark, sf_dir):
    r = requests(spark, sf_dir)
    calls = tools.asof_forward(stream(spark, sf_dir, "click").withColumn("event_key", F.lit(None).cast("string")), r)
    return tools.parallel_share(calls, r).select("idx", "parallel", F.round("call_output_tokens", 6).alias("call_output_tokens"))


@BOOK.add(f"""WITH {R}, g AS (SELECT u, i, inp - lag(inp) OVER (PARTITION BY u ORDER BY i) - lag(outp) OVER (PARTITION BY u ORDER BY i) AS growth FROM r),
c AS (SELECT c.user_id AS u, c.event_id AS i, 1 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS est, (SELECT min(r.i) FROM r WHERE r.u = c.user_id AND r.i > c.event_id) AS q FROM events c WHERE event_type = 'click'),
j AS (SELECT c.*, g.growth, sum(est) OVER (PARTITION BY c.u, q) AS total FROM c LEFT JOIN g ON g.i = c.q)
SELECT i AS idx, CAST(CASE WHEN q IS NOT NULL AND growth > 0 THEN round(growth * est / CAST(total AS DOUBLE)) ELSE est END AS BIGINT) AS result_tokens, CASE WHEN q IS NOT NULL AND growth > 0 THEN 'measured' ELSE 'estimated' END AS result_tokens_source FROM j""")
def result_share(spark, sf_dir):
    r = tools.context_growth(requests(spark, sf_dir), stream(spark, sf_dir, "error").limit(0)).withColumn("prompt_estimate", F.lit(0))
    c = stream(spark, sf_dir, "click").select("conversation_id", "stream", "idx", F.col("idx").alias("result_idx"), F.lit(None).cast("string").alias("request_key"), F.lit(0).alias("result_epoch"), (F.col("k") + 1).alias("estimate"))
    return tools.result_share(tools.next_request(c, r), r).select("idx", "result_tokens", "result_tokens_source")


@BOOK.add(f"WITH {CALLS} SELECT workspace_id, day, tool, status, error_type, path IS NOT NULL AS has_path, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS duration_ms_sum, min(duration_ms) AS duration_ms_min, max(duration_ms) AS duration_ms_max, count(duration_ms) AS duration_ms_n FROM calls GROUP BY 1, 2, 3, 4, 5, 6".replace("workspace_id, day, tool", "workspace_id, strftime(day, '%Y-%m-%d') AS day, tool"))
def tool_call_cube(spark, sf_dir):
    cube = tools.tool_call_cube(tool_calls(spark, sf_dir), ["workspace_id", "day", "tool", "status", "error_type"], ["path"], ["duration_ms"])
    return cube.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@BOOK.add(f"""WITH {CALLS} SELECT strftime(day, '%Y-%m-%d') AS day, tool, count(*) AS calls, count(CASE WHEN status = 'error' THEN 1 END) AS errors, count(CASE WHEN error_type = 'timeout' THEN 1 END) AS timeouts, count(CASE WHEN error_type = 'user_rejected' THEN 1 END) AS rejected,
count(DISTINCT workspace_id) AS works, round(avg(duration_ms), 4) AS avg_duration_ms, round(count(CASE WHEN status = 'error' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM calls GROUP BY 1, 2""")
def tool_usage_daily(spark, sf_dir):
    cube = tools.tool_call_cube(tool_calls(spark, sf_dir), ["workspace_id", "day", "tool", "status", "error_type"], ["path"], ["duration_ms"])
    out = tools.tool_usage_daily(cube, ["tool"])
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "avg_duration_ms": F.round("avg_duration_ms", 4), "error_rate": F.round("error_rate", 6)})


@BOOK.add(f"WITH {CALLS} SELECT tool, count(*) AS calls, count(CASE WHEN status = 'error' THEN 1 END) AS failures, round(avg(duration_ms), 4) AS avg_ms, max(result_bytes) AS largest FROM calls GROUP BY 1")
def call_stats(spark, sf_dir):
    return tools.call_stats(tool_calls(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 4))


@BOOK.add("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'web' ELSE 'mcp' END AS category, CASE page_id % 3 WHEN 2 THEN 'git' END AS server FROM pages""")
def tool_category(spark, sf_dir):
    name = F.element_at(F.array(F.lit("Bash"), F.lit("WebFetch"), F.lit("mcp__git__log")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.tool_category(name, F.lit("tool_call")).alias("category"), T.mcp_server(name).alias("server"))


@BOOK.add("""WITH e AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k % 7 = 0 AND k % 3 <> 1 THEN 'error' WHEN k % 3 = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 3 = 1 THEN 'interrupted' WHEN k % 7 = 0 THEN 'nonzero_exit' END AS error_type, CAST(CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS exit_code FROM e""")
def tool_outcome(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    details = F.to_json(F.struct(F.when(k % 7 == 0, 2).otherwise(0).alias("exitCode"), (k % 3 == 1).alias("interrupted")))
    out = T.tool_outcome(F.lit("some text"), F.lit(False), details, F.lit(True), F.lit("make"), F.lit("command"))
    return table(spark, sf_dir, "events").select("event_id", out.alias("o")).select("event_id", "o.status", "o.error_type", "o.exit_code")


#: What the commands of each kind of page read as: kind, position, operator, program, subcommand, category, is_primary.
COMMAND_ROWS = [
    (0, 0, "", "curl", "", "network", True), (0, 1, "|", "jq", "", "read", False),
    (1, 0, "", "cd", "", "shell", False), (1, 1, "&&", "git", "log", "vcs", True), (1, 2, "||", "echo", "", "shell", False),
    (2, 0, "", "tee", "", "file-write", True), (2, 1, ";", "python3", "-m pytest", "test", False),
    (3, 0, "", "wget", "", "network", True), (3, 1, "&", "sleep", "", "shell", False),
    (4, 0, "", "npm", "run build", "build", True), (4, 1, "script", "echo", "", "shell", False), (4, 2, ";", "rg", "", "search", False),
    (5, 0, "", "git", "commit", "vcs", True), (5, 1, "&&", "git", "push", "vcs", False),
]
_FLAGS = {0: (True, False, False, False), 1: (False, True, False, False), 2: (False, True, True, False), 3: (False, False, False, True), 4: (False, False, False, False), 5: (False, False, True, False)}
_EXPECTED = ", ".join(f"({k}, {p}, '{o}', '{g}', '{s}', '{c}', {m}, {', '.join(map(str, _FLAGS[k]))})" for k, p, o, g, s, c, m in COMMAND_ROWS)


@BOOK.add(f"""SELECT CAST(page_id AS VARCHAR) AS call_id, e.* EXCLUDE (kind) FROM pages JOIN (VALUES {_EXPECTED}) e(kind, position, operator, program, subcommand, category, is_primary, has_pipe, has_redirect, has_heredoc, is_backgrounded) ON page_id % 6 = kind""")
def shell_commands(spark, sf_dir):
    url = F.regexp_replace("url", "['\"\\\\]", "")
    said = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    kind = F.col("page_id") % 6
    line = (
        F.when(kind == 0, said("FOO=1 timeout 30 curl -sS '", url, "' | jq .")).when(kind == 1, said("cd /srv && git -C lib log '", url, "' > log.txt || echo \"", url, "; none\""))
        .when(kind == 2, said("tee page.txt > copy.txt <<'END'\n", url, " | a && b\nit's; text\nEND\nenv -i X=1 python3 -m pytest -q tests")).when(kind == 3, said("sudo wget -q '", url, "' & sleep 2"))
        .when(kind == 5, said("git commit -m \"$(cat <<'EOF'\nMend ", url, "; don't break\nEOF\n)\" && git push"))
    )
    script = said('await tools.exec_command({cmd:"npm run build"}); run({cmd: `echo (a; b); rg -n x`}) // ', url)
    given = F.when(kind == 3, F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), line).alias("command")))).when(kind == 4, script).otherwise(F.to_json(F.struct(line.alias("command"))))
    calls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.lit("exec").alias("tool"), given.alias("input"), F.lit(None).cast("string").alias("details"))
    out = shell.shell_commands(shell.call_commands(calls))
    return out.select("call_id", "position", "operator", "program", "subcommand", "category", "is_primary", "has_pipe", "has_redirect", "has_heredoc", "is_backgrounded")


@BOOK.add("""WITH p AS (SELECT page_id, page_id % 4 AS k, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), f(k, position, host, source) AS (VALUES (0, 0, NULL, 'command'), (1, 0, NULL, 'input'), (1, 1, 'shown.example', 'search_result'), (2, 0, NULL, 'command'), (2, 1, 'second.example', 'command'))
SELECT CAST(page_id AS VARCHAR) AS call_id, position, coalesce(f.host, lower(p.host)) AS host, source FROM p JOIN f ON p.k = f.k""")
def tool_urls(spark, sf_dir):
    kind = F.col("page_id") % 4
    none = F.lit(None).cast("string")
    url = F.regexp_extract("url", r"^[^\s\"'<>`\\|{}^\[\]]*", 0)
    said = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    command = F.when(kind == 0, said("U='", url, "'\ncurl $U")).when(kind == 2, said("BASE=", url, "\nexport A=\"$BASE\"\nX=https://unused.example\nnode -e \"fetch(process.env.A)\" https://second.example"))
    command = command.when(kind == 3, said("prefetch(", url, ")\necho ", url, "\nreopen ", url))
    arguments = F.when(kind == 1, F.to_json(F.struct(F.struct(F.array(url).alias("urls")).alias("page"), F.lit("https://prompt.example").alias("prompt"))))
    result = F.when(kind == 1, F.lit("<https://shown.example>."))
    c = table(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.when(kind == 1, "web").otherwise("shell").alias("category"), arguments.alias("arguments"), command.alias("command"), F.coalesce(result, none).alias("result"))
    return addresses.tool_urls(c).select("call_id", "position", "host", "source")
