"""The library's input tables, derived from the star tables: each stands in for a table of transcripts or workflow runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(factor: int):
    return F.floor(F.col("value") * factor).cast("long")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage ledger: a session per user, a model per event type, token counters from the value."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").alias("session_id"), (F.col("user_id") % 20).alias("workspace_id"), F.col("ts").cast("timestamp").alias("created_at"), F.date_trunc("hour", "ts").cast("timestamp").alias("usage_hour"), F.to_date("ts").alias("day"),
        F.concat(F.lit("claude-"), "event_type", F.lit("-20240115")).alias("model"), F.col("event_type").alias("provider"), k.alias("k"), F.when(k % 10 == 0, "session-start").otherwise("request").alias("attribution"),
        _part(100).alias("total_tokens"), _part(80).alias("input_tokens"), _part(40).alias("uncached_input_tokens"), _part(30).alias("cache_read_input_tokens"), _part(10).alias("cache_creation_input_tokens"),
        F.when(k % 2 == 1, _part(5)).otherwise(F.lit(0)).cast("long").alias("cache_creation_1h_input_tokens"), _part(20).alias("output_tokens"), F.when(k == 7, 1).otherwise(0).cast("long").alias("unclassified_tokens"),
    )


LEDGER = """led AS (
  SELECT event_id, user_id AS session_id, user_id % 20 AS workspace_id, ts AS created_at, date_trunc('hour', ts) AS usage_hour, CAST(ts AS DATE) AS day,
    event_type AS family, event_type AS provider, k, CASE WHEN k % 10 = 0 THEN 'session-start' ELSE 'request' END AS attribution,
    CAST(floor(value * 100) AS BIGINT) AS total_tokens, CAST(floor(value * 80) AS BIGINT) AS input_tokens, CAST(floor(value * 40) AS BIGINT) AS uncached,
    CAST(floor(value * 30) AS BIGINT) AS rd, CAST(floor(value * 10) AS BIGINT) AS wr, CASE WHEN k % 2 = 1 THEN CAST(floor(value * 5) AS BIGINT) ELSE 0 END AS wr1h,
    CAST(floor(value * 20) AS BIGINT) AS outp, CASE WHEN k = 7 THEN 1 ELSE 0 END AS uncl
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""

#: Prices in USD per million tokens, and aliases; ``today`` is the last day of the data.
PRICES = [
    ("view", "2024-01-01", 10.0, 1.0, 12.5, 20.0, 50.0, False),
    ("view", "2024-01-16", 5.0, 0.5, 6.25, 10.0, 25.0, False),
    ("click", "2024-01-05", 3.0, 0.3, 3.75, 6.0, 15.0, False),
    ("purchase", "2024-01-01", 15.0, 1.5, None, 30.0, 75.0, False),
    ("error", "2024-01-10", 1.0, 0.1, 1.25, 2.0, 5.0, True),
]
ALIASES = [("signup", "view", "2024-01-10"), ("view", "view", "2024-01-01")]
TODAY = "2024-01-30"


def prices(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    lit = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"{x}D" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else f"'{x}'"
    rows = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in PRICES)
    p = spark.sql(f"SELECT model_key, to_date(d) AS effective_from, input, cache_read, cache_write_5m, cache_write_1h, output, assumption, 'confirmed' AS status FROM VALUES {rows} AS t(model_key, d, input, cache_read, cache_write_5m, cache_write_1h, output, assumption)")
    rows = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in ALIASES)
    return p, spark.sql(f"SELECT alias, target, to_date(d) AS effective_from FROM VALUES {rows} AS t(alias, target, d)")


def _sql(rows: list[tuple]) -> str:
    lit = lambda x: "CAST(NULL AS DOUBLE)" if x is None else str(x) if isinstance(x, bool | float) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


#: ``priced``: the ledger with the resolved model and costs on the day and today.
PRICED = f"""{LEDGER},
price AS (SELECT model_key, CAST(d AS DATE) AS a, CAST(lead(d) OVER (PARTITION BY model_key ORDER BY d) AS DATE) AS z, i, r, w5, w1, o, assumed
  FROM (VALUES {_sql(PRICES)}) t(model_key, d, i, r, w5, w1, o, assumed)),
resolved AS (SELECT *, CASE WHEN family = 'signup' AND day >= DATE '2024-01-10' THEN 'view' ELSE family END AS priced_model FROM led),
rated AS (
  SELECT l.*, p.i, p.r, p.w5, p.w1, p.o, p.assumed, q.i AS i2, q.r AS r2, q.w5 AS w52, q.w1 AS w12, q.o AS o2
  FROM resolved l LEFT JOIN price p ON l.priced_model = p.model_key AND l.day >= p.a AND (p.z IS NULL OR l.day < p.z)
  LEFT JOIN price q ON l.priced_model = q.model_key AND DATE '{TODAY}' >= q.a AND (q.z IS NULL OR DATE '{TODAY}' < q.z)),
priced AS (SELECT *,
  CASE WHEN i IS NULL AND r IS NULL AND w5 IS NULL AND w1 IS NULL AND o IS NULL THEN NULL ELSE
    coalesce(uncached * i / 1e6, 0) + coalesce(rd * r / 1e6, 0) + coalesce((wr - wr1h) * w5 / 1e6, 0) + coalesce(wr1h * w1 / 1e6, 0) + coalesce(outp * o / 1e6, 0) END AS cost_usd,
  CASE WHEN i2 IS NULL AND r2 IS NULL AND w52 IS NULL AND w12 IS NULL AND o2 IS NULL THEN NULL ELSE
    coalesce(uncached * i2 / 1e6, 0) + coalesce(rd * r2 / 1e6, 0) + coalesce((wr - wr1h) * w52 / 1e6, 0) + coalesce(wr1h * w12 / 1e6, 0) + coalesce(outp * o2 / 1e6, 0) END AS cost_today_usd,
  CASE WHEN i IS NULL AND r IS NULL AND w5 IS NULL AND w1 IS NULL AND o IS NULL THEN 'unpriced'
    WHEN (wr - wr1h > 0 AND w5 IS NULL) OR uncl > 0 THEN 'partial' WHEN assumed THEN 'assumed' ELSE 'priced' END AS price_status
  FROM rated)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: a conversation per conv_id, one minute between turns, an hour between conversations."""
    secs = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("conversation_id"), (F.col("conv_id") % 10).cast("string").alias("workspace_id"), F.col("turn").alias("source_order"),
        "role", F.lit("text").alias("kind"), "text", F.timestamp_seconds(secs).alias("created_at"), F.timestamp_seconds(secs).alias("sent_at"), (F.col("role") == "system").alias("is_error"),
        F.lit(None).cast("string").alias("sender"), F.lit("codex").alias("source_kind"), F.lit(False).alias("sub_agent"), F.lit(None).cast("string").alias("model"),
    )


MESSAGES = """msg AS (
  SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, CAST(conv_id AS VARCHAR) AS conversation_id, CAST(conv_id % 10 AS VARCHAR) AS workspace_id,
    turn AS source_order, role, text, 1704067200 + conv_id * 3600 + turn * 60 AS secs FROM conversations)"""


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: an event each; errors fail, ``k`` is the exit code and the value the duration."""
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), (F.col("user_id") % 20).cast("string").alias("workspace_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("tool"), F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, F.when(k % 3 == 0, "timeout").when(k % 3 == 1, "user_rejected").otherwise("tool_error")).alias("error_type"), F.when(k < 50, F.concat(F.lit("src/"), k.cast("string"))).alias("path"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), (k * 10).cast("long").alias("result_bytes"), k.alias("exit_code"),
    )


CALLS = """calls AS (
  SELECT event_id AS call_id, CAST(user_id % 20 AS VARCHAR) AS workspace_id, CAST(ts AS DATE) AS day, event_type AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'user_rejected' ELSE 'tool_error' END END AS error_type,
    CASE WHEN k < 50 THEN concat('src/', CAST(k AS VARCHAR)) END AS path, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, CAST(k * 10 AS BIGINT) AS result_bytes, k AS exit_code
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""

FAILURES = ["worker w7 died", "Rate limit reached (429)", "script exited with code 3", "codex exited with code 1: reading prompt from stdin", "timed out after 300 s in /srv/run/a1b2c3d4e5", None]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow tasks: an order each; priority is the flavor, the customer the candidate, some orders fail in one of six ways."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    failed = F.col("o_orderstatus") == "F"
    reason = F.element_at(F.array(*map(F.lit, FAILURES)), (key % 6 + 1).cast("int"))
    created = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (key % 1440).cast("int"))
    return o.select(
        key.alias("task_id"), (key % 3).alias("installation_id"), F.concat(F.lit("p"), (key % 2).cast("string")).alias("project"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("flavor"), F.year("o_orderdate").alias("version"),
        F.when(key % 4 != 0, F.floor(key / 4)).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("created_by"), created.alias("created_at"), F.when(F.col("o_orderstatus") != "P", created + F.expr("interval 1 hour")).alias("finished_at"),
        F.lower("o_orderstatus").alias("state"), F.when(F.col("o_orderstatus") == "O", "done").alias("outcome"), F.when(failed, reason).alias("failure_reason"), (key % 11 == 0).alias("is_human"), (key % 13 == 0).alias("escalated"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts: a line item each; the line number orders them, the return flag is the configuration, the price the cost."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_shipdate").cast("timestamp")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("configuration"), F.sum("l_extendedprice").alias("price"), F.max("l_quantity").alias("q"), F.min("l_shipdate").alias("l_shipdate")).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("attempt_id"), F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("number"), "configuration", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("failure_reason"),
        start.alias("started_at"), (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("q").cast("int"))).alias("finished_at"), (F.col("price") / 10000).alias("reported_cost"), F.col("q").cast("long").alias("lines_changed"),
        (F.col("q") * 1000).cast("long").alias("total_tokens"), (F.col("q") * 800).cast("long").alias("input_tokens"), (F.col("q") * 300).cast("long").alias("cache_read_input_tokens"),
    )


TASKS = """tasks AS (
  SELECT o_orderkey AS task_id, o_orderkey % 3 AS installation_id, concat('p', CAST(o_orderkey % 2 AS VARCHAR)) AS project, o_custkey AS candidate_id, o_orderpriority AS flavor, CAST(year(o_orderdate) AS INTEGER) AS version,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey // 4 END AS parent_id, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS created_at, lower(o_orderstatus) AS state,
    CASE WHEN o_orderstatus = 'O' THEN 'done' END AS outcome, o_orderkey % 11 = 0 AS is_human, o_orderkey % 13 = 0 AS escalated,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 6 WHEN 0 THEN 'worker_died' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'script_exit' WHEN 3 THEN 'executor_exit' WHEN 4 THEN 'timeout' END END AS error_class,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 6 WHEN 0 THEN 'worker died' WHEN 1 THEN 'Rate limit reached (<n>)' WHEN 2 THEN 'script exited with code 3' WHEN 3 THEN 'codex exited with code 1' WHEN 4 THEN 'timed out after <n> s in <path>' END END AS error_signature,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 6 WHEN 0 THEN 'infrastructure' WHEN 1 THEN 'provider' WHEN 2 THEN 'script' WHEN 3 THEN 'configuration' WHEN 4 THEN 'agent' END END AS attribution
  FROM orders)"""

ATTEMPTS = f"""{TASKS},
att AS (
  SELECT l_orderkey * 100 + l_linenumber AS attempt_id, l_orderkey AS task_id, l_linenumber AS number, max(l_returnflag) AS configuration, sum(l_extendedprice) / 10000 AS cost_usd, max(l_quantity) AS q
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
runs AS (
  SELECT a.*, t.flavor, t.version, t.candidate_id, t.created_at, CAST(q * 1000 AS BIGINT) AS total_tokens, CAST(q * 800 AS BIGINT) AS input_tokens, CAST(q * 300 AS BIGINT) AS rd, CAST(q AS INTEGER) * 60000 AS duration_ms,
    row_number() OVER (PARTITION BY a.task_id ORDER BY number DESC, attempt_id DESC) = 1 AS is_final, t.error_class AS ec, t.error_signature AS es, t.attribution AS ea, t.outcome AS oc, coalesce(f.h, false) AS followed
  FROM att a JOIN tasks t ON a.task_id = t.task_id LEFT JOIN (SELECT parent_id, bool_or(is_human) AS h FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1) f ON f.parent_id = t.task_id),
rows_ AS (
  SELECT *, CASE WHEN is_final THEN ec END AS error_class, CASE WHEN is_final THEN es END AS error_signature, CASE WHEN is_final THEN ea END AS attribution,
    CASE WHEN is_final AND ec IS NOT NULL THEN 'error' WHEN NOT is_final THEN 'retried' WHEN followed THEN 'escalated' WHEN oc IS NOT NULL THEN 'advanced' ELSE 'open' END AS disposition
  FROM runs)"""
