"""Queries over the usage ledger: prices, sums, windows, carbon, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import money
from ledgerfold.operators import pricing, tokens, usage
from ledgerfold.plans.book import Book
from ledgerfold.plans.standins import LEDGER, PRICED, TODAY, ledger, prices, table

BOOK = Book()


def priced(spark, sf_dir):
    return pricing.price_usage(ledger(spark, sf_dir), *prices(spark), today=TODAY)


@BOOK.add(f"WITH {PRICED} SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, family AS model_family, round(sum(cost_usd), 4) AS cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM priced GROUP BY 1, 2")
def cost_by_week_family(spark, sf_dir):
    p = priced(spark, sf_dir)
    return p.groupBy(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week"), money.model_family(F.col("model")).alias("model_family")).agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("total_tokens").alias("total_tokens"))


@BOOK.add(f"WITH {PRICED} SELECT workspace_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 4) AS cost_usd, round(sum(cost_today_usd), 4) AS cost_today_usd, CASE max(CASE price_status WHEN 'priced' THEN 0 WHEN 'assumed' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) WHEN 0 THEN 'priced' WHEN 1 THEN 'assumed' WHEN 2 THEN 'partial' ELSE 'unpriced' END AS price_status FROM priced GROUP BY workspace_id")
def work_costs(spark, sf_dir):
    out = pricing.work_costs(priced(spark, sf_dir))
    return out.withColumns({"cost_usd": F.round("cost_usd", 4), "cost_today_usd": F.round("cost_today_usd", 4)})


@BOOK.add(f"""WITH {PRICED} SELECT CAST(coalesce(sum(total_tokens) FILTER (price_status = 'priced'), 0) AS BIGINT) AS priced_tokens, CAST(coalesce(sum(total_tokens) FILTER (price_status = 'assumed'), 0) AS BIGINT) AS assumed_tokens,
CAST(coalesce(sum(total_tokens) FILTER (price_status = 'partial'), 0) AS BIGINT) AS partial_tokens, CAST(coalesce(sum(total_tokens) FILTER (price_status = 'unpriced'), 0) AS BIGINT) AS unpriced_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 4) AS cost_usd,
CAST(coalesce(sum(total_tokens) FILTER (day >= DATE '2024-01-10' - 29 + 10), 0) AS BIGINT) AS recent_tokens, round(sum(cost_usd) FILTER (day >= DATE '2024-01-10' - 29 + 10), 4) AS recent_cost_usd FROM priced""")
def pricing_health(spark, sf_dir):
    out = pricing.pricing_health(priced(spark, sf_dir), "2024-01-20")
    return out.withColumns({"cost_usd": F.round("cost_usd", 4), "recent_cost_usd": F.round("recent_cost_usd", 4)})


@BOOK.add(f"WITH {PRICED} SELECT concat('claude-', family, '-20240115') AS model, CAST(sum(total_tokens) AS BIGINT) AS tokens, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM priced WHERE price_status = 'unpriced' GROUP BY family")
def models_unpriced(spark, sf_dir):
    out = pricing.models_with_status(priced(spark, sf_dir), "unpriced")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@BOOK.add(f"WITH {PRICED} SELECT event_id, priced_model, price_status, round(cost_usd, 9) AS cost_usd, round(cost_today_usd, 9) AS cost_today_usd FROM priced")
def price_then_and_today(spark, sf_dir):
    return priced(spark, sf_dir).select("event_id", "priced_model", "price_status", F.round("cost_usd", 9).alias("cost_usd"), F.round("cost_today_usd", 9).alias("cost_today_usd"))


@BOOK.add(f"""WITH {PRICED} SELECT session_id, strftime(day, '%Y-%m-%d') AS day, concat('claude-', family, '-20240115') AS model, family AS model_family, strftime(date_trunc('week', day), '%Y-%m-%d') AS week, strftime(day, '%Y-%m') AS month, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
round(sum(cost_usd), 9) AS cost_usd, CASE WHEN max(CASE WHEN attribution <> 'request' THEN 1 ELSE 0 END) = 1 THEN 'session-start' ELSE 'request' END AS attribution, round(100.0 * sum(rd) / nullif(sum(input_tokens), 0), 4) AS cache_read_share,
strftime(min(usage_hour), '%Y-%m-%d %H') AS first_hour, strftime(max(usage_hour), '%Y-%m-%d %H') AS last_hour FROM priced GROUP BY session_id, day, family""")
def usage_rows(spark, sf_dir):
    out = usage.usage_rows(priced(spark, sf_dir))
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH")
    return out.select("session_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "model", "model_family", F.date_format("week", "yyyy-MM-dd").alias("week"), "month", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"), "attribution", F.round("cache_read_share", 4).alias("cache_read_share"), hour("first_usage_at").alias("first_hour"), hour("last_usage_at").alias("last_hour"))


@BOOK.add(f"""WITH {LEDGER}, late AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL ELSE created_at END AS placed FROM led), st AS (SELECT session_id, min(created_at) AS started FROM led GROUP BY 1)
SELECT l.session_id, strftime(date_trunc('hour', coalesce(placed, started)), '%Y-%m-%d %H') AS usage_hour, family AS model, CASE WHEN placed IS NULL THEN 'session-start' ELSE 'request' END AS attribution, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(outp) AS BIGINT) AS output_tokens
FROM late l JOIN st ON l.session_id = st.session_id GROUP BY 1, 2, 3, 4""")
def hourly_usage(spark, sf_dir):
    led = ledger(spark, sf_dir)
    sessions = led.groupBy("session_id").agg(F.min("created_at").alias("started_at"))
    reports = led.select("session_id", F.when(F.col("k") % 10 != 0, F.col("created_at")).alias("created_at"), F.col("provider").alias("model"), "total_tokens", "output_tokens")
    return usage.hourly_usage(reports, sessions).withColumn("usage_hour", F.date_format("usage_hour", "yyyy-MM-dd HH"))


@BOOK.add(f"""WITH {LEDGER}, w(win, h) AS (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168), ('30d', 720), ('all', 0)),
s AS (SELECT win, total_tokens, CASE WHEN h = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (epoch(usage_hour) + 3600 - (epoch(TIMESTAMP '2024-01-30 21:20:00') - h * 3600)) / 3600.0)) END AS share FROM led, w)
SELECT win AS "window", CAST(sum(floor(total_tokens * share + 0.5)) AS BIGINT) AS tokens FROM s GROUP BY win""")
def usage_summary(spark, sf_dir):
    return usage.usage_summary(ledger(spark, sf_dir), "2024-01-30 21:20:00")


@BOOK.add(f"""WITH {LEDGER}, per AS (SELECT provider, session_id, CASE WHEN count(DISTINCT k % 3) > 1 THEN 'Multiple models' ELSE max(CAST(k % 3 AS VARCHAR)) END AS model, sum(total_tokens) AS t FROM led GROUP BY 1, 2)
SELECT provider, model, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS sessions FROM per GROUP BY 1, 2""")
def tokens_by_model(spark, sf_dir):
    return usage.tokens_by_model(ledger(spark, sf_dir).withColumn("model", (F.col("k") % 3).cast("string")))


FACTORS = {
    "tiers": [{"key": "small", "match": ["view"], "output_wh_per_mtok": {"low": 30, "central": 100, "high": 300}}, {"key": "large", "match": ["purchase", "err"], "output_wh_per_mtok": {"low": 250, "central": 900, "high": 2500}}, {"key": "medium", "match": [], "output_wh_per_mtok": {"low": 100, "central": 400, "high": 1200}}],
    "default_tier": "medium", "ratios": {"input": {"low": 0.1, "central": 0.2, "high": 0.4}, "write": {"low": 0.1, "central": 0.2, "high": 0.4}, "read": {"low": 0.002, "central": 0.02, "high": 0.08}},
    "pue": {"low": 1.1, "central": 1.15, "high": 1.3}, "grids": [{"key": "us", "g_co2e_per_kwh": 350}], "default_grid": "us",
}


@BOOK.add(f"""WITH {LEDGER}, tier AS (SELECT *, CASE WHEN family = 'view' THEN 1 WHEN family IN ('purchase', 'error') THEN 2 ELSE 3 END AS t FROM led),
f(scenario, t, wh, ri, rr, pue) AS (VALUES ('low',1,30.0,0.1,0.002,1.1),('central',1,100.0,0.2,0.02,1.15),('high',1,300.0,0.4,0.08,1.3),('low',2,250.0,0.1,0.002,1.1),('central',2,900.0,0.2,0.02,1.15),('high',2,2500.0,0.4,0.08,1.3),('low',3,100.0,0.1,0.002,1.1),('central',3,400.0,0.2,0.02,1.15),('high',3,1200.0,0.4,0.08,1.3)),
x AS (SELECT win, scenario, pue, (uncached + uncl) / 1e6 * wh * ri AS a, wr / 1e6 * wh * ri AS b, rd / 1e6 * wh * rr AS c, outp / 1e6 * wh AS d FROM tier JOIN f ON tier.t = f.t JOIN (VALUES ('all'), ('30d')) v(win) ON win = 'all' OR day >= DATE '2024-02-10' - 29)
SELECT win AS "window", scenario, round(sum(a), 4) AS input_wh, round(sum(b), 4) AS write_wh, round(sum(c), 4) AS read_wh, round(sum(d), 4) AS output_wh, round(sum(a + b + c + d), 4) AS total_wh, round(sum(a + b + c + d) * CAST(max(pue) AS DOUBLE) * 350 / 1000, 4) AS co2e_g FROM x GROUP BY 1, 2""")
def carbon(spark, sf_dir):
    out = usage.carbon(ledger(spark, sf_dir), FACTORS, "2024-02-10")
    return out.select("window", "scenario", *[F.round(c, 4).alias(c) for c in ("input_wh", "write_wh", "read_wh", "output_wh", "total_wh", "co2e_g")])


@BOOK.add(f"""WITH {LEDGER}, s AS (SELECT day AS b, CAST(k % 9 AS VARCHAR) AS split, sum(total_tokens) AS v FROM led GROUP BY 1, 2), top AS (SELECT split FROM s GROUP BY split ORDER BY sum(v) DESC, split LIMIT 5),
f AS (SELECT b, CASE WHEN split IN (SELECT split FROM top) THEN split ELSE 'Other' END AS split, sum(v) AS v FROM s GROUP BY 1, 2), days AS (SELECT DISTINCT b FROM f), sp AS (SELECT DISTINCT split FROM f)
SELECT strftime(days.b, '%Y-%m-%d') AS bucket, sp.split, CAST(coalesce(v, 0) AS BIGINT) AS value FROM days CROSS JOIN sp LEFT JOIN f ON f.b = days.b AND f.split = sp.split""")
def chart_series(spark, sf_dir):
    out = usage.chart_series(ledger(spark, sf_dir).withColumn("s", F.col("k") % 9), F.col("created_at"), "s", "total_tokens")
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@BOOK.add("""SELECT event_id, user_id, CAST(CASE WHEN v < p THEN 1 ELSE greatest(0, v - coalesce(p, 0)) END AS BIGINT) AS delta
FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def counter_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("running"), F.lit(1).cast("long").alias("last"))
    return tokens.counter_deltas(e, ["user_id"], ["ts", "event_id"], "running", "last").select("event_id", "user_id", F.col("delta").cast("long").alias("delta"))


@BOOK.add("""WITH e AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS v, CASE WHEN event_id % 5 = 0 THEN CAST(floor(value * 20) AS BIGINT) END AS ck FROM events),
c AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM e),
m AS (SELECT *, greatest(0, coalesce(max(ck - c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)) AS m FROM c)
SELECT event_id, CAST(v + m - coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS BIGINT) AS filled FROM m""")
def checkpoint_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("v"), F.when(F.col("event_id") % 5 == 0, F.floor(F.col("value") * 20).cast("long")).alias("ck"))
    return tokens.checkpoint_fill(e, ["user_id"], ["ts", "event_id"], "v", "ck").select("event_id", F.col("filled").cast("long").alias("filled"))


@BOOK.add("""WITH e AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS i, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS o, event_id FROM events),
last AS (SELECT user_id, event_id % 400 AS r, max_by(i, event_id) AS i, max_by(o, event_id) AS o FROM e GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS conversation_id, CAST(sum(i) AS DOUBLE) AS input_tokens, CAST(sum(o) AS DOUBLE) AS output_tokens, CAST(sum(i + o) AS DOUBLE) AS total_tokens FROM last GROUP BY user_id""")
def reconcile_tokens(spark, sf_dir):
    """Requests that are reported again under one id count once, with the last report's numbers."""
    k = F.get_json_object("props", "$.k").cast("long")
    usage_ = F.struct(F.floor("value").cast("long").alias("input_tokens"), k.alias("output_tokens"))
    raw = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.concat(F.lit("r"), F.col("event_id") % 400).alias("id"), usage_.alias("usage")).alias("message")))
    none = F.lit(None).cast("string")
    m = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("conversation_id"), F.col("event_id").alias("source_order"), F.col("event_id").cast("string").alias("id"), F.lit("metadata").alias("kind"), none.alias("native_id"), none.alias("parent_native_id"), none.alias("call_id"), raw.alias("raw_text"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("model"))
    return tokens.reconcile_tokens(m).groupBy("conversation_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


@BOOK.add(f"""WITH {PRICED}, c AS (SELECT *, CASE WHEN provider = 'purchase' THEN 0 ELSE rd END AS fresh, CASE WHEN provider = 'purchase' THEN rd ELSE 0 END AS written FROM priced)
SELECT event_id, round(CASE WHEN i IS NULL AND r IS NULL AND w5 IS NULL AND w1 IS NULL AND o IS NULL THEN NULL ELSE coalesce(fresh * i / 1e6, 0) + coalesce(wr * r / 1e6, 0) + coalesce(written * w5 / 1e6, 0) + coalesce(outp * o / 1e6, 0) END, 9) AS cost_usd FROM c""")
def price_tool_calls(spark, sf_dir):
    led = ledger(spark, sf_dir)
    calls = led.select("event_id", "model", "day", F.when(F.col("provider") == "purchase", "claude").otherwise("other").alias("provider"), F.col("cache_read_input_tokens").alias("result_tokens"), F.col("cache_creation_input_tokens").alias("carried_tokens"), F.col("output_tokens").cast("double").alias("call_output_tokens"))
    return pricing.price_tool_calls(calls, *prices(spark)).select("event_id", F.round("cost_usd", 9).alias("cost_usd"))


@BOOK.add(f"""WITH {LEDGER} SELECT event_id, l.workspace_id, CASE WHEN k % 3 = 0 THEN 'session model' ELSE family END AS model, c_name AS title, n_name AS repository_name FROM led l JOIN customer c ON c.c_custkey = l.workspace_id LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 10 WHERE total_tokens > 0""")
def usage_ledger(spark, sf_dir):
    led = ledger(spark, sf_dir)
    rows = led.select("event_id", "session_id", "total_tokens", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("provider")).alias("model"))
    sessions = led.select("session_id", "workspace_id", F.lit("session model").alias("model")).distinct()
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("repository_id"))
    repos = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("repository_id"), F.col("n_name").alias("name"))
    return usage.usage_ledger(rows, sessions, works, repos).select("event_id", "workspace_id", "model", "title", "repository_name")


@BOOK.add("""WITH m AS (SELECT ts, CAST(floor(value) AS BIGINT) AS w FROM events WHERE floor(value) > 0), x(win, h) AS (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168), ('30d', 720), ('all', 0))
SELECT win AS "window", CAST(sum(w) AS BIGINT) AS words, count(*) AS messages FROM m, x WHERE h = 0 OR floor(epoch(ts)) >= epoch(TIMESTAMP '2024-01-30 21:20:00') - h * 3600 GROUP BY 1""")
def typed_words(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("sent_at"), F.floor("value").cast("long").alias("words"))
    return usage.typed_words(m, "2024-01-30 21:20:00")
