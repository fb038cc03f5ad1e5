"""Queries over workflow runs, works and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import joins, library, workflow
from ledgerfold.plans.book import Book
from ledgerfold.plans.standins import ATTEMPTS, MESSAGES, TASKS, attempts, messages, table, tasks
from ledgerfold.session import materialize
from ledgerfold.streaming import incremental

BOOK = Book()


def rows(spark, sf_dir):
    a = attempts(spark, sf_dir)
    usage = a.select("attempt_id", F.lit(None).cast("string").alias("installation_id"), "total_tokens", "input_tokens", "cache_read_input_tokens", F.lit(None).cast("double").alias("token_cost"))
    return workflow.attempt_rows(workflow.task_links(tasks(spark, sf_dir)), a.drop("total_tokens", "input_tokens", "cache_read_input_tokens"), usage)


def failed_tasks(spark, sf_dir):
    """Tasks with their classified failure."""
    t = tasks(spark, sf_dir)
    known = workflow.classified_failures(t).select("failure_reason", F.col("failure.error_class").alias("error_class"))
    return workflow.task_links(t).join(known, "failure_reason", "left")


@BOOK.add(f"WITH {ATTEMPTS} SELECT attempt_id, disposition, error_class, error_signature, attribution, round(cost_usd, 6) AS cost_usd, CAST(duration_ms AS BIGINT) AS duration_ms, is_final FROM rows_")
def attempt_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("attempt_id", "disposition", "error_class", "error_signature", "attribution", F.round("cost_usd", 6).alias("cost_usd"), "duration_ms", "is_final")


@BOOK.add(f"""WITH {ATTEMPTS}, g AS (SELECT flavor, configuration, count(*) AS attempts, count(*) FILTER (disposition = 'advanced') AS advanced, count(*) FILTER (disposition = 'error') AS error, count(*) FILTER (disposition = 'escalated') AS escalated,
count(*) FILTER (error_class IS NOT NULL AND attribution NOT IN ('infrastructure', 'provider')) AS agent_errors, count(*) FILTER (error_class IS NOT NULL AND attribution IN ('infrastructure', 'provider')) AS infra, sum(cost_usd) AS cost,
quantile_cont(CASE WHEN error_class IS NULL OR attribution NOT IN ('infrastructure', 'provider') THEN cost_usd END, 0.5) AS med, quantile_cont(CASE WHEN error_class IS NULL OR attribution NOT IN ('infrastructure', 'provider') THEN cost_usd END, 0.9) AS p90 FROM rows_ GROUP BY 1, 2),
c AS (SELECT *, cost / nullif(advanced, 0) AS per FROM g)
SELECT flavor, configuration, attempts, advanced, error, escalated, agent_errors, infra AS infrastructure_errors, round(cost, 4) AS cost_usd, round(med, 6) AS median_cost_usd, round(p90, 6) AS p90_cost_usd, round(agent_errors / CAST(nullif(attempts - infra, 0) AS DOUBLE), 6) AS agent_error_rate, round(per, 6) AS cost_per_advance_usd,
CASE WHEN per = min(per) OVER (PARTITION BY flavor) THEN 'best' WHEN per = max(per) OVER (PARTITION BY flavor) THEN 'worst' END AS value_flag FROM c""")
def workflow_matrix(spark, sf_dir):
    m = workflow.workflow_matrix(rows(spark, sf_dir))
    r = lambda c, n: F.round(c, n).alias(c)
    return m.select("flavor", "configuration", "attempts", "advanced", "error", "escalated", "agent_errors", "infrastructure_errors", r("cost_usd", 4), r("median_cost_usd", 6), r("p90_cost_usd", 6), r("agent_error_rate", 6), r("cost_per_advance_usd", 6), "value_flag")


@BOOK.add(f"""WITH {ATTEMPTS}, g AS (SELECT flavor, configuration, count(*) AS attempts, count(*) FILTER (disposition = 'advanced') AS advanced, count(*) FILTER (disposition = 'error') AS error, count(*) FILTER (disposition = 'escalated') AS escalated,
count(*) FILTER (error_class IS NOT NULL AND attribution NOT IN ('infrastructure', 'provider')) AS agent_errors, count(*) FILTER (error_class IS NOT NULL AND attribution IN ('infrastructure', 'provider')) AS infra, sum(cost_usd) AS cost,
quantile_cont(CASE WHEN error_class IS NULL OR attribution NOT IN ('infrastructure', 'provider') THEN cost_usd END, 0.5) AS med, quantile_cont(CASE WHEN error_class IS NULL OR attribution NOT IN ('infrastructure', 'provider') THEN cost_usd END, 0.9) AS p90 FROM rows_ GROUP BY 1, 2),
c AS (SELECT *, cost / nullif(advanced, 0) AS per FROM g)
SELECT flavor, configuration, attempts, advanced, error, escalated, agent_errors, infra AS infrastructure_errors, round(cost, 4) AS cost_usd, round(med, 6) AS median_cost_usd, round(p90, 6) AS p90_cost_usd, round(agent_errors / CAST(nullif(attempts - infra, 0) AS DOUBLE), 6) AS agent_error_rate, round(per, 6) AS cost_per_advance_usd,
CASE WHEN per = min(per) OVER (PARTITION BY flavor) THEN 'best' WHEN per = max(per) OVER (PARTITION BY flavor) THEN 'worst' END AS value_flag FROM c""")
def workflow_matrix_spread(spark, sf_dir):
    """The same cells, with percentiles that gather no cell's values in one task."""
    m = workflow.workflow_matrix(materialize(rows(spark, sf_dir)), spread=True)
    r = lambda c, n: F.round(c, n).alias(c)
    return m.select("flavor", "configuration", "attempts", "advanced", "error", "escalated", "agent_errors", "infrastructure_errors", r("cost_usd", 4), r("median_cost_usd", 6), r("p90_cost_usd", 6), r("agent_error_rate", 6), r("cost_per_advance_usd", 6), "value_flag")


@BOOK.add(f"WITH {TASKS}, e AS (SELECT p.flavor AS parent_flavor, p.outcome AS parent_outcome, t.flavor, t.error_class FROM tasks t JOIN tasks p ON t.parent_id = p.task_id) SELECT parent_flavor, parent_outcome, flavor, count(*) AS n, round(avg(CASE WHEN error_class IS NOT NULL THEN 1 ELSE 0 END), 6) AS error_share FROM e GROUP BY 1, 2, 3")
def workflow_graph(spark, sf_dir):
    return workflow.workflow_graph(failed_tasks(spark, sf_dir)).withColumn("error_share", F.round("error_share", 6))


@BOOK.add(f"""WITH {TASKS}, e AS (SELECT p.flavor AS parent_flavor, t.flavor FROM tasks t JOIN tasks p ON t.parent_id = p.task_id),
b AS (SELECT 'in' AS direction, parent_flavor AS other FROM e WHERE flavor = '1-URGENT' UNION ALL SELECT 'out', flavor FROM e WHERE parent_flavor = '1-URGENT'),
g AS (SELECT direction, other, count(*) AS n FROM b GROUP BY 1, 2)
SELECT direction, other, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY n DESC, other) AS rank FROM g) WHERE rank <= 3""")
def graph_neighbours(spark, sf_dir):
    """The three largest edges into and out of one flavor."""
    return workflow.graph_neighbours(workflow.workflow_graph(failed_tasks(spark, sf_dir)), "1-URGENT", 3).select("direction", "other", "n", "rank")


@BOOK.add(f"""WITH {TASKS}, h AS (SELECT parent_id, bool_or(is_human) AS h FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT t.task_id, p.flavor AS parent_flavor, coalesce(h.h, false) AS human_followup, row_number() OVER (PARTITION BY t.candidate_id, t.flavor ORDER BY t.created_at, t.task_id) > 1 AS revisit FROM tasks t LEFT JOIN tasks p ON p.task_id = t.parent_id LEFT JOIN h ON h.parent_id = t.task_id""")
def task_links(spark, sf_dir):
    return workflow.task_links(tasks(spark, sf_dir)).select("task_id", "parent_flavor", "human_followup", "revisit")


@BOOK.add(f"""WITH {ATTEMPTS}, h AS (SELECT parent_id, bool_or(is_human) AS h FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1), e AS (SELECT r.*, coalesce(h.h, false) AS hf FROM rows_ r LEFT JOIN h ON h.parent_id = r.task_id WHERE error_class IS NOT NULL),
s AS (SELECT error_class, error_signature, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY n) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY error_class, error_signature ORDER BY created_at DESC, task_id) AS n FROM e) WHERE n <= 5 GROUP BY 1, 2)
SELECT e.error_class, e.error_signature, min(attribution) AS attribution, count(DISTINCT task_id) AS tasks, count(DISTINCT flavor) AS flavors, count(DISTINCT CASE WHEN hf THEN task_id END) AS human_followups, round(sum(cost_usd), 4) AS cost_usd, s.samples FROM e JOIN s ON s.error_class = e.error_class AND s.error_signature = e.error_signature GROUP BY 1, 2, s.samples""")
def error_clusters(spark, sf_dir):
    c = workflow.error_clusters(rows(spark, sf_dir))
    return c.select("error_class", "error_signature", "attribution", "tasks", "flavors", "human_followups", F.round("cost_usd", 4).alias("cost_usd"), F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@BOOK.add(f"""WITH {ATTEMPTS}, m AS (SELECT flavor, configuration, quantile_cont(cost_usd, 0.5) AS med FROM rows_ GROUP BY 1, 2) SELECT attempt_id, r.flavor, r.configuration, round(cost_usd, 6) AS cost_usd, round(med, 6) AS median_cost_usd
FROM rows_ r JOIN m ON m.flavor = r.flavor AND m.configuration = r.configuration WHERE cost_usd >= 1.5 * med AND cost_usd >= med + 2 AND cost_usd >= 3 * med ORDER BY cost_usd DESC, attempt_id LIMIT 12""")
def cost_outliers(spark, sf_dir):
    return workflow.cost_outliers(rows(spark, sf_dir)).select("attempt_id", "flavor", "configuration", F.round("cost_usd", 6).alias("cost_usd"), F.round("median_cost_usd", 6).alias("median_cost_usd"))


@BOOK.add("""WITH g AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 180 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (ORDER BY ts, user_id) AS unused FROM g),
a AS (SELECT ts, event_type, sum(CASE WHEN p >= ts - INTERVAL 4 MINUTE THEN 0 ELSE 1 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT ts, event_type, lag(ts) OVER (ORDER BY ts) AS p FROM events))
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS root_tasks, count(DISTINCT event_type) AS flavors FROM a GROUP BY grp HAVING count(*) >= 5""")
def enqueue_bursts(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("created_by"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("flavor"))
    out = workflow.enqueue_bursts(t, "4 minutes")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "ended_at")})


@BOOK.add(f"""WITH {TASKS}, v AS (SELECT flavor, version, min(created_at) AS f, count(*) AS n, avg(CASE WHEN error_class IS NOT NULL THEN 1.0 ELSE 0 END) AS e FROM tasks GROUP BY 1, 2), w AS (SELECT *, lag(e) OVER (PARTITION BY flavor ORDER BY f, version) AS b, lead(version) OVER (PARTITION BY flavor ORDER BY f, version) AS nx FROM v)
SELECT flavor, version, round(e - b, 6) AS change FROM w WHERE nx IS NULL AND abs(e - b) >= 0.001""")
def definition_shift(spark, sf_dir):
    return workflow.definition_shift(failed_tasks(spark, sf_dir), change=0.001).select("flavor", F.col("version").cast("int").alias("version"), "change")


@BOOK.add(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, flavor ORDER BY created_at, task_id) > 1 AS again FROM tasks)
SELECT flavor, count(*) AS tasks, round(avg(CASE WHEN error_class IS NOT NULL THEN 1 ELSE 0 END), 6) AS error_rate, round(avg(CASE WHEN again THEN 1 ELSE 0 END), 6) AS revisit_rate, count(DISTINCT version) AS versions FROM r GROUP BY 1""")
def flavor_summary(spark, sf_dir):
    t = failed_tasks(spark, sf_dir).withColumn("started_at", F.col("created_at"))
    return workflow.flavor_summary(t).select("flavor", "tasks", F.round("error_rate", 6).alias("error_rate"), F.round("revisit_rate", 6).alias("revisit_rate"), "versions")


@BOOK.add(f"WITH {ATTEMPTS}, s AS (SELECT candidate_id, count(*) AS steps FROM tasks GROUP BY 1), c AS (SELECT s.*, cost FROM s LEFT JOIN (SELECT candidate_id, sum(cost_usd) AS cost FROM rows_ GROUP BY 1) r ON r.candidate_id = s.candidate_id) SELECT count(*) AS candidates, quantile_cont(steps, 0.5) AS median_steps, quantile_cont(steps, 0.9) AS p90_steps, round(sum(cost), 4) AS cost_usd, count(*) FILTER (steps >= 16) AS near_limit FROM c")
def candidate_summary(spark, sf_dir):
    s, _ = workflow.candidate_summary(rows(spark, sf_dir), tasks(spark, sf_dir), step_limit=20)
    return s.withColumn("cost_usd", F.round("cost_usd", 4))


@BOOK.add(f"WITH {TASKS}, h AS (SELECT coalesce(p.flavor, 'none') AS cause FROM tasks t LEFT JOIN tasks p ON p.task_id = t.parent_id WHERE t.is_human) SELECT cause, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, cause LIMIT 12")
def human_causes(spark, sf_dir):
    return workflow.human_causes(workflow.task_links(tasks(spark, sf_dir)))


@BOOK.add(f"WITH {TASKS}, h AS (SELECT t.*, p.error_class AS pe FROM tasks t LEFT JOIN tasks p ON p.task_id = t.parent_id WHERE t.is_human) SELECT count(*) AS human_tasks, count(*) FILTER (state = 'p') AS pending, round(avg(CASE WHEN pe IS NOT NULL THEN 1 ELSE 0 END), 6) AS error_caused_share FROM h")
def human_summary(spark, sf_dir):
    t = failed_tasks(spark, sf_dir)
    parent = t.select(F.col("task_id").alias("parent_id"), F.col("error_class").alias("parent_error"))
    return workflow.human_summary(t.join(parent, "parent_id", "left"), "2002-01-01").select("human_tasks", "pending", F.round("error_caused_share", 6).alias("error_caused_share"))


@BOOK.add(f"WITH {TASKS} SELECT flavor, count(*) FILTER (task_id % 4 = 0) AS invalid_handoffs, count(*) FILTER (task_id % 4 = 1) AS repairs_started, count(*) FILTER (task_id % 4 = 2) AS repairs_recovered, count(*) FILTER (task_id % 4 = 3) AS repairs_failed FROM tasks GROUP BY 1")
def contract_repairs(spark, sf_dir):
    t = tasks(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("handoff_invalid", "contract_repair_started", "contract_repair_succeeded", "contract_repair_failed")))
    return workflow.contract_repairs(t.select("task_id", F.element_at(kinds, (F.col("task_id") % 4 + 1).cast("int")).alias("kind")), t)


@BOOK.add(f"WITH {TASKS}, i AS (SELECT installation_id, project, count(*) AS tasks, max(created_at) AS last_at FROM tasks GROUP BY 1, 2), a AS (SELECT installation_id, project, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN tasks ON task_id = l_orderkey GROUP BY 1, 2) SELECT i.project, count(DISTINCT i.installation_id) AS installations, CAST(sum(i.tasks) AS BIGINT) AS tasks, CAST(sum(a.n) AS BIGINT) AS attempts, strftime(max(last_at), '%Y-%m-%d') AS last_day FROM i JOIN a ON a.installation_id = i.installation_id AND a.project = i.project GROUP BY 1")
def projects(spark, sf_dir):
    t = tasks(spark, sf_dir).withColumn("installation_id", F.concat_ws(":", "project", "installation_id"))
    inst = t.select("installation_id", "project").distinct()
    return workflow.projects(inst, t, attempts(spark, sf_dir)).select("project", "installations", "tasks", "attempts", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))


@BOOK.add(f"WITH {ATTEMPTS} SELECT configuration, count(*) AS attempts, count(*) FILTER (total_tokens > 0) AS with_tokens, count(cost_usd) AS priced, round(sum(cost_usd), 4) AS cost_usd FROM rows_ GROUP BY 1")
def workflow_totals(spark, sf_dir):
    return workflow.workflow_totals(rows(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 4))


@BOOK.add()
def workflow_detectors(spark, sf_dir):
    r, t = materialize(rows(spark, sf_dir)), materialize(failed_tasks(spark, sf_dir).withColumn("started_at", F.col("created_at")))
    parent = t.select(F.col("task_id").alias("parent_id"), F.col("error_class").alias("parent_error"))
    kinds = F.array(*map(F.lit, ("handoff_invalid", "contract_repair_started", "contract_repair_succeeded", "contract_repair_failed")))
    contracts = workflow.contract_repairs(t.select("task_id", F.element_at(kinds, (F.col("task_id") % 4 + 1).cast("int")).alias("kind")), t)
    matrix, clusters = workflow.workflow_matrix(r), workflow.error_clusters(r)
    return workflow.detectors(matrix, clusters, contracts, workflow.cost_outliers(r), workflow.candidate_summary(r, t)[0], workflow.human_summary(t.join(parent, "parent_id", "left"), "2002-01-01"), workflow.definition_shift(t, change=0.01), workflow.flavor_summary(t), workflow.workflow_totals(r))


@BOOK.add()
def workflow_opportunities(spark, sf_dir):
    r = materialize(rows(spark, sf_dir))
    return workflow.opportunities(workflow.workflow_matrix(r), workflow.error_clusters(r))


@BOOK.add(f"WITH {MESSAGES} SELECT workspace_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS agent_turns, CAST(0 AS BIGINT) AS tool_calls, count(*) FILTER (role = 'system') AS visible_errors, CAST(max(secs) - min(secs) AS BIGINT) AS span_seconds FROM msg GROUP BY 1")
def derived_metrics(spark, sf_dir):
    return library.derived_metrics(messages(spark, sf_dir)).select("workspace_id", "user_turns", "agent_turns", "tool_calls", "visible_errors", "span_seconds")


@BOOK.add(f"WITH {MESSAGES} SELECT conversation_id, min_by(text, source_order) FILTER (role = 'user') AS first_request, max_by(text, source_order) FILTER (role = 'assistant') AS last_reply FROM msg GROUP BY 1")
def first_and_last(spark, sf_dir):
    return library.first_and_last(messages(spark, sf_dir))


@BOOK.add(f"WITH {MESSAGES} SELECT workspace_id, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY source_order, secs, id) AS INTEGER) AS sequence, 'text' AS kind, role = 'system' AS is_error FROM msg")
def event_ledger(spark, sf_dir):
    return library.event_ledger(messages(spark, sf_dir))


@BOOK.add(f"WITH {MESSAGES}, a AS (SELECT id, row_number() OVER (ORDER BY source_order) AS p FROM msg WHERE conversation_id = '7') SELECT id, CAST(p AS INTEGER) AS position FROM a WHERE abs(p - 3) <= 2")
def message_window(spark, sf_dir):
    return library.message_window(messages(spark, sf_dir), "7:2", 2).select("id", "position")


@BOOK.add("""WITH o AS (SELECT o_custkey AS w, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1), l AS (SELECT o_custkey AS w, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_partkey) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS workspace_id, coalesce(n, 0) AS conversations, p AS providers, coalesce(a, 0) AS tool_uses, coalesce(r, 0) AS user_turns, coalesce(f, 0) AS changed_files FROM customer LEFT JOIN o ON o.w = c_custkey LEFT JOIN l ON l.w = c_custkey""")
def library_rows(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id"))
    convs = o.select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderpriority").alias("provider"), F.lit(0).alias("depth"))
    j = li.join(o.select("o_orderkey", F.col("o_custkey").alias("workspace_id")), li.l_orderkey == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "A", "tool_call").otherwise("text")
    msgs = j.select("workspace_id", F.when(F.col("l_returnflag") == "R", "user").otherwise("assistant").alias("role"), kind.alias("kind"), F.lit(False).alias("is_error"), F.lit("m").alias("model"))
    changes = j.select("workspace_id", F.col("l_partkey").cast("string").alias("path"))
    prs = j.where("l_linenumber = 1").select("workspace_id", F.lit("h").alias("host"), F.col("l_suppkey").alias("number"))
    return library.library_rows(works, convs, msgs, changes, prs).select("workspace_id", "conversations", "providers", "tool_uses", "user_turns", "changed_files")


@BOOK.add("SELECT c_custkey AS workspace_id FROM customer WHERE lower(c_name) LIKE '%00001%' AND c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def search_work(spark, sf_dir):
    works = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "workspace_id")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "workspace_id")
    return library.search_work(works, text={"c_name": "00001"}, equal={"c_mktsegment": "BUILDING"}, children=[(orders, F.col("o_totalprice") > 300000)]).select("workspace_id")


@BOOK.add("SELECT o_custkey, max(o_orderkey) AS version, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def newest_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_orderstatus")
    return incremental.newest(o.where("version % 2 = 0"), o.where("version % 2 = 1"), ["o_custkey"])


@BOOK.add("SELECT o_custkey, o_orderstatus FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def new_records(spark, sf_dir):
    from ledgerfold.functions.text import content_hash

    o = table(spark, sf_dir, "orders")
    state = o.where("o_orderkey % 2 = 1").select("o_custkey", content_hash(F.col("o_orderstatus")).alias("digest"))
    return incremental.new_records(o.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderstatus"), state, ["o_custkey"], ["o_orderstatus"]).select("o_custkey", "o_orderstatus")


@BOOK.add("""WITH s AS (SELECT event_type AS source, max(ts) AS last_at, count(*) AS n FROM events GROUP BY 1) SELECT source, round((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last_at))) / 3600.0, 2) AS lag_hours, round(n / 2010.0, 4) AS coverage,
CASE WHEN (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last_at))) / 3600.0 > 24.5 THEN 'stale' WHEN n / 2010.0 < 1 THEN 'partial' ELSE 'fresh' END AS state FROM s""")
def freshness(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_success_at"), F.count(F.lit(1)).alias("seen"))
    s = s.select("*", F.lit("").alias("last_error"), F.lit(0).alias("pending"), F.lit(2010).alias("expected"))
    return incremental.freshness(s, "2024-02-01 00:00:00", 24.5)


@BOOK.add("SELECT o_custkey AS workspace_id, count(*) AS n FROM orders GROUP BY 1")
def refresh_works(spark, sf_dir):
    """A projection kept current: works of changed orders are recomputed, the rest is kept."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "workspace_id")
    count = lambda df: df.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
    stored, changed = count(o.where("o_orderkey % 10 <> 0")), o.where("o_orderkey % 10 = 0")
    return library.refresh(stored, changed, lambda keys: count(joins.having(o, keys, "workspace_id")))


@BOOK.add("""WITH a AS (SELECT DISTINCT l_partkey AS c, l_shipdate AS t, max(l_orderkey * 100 + l_linenumber) AS id, max_by(l_returnflag, l_orderkey * 100 + l_linenumber) AS conf FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), f AS (SELECT l_orderkey * 100 + l_linenumber AS fid, l_partkey AS c, l_shipdate AS t, CASE WHEN l_tax > 0.05 THEN 'high' ELSE 'low' END AS sev, l_suppkey AS path FROM lineitem WHERE l_linenumber = 2),
g AS (SELECT f.*, a.conf, a.id, row_number() OVER (PARTITION BY fid, f.c, f.t, f.path ORDER BY a.t DESC) AS n FROM f JOIN a ON a.c = f.c AND a.t <= f.t)
SELECT conf AS configuration, count(*) AS findings, count(DISTINCT id) AS runs, count(*) FILTER (sev = 'high') AS high, count(DISTINCT path) AS files, round(count(*) / CAST(count(DISTINCT id) AS DOUBLE), 6) AS per_run FROM g WHERE n = 1 GROUP BY 1""")
def review_summary(spark, sf_dir):
    """Review findings go to the last run on their candidate at or before them."""
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    runs = li.where("l_linenumber = 1").groupBy("l_partkey", F.col("l_shipdate").alias("at")).agg(F.max("id").alias("attempt_id"), F.max_by("l_returnflag", "id").alias("configuration"))
    found = li.where("l_linenumber = 2").dropDuplicates(["id", "l_partkey", "l_shipdate", "l_suppkey"]).select("id", "l_partkey", "l_shipdate", F.when(F.col("l_tax") > 0.05, "high").otherwise("low").alias("severity"), F.col("l_suppkey").alias("path"))
    out = workflow.review_summary(joins.asof_backward(found, runs, ["l_partkey"], "l_shipdate", "at", ["attempt_id", "configuration"]))
    return out.withColumn("per_run", F.round("per_run", 6))
