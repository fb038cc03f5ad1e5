"""Analysis of workflow runs: attempts, cells of flavor and configuration, errors, candidates, people, detectors, savings.

Inputs are flat tables. ``tasks``: task_id, installation_id, project, candidate_id, flavor, version, parent_id, created_by,
created_at, finished_at, state, outcome, failure_reason, is_human, escalated. ``attempts``: attempt_id, task_id, number,
configuration, model, failure_reason, started_at, finished_at, reported_cost, lines_changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import text as T
from ledgerfold.functions.money import model_family, ratio
from ledgerfold.operators.percentiles import exact_percentiles
from ledgerfold.operators.pricing import small
from ledgerfold.session import materialize

MIN_SAMPLE = 10


def task_links(tasks: DataFrame) -> DataFrame:
    """Adds the parent's flavor and outcome, whether a child is a human task, and ``revisit``: the candidate saw the flavor before.

    Apply it to the full history; a window is filtered afterwards.
    """
    p = tasks.select(F.col("task_id").alias("parent_id"), F.col("flavor").alias("parent_flavor"), F.col("outcome").alias("parent_outcome"))
    c = tasks.where("parent_id is not null").groupBy(F.col("parent_id").alias("task_id")).agg(F.max("is_human").alias("human_followup"))
    w = Window.partitionBy("candidate_id", "flavor").orderBy("created_at", "task_id")
    out = tasks.join(p, "parent_id", "left").join(c, "task_id", "left")
    revisit = F.col("candidate_id").isNotNull() & (F.row_number().over(w) > 1)
    return out.withColumns({"human_followup": F.coalesce("human_followup", F.lit(False)), "revisit": revisit})


def attempt_usage(usage: DataFrame) -> DataFrame:
    """Tokens and cost per attempt of transcript usage whose native id reads ``installation:attempt:file``."""
    parts = F.split("native_id", ":")
    return usage.where(F.size(parts) >= 3).groupBy(parts[0].alias("installation_id"), parts[1].alias("attempt_id")).agg(
        *[F.sum(c).alias(c) for c in ("total_tokens", "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens") if c in usage.columns],
        F.sum("cost_usd").alias("token_cost"))


def final_attempts(attempts: DataFrame) -> DataFrame:
    """Adds ``is_final``: the last attempt of its task by number."""
    w = Window.partitionBy("task_id").orderBy(F.desc("number"), F.desc("attempt_id"))
    return attempts.withColumn("is_final", F.row_number().over(w) == 1)


def classified_failures(*frames: DataFrame) -> DataFrame:
    """(failure_reason, failure): each distinct text of the frames' ``failure_reason`` classified once, written for the joins to come."""
    texts = reduce(DataFrame.union, [f.select("failure_reason") for f in frames]).where(F.trim("failure_reason") != "").distinct()
    return small(materialize(texts.select("failure_reason", T.failure(F.col("failure_reason")).alias("failure"))))


def attempt_rows(tasks: DataFrame, attempts: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per attempt: disposition, error, cost and its source, tokens, duration, flags.

    The attempt's own failure reason is classified, else the task's; token cost wins over the reported one; a run without a
    configuration takes its model's family or "unrecorded".
    """
    t = tasks.select("task_id", "flavor", "version", "candidate_id", "state", "outcome", "escalated", "created_at", F.col("failure_reason").alias("task_failure"), "human_followup", "revisit")
    rows = final_attempts(attempts).join(t, "task_id").join(usage.drop("installation_id"), "attempt_id", "left")
    blank = lambda c: F.when(F.trim(c) != "", c)
    final_failure = F.when(F.col("is_final"), F.col("task_failure"))
    rows = rows.withColumn("failure_reason", F.coalesce(blank(F.col("failure_reason")), final_failure))
    known = classified_failures(attempts, tasks)
    rows = rows.join(known, "failure_reason", "left").withColumnRenamed("failure", "_e").withColumns({
        "error_class": F.col("_e.error_class"), "error_signature": F.col("_e.signature"), "attribution": F.col("_e.attribution"),
        "configuration": F.coalesce(blank(F.col("configuration")), blank(model_family(F.col("model"))), F.lit("unrecorded")),
        "cost_usd": F.coalesce("token_cost", "reported_cost"), "cost_source": F.when(F.col("token_cost").isNotNull(), "tokens").when(F.col("reported_cost").isNotNull(), "reported"),
        "duration_ms": F.unix_millis("finished_at") - F.unix_millis("started_at"),
    }).drop("_e")
    return rows.withColumn("disposition", T.disposition(F.col("error_class"), F.col("is_final"), F.col("human_followup"), F.col("outcome")))


OUTSIDE = ("infrastructure", "provider")


def _spread_percentiles(rows: DataFrame, typical: Column) -> DataFrame:
    """(flavor, configuration, medians and 90th percentiles), each measure ordered over tasks instead of gathered per cell."""
    keys = ["flavor", "configuration"]
    wanted = {"cost_usd": {0.5: "median_cost_usd", 0.9: "p90_cost_usd"}, "duration_ms": {0.5: "median_duration_ms", 0.9: "p90_duration_ms"}, "total_tokens": {0.5: "median_tokens"}}
    parts = []
    for measure, names in wanted.items():
        some = typical & (F.col("total_tokens") > 0) if measure == "total_tokens" else typical
        found = exact_percentiles(rows.where(some), keys, measure, list(names))
        parts.append(found.select(*keys, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("p")).alias("name"), "value"))
    names = [n for of in wanted.values() for n in of.values()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def workflow_matrix(rows: DataFrame, spread: bool = False) -> DataFrame:
    """Cells of flavor x configuration: dispositions, rates, cost per useful result, typical cost, duration and tokens, cache share.

    Medians and 90th percentiles interpolate and leave out runs killed from outside; spend does not. Best and worst value mark the
    cheapest and dearest of at least two cells of a flavor with enough runs. With ``spread`` no cell's values are gathered in one task, for cells of
    any size; ``rows`` should be a written table then.
    """
    outside = F.col("attribution").isin(*OUTSIDE)
    typical = F.col("error_class").isNull() | ~outside
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    typ = lambda c: F.when(typical, F.col(c))
    gathered = (
        F.percentile(typ("cost_usd"), 0.5).alias("median_cost_usd"), F.percentile(typ("cost_usd"), 0.9).alias("p90_cost_usd"),
        F.percentile(typ("duration_ms"), 0.5).alias("median_duration_ms"), F.percentile(typ("duration_ms"), 0.9).alias("p90_duration_ms"),
        F.percentile(F.when(typical & (F.col("total_tokens") > 0), F.col("total_tokens")), 0.5).alias("median_tokens"),
    )
    g = rows.groupBy("flavor", "configuration").agg(
        F.count(F.lit(1)).alias("attempts"), *[n(F.col("disposition") == d).alias(d) for d in ("advanced", "escalated", "error", "retried", "open")],
        n(F.col("error_class").isNotNull() & ~outside).alias("agent_errors"), n(F.col("error_class").isNotNull() & outside).alias("infrastructure_errors"),
        F.count("cost_usd").alias("priced_attempts"), F.sum("cost_usd").alias("cost_usd"),
        *([] if spread else gathered),
        F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read_input_tokens").alias("cache_read_tokens"),
    )
    if spread:
        g = g.join(_spread_percentiles(rows, typical), ["flavor", "configuration"], "left")
    per = F.when((F.col("advanced") > 0) & (F.col("priced_attempts") > 0), F.col("cost_usd") * F.col("attempts") / F.col("priced_attempts") / F.col("advanced"))
    g = g.withColumns({
        "advance_rate": ratio(F.col("advanced"), F.col("attempts")), "error_rate": ratio(F.col("error"), F.col("attempts")), "escalation_rate": ratio(F.col("escalated"), F.col("attempts")),
        "agent_error_rate": ratio(F.col("agent_errors"), F.col("attempts") - F.col("infrastructure_errors")), "cost_per_advance_usd": per,
        "cache_read_share": ratio(F.col("cache_read_tokens"), F.col("input_tokens")), "low_sample": F.col("attempts") < MIN_SAMPLE,
    })
    able = (F.col("attempts") >= MIN_SAMPLE) & F.col("cost_per_advance_usd").isNotNull()
    w = Window.partitionBy("flavor", able)
    cheap = F.rank().over(w.orderBy("cost_per_advance_usd", "configuration"))
    dear = F.rank().over(w.orderBy(F.desc("cost_per_advance_usd"), "configuration"))
    many = F.count(F.lit(1)).over(w) >= 2
    return g.withColumn("value_flag", F.when(able & many & (cheap == 1), "best").when(able & many & (dear == 1), "worst"))


def top_errors(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent failure signatures of each cell."""
    n = rows.where("error_signature is not null").groupBy("flavor", "configuration", "error_signature").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("flavor", "configuration").orderBy(F.desc("n"), "error_signature")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def flavor_summary(tasks: DataFrame) -> DataFrame:
    """Per flavor: tasks, error and revisit rates, median queue wait, number of versions, and the version history with its error rates.

    ``tasks`` carries error_class, revisit, started_at. The history is one struct per definition version.
    """
    err = F.col("error_class").isNotNull().cast("int")
    v = tasks.groupBy("flavor", "version").agg(F.min("created_at").alias("first_seen"), F.count(F.lit(1)).alias("n"), F.avg(err).alias("error_rate"))
    h = v.groupBy("flavor").agg(F.count(F.lit(1)).alias("versions"), F.sort_array(F.collect_list(F.struct("first_seen", "version", "n", "error_rate"))).alias("history"))
    wait = F.unix_millis("started_at") - F.unix_millis("created_at")
    g = tasks.groupBy("flavor").agg(F.count(F.lit(1)).alias("tasks"), F.avg(err).alias("error_rate"), F.avg(F.col("revisit").cast("int")).alias("revisit_rate"), F.percentile(wait, 0.5).alias("median_wait_ms"))
    return g.join(h, "flavor")


def definition_shift(tasks: DataFrame, least: int = 10, change: float = 0.15) -> DataFrame:
    """Flavors whose last definition's error rate differs by ``change`` or more from the one before, with ``least`` tasks each."""
    err = F.col("error_class").isNotNull().cast("int")
    v = tasks.groupBy("flavor", "version").agg(F.min("created_at").alias("first_seen"), F.count(F.lit(1)).alias("n"), F.avg(err).alias("error_rate"))
    w = Window.partitionBy("flavor").orderBy("first_seen", "version")
    v = v.withColumns({"before_rate": F.lag("error_rate").over(w), "before_n": F.lag("n").over(w), "is_last": F.lead("version").over(w).isNull()})
    shift = F.col("error_rate") - F.col("before_rate")
    return v.where(F.col("is_last") & (F.col("n") >= least) & (F.col("before_n") >= least) & (F.abs(shift) >= change)).select("flavor", "version", "error_rate", "before_rate", F.round(shift, 6).alias("change"))


def workflow_graph(tasks: DataFrame) -> DataFrame:
    """Edges (parent flavor, outcome) -> flavor with counts and the share that ended in an error. ``tasks`` went through task_links."""
    e = tasks.where("parent_flavor is not null").groupBy("parent_flavor", "parent_outcome", "flavor")
    return e.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("error_class").isNotNull().cast("int")).alias("error_share"))


def graph_neighbours(edges: DataFrame, flavor: str, k: int = 5) -> DataFrame:
    """The largest incoming and outgoing edges of one flavor."""
    both = edges.where(F.col("flavor") == flavor).select(F.lit("in").alias("direction"), F.col("parent_flavor").alias("other"), "n").union(edges.where(F.col("parent_flavor") == flavor).select(F.lit("out"), "flavor", "n"))
    g = both.groupBy("direction", "other").agg(F.sum("n").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("n"), "other"))).where(F.col("rank") <= k)


def error_clusters(rows: DataFrame, samples: int = 5) -> DataFrame:
    """Failures by class and signature: tasks, flavors, human follow-ups, cost, first and last time, newest samples.

    Samples are ranked by a window first, so no group is collected whole.
    """
    e = rows.where("error_class is not null")
    keys = ["error_class", "error_signature"]
    g = e.groupBy(*keys).agg(
        F.first("attribution").alias("attribution"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("flavor").alias("flavors"), F.countDistinct("configuration").alias("configurations"),
        F.countDistinct(F.when(F.col("human_followup"), F.col("task_id"))).alias("human_followups"), F.sum("cost_usd").alias("cost_usd"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), "task_id")
    s = e.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", "task_id"))).alias("_s"))
    top = e.groupBy(*keys, "flavor").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max_by("flavor", F.struct("n", "flavor")).alias("main_flavor"))
    return g.join(s, keys).join(top, keys).withColumn("samples", F.transform("_s", lambda x: x["task_id"])).drop("_s")


def candidate_summary(rows: DataFrame, tasks: DataFrame, step_limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(summary, top): status counts, median and 90th percentile of steps, cost, candidates near the step limit; the 15 dearest."""
    steps = tasks.where("candidate_id is not null").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("steps"), F.max_by("state", F.struct("created_at", "task_id")).alias("state"))
    c = steps.join(rows.groupBy("candidate_id").agg(F.sum("cost_usd").alias("cost_usd")), "candidate_id", "left")
    s = c.agg(F.count(F.lit(1)).alias("candidates"), F.percentile("steps", 0.5).alias("median_steps"), F.percentile("steps", 0.9).alias("p90_steps"), F.sum("cost_usd").alias("cost_usd"), F.sum((F.col("steps") >= 0.8 * step_limit).cast("long")).alias("near_limit"))
    return s, c.orderBy(F.desc_nulls_last("cost_usd"), "candidate_id").limit(15)


def candidate_home(tasks: DataFrame) -> DataFrame:
    """Installation of each candidate: that of its first task."""
    return tasks.where("candidate_id is not null").groupBy("candidate_id").agg(F.min_by("installation_id", F.struct("created_at", "task_id")).alias("installation_id"))


def human_summary(tasks: DataFrame, now: str) -> DataFrame:
    """One row: human tasks, pending ones, the share an error caused, and the age of the oldest pending one. ``tasks``: + cause."""
    h = tasks.where("is_human")
    pending = F.col("finished_at").isNull()
    oldest = F.min(F.when(pending, F.col("created_at")))
    return h.agg(F.count(F.lit(1)).alias("human_tasks"), F.coalesce(F.sum(pending.cast("long")), F.lit(0)).alias("pending"), F.coalesce(F.sum(F.col("parent_error").isNotNull().cast("long")), F.lit(0)).alias("error_caused"), F.avg((F.col("parent_error").isNotNull()).cast("int")).alias("error_caused_share"), ((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(oldest)) / 3600.0).alias("oldest_pending_hours"))


def human_causes(tasks: DataFrame, k: int = 12) -> DataFrame:
    return tasks.where("is_human").groupBy(F.coalesce("parent_flavor", F.lit("none")).alias("cause")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cause").limit(k)


def contract_repairs(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Repair counts per flavor from (task_id, kind) events: invalid handoffs, repairs started, recovered and failed."""
    kinds = {"handoff_invalid": "invalid_handoffs", "contract_repair_started": "repairs_started", "contract_repair_succeeded": "repairs_recovered", "contract_repair_failed": "repairs_failed"}
    j = events.where(F.col("kind").isin(*kinds)).join(tasks.select("task_id", "flavor"), "task_id")
    return j.groupBy("flavor").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(v) for k, v in kinds.items()])


def review_summary(findings: DataFrame) -> DataFrame:
    """Findings per implementing configuration, per run, with severities. ``findings``: event_configuration, event_attempt_id, severity, path."""
    return findings.where("event_configuration is not null").groupBy(F.col("event_configuration").alias("configuration")).agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("event_attempt_id").alias("runs"), F.sum((F.col("severity") == "high").cast("long")).alias("high"), F.countDistinct("path").alias("files"),
    ).withColumn("per_run", ratio(F.col("findings"), F.col("runs")))


def workflow_totals(rows: DataFrame) -> DataFrame:
    """Totals and coverage per configuration: attempts with tokens and with a price."""
    return rows.groupBy("configuration").agg(F.count(F.lit(1)).alias("attempts"), F.sum((F.col("total_tokens") > 0).cast("long")).alias("with_tokens"), F.count("cost_usd").alias("priced"), F.sum("cost_usd").alias("cost_usd"))


def projects(installations: DataFrame, tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Installations of one project combined: task and attempt counts, last activity, most recent first."""
    t = tasks.groupBy("installation_id").agg(F.count(F.lit(1)).alias("tasks"), F.max("created_at").alias("last_at"))
    a = attempts.join(tasks.select("task_id", "installation_id"), "task_id").groupBy("installation_id").agg(F.count(F.lit(1)).alias("attempts"))
    j = installations.join(t, "installation_id", "left").join(a, "installation_id", "left")
    return j.groupBy("project").agg(F.count(F.lit(1)).alias("installations"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.max("last_at").alias("last_at")).orderBy(F.desc_nulls_last("last_at"), "project")


def enqueue_bursts(tasks: DataFrame, gap: str = "10 minutes", least: int = 5) -> DataFrame:
    """Bursts of root tasks (no parent, not created by a task) with gaps of at most ``gap``: start, end, tasks, flavor counts, newest first.

    Tasks are counted per slot of one gap's length first, as those of a slot are of one burst: the ordered window, which has no key,
    sees a row per slot, whose number depends on the time covered and not on the tasks.
    """
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
    width = F.unix_micros(zero + F.expr(f"interval {gap}")) - F.unix_micros(zero)
    roots = tasks.where("parent_id is null and created_by is null and created_at is not null")
    per = roots.withColumn("slot", F.floor(F.unix_micros("created_at") / width)).groupBy("slot", "flavor").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    slots = per.groupBy("slot").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    w = Window.orderBy("slot")
    apart = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(w)) > width
    bursts = slots.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("burst", F.sum("_new").over(w)).select("slot", "burst")
    whole = per.join(bursts, "slot").groupBy("burst").agg(F.min("first_at").alias("started_at"), F.max("last_at").alias("ended_at"), F.sum("n").alias("root_tasks"), F.countDistinct("flavor").alias("flavors"))
    return whole.where(F.col("root_tasks") >= least).drop("burst").orderBy(F.desc("started_at"))


def definition_changes(tasks: DataFrame, bursts: DataFrame) -> DataFrame:
    """New definitions of each burst: (started_at, flavor, version, during). First definitions ever are no change."""
    seen = tasks.groupBy("flavor", "version").agg(F.min("created_at").alias("first_seen"))
    w = Window.partitionBy("flavor").orderBy("first_seen", "version")
    new = seen.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
    day = lambda c: F.to_date(c).alias("day")
    # the last burst of the same day, else that of a day before: joins on days, and a window over one row per day
    of_day = bursts.select(day("started_at"), "started_at")
    same = new.select("flavor", "version", "first_seen", day("first_seen")).join(of_day, "day", "left")
    same = same.groupBy("flavor", "version", "first_seen", "day").agg(F.max(F.when(F.col("started_at") <= F.col("first_seen"), F.col("started_at"))).alias("started_at"))
    days = of_day.groupBy("day").agg(F.max("started_at").alias("last")).unionByName(same.select("day").distinct().withColumn("last", F.lit(None).cast("timestamp")))
    days = days.groupBy("day").agg(F.max("last").alias("last"))
    before = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row per calendar day
    days = days.withColumn("earlier", F.max("last").over(before)).drop("last")
    found = same.join(days, "day").withColumn("started_at", F.coalesce("started_at", "earlier")).where("started_at is not null")
    return found.select("started_at", "flavor", "version", (F.col("first_seen") > F.col("started_at")).alias("during"))


def window_filter(tasks: DataFrame, since: str | None = None, until: str | None = None, last_days: int | None = None, now: str | None = None, bursts: DataFrame | None = None) -> DataFrame:
    """Tasks of an analysis window: since / until, the last N days, or from the latest burst on (if given)."""
    at = F.col("created_at")
    if since:
        tasks = tasks.where(at >= F.lit(since).cast("timestamp"))
    if until:
        tasks = tasks.where(at < F.lit(until).cast("timestamp"))
    if last_days:
        tasks = tasks.where(at >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(last_days)} days"))
    if bursts is not None:
        latest = bursts.agg(F.max("started_at").alias("_from"))  # one row
        tasks = tasks.join(F.broadcast(latest), at >= F.col("_from")).drop("_from")
    return tasks


def current_definitions(tasks: DataFrame) -> DataFrame:
    """Tasks that ran the newest definition of their flavor."""
    new = tasks.groupBy("flavor").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))
    return tasks.join(new, ["flavor", "version"], "left_semi")


def cost_outliers(rows: DataFrame, least: int = 5, k: int = 12) -> DataFrame:
    """Runs at three times their cell's median cost or more and two dollars above it, in cells with enough priced runs; the k largest."""
    med = rows.where("cost_usd is not null").groupBy("flavor", "configuration").agg(F.percentile("cost_usd", 0.5).alias("median_cost_usd"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    j = rows.join(med, ["flavor", "configuration"])
    out = j.where((F.col("cost_usd") >= 3 * F.col("median_cost_usd")) & (F.col("cost_usd") >= F.col("median_cost_usd") + 2))
    return out.select("attempt_id", "flavor", "configuration", "cost_usd", "median_cost_usd").orderBy(F.desc("cost_usd"), "attempt_id").limit(k)


def severity(n: Column, high: int = 20, medium: int = 5) -> Column:
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")


def detectors(matrix: DataFrame, clusters: DataFrame, contracts: DataFrame, outliers: DataFrame, candidates: DataFrame, people: DataFrame, shifts: DataFrame, flavors: DataFrame, totals: DataFrame) -> DataFrame:
    """Concerns as uniform rows (kind, subject, severity, n, detail), most severe first, from the summaries of this module.

    Error clusters: the ten largest with three tasks or more. Unreliable cells: a quarter of five runs or more, with a peer of the flavor
    that fails 15 points less named where there is one.
    """
    one = lambda df, kind, subject, sev, n, detail: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), sev.alias("severity"), n.cast("double").alias("n"), detail.cast("string").alias("detail"))
    c = F.col
    cell = F.concat_ws(" on ", "flavor", "configuration")
    top = clusters.orderBy(F.desc("tasks"), "error_signature").limit(10).where("tasks >= 3")
    able = matrix.where("attempts >= 5 and agent_error_rate is not null")
    peers = able.select("flavor", c("configuration").alias("peer"), c("agent_error_rate").alias("_rate"), c("attempts").alias("_n"))
    bad = able.where("agent_error_rate >= 0.25").join(peers, "flavor", "left")
    better = (c("peer") != c("configuration")) & (c("_rate") <= c("agent_error_rate") - 0.15)
    bad = bad.groupBy("flavor", "configuration", "agent_errors").agg(F.max_by(F.when(better, c("peer")), F.when(better, F.struct("_n", "peer"))).alias("peer"))
    excess = outliers.agg(F.sum(c("cost_usd") - c("median_cost_usd")).alias("excess"), F.count(F.lit(1)).alias("runs")).where("runs > 0")
    loops = flavors.where("tasks >= 10 and revisit_rate >= 0.35").orderBy(F.desc("revisit_rate"), "flavor").limit(3)
    parts = [
        one(top, "error_cluster", c("error_signature"), F.when(c("human_followups") >= 10, "high").otherwise(severity(c("tasks"))), c("tasks"), c("attribution")),
        one(bad, "configuration_reliability", cell, severity(c("agent_errors")), c("agent_errors"), c("peer")),
        one(contracts.where("repairs_started >= 5 and repairs_failed >= 0.5 * repairs_started"), "output_contract", c("flavor"), severity(c("repairs_failed")), c("repairs_failed"), c("repairs_started")),
        one(excess, "cost_outlier", F.lit("runs far above their cell's median"), F.when(c("excess") >= 50, "medium").otherwise("low"), c("runs"), F.round("excess", 2)),
        one(candidates.where("near_limit > 0"), "budget_pressure", F.lit("candidates near the step limit"), severity(c("near_limit"), 10, 3), c("near_limit"), c("p90_steps")),
        one(loops, "rework_loop", c("flavor"), F.lit("medium"), F.round(c("revisit_rate") * c("tasks")), F.round("revisit_rate", 4)),
        one(people.where("error_caused_share >= 0.3 and error_caused >= 10"), "human_attention", F.lit("human tasks that errors caused"), F.lit("high"), c("error_caused"), F.round("error_caused_share", 4)),
        one(people.where("pending >= 10"), "human_queue", F.lit("pending human tasks"), severity(c("pending"), 50, 10), c("pending"), F.round("oldest_pending_hours", 1)),
        one(totals.where("attempts >= 5 and with_tokens < 0.8 * attempts"), "coverage_gap", c("configuration"), F.lit("low"), c("attempts"), c("with_tokens")),
        one(shifts.where("change > 0"), "shape_regression", c("flavor"), F.lit("high"), c("change"), c("version")),
        one(shifts.where("change < 0"), "shape_improvement", c("flavor"), F.lit("info"), -c("change"), c("version")),
        one(matrix.where("input_tokens >= 20000000 and attempts >= 5 and cache_read_share < 0.6"), "cache_efficiency", cell, F.lit("low"), c("attempts"), F.round("cache_read_share", 4)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(c("severity") == "high", 0).when(c("severity") == "medium", 1).when(c("severity") == "low", 2).otherwise(3)
    return out.orderBy(rank, F.desc("n"), "kind", "subject")


def opportunities(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """Savings: a cheaper configuration as reliable as the one with most runs, and the cost of each error cluster."""
    w = Window.partitionBy("flavor").orderBy(F.desc("attempts"), "configuration")
    m = matrix.withColumn("_n", F.row_number().over(w))
    inc = m.where((F.col("_n") == 1) & (F.col("attempts") >= MIN_SAMPLE)).select("flavor", F.col("configuration").alias("from_configuration"), F.col("cost_per_advance_usd").alias("_price"), F.col("agent_error_rate").alias("_err"), F.col("escalation_rate").alias("_esc"), F.col("advanced").alias("_adv"))
    alt = m.where((F.col("_n") > 1) & (F.col("attempts") >= MIN_SAMPLE)).join(inc, "flavor")
    good = (F.col("cost_per_advance_usd") < 0.8 * F.col("_price")) & (F.col("agent_error_rate") <= F.col("_err") + 0.05) & (F.col("escalation_rate") <= F.col("_esc") + 0.05)
    a = alt.where(good).select(F.lit("cheaper_configuration").alias("kind"), "flavor", "from_configuration", F.col("configuration").alias("to"), ((F.col("_price") - F.col("cost_per_advance_usd")) * F.col("_adv")).alias("savings_usd"), F.lit(0).cast("long").alias("human_tasks"))
    top = clusters.orderBy(F.desc("tasks"), "error_signature").limit(8).where("cost_usd >= 1")
    b = top.select(F.lit("fix_error_cluster").alias("kind"), F.col("main_flavor").alias("flavor"), F.lit(None).cast("string").alias("from_configuration"), F.col("error_signature").alias("to"), F.col("cost_usd").alias("savings_usd"), F.col("human_followups").cast("long").alias("human_tasks"))
    return a.unionByName(b).orderBy(F.desc("savings_usd"), F.desc("human_tasks"), "kind", "flavor", "to")
