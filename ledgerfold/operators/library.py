"""One wide row per work, structured search over works, derived metrics, documents to embed, incremental refresh.

Every child table is aggregated by work once; the aggregates share the key, so their joins need no second shuffle of the
children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import clip
from ledgerfold.operators.joins import having


def library_rows(works: DataFrame, conversations: DataFrame, messages: DataFrame, changes: DataFrame, prs: DataFrame) -> DataFrame:
    """Derived columns of works: conversations, user turns, tool uses and errors, compactions, depth, files, pull requests, providers, models."""
    c = conversations.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("conversations"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.sum((F.col("depth") > 0).cast("long")).alias("subagents"), F.max("depth").alias("max_depth"))
    m = messages.groupBy("workspace_id").agg(
        *[F.sum(k.cast("long")).alias(n) for n, k in (("user_turns", (F.col("role") == "user") & (F.col("kind") == "text")), ("tool_uses", F.col("kind") == "tool_call"), ("tool_errors", (F.col("kind") == "tool_result") & F.col("is_error")), ("compactions", F.col("kind") == "compaction"))],
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    f = changes.groupBy("workspace_id").agg(F.countDistinct("path").alias("changed_files"))
    p = prs.select("workspace_id", "host", "number").distinct().groupBy("workspace_id").agg(F.count(F.lit(1)).alias("pull_requests"), F.to_json(F.sort_array(F.collect_list(F.struct("host", "number")))).alias("pr_list"))
    out = works
    for child in (c, m, f, p):
        out = out.join(child, "workspace_id", "left")
    return out.fillna(0, ["conversations", "subagents", "user_turns", "tool_uses", "tool_errors", "compactions", "changed_files", "pull_requests"])


def derived_metrics(messages: DataFrame) -> DataFrame:
    """Per work: user, agent and delegated turns, tool calls, visible errors and the span of time in seconds."""
    n = lambda c: F.sum(c.cast("long"))
    k, r = F.col("kind"), F.col("role")
    return messages.groupBy("workspace_id").agg(
        n((r == "user") & (k == "text")).alias("user_turns"), n((r == "assistant") & (k == "text")).alias("agent_turns"), n(k == "delegation").alias("delegated_turns"),
        n(k == "tool_call").alias("tool_calls"), n(F.coalesce(F.col("is_error"), F.lit(False))).alias("visible_errors"), (F.unix_seconds(F.max("created_at")) - F.unix_seconds(F.min("created_at"))).alias("span_seconds"))


def event_ledger(messages: DataFrame) -> DataFrame:
    """Messages in order: (workspace_id, sequence, kind, is_error)."""
    w = Window.partitionBy("workspace_id").orderBy(F.col("source_order").asc_nulls_last(), "created_at", "id")
    return messages.select("workspace_id", F.row_number().over(w).alias("sequence"), "kind", F.coalesce("is_error", F.lit(False)).alias("is_error"))


def search_work(works: DataFrame, *, text: dict[str, str] | None = None, equal: dict[str, object] | None = None, since: str | None = None, until: str | None = None, children: list[tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """Works by LIKE texts, equal fields, activity range (a date-only upper bound covers its day) and rows they must have elsewhere."""
    for name, value in (text or {}).items():
        works = works.where(F.lower(name).contains(value.lower()))
    for name, value in (equal or {}).items():
        works = works.where(F.col(name) == F.lit(value))
    if since:
        works = works.where(F.col("activity_at") >= F.lit(since).cast("timestamp"))
    if until:
        end = F.lit(until).cast("timestamp")
        works = works.where(F.col("activity_at") < (end + F.expr("interval 1 day") if len(until) == 10 else end))
    for child, predicate in children or []:
        works = having(works, child, "workspace_id", predicate)
    return works


def message_window(messages: DataFrame, anchor: object, n: int) -> DataFrame:
    """The n messages before and after an anchor message in its conversation, with positions."""
    conv = messages.where(F.col("id") == F.lit(anchor)).select("conversation_id")
    own = messages.join(F.broadcast(conv.limit(1)), "conversation_id", "left_semi")
    w = Window.partitionBy("conversation_id").orderBy(F.col("source_order").asc_nulls_last(), "created_at", "id")
    at = own.withColumn("position", F.row_number().over(w))
    mid = at.where(F.col("id") == F.lit(anchor)).select("conversation_id", F.col("position").alias("_mid"))
    return at.join(F.broadcast(mid), "conversation_id").where(F.abs(F.col("position") - F.col("_mid")) <= n).drop("_mid")


def first_and_last(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """First user request and last assistant reply per conversation (or work)."""
    at = F.struct(F.coalesce("source_order", F.lit(2**62)), "created_at", "id")
    return messages.where("kind = 'text'").groupBy(key).agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", at)).alias("first_request"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", at)).alias("last_reply"))


def documents(works: DataFrame, ends: DataFrame, failures: DataFrame, clip_at: int = 2000) -> DataFrame:
    """Text to embed per work: title, purpose, outcome, first request, last reply and three failures; the title where all is empty."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), "text")
    f = failures.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy("workspace_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n").alias("failures"))
    j = works.join(ends, "workspace_id", "left").join(f, "workspace_id", "left")
    parts = [F.when(F.col(c) != "", clip(F.col(c), clip_at)) for c in ("title", "purpose", "outcome", "first_request", "last_reply", "failures")]
    return j.select("workspace_id", F.concat_ws("\n", *parts).alias("text"))


def sightings(observations: DataFrame) -> DataFrame:
    """First and last seen, and the message count at the last sighting, per (conversation, host, origin)."""
    return observations.groupBy("conversation_id", "host", "origin").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max_by("message_count", F.struct("seen_at", "message_count")).alias("messages"))


def refresh(stored: DataFrame, changed_keys: DataFrame, recompute, key: str = "workspace_id") -> DataFrame:
    """Stored rows with those of changed works recomputed: ``recompute`` gets the distinct changed keys and returns their rows."""
    keys = changed_keys.select(key).distinct()
    return stored.join(keys, key, "left_anti").unionByName(recompute(keys))
