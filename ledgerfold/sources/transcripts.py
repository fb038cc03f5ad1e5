"""Readers of agent transcripts: event lines become rows of one message table.

Lines are read as text and only the paths that are needed are taken from their JSON (no inference: provider events are
polymorphic). File and line order come from the file path and the line's position in it; a file is one conversation, so the
ordering windows are as large as a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold import schemas
from ledgerfold.functions import dates
from ledgerfold.functions import text as T
from ledgerfold.session import materialize
from ledgerfold.sources.exports import json_records


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of every line that isn't blank; ``line`` orders the lines of a file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    # the id grows with the position inside a split, and splits of a file are numbered in order
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value").where(F.trim("value") != "")
    w = Window.partitionBy("file").orderBy("block", "n")
    return rows.select("file", F.row_number().over(w).alias("line"), "value")


def _get(path: str, source: str = "value") -> Column:
    return F.get_json_object(source, f"$.{path}")


def _messages(df: DataFrame) -> DataFrame:
    """The columns of the message table, in its order and types; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MESSAGE])


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    """Messages of session files: text, tool calls and results, usage and compactions.

    Files under ``<session>/subagents/`` belong to their root session, as the stream of the sub-agent. The model carries forward
    inside a file.
    """
    up = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return claude_messages(_lines(spark, path).withColumn("model", F.last(claude_model(), ignorenulls=True).over(up)))


def claude_model() -> Column:
    """The model a session line names, which holds for the lines after it."""
    return _get("message.model")


def claude_messages(lines: DataFrame) -> DataFrame:
    """Messages of session lines (file, line, value, model); the model is the one carried forward to the line."""
    file = F.col("file")
    session = F.coalesce(F.nullif(F.regexp_extract(file, r"([^/]+)/subagents/", 1), F.lit("")), F.regexp_extract(file, r"([^/]+)\.jsonl$", 1))
    stream = F.nullif(F.regexp_extract(file, r"/subagents/(?:.*/)?([^/]+)\.jsonl$", 1), F.lit(""))
    e = lines.select(
        "file", "line", "value", session.alias("conversation_id"), stream.alias("parent_native_id"), _get("type").alias("type"), _get("subtype").alias("subtype"), _get("uuid").alias("uuid"),
        dates.parse_timestamp(_get("timestamp")).alias("created_at"), _get("message.role").alias("role"), _get("message.content").alias("content"), _get("message.usage").isNotNull().alias("has_usage"), "model",
    )
    blocks = F.when(F.col("content").startswith("["), F.from_json("content", schemas.CLAUDE_BLOCKS)).otherwise(F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))), schemas.CLAUDE_BLOCKS[6:-1])))
    talk = e.where(F.col("content").isNotNull()).select("*", F.posexplode(blocks).alias("block_no", "b"))
    kind = F.element_at(F.create_map(F.lit("tool_use"), F.lit("tool_call"), F.lit("tool_result"), F.lit("tool_result"), F.lit("text"), F.lit("text")), F.col("b.type"))
    rows = talk.select(
        F.lit("claude").alias("provider"), "conversation_id", (F.col("line") * 1000 + F.col("block_no")).alias("source_order"), F.concat_ws(":", "uuid", "block_no").alias("native_id"), "parent_native_id",
        F.coalesce("b.id", "b.tool_use_id").alias("call_id"), "role", F.coalesce(kind, F.lit("metadata")).alias("kind"), "model", F.coalesce("b.text", "b.input", "b.content").alias("text"),
        F.when((F.col("block_no") == 0) & F.col("has_usage"), F.col("value")).alias("raw_text"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), "created_at", "file",
    )
    rest = e.where(F.col("content").isNull()).select(
        F.lit("claude").alias("provider"), "conversation_id", (F.col("line") * 1000).alias("source_order"), F.col("uuid").alias("native_id"), "parent_native_id", F.col("type").alias("role"),
        F.when(F.col("subtype") == "compact_boundary", "compaction").otherwise("metadata").alias("kind"), "model", F.col("value").alias("text"), F.col("value").alias("raw_text"), "created_at", "file",
    )
    both = rows.unionByName(rest, allowMissingColumns=True)
    return _messages(both.withColumn("id", T.stable_id("message", F.lit("claude"), F.col("file"), F.col("source_order"))))


def read_codex(spark: SparkSession, path: str) -> DataFrame:
    """Messages of rollout files: session metadata, model carried forward, text, calls, outputs, searches and token counts."""
    whole = Window.partitionBy("file").orderBy("line")
    up, all_ = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = _lines(spark, path).withColumns({"model": F.last(codex_model(), ignorenulls=True).over(up), "session": F.first(codex_session(), ignorenulls=True).over(all_)})
    return codex_messages(lines)


def codex_model() -> Column:
    """The model a rollout line names, which holds for the lines after it."""
    return F.when(_get("type") == "turn_context", _get("model", F.coalesce(_get("payload"), F.col("value"))))


def codex_session() -> Column:
    """The session a rollout line declares; a file's first one holds for all its lines."""
    return F.when(_get("type") == "session_meta", _get("id", F.coalesce(_get("payload"), F.col("value"))))


def codex_messages(lines: DataFrame) -> DataFrame:
    """Messages of rollout lines (file, line, value, model, session)."""
    p = F.coalesce(_get("payload"), F.col("value"))
    e = lines.select("file", "line", "value", "model", "session", _get("type").alias("type"), p.alias("p"), dates.parse_timestamp(_get("timestamp")).alias("created_at"))
    named = F.regexp_extract("file", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1)
    e = e.withColumns({"conversation_id": F.coalesce(F.nullif(named, F.lit("")), "session", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)), "ptype": _get("type", "p")})
    kind = (
        F.when(F.col("ptype").isin("function_call", "custom_tool_call", "local_shell_call", "web_search_call"), "tool_call").when(F.col("ptype").isin("function_call_output", "custom_tool_call_output"), "tool_result")
        .when(F.col("ptype") == "message", "text").when((F.col("type") == "compacted") | (F.col("ptype") == "compaction"), "compaction").otherwise("metadata")
    )
    said = F.array_join(F.filter(F.from_json(_get("content", "p"), "array<struct<type:string,text:string>>").getField("text"), lambda x: x.isNotNull()), "\n")
    text = F.when(kind == "text", said).when(kind == "tool_call", F.coalesce(_get("arguments", "p"), _get("input", "p"), _get("action", "p"))).when(kind == "tool_result", _get("output", "p")).otherwise(F.col("value"))
    usage = F.col("value").contains("token_usage") | F.col("value").contains('"usage"')
    rows = e.select(
        F.lit("codex").alias("provider"), "conversation_id", (F.col("line") * 1000).alias("source_order"), _get("id", "p").alias("native_id"), _get("call_id", "p").alias("call_id"), F.coalesce(_get("role", "p"), F.when(kind == "tool_call", "assistant")).alias("role"),
        kind.alias("kind"), "model", text.alias("text"), F.when(usage, F.col("value")).alias("raw_text"), "created_at", T.stable_id("message", F.lit("codex"), F.col("file"), F.col("line")).alias("id"),
    )
    return _messages(rows.withColumn("is_error", F.lit(False)))


def read_chatgpt(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an export: the graph's nodes that hold a message, by time, then id."""
    c = json_records(spark, path).select(F.from_json("record", schemas.EXPORT_CONVERSATION).alias("c")).select("c.*")
    m = c.select("conversation_id", F.explode("mapping").alias("node", "v")).select("conversation_id", "node", "v.message.*").where("id is not null")
    w = Window.partitionBy("conversation_id").orderBy(F.col("create_time").asc_nulls_first(), "id")
    rows = m.select(
        F.lit("chatgpt").alias("provider"), "conversation_id", F.row_number().over(w).alias("source_order"), T.stable_id("message", F.lit("chatgpt"), F.col("conversation_id"), F.col("id")).alias("id"), F.col("id").alias("native_id"),
        F.col("author.role").alias("role"), F.lit("text").alias("kind"), F.array_join("content.parts", "\n").alias("text"), F.timestamp_millis(F.round(F.col("create_time") * 1000).cast("long")).alias("created_at"), F.lit(False).alias("is_error"),
    )
    return _messages(rows)


def read_canonical(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of canonical exports (one workspace or ``{"workspaces": [...]}`` a file): workspaces, conversations, messages, changes, metrics, prs."""
    w = json_records(spark, path).select(F.from_json("record", schemas.CANONICAL_WORKSPACE).alias("w")).select("w.*").where("id is not null")
    w = materialize(w).withColumn("workspace_id", T.stable_id("workspace", F.col("source_kind"), F.col("id"))).withColumn("activity_at", dates.parse_timestamp(F.col("activity_at")))
    c = w.select("workspace_id", F.inline("conversations")).withColumn("conversation_id", T.stable_id("conversation", F.col("workspace_id"), F.col("id")))
    m = c.select("workspace_id", "conversation_id", "provider", F.posexplode("messages").alias("source_order", "m")).select("workspace_id", "conversation_id", "provider", "source_order", "m.*")
    return {
        "workspaces": w.drop("conversations", "changes", "metrics", "prs"), "conversations": c.drop("messages"), "messages": m.withColumn("created_at", dates.parse_timestamp(F.col("created_at"))),
        "changes": w.select("workspace_id", F.inline("changes")).select("workspace_id", "classification", "base_id", "head_id", F.inline_outer("files")),
        "metrics": w.select("workspace_id", F.inline("metrics")), "prs": w.select("workspace_id", F.inline("prs")),
    }


def pick_message_field(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``text`` and ``text_field``: the longest populated of the columns, the earlier one on a tie, and which it was."""
    best = F.greatest(*[F.struct(F.coalesce(F.length(c), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("field"), F.col(c).alias("text")) for i, c in enumerate(cols)])
    return df.withColumn("_b", best).withColumn("text", F.when(F.col("_b.n") > 0, F.col("_b.text"))).withColumn("text_field", F.when(F.col("_b.n") > 0, F.col("_b.field"))).drop("_b")
