"""Joins by time, scope and absence that other jobs share, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.graph import connected_components


def having(df: DataFrame, child: DataFrame, key: str, predicate: Column | None = None) -> DataFrame:
    """Rows that have a child row (for which the predicate holds)."""
    return df.join((child.where(predicate) if predicate is not None else child).select(key), key, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(keys.select(key), key, "left_anti")


def asof_backward(points: DataFrame, events: DataFrame, keys: list[str], point_ts: str, event_ts: str, payload: list[str]) -> DataFrame:
    """Adds to each point the payload of the last event of its key at or before it; nulls without one.

    Union and window: one shuffle by key, no range join. Ties of time go to the event with the largest payload.
    """
    e = events.select(*keys, F.col(event_ts).alias("_t"), F.lit(0).alias("_p"), F.struct(*payload).alias("_e"))
    p = points.select("*", F.col(point_ts).alias("_t"), F.lit(1).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("_t", "_p", "_e").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(e, allowMissingColumns=True)
    got = both.withColumn("_got", F.last("_e", ignorenulls=True).over(w)).where("_p = 1")
    return got.select(*points.columns, *[F.col(f"_got.{c}").alias(f"event_{c}") for c in payload])


def attribute_changes(changes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversation of each change set, and how it was found.

    ``changes``: change_id, workspace_id, work_item, at; ``conversations``: conversation_id, workspace_id, work_item, started_at,
    ended_at. The only conversation of the work, else the only one of the work item, else the only one whose span contains
    the time; otherwise the change belongs to the work as a whole.
    """
    c = conversations.where("conversation_id is not null")
    one = lambda name: (F.count(F.lit(1)).alias(f"n_{name}"), F.min("conversation_id").alias(f"c_{name}"))
    works = c.groupBy("workspace_id").agg(*one("all"))
    items = c.where("work_item is not null").groupBy("workspace_id", "work_item").agg(*one("item"))
    known = changes.join(works, "workspace_id", "left").join(items, ["workspace_id", "work_item"], "left")
    pick = F.when(F.col("n_all") == 1, F.col("c_all")).when(F.col("n_item") == 1, F.col("c_item"))
    how = F.when(F.col("n_all") == 1, "sole").when(F.col("n_item") == 1, "work_item")
    known = known.withColumns({"_pick": pick, "_how": how})
    timed = only_open(known, c)
    return timed.select("change_id", "workspace_id", F.coalesce("_pick", F.when(F.col("_how").isNull(), F.col("c_time"))).alias("conversation_id"), F.coalesce("_how", F.when(F.col("c_time").isNotNull(), "time"), F.lit("workspace")).alias("scope"))


def only_open(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``c_time`` to each point (workspace_id, at, ...): the only conversation of its work whose span contains the time, else null.

    A sweep over the borders of the spans, both inclusive: spans open so far are counted and their hashes summed, so that where
    one is open the sum is its hash. No pair of a point and a span is made.
    """
    h = F.xxhash64("conversation_id").cast("decimal(20,0)")
    s = spans.where("started_at <= ended_at").select("workspace_id", "started_at", "ended_at", h.alias("_h"), "conversation_id")
    border = lambda at, place, sign: s.select("workspace_id", F.col(at).alias("_t"), F.lit(place).alias("_p"), F.lit(sign).alias("_n"), (F.col("_h") * sign).cast("decimal(20,0)").alias("_h"))
    both = points.withColumns({"_t": F.col("at"), "_p": F.lit(1)}).unionByName(border("started_at", 0, 1).unionByName(border("ended_at", 2, -1)), allowMissingColumns=True)
    w = Window.partitionBy("workspace_id").orderBy("_t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumns({"_open": F.sum("_n").over(w), "_sum": F.sum("_h").over(w)}).where("_p = 1")
    swept = swept.withColumn("_h", F.when((F.col("_open") == 1) & F.col("at").isNotNull(), F.col("_sum").cast("decimal(20,0)")))
    names = s.groupBy("workspace_id", "_h").agg(F.min("conversation_id").alias("c_time"))
    return swept.join(names, ["workspace_id", "_h"], "left").select(*points.columns, "c_time")


def identity_links(conversations: DataFrame) -> DataFrame:
    """Ordered pairs of conversations of one account, one of which declares the other's native id among its aliases."""
    said = conversations.select("account", F.col("conversation_id").alias("a"), F.explode("aliases").alias("native_id")).distinct()
    own = conversations.select("account", F.col("conversation_id").alias("b"), "native_id")
    pairs = said.join(own, ["account", "native_id"]).where("a != b")
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()


def propagate_activity(works: DataFrame, links: DataFrame) -> DataFrame:
    """Workflow works take the later activity time of a linked work. ``links``: (left_id, right_id)."""
    both = links.select(F.col("left_id").alias("workspace_id"), F.col("right_id").alias("other")).union(links.select("right_id", "left_id"))
    late = both.join(works.select(F.col("workspace_id").alias("other"), F.col("activity_at").alias("_other_at")), "other").groupBy("workspace_id").agg(F.max("_other_at").alias("_late"))
    out = works.join(late, "workspace_id", "left")
    flow = F.when(F.col("source_kind") == "workflow", F.greatest("activity_at", "_late")).otherwise(F.col("activity_at"))
    return out.withColumn("activity_at", flow).drop("_late")


#: Which of mirrored works represents them, lowest first.
SOURCE_PRIORITY = {"workflow": 0, "codex": 1, "claude": 1, "conductor": 9}


def suppress_mirrors(works: DataFrame, links: DataFrame) -> DataFrame:
    """Groups of works joined by identity links: adds ``representative``, ``is_mirror`` and ``group_size``.

    The representative is the work of the best source priority, then the latest activity, then the smallest id. Groups are connected
    components; ranking uses aggregates, so a very large group is pre-aggregated.
    """
    parts = connected_components(links.select("left_id", "right_id")).withColumnRenamed("vertex", "workspace_id")
    pairs = [F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]
    priority = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source_kind")), F.lit(5))
    w = works.join(parts, "workspace_id", "left").withColumn("component", F.coalesce("component", "workspace_id"))
    key = F.struct(priority.alias("p"), (-F.unix_micros(F.coalesce("activity_at", F.lit("1970-01-01").cast("timestamp")))).alias("t"), F.col("workspace_id"))
    best = w.groupBy("component").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("group_size"), F.array_sort(F.collect_set("source_kind")).alias("sources"))
    out = w.join(best, "component").withColumn("representative", F.col("k.workspace_id"))
    return out.withColumn("is_mirror", F.col("representative") != F.col("workspace_id")).drop("k", "component")


def subagent_parents(conversations: DataFrame) -> DataFrame:
    """(workspace_id, parent): works all of whose conversations have a parent conversation in another work."""
    c = conversations.select("conversation_id", "workspace_id", "parent_id")
    p = c.select(F.col("conversation_id").alias("parent_id"), F.col("workspace_id").alias("parent_work"))
    j = c.join(p, "parent_id", "left").withColumn("away", F.col("parent_work").isNotNull() & (F.col("parent_work") != F.col("workspace_id")))
    g = j.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("away").cast("int")).alias("n_away"), F.min(F.when(F.col("away"), F.col("parent_work"))).alias("parent"))
    return g.where("n = n_away").select("workspace_id", "parent")


def union_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames in which the first frame's row of a key wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_from", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_from", *[c for c in frames[0].columns if c not in keys])
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def except_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def merge_copies(stored: DataFrame, copy: DataFrame, group: str = "conversation_id") -> DataFrame:
    """Messages after a diverging copy arrives: a copy that covers every stored (native_id, content_hash) replaces it, else it only adds new native ids."""
    missing = stored.join(copy.select(group, "native_id", "content_hash"), [group, "native_id", "content_hash"], "left_anti").select(group).distinct()
    came = copy.select(group).distinct()
    replaced = came.join(missing, group, "left_anti")
    keep = stored.join(replaced, group, "left_anti")
    whole = copy.join(replaced, group, "left_semi")
    added = copy.join(missing, group, "left_semi").join(stored.select(group, "native_id"), [group, "native_id"], "left_anti")
    return keep.unionByName(whole).unionByName(added)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in a total order; also the newest rows of a log."""
    return df.orderBy(*order).limit(k)


def rank_by_metric(works: DataFrame, metrics: DataFrame, key: str, value: str) -> DataFrame:
    """Works by a metric, largest first, works without it last."""
    return works.join(metrics.select(key, value), key, "left").orderBy(F.col(value).desc_nulls_last(), key)
