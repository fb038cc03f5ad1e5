"""The tool ledger: requests, calls with results, context cost, cube and daily rollup.

Every per-conversation rule is a window over (conversation, stream) ordered by message index, so one hash
partitioning by conversation serves them all. Only ids, sizes and counters are in these tables; texts stay behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = ("conversation_id", "stream")


def pair_calls_results(messages: DataFrame) -> DataFrame:
    """Calls with their results: the first call and the first result of each (conversation, call_id) win.

    ``messages``: conversation_id, stream, idx, kind (tool_call or tool_result), call_id and more columns. Result
    columns get the prefix ``result_``; a call without a result keeps nulls.
    """
    w = Window.partitionBy("conversation_id", "call_id", "kind").orderBy("idx")
    firsts = messages.where(F.col("kind").isin("tool_call", "tool_result") & F.col("call_id").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    calls = firsts.where("kind = 'tool_call'")
    results = firsts.where("kind = 'tool_result'").select("conversation_id", "call_id", *[F.col(c).alias(f"result_{c}") for c in messages.columns if c not in ("conversation_id", "call_id", "kind")])
    return calls.join(results, ["conversation_id", "call_id"], "left")


def model_requests(reports: DataFrame) -> DataFrame:
    """One row per request key: first place, final counts and model of (conversation_id, stream, request_key, idx, counters)."""
    return reports.groupBy(*STREAM, "request_key").agg(
        F.min("idx").alias("first_idx"), F.min_by("created_at", "idx").alias("requested_at"), F.max_by("model", "idx").alias("model"),
        *[F.max_by(c, "idx").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], F.min_by("native_id", "idx").alias("native_id"),
    ).where("total_tokens > 0")


def merge_anonymous(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """Join consecutive requests without a native id that are one streamed response.

    Same stream, same prompt size and no turn (``turns``: conversation_id, stream, idx) between them; the merged
    request keeps the first place and the largest output. Gaps and islands: a turn or another prompt size starts an island.
    """
    marks = turns.select(*STREAM, "idx", F.lit(1).alias("turn")).unionByName(requests.select(*STREAM, F.col("first_idx").alias("idx"), F.lit(0).alias("turn"), "request_key"), allowMissingColumns=True)
    up = Window.partitionBy(*STREAM).orderBy("idx", F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("turns_before", F.sum("turn").over(up)).where("turn = 0").select(*STREAM, "request_key", "turns_before")
    r = requests.join(seen, [*STREAM, "request_key"])
    w = Window.partitionBy(*STREAM).orderBy("first_idx", "request_key")
    same = F.col("native_id").isNull() & F.lag("native_id").over(w).isNull() & (F.lag("input_tokens").over(w) == F.col("input_tokens")) & (F.lag("turns_before").over(w) == F.col("turns_before"))
    r = r.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct("output_tokens", -F.col("first_idx"))
    return r.groupBy(*STREAM, "island").agg(
        F.min_by("request_key", "first_idx").alias("request_key"), F.min("first_idx").alias("first_idx"), F.min_by("requested_at", "first_idx").alias("requested_at"), F.min_by("model", "first_idx").alias("model"),
        F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"), F.max_by("total_tokens", best).alias("total_tokens"), F.min_by("native_id", "first_idx").alias("native_id"),
    ).drop("island")


def context_growth(requests: DataFrame, compactions: DataFrame) -> DataFrame:
    """Adds ``epoch`` (compactions so far) and ``context_growth``: input less the request before's input and output, null after a compaction."""
    both = requests.withColumn("idx", F.col("first_idx")).withColumn("mark", F.lit(0)).unionByName(compactions.select(*STREAM, "idx", F.lit(1).alias("mark")), allowMissingColumns=True)
    up = Window.partitionBy(*STREAM).orderBy("idx", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    r = both.withColumn("epoch", F.sum("mark").over(up)).where("mark = 0").drop("mark", "idx")
    w = Window.partitionBy(*STREAM).orderBy("first_idx", "request_key")
    growth = F.col("input_tokens") - F.lag("input_tokens").over(w) - F.lag("output_tokens").over(w)
    return r.withColumn("context_growth", F.when(F.lag("epoch").over(w) == F.col("epoch"), growth))


def _with_requests(points: DataFrame, at: str, requests: DataFrame) -> DataFrame:
    """Points and requests of each stream in one order; ``is_request`` tells them apart."""
    p = points.select("*", F.col(at).alias("_i"), F.lit(0).alias("is_request"))
    r = requests.select(*STREAM, F.col("first_idx").alias("_i"), F.lit(1).alias("is_request"), F.struct(F.col("first_idx").alias("first_idx"), F.col("request_key").alias("key")).alias("_r"))
    return p.unionByName(r, allowMissingColumns=True)


def asof_forward(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``request_key``: the request of the same provider event (``event_key``), else the first at or after the call in its stream."""
    own = requests.select("conversation_id", F.col("request_key").alias("own_key"), F.col("request_key").alias("event_key"))
    both = _with_requests(calls, "idx", requests)
    down = Window.partitionBy(*STREAM).orderBy("_i", "is_request").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("later", F.first("_r", ignorenulls=True).over(down)).where("is_request = 0")
    out = found.join(own, ["conversation_id", "event_key"], "left").withColumn("request_key", F.coalesce("own_key", "later.key"))
    return out.drop("_i", "_r", "is_request", "later", "own_key")


def next_request(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``next_key`` and ``carried``: the next request after the result that isn't the call's own, and how many follow before a compaction.

    ``requests`` carries epoch; calls carry result_idx, request_key and the epoch of the result (``result_epoch``). The two nearest
    later requests are looked up, so the own one can be passed over; later requests are a reverse running count.
    """
    r = requests.select(*STREAM, "first_idx", "request_key", "epoch")
    w = Window.partitionBy(*STREAM).orderBy("first_idx", "request_key")
    rank = r.withColumn("second", F.lead(F.struct("first_idx", "request_key")).over(w))
    rank = rank.withColumn("left_in_epoch", F.count(F.lit(1)).over(Window.partitionBy(*STREAM, "epoch").orderBy(F.desc("first_idx"), F.desc("request_key"))))
    p = calls.where("result_idx is not null").select("*", F.col("result_idx").alias("_i"), F.lit(1).alias("is_point"))
    q = rank.select(*STREAM, F.col("first_idx").alias("_i"), F.lit(0).alias("is_point"), F.struct("request_key", "second", "epoch", "left_in_epoch").alias("_r"))
    both = p.unionByName(q, allowMissingColumns=True)
    # strictly after: at one index the request stands before the point
    down = Window.partitionBy(*STREAM).orderBy("_i", "is_point").rowsBetween(0, Window.unboundedFollowing)
    f = both.withColumn("n", F.first("_r", ignorenulls=True).over(down)).where("is_point = 1")
    own = r.select(*STREAM, F.col("request_key"), F.col("first_idx").alias("own_idx"), F.col("epoch").alias("own_epoch"))
    f = f.join(own, [*STREAM, "request_key"], "left")
    key = F.when(F.col("n.request_key").eqNullSafe(F.col("request_key")), F.col("n.second.request_key")).otherwise(F.col("n.request_key"))
    own_later = F.coalesce((F.col("own_idx") > F.col("result_idx")) & (F.col("own_epoch") == F.col("result_epoch")), F.lit(False))
    n = F.when(F.col("n.epoch") == F.col("result_epoch"), F.col("n.left_in_epoch")).otherwise(0) - own_later.cast("int")
    f = f.select(*calls.columns, key.alias("next_key"), n.cast("long").alias("carried"))
    none = calls.where("result_idx is null").select("*", F.lit(None).cast("string").alias("next_key"), F.lit(0).cast("long").alias("carried"))
    return f.unionByName(none)


def parallel_share(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``parallel`` and ``call_output_tokens``: calls of one request share its output evenly."""
    n = F.count("request_key").over(Window.partitionBy("conversation_id", "request_key"))
    r = requests.select("conversation_id", "request_key", F.col("output_tokens").alias("_out"))
    out = calls.withColumn("parallel", F.when(F.col("request_key").isNotNull(), n)).join(r, ["conversation_id", "request_key"], "left")
    return out.withColumn("call_output_tokens", F.col("_out") / F.col("parallel")).drop("_out")


def result_share(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``result_tokens`` and its source: prompt growth split over the results in the gap by estimate, else the estimate.

    ``requests`` carries context_growth and ``prompt_estimate`` (user turns in the gap, which take their part).
    """
    r = requests.select("conversation_id", F.col("request_key").alias("next_key"), "context_growth", F.coalesce("prompt_estimate", F.lit(0)).alias("_user"))
    total = F.sum("estimate").over(Window.partitionBy("conversation_id", "next_key")) + F.coalesce("_user", F.lit(0))
    out = calls.join(r, ["conversation_id", "next_key"], "left").withColumn("_total", total)
    usable = F.col("next_key").isNotNull() & (F.col("context_growth") > 0) & (F.col("_total") > 0)
    split = F.round(F.col("context_growth") * F.col("estimate") / F.col("_total")).cast("long")
    none = F.col("result_idx").isNull()
    out = out.withColumn("result_tokens", F.when(none, 0).when(usable, split).otherwise(F.col("estimate")))
    out = out.withColumn("result_tokens_source", F.when(none, "").when(usable, "measured").otherwise("estimated"))
    return out.withColumn("carried_tokens", F.col("result_tokens") * F.col("carried")).drop("_user", "_total", "context_growth")


# --- cube and rollup --------------------------------------------------------------------------------------------


def tool_call_cube(calls: DataFrame, keys: list[str], wide: list[str], measures: list[str]) -> DataFrame:
    """Calls grouped by columns of few values and by whether wide columns are present, with count and sum, min, max, n of each measure."""
    flags = [(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"has_{c}") for c in wide]
    aggs = [F.count(F.lit(1)).alias("calls")]
    for m in measures:
        aggs += [F.sum(m).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.count(m).alias(f"{m}_n")]
    return calls.groupBy(*keys, *flags).agg(*aggs)


def cube_measure(op: str, measure: str | None = None) -> Column:
    """The aggregate over cube rows that equals ``op`` over calls: averages are sums over counts."""
    if measure is None:
        return F.sum("calls")
    if op == "avg":
        return F.try_divide(F.sum(f"{measure}_sum"), F.sum(f"{measure}_n"))
    return {"sum": F.sum(f"{measure}_sum"), "min": F.min(f"{measure}_min"), "max": F.max(f"{measure}_max"), "count": F.sum(f"{measure}_n")}[op]


def route_to_cube(keys: set[str], fields: set[str], cube: DataFrame, calls: DataFrame) -> DataFrame:
    """The cube if it keeps every field a request names, else the calls."""
    return cube if (keys | {f"{m}_sum" for m in fields}) <= set(cube.columns) else calls


def _call_measure(op: str, measure: str | None) -> Column:
    """The aggregate over calls that ``cube_measure`` states over cube rows."""
    if measure is None:
        return F.count(F.lit(1))
    return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}[op](measure)


def answer_metrics(calls: DataFrame, cube: DataFrame, keys: list[str], metrics: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Named metrics (op, measure) per group of ``keys``: from the cube if it keeps all the fields, with the same results as from calls."""
    frame = route_to_cube(set(keys), {m for _, m in metrics.values() if m}, cube, calls)
    measure = cube_measure if frame is cube else _call_measure
    return frame.groupBy(*keys).agg(*[measure(op, m).alias(name) for name, (op, m) in metrics.items()])


def answer_distinct(calls: DataFrame, cube: DataFrame, field: str) -> DataFrame:
    """(value, calls) of the values of a field that some call has, from the cube if it keeps the field."""
    out = answer_metrics(calls, cube, [field], {"calls": ("count", None)})
    return out.where(F.col(field).isNotNull()).withColumnRenamed(field, "value")


def answer_stats(calls: DataFrame, cube: DataFrame, measure: str) -> DataFrame:
    """One row of a measure: n, least, most and mean over all calls, from the cube if it keeps the measure."""
    return answer_metrics(calls, cube, [], {"n": ("count", measure), "least": ("min", measure), "most": ("max", measure), "mean": ("avg", measure)})


def tool_usage_daily(cube: DataFrame, dims: list[str]) -> DataFrame:
    """Daily rollup of a cube: calls, errors by type, distinct works, error rate and mean duration."""
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("calls"))), F.lit(0)).cast("long")
    out = cube.groupBy("day", *dims).agg(
        F.sum("calls").cast("long").alias("calls"), when(F.col("status") == "error").alias("errors"), when(F.col("error_type") == "timeout").alias("timeouts"),
        when(F.col("error_type") == "user_rejected").alias("rejected"), F.countDistinct("workspace_id").alias("works"),
        cube_measure("avg", "duration_ms").alias("avg_duration_ms"),
    )
    return out.withColumn("error_rate", F.try_divide(F.col("errors").cast("double"), F.col("calls").cast("double")))


def call_stats(calls: DataFrame) -> DataFrame:
    """Calls, failures, averages and the largest result per tool."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("status") == "error").cast("long")).alias("failures"), F.avg("duration_ms").alias("avg_ms"), F.max("result_bytes").alias("largest"))
