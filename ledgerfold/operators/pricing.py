"""Date-effective prices: validity intervals, alias resolution on a date, cost then and today, coverage.

Price and alias histories are dimensions of a few rows per model. They are joined to the *distinct* (model, day)
pairs of a ledger, never to its rows; ``small`` broadcasts a side only after counting it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import money
from ledgerfold.session import materialize

BROADCAST_ROWS = 200_000
RATES = ("input", "cache_read", "cache_write_5m", "cache_write_1h", "output")
QUANTITIES = ("total_tokens", "uncached_input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation_1h_input_tokens", "output_tokens", "unclassified_tokens")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def validity(history: DataFrame, key: str, start: str = "effective_from") -> DataFrame:
    """Half-open intervals: adds ``effective_to``, the next start of the same key (null: still in force)."""
    return history.withColumn("effective_to", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def _in_force(day: Column, start: Column, end: Column) -> Column:
    return (day >= start) & (end.isNull() | (day < end))


def resolve_alias(usage: DataFrame, aliases: DataFrame, hops: int = 4) -> DataFrame:
    """Adds ``priced_model`` to distinct (model_key, day): up to ``hops`` aliases in force on the day, stopping where none is.

    ``aliases`` has (alias, target, effective_from); an alias to itself ends the chain.
    """
    spans = small(validity(aliases.select("alias", "target", "effective_from"), "alias"))
    out = usage.withColumn("priced_model", F.col("model_key"))
    for _ in range(hops):
        a = spans.select(F.col("alias").alias("a_alias"), F.col("target").alias("a_target"), F.col("effective_from").alias("a_from"), F.col("effective_to").alias("a_to"))
        on = (F.col("priced_model") == F.col("a_alias")) & _in_force(F.col("day"), F.col("a_from"), F.col("a_to"))
        out = out.join(a, on, "left").withColumn("priced_model", F.coalesce("a_target", "priced_model")).drop("a_alias", "a_target", "a_from", "a_to")
    return out


def price_on_date(pairs: DataFrame, prices: DataFrame, day: Column, prefix: str = "") -> DataFrame:
    """Left interval join: the rates of ``priced_model`` in force on ``day``, as ``prefix`` + rate columns and ``assumption``.

    Only confirmed prices count.
    """
    spans = validity(prices.where("status = 'confirmed'").select("model_key", "effective_from", *RATES, "assumption"), "model_key")
    p = small(spans).select(F.col("model_key").alias("p_key"), F.col("effective_from").alias("p_from"), F.col("effective_to").alias("p_to"), *[F.col(r).alias(prefix + r) for r in RATES], F.col("assumption").alias(prefix + "assumption"))
    return pairs.join(p, (F.col("priced_model") == F.col("p_key")) & _in_force(day, F.col("p_from"), F.col("p_to")), "left").drop("p_key", "p_from", "p_to")


def cost_columns(prefix: str = "") -> tuple[Column, Column]:
    """Cost and status of a ledger row joined to rates. Writes without a TTL split are charged at the 5-minute rate."""
    hour = F.coalesce(F.col("cache_creation_1h_input_tokens"), F.lit(0))
    write_5m = F.greatest(F.lit(0), F.coalesce(F.col("cache_creation_input_tokens"), F.lit(0)) - hour)
    rates = {r: F.col(prefix + r) for r in RATES}
    return money.cost(F.col("uncached_input_tokens"), F.col("cache_read_input_tokens"), write_5m, hour, F.col("output_tokens"), rates, F.col("unclassified_tokens"), F.col(prefix + "assumption"))


def price_usage(usage: DataFrame, prices: DataFrame, aliases: DataFrame, today: str) -> DataFrame:
    """``usage`` (model, day, token columns) with priced_model, cost_usd, cost_today_usd and price_status.

    The alias is resolved on the usage day for both costs. Without a day the row is unpriced and costs nothing.
    """
    keyed = usage.withColumn("model_key", money.model_family(F.col("model")))
    pairs = keyed.where("day is not null and model_key is not null").select("model_key", "day").distinct()
    priced = price_on_date(resolve_alias(pairs, aliases), prices, F.col("day"))
    priced = materialize(price_on_date(priced, prices, F.lit(today).cast("date"), "today_"))
    joined = keyed.join(small(priced), ["model_key", "day"], "left")
    cost, status = cost_columns()
    now, _ = cost_columns("today_")
    drop = ["model_key", *RATES, "assumption", *["today_" + r for r in RATES], "today_assumption"]
    return joined.withColumns({"cost_usd": cost, "price_status": status, "cost_today_usd": now}).drop(*drop)


def placeholder(model: Column) -> Column:
    """Names that stand for no real model."""
    return (model == "Unknown model") | model.rlike("^<.*>$")


def pricing_health(usage: DataFrame, today: str) -> DataFrame:
    """One row: tokens by price status, and tokens and cost of all time and the last 30 days."""
    recent = F.col("day") >= F.date_sub(F.lit(today).cast("date"), 29)
    by = [F.coalesce(F.sum(F.when(F.col("price_status") == s, F.col("total_tokens"))), F.lit(0)).cast("long").alias(f"{s}_tokens") for s in money.STATUSES]
    return usage.agg(*by, F.sum("total_tokens").cast("long").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.coalesce(F.sum(F.when(recent, F.col("total_tokens"))), F.lit(0)).cast("long").alias("recent_tokens"), F.sum(F.when(recent, F.col("cost_usd"))).alias("recent_cost_usd"))


def models_with_status(usage: DataFrame, status: str) -> DataFrame:
    """Models whose usage has a price status, with tokens and first and last day, most tokens first."""
    rows = usage.where((F.col("price_status") == status) & ~placeholder(F.col("model")))
    return rows.groupBy("model").agg(F.sum("total_tokens").cast("long").alias("tokens"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).orderBy(F.desc("tokens"), "model")


def work_costs(usage: DataFrame) -> DataFrame:
    """Tokens, cost then and today, and worst price status per work; costs stay null where nothing is priced."""
    return usage.groupBy("workspace_id").agg(F.sum("total_tokens").cast("long").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.sum("cost_today_usd").alias("cost_today_usd"), money.worst_status(F.col("price_status")).alias("price_status"))


def price_tool_calls(calls: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``cost_usd``: the result as new input (a cache write for provider claude), carried tokens as cache reads, the output share.

    Output tokens are rounded to whole tokens first.
    """
    claude = F.col("provider") == "claude"
    result = F.coalesce(F.col("result_tokens"), F.lit(0))
    sized = calls.select(
        "*", F.when(claude, 0).otherwise(result).alias("uncached_input_tokens"), F.coalesce("carried_tokens", F.lit(0)).alias("cache_read_input_tokens"),
        F.when(claude, result).otherwise(0).alias("cache_creation_input_tokens"), F.lit(0).alias("cache_creation_1h_input_tokens"),
        F.round(F.coalesce("call_output_tokens", F.lit(0.0))).cast("long").alias("output_tokens"), F.lit(0).alias("unclassified_tokens"),
    )
    out = price_usage(sized, prices, aliases, "1970-01-01")
    return out.drop(*QUANTITIES[1:], "cost_today_usd")
