"""The usage ledger: hourly sums, rows per session, day and model, trailing windows, carbon, chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import dates, money
from ledgerfold.operators.pricing import small

TOKENS = ("total_tokens", "input_tokens", "uncached_input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation_1h_input_tokens", "output_tokens", "reasoning_output_tokens", "unclassified_tokens")


def hourly_usage(reports: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session x UTC hour x model x attribution sums of (session_id, created_at, model, tokens...).

    A report without a timestamp is placed at its session's start (``sessions``: session_id, started_at) and marked.
    """
    cols = [c for c in TOKENS if c in reports.columns]
    placed = reports.join(sessions.select("session_id", "started_at"), "session_id", "left")
    hour = F.date_trunc("hour", F.coalesce("created_at", "started_at")).alias("usage_hour")
    how = F.when(F.col("created_at").isNull(), "session-start").otherwise("request").alias("attribution")
    return placed.groupBy("session_id", hour, F.trim("model").alias("model"), how).agg(*[F.sum(c).cast("long").alias(c) for c in cols])


def usage_ledger(ledger: DataFrame, sessions: DataFrame, workspaces: DataFrame, repositories: DataFrame) -> DataFrame:
    """Ledger rows with their session, work and repository (which may be missing); only rows with tokens count.

    The model is the ledger's, else the session's, else "Unknown model".
    """
    s = small(sessions.select("session_id", "workspace_id", F.col("model").alias("session_model")))
    w = small(workspaces.select("workspace_id", "title", "repository_id"))
    r = small(repositories.select("repository_id", F.col("name").alias("repository_name")))
    rows = ledger.where("total_tokens > 0").join(s, "session_id").join(w, "workspace_id").join(r, "repository_id", "left")
    blank = lambda c: F.when(F.trim(c) != "", c)
    return rows.withColumn("model", F.coalesce(blank(F.col("model")), blank(F.col("session_model")), F.lit("Unknown model"))).drop("session_model")


def usage_rows(ledger: DataFrame, tz: str = "UTC", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row per session, local day and model: token sums, times, cache-read share, cost, worst status and attribution.

    ``ledger`` may carry cost_usd, cost_today_usd and price_status. A day that mixes placements is as precise as its least.
    """
    cols = [c for c in TOKENS if c in ledger.columns]
    aggs = [F.sum(c).cast("long").alias(c) for c in cols]
    aggs += [F.min("usage_hour").alias("first_usage_at"), F.max("usage_hour").alias("last_usage_at")]
    if "attribution" in ledger.columns:
        aggs.append(F.coalesce(F.max(F.when(F.col("attribution") != "request", F.col("attribution"))), F.lit("request")).alias("attribution"))
    if "cost_usd" in ledger.columns:
        aggs += [F.sum("cost_usd").alias("cost_usd"), F.sum("cost_today_usd").alias("cost_today_usd"), money.worst_status(F.col("price_status")).alias("price_status")]
    day = dates.local_day(F.col("usage_hour"), tz).alias("day")
    out = ledger.groupBy(*keys, day, "model").agg(*aggs)
    out = out.withColumns({"model_family": money.model_family(F.col("model")), "week": F.to_date(F.date_trunc("week", "day")), "month": F.date_format("day", "yyyy-MM")})
    if {"input_tokens", "cache_read_input_tokens"} <= set(cols):
        out = out.withColumn("cache_read_share", 100 * money.ratio(F.col("cache_read_input_tokens"), F.col("input_tokens")))
    return out


#: Trailing windows in hours; 0 is all time.
WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720, "all": 0}


def usage_summary(ledger: DataFrame, now: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tokens (and cost_usd, and ``extra`` columns by share) of trailing windows; the hour at the cutoff counts by its part inside.

    Tokens are rounded per ledger row. One pass: each row is exploded to the six windows, which is a fixed factor.
    """
    at = F.lit(now).cast("timestamp")
    spans = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(h).alias("hours")) for k, h in WINDOWS.items()])
    x = ledger.select("*", F.inline(spans))
    cutoff = F.unix_seconds(at) - F.col("hours") * 3600
    inside = (F.unix_seconds(F.col("usage_hour")) + 3600 - cutoff) / 3600
    share = F.when(F.col("hours") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))
    x = x.withColumn("share", F.coalesce(share, F.lit(0.0)))
    aggs = [F.sum(F.floor(F.col("total_tokens") * F.col("share") + 0.5)).cast("long").alias("tokens")]
    aggs += [F.sum(F.col(c) * F.col("share")).alias(c) for c in (*extra, *(["cost_usd"] if "cost_usd" in ledger.columns else []))]
    return x.groupBy("window").agg(*aggs)


def typed_words(messages: DataFrame, now: str) -> DataFrame:
    """Words a person typed and messages with any, per trailing window, of (sent_at, words)."""
    spans = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(h).alias("hours")) for k, h in WINDOWS.items()])
    x = messages.where("words > 0").select("*", F.inline(spans))
    inside = (F.col("hours") == 0) | (F.unix_seconds("sent_at") >= F.unix_seconds(F.lit(now).cast("timestamp")) - F.col("hours") * 3600)
    return x.where(inside).groupBy("window").agg(F.sum("words").cast("long").alias("words"), F.count(F.lit(1)).alias("messages"))


def tokens_by_model(usage: DataFrame) -> DataFrame:
    """Tokens by provider and model; a session with several models is named as such. The total is the reported one, else the parts' sum."""
    total = F.coalesce("total_tokens", F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    per = usage.groupBy("provider", "session_id").agg(
        F.when(F.countDistinct("model") > 1, "Multiple models").otherwise(F.coalesce(F.max("model"), F.lit("Unknown model"))).alias("model"), F.sum(total).alias("tokens"))
    return per.groupBy("provider", "model").agg(F.sum("tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("sessions"))


CATEGORIES = ("input", "write", "read", "output")
SCENARIOS = ("low", "central", "high")


def carbon(usage: DataFrame, factors: dict, today: str) -> DataFrame:
    """Energy (Wh) and emissions (g) of all time and the last 30 days per scenario and tier category.

    ``factors`` is a parsed carbon document. Returns (window, scenario, energy_wh of each category, total_wh, co2e_g):
    energy = Mtok x the tier's Wh per Mtok of output x the category's ratio; grams = Wh x PUE x grid / 1000.
    """
    tiers = [(t["key"], [m.lower() for m in t["match"]]) for t in factors["tiers"]]
    tier = money.carbon_tier(money.model_family(F.col("model")), tiers, factors["default_tier"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    parts = {"input": z("uncached_input_tokens") + z("unclassified_tokens"), "write": z("cache_creation_input_tokens"), "read": z("cache_read_input_tokens"), "output": z("output_tokens")}
    recent = F.col("day") >= F.date_sub(F.lit(today).cast("date"), 29)
    windows = F.when(recent, F.array(F.lit("all"), F.lit("30d"))).otherwise(F.array(F.lit("all")))
    sums = usage.select(F.explode(windows).alias("window"), tier.alias("tier"), *[c.alias(k) for k, c in parts.items()]).groupBy("window", "tier").agg(*[F.sum(k).alias(k) for k in CATEGORIES])
    per = {t["key"]: t["output_wh_per_mtok"] for t in factors["tiers"]}
    grid = next(g["g_co2e_per_kwh"] for g in factors["grids"] if g["key"] == factors["default_grid"])
    rows = []
    for s in SCENARIOS:
        wh = F.lit(0.0)
        for k, v in per.items():
            wh = F.when(F.col("tier") == k, float(v[s])).otherwise(wh)
        cells = [(F.col(k) / 1e6 * wh * (1.0 if k == "output" else float(factors["ratios"][k][s]))).alias(f"{k}_wh") for k in CATEGORIES]
        rows.append(F.struct(F.lit(s).alias("scenario"), F.lit(float(factors["pue"][s])).alias("pue"), *cells))
    out = sums.select("window", F.inline(F.array(*rows)))
    out = out.groupBy("window", "scenario", "pue").agg(*[F.sum(f"{k}_wh").alias(f"{k}_wh") for k in CATEGORIES])
    total = sum((F.col(f"{k}_wh") for k in CATEGORIES[1:]), F.col("input_wh"))
    return out.withColumn("total_wh", total).withColumn("co2e_g", F.col("total_wh") * F.col("pue") * float(grid) / 1000).drop("pue")


def chart_series(df: DataFrame, bucket: Column, split: str, value: str, top: int = 5, unit: str = "day") -> DataFrame:
    """(bucket, split, value): sums per calendar bucket, the ``top`` largest splits by total kept, the rest folded into "Other".

    Every split has a row for each bucket between the first and the last, 0 where it has no value. The grid is made of splits
    (``top`` + 1 at most) and buckets, not of rows.
    """
    sums = df.groupBy(F.date_trunc(unit, bucket).alias("bucket"), F.coalesce(F.col(split).cast("string"), F.lit("none")).alias("split")).agg(F.sum(value).alias("value"))
    totals = sums.groupBy("split").agg(F.sum("value").alias("total"))
    best = totals.orderBy(F.desc("total"), "split").limit(top).select("split", F.lit(1).alias("keep"))
    folded = sums.join(F.broadcast(best), "split", "left").withColumn("split", F.when(F.col("keep").isNotNull(), F.col("split")).otherwise("Other"))
    folded = folded.groupBy("bucket", "split").agg(F.sum("value").alias("value"))
    ends = folded.groupBy("split").agg(F.lit(1).alias("one")).join(folded.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"), F.lit(1).alias("one")), "one")
    grid = ends.select("split", F.explode(F.sequence("a", "z", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return grid.join(folded, ["bucket", "split"], "left").select("bucket", "split", F.coalesce("value", F.lit(0)).alias("value"))


def running(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds a running sum of ``value`` per key."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))
