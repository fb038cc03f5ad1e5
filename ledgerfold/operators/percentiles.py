"""Exact percentiles of groups of any size, without a group's values in one task.

A mergeable sketch per group brackets each percentile: two values between which it lies. A second pass counts, map-side, what lies below the
bracket, and only values inside are put in order, by range partitions. A bracket that missed its percentile, which the counts tell,
is opened and counted again, so results never rest on the sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.ordering import numbered
from ledgerfold.session import materialize

#: Size of the sketch, and how far to both sides of a percentile's rank its bracket reaches.
SKETCH, REACH = 800, 0.01
#: Brackets (a row per group and percentile) up to this many are broadcast.
FEW_BRACKETS = 50_000


def _inside(values: DataFrame, brackets: DataFrame, keys: list[str], fine: int | None) -> DataFrame:
    """(keys, p, n, below, held, low, high): counts around each bracket and the two values at its percentile's ranks, null where the bracket missed."""
    small = brackets.count() <= (FEW_BRACKETS if fine is None else fine)
    both = values.join(F.broadcast(brackets) if small else brackets.hint("shuffle_hash"), keys)
    above = F.coalesce(F.col("v") >= F.col("from"), F.lit(True))
    within = above & F.coalesce(F.col("v") <= F.col("to"), F.lit(True))
    counts = both.groupBy(*keys, "p", "n").agg(F.count(F.when(~above, 1)).alias("below"), F.count(F.when(within, 1)).alias("held"))
    ordered = numbered(both.where(within).select(*keys, "p", "v"), [*(F.col(k).asc_nulls_first() for k in keys), F.col("p"), F.col("v")], "at")
    starts = ordered.groupBy(*keys, "p").agg(F.min("at").alias("begin"))
    marks = materialize(counts.join(starts, [*keys, "p"]).withColumn("rank", F.col("p") * (F.col("n") - 1)))
    place = lambda c: (F.col("begin") + c - F.col("below")).cast("long")
    wanted = marks.select(*keys, "p", F.explode(F.array(F.struct(F.lit("low").alias("side"), place(F.floor("rank")).alias("at")), F.struct(F.lit("high").alias("side"), place(F.ceil("rank")).alias("at")))).alias("w"), "begin", "held")
    wanted = wanted.select("p", *keys, "w.*", "begin", "held").where((F.col("at") >= F.col("begin")) & (F.col("at") < F.col("begin") + F.col("held")))
    found = wanted.join(ordered.select("at", "v"), "at").groupBy(*keys, "p").agg(F.max(F.when(F.col("side") == "low", F.col("v"))).alias("low"), F.max(F.when(F.col("side") == "high", F.col("v"))).alias("high"))
    return marks.join(found, [*keys, "p"], "left")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], reach: float = REACH, fine: int | None = None) -> DataFrame:
    """(keys, p, n, value): interpolated percentiles of the non-null values of each group, as ``percentile`` gives them.

    Null keys are a group of their own; groups without values have no row.
    """
    names = [f"k{i}" for i in range(len(keys))]
    # a null key is marked by a flag and a filler, so that plain joins and sorts meet it
    parts = [F.to_json(F.struct(F.col(k).alias("k"))).alias(n) for k, n in zip(keys, names)]
    values = materialize(df.where(F.col(value).isNotNull()).select(*keys, *parts, F.col(value).cast("double").alias("v")))
    groups = values.groupBy(*names).agg(*[F.first(k).alias(f"_{k}") for k in keys], F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch"))
    groups = materialize(groups)
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(rank)) if 0 < rank < 1 else F.lit(None).cast("double")
    each = [F.struct(F.lit(float(p)).alias("p"), at(p - reach).alias("from"), at(p + reach).alias("to")) for p in percentiles]
    brackets = materialize(groups.select(*names, "n", F.inline(F.array(*each))))
    plain = values.select(*names, "v")
    first = materialize(_inside(plain, brackets, names, fine))
    done = first.where("low is not null and high is not null")
    missed = first.where("low is null or high is null").select(*names, "p", "n", F.lit(None).cast("double").alias("from"), F.lit(None).cast("double").alias("to"))
    if not missed.isEmpty():
        done = done.unionByName(_inside(plain, materialize(missed), names, fine))
    part = F.col("rank") - F.floor("rank")
    result = done.select(*names, "p", "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high")).alias("value"))
    back = groups.select(*names, *[F.col(f"_{k}").alias(k) for k in keys])
    return result.join(back, names).select(*keys, "p", "n", "value")
