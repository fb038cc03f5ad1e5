"""Prices, statuses, ratios and energy, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price statuses from best to worst.
STATUSES = ("priced", "assumed", "partial", "unpriced")


def model_family(model: Column) -> Column:
    """Model name without vendor prefix, context-size and date suffixes."""
    m = F.trim(F.lower(model))
    for pattern in (r"^claude-", r"(-1m|\[1m\])$", r"-\d{8}$"):
        m = F.regexp_replace(m, pattern, "")
    return m


def status_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(STATUSES):
        out = F.when(status == s, i).otherwise(out)
    return out


def status_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), rank + 1)


def worst_status(status: Column) -> Column:
    """Aggregate: the worst status of a group."""
    return status_name(F.max(status_rank(status)))


def cost(uncached: Column, cache_read: Column, write_5m: Column, write_1h: Column, output: Column, rates: dict[str, Column], unclassified: Column | None = None, assumed: Column | None = None) -> tuple[Column, Column]:
    """(cost in USD, status) of five quantities at per-million rates; null without any rate.

    A quantity whose rate is missing is left out and makes the row partial, as unclassified tokens do.
    """
    parts = [(uncached, rates["input"]), (cache_read, rates["cache_read"]), (write_5m, rates["cache_write_5m"]), (write_1h, rates["cache_write_1h"]), (output, rates["output"])]
    total, missing, known = F.lit(0.0), F.lit(False), F.lit(False)
    for q, rate in parts:
        q = F.coalesce(q, F.lit(0)).cast("double")
        total = total + F.coalesce(q * rate / 1e6, F.lit(0.0))
        missing = missing | ((q > 0) & rate.isNull())
        known = known | rate.isNotNull()
    if unclassified is not None:
        missing = missing | (F.coalesce(unclassified, F.lit(0)) > 0)
    status = F.when(~known, "unpriced").when(missing, "partial").when(F.coalesce(assumed, F.lit(False)) if assumed is not None else F.lit(False), "assumed").otherwise("priced")
    return F.when(known, total), status


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(a: Column, b: Column) -> Column:
    """Percentage to a tenth, null where b is 0."""
    return F.round(100 * ratio(a, b), 1)


def carbon_tier(model: Column, tiers: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first tier, in order, one of whose fragments the model name contains."""
    out = F.lit(default)
    for key, fragments in reversed(tiers):
        hit = F.lit(False)
        for f in fragments:
            hit = hit | F.lower(F.coalesce(model, F.lit(""))).contains(f)
        out = F.when(hit, key).otherwise(out)
    return out


def carbon_categories(total: Column, uncached: Column, read: Column, write: Column, output: Column) -> Column:
    """A struct of input, write, read and output tokens; what isn't classified is charged as input."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    rest = F.greatest(F.lit(0.0), z(total) - z(uncached) - z(read) - z(write) - z(output))
    return F.struct((z(uncached) + rest).alias("input"), z(write).alias("write"), z(read).alias("read"), z(output).alias("output"))
