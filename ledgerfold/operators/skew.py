"""Joins that spread the rows of very frequent keys over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def hot_limit(total: int) -> int:
    """Rows from which a key is salted; fewer than 500 keys of a table can have as many."""
    return max(256, total // 500)


def hot_keys(counted: DataFrame, key: str, total: int, n: str = "n") -> list:
    """The keys of (key, n) with more than ``hot_limit`` of ``total`` rows: fewer than 500, so they may visit the driver. A table within the limit has none and isn't looked at."""
    if total <= hot_limit(total):
        return []
    return [r[0] for r in counted.where(F.col(n) > hot_limit(total)).select(key).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``big`` joined to ``small`` (unique in ``key``) by a shuffle in which the rows of ``hot`` keys go to ``salts`` tasks.

    The salt of a row is a hash of all its columns' text forms; only rows of ``small`` with hot keys are repeated, once per salt.
    """
    if not hot:
        return big.join(small.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    others = [F.col(c).cast("string") for c in big.columns]
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(0))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
