"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import materialize

_LOCAL_BITS = 33  # ``monotonically_increasing_id`` keeps the row's place in its partition in so many low bits


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``df`` with its row numbers (from 1) in ``order``.

    Rows are range-partitioned and sorted, numbered within their partitions, and raised by the number of rows in the partitions
    before: a table of one row per partition.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1)
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + local + 1).cast("long")).drop("_part", "_at", "_before")
