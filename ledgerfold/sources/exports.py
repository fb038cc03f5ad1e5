"""Records of large JSON exports, read by many tasks: one array of objects, or an object whose ``workspaces`` are one.

A file is read once, as the pieces between its closing braces, which byte ranges can be cut into. Whether a piece begins inside a string, and how
deep in objects, follows from what is before it: a piece says how it changes both, for either kind of beginning, so the states of pieces
within a byte range and those of ranges are running sums, the latter over one row per range. A closing brace outside of strings that leads back to
the records' depth ends a record; pieces of one record are put together and parsed on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.session import materialize

#: An export that lists its records under this name holds them one level deeper.
LISTED = r'^[\s\x{FEFF}]*\{\s*"workspaces"\s*:\s*\['


def _opened(text: Column) -> Column:
    """How many objects begin outside of strings in a text that begins outside of one."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r'"[^"]*+(?:"|\z)', ""), r"[^{]++", ""))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record) of every object of the files' arrays, in order from 0; a file that is one object is one record."""
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(F.regexp_replace(bare, r'[^"]++', "")) % 2
    inside = F.regexp_replace(bare, r'^[^"]*+(?:"|\z)', "")
    # what a piece and its closing brace do to the depth, beginning outside and inside of a string
    changes = {"flip": quotes, "out": _opened(bare) - F.when(quotes == 0, 1).otherwise(0), "in": _opened(inside) - F.when(quotes == 1, 1).otherwise(0)}
    read = materialize(pieces.withColumns(changes))
    thin = read.select("file", "block", "n", "flip", "out", "in")

    here = Window.partitionBy("file", "block").orderBy("n")
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2  # relative to the range's beginning
    step = lambda flipped: F.when((start + flipped) % 2 == 0, F.col("out")).otherwise(F.col("in"))
    local = thin.withColumns({"end": F.sum("flip").over(upto) % 2, "d0": step(0), "d1": step(1)})
    local = materialize(local.withColumns({"s0": F.sum("d0").over(upto), "s1": F.sum("d1").over(upto)}).select("file", "block", "n", "end", "s0", "s1"))
    # ranges in a row: a row per byte range
    ranges = local.groupBy("file", "block").agg(F.max_by("end", "n").alias("flip"), F.max_by("s0", "n").alias("t0"), F.max_by("s1", "n").alias("t1"))
    row = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("begin", F.coalesce(F.sum("flip").over(row), F.lit(0)) % 2)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("begin") == 0, F.col("t0")).otherwise(F.col("t1"))).over(row), F.lit(0)))
    opening = read.where("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("first"))
    ranges = ranges.select("file", "block", "begin", "depth").join(opening.select("file", F.when(F.col("first").rlike(LISTED), 1).otherwise(0).alias("level")), "file")
    few = F.broadcast(ranges) if ranges.count() <= 50_000 else ranges
    known = local.join(few, ["file", "block"])
    depth = F.col("depth") + F.when(F.col("begin") == 0, F.col("s0")).otherwise(F.col("s1"))
    ends = (((F.col("begin") + F.col("end")) % 2 == 0) & (depth == F.col("level"))).cast("long")
    marked = materialize(known.select("file", "block", "n", ends.alias("ends")))
    # records are counted within ranges and raised by those of the ranges before
    sums = marked.groupBy("file", "block").agg(F.sum("ends").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(row), F.lit(0))).drop("sum")
    numbered = marked.join(F.broadcast(sums) if sums.count() <= 50_000 else sums, ["file", "block"])
    number = F.col("base") + F.coalesce(F.sum("ends").over(before), F.lit(0))
    placed = numbered.select("file", "block", "n", number.alias("number"))
    whole = read.select("file", "block", "n", "value").join(placed, ["file", "block", "n"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]), "}")
    records = whole.groupBy("file", "number").agg(joined.alias("text"))
    # what stands before a record's own brace: the array's bracket, a comma, the list's name
    tidy = F.regexp_replace(F.regexp_replace("text", LISTED, ""), r"^[\s\x{FEFF}]*[\[,]?\s*", "")
    return records.select("file", "number", tidy.alias("record")).where(F.col("record").startswith("{")).select("file", "number", F.concat("record", F.lit("}")).alias("record"))
