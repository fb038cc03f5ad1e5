"""Incremental and streaming forms: new files, new records, guarded upserts, late data, freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerfold.functions import text as T
from ledgerfold.session import materialize
from ledgerfold.sources.tables import read_stored, write_table

GUARD = "version"
SHARD, SHARDS = "shard", 64


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New transcript files as a stream of (file, modified_at, value); the query's checkpoint remembers the files it has read."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", max_files).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are new or whose size or time changed since ``state`` (path, size, modified_at); they are read again whole."""
    return listing.join(state.select("path", "size", "modified_at"), ["path", "size", "modified_at"], "left_anti")


def new_records(df: DataFrame, state: DataFrame, keys: list[str], digest: list[str]) -> DataFrame:
    """Records whose (key, digest) isn't stored, each once, with their digest."""
    d = df.withColumn("digest", T.content_hash(*[F.col(c) for c in digest])).dropDuplicates([*keys, "digest"])
    return d.join(state.select(*keys, "digest"), [*keys, "digest"], "left_anti")


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """A stream without repeated keys inside the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def newest(batch: DataFrame, stored: DataFrame, keys: list[str], version: str = GUARD) -> DataFrame:
    """One row per key of stored and incoming rows, the one of the highest version; a stored row wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), "_new", *[F.col(c) for c in stored.columns if c not in (*keys, version)])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def upsert_versioned(batch: DataFrame, target: str, keys: list[str], version: str = GUARD, shards: int = SHARDS) -> None:
    """Merge a batch into a Parquet table partitioned by ``shard``: an older copy never overwrites a newer one.

    The shard is a hash of the key, so all versions of a key meet in one partition, whatever else changes in its row, and only
    shards the batch touches are read and replaced. A table keeps the number of shards it was begun with. Rows are staged in the
    shared folder first, as a table can't be overwritten while it is read.
    """
    spark = batch.sparkSession
    batch = materialize(batch.withColumn(SHARD, F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")))
    stored = read_stored(spark, target)
    stored = batch.limit(0) if stored is None else stored.select(batch.columns)
    touched = stored.join(batch.select(SHARD).distinct(), SHARD, "left_semi").select(batch.columns)
    write_table(materialize(newest(batch, touched, keys, version)), target, [SHARD])


def upsert_stream(stream: DataFrame, target: str, keys: list[str], checkpoint: str, version: str = GUARD, shards: int = SHARDS) -> DataStreamWriter:
    """A writer that upserts every micro-batch; a batch that is run again changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_versioned(df, target, keys, version, shards))


def hourly_stream(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly token sums of (session_id, model, created_at, total_tokens); rows later than ``delay`` are dropped by the watermark."""
    return events.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 hour").alias("w"), "session_id", "model").agg(F.sum("total_tokens").alias("total_tokens")).select("session_id", "model", F.col("w.start").alias("usage_hour"), "total_tokens")


def burst_stream(tasks: DataFrame, keys: tuple[str, ...] = ("installation_id",), gap: str = "10 minutes", delay: str = "1 hour", least: int = 5) -> DataFrame:
    """Enqueue bursts as a stream of session windows, per key: a stream has no session windows without one."""
    roots = tasks.where("parent_id is null and created_by is null").withWatermark("created_at", delay)
    out = roots.groupBy(F.session_window("created_at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("root_tasks"), F.max("created_at").alias("ended_at"))
    return out.where(F.col("root_tasks") >= least).select(*keys, F.col("w.start").alias("started_at"), "ended_at", "root_tasks")


def refresh_batches(changes: DataFrame, store: str, recompute: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "workspace_id") -> DataStreamWriter:
    """Keep a projection current: each batch of changed keys recomputes its rows and replaces them as new versions."""

    def apply(df: DataFrame, epoch: int) -> None:
        rows = recompute(df.select(key).distinct()).withColumn(GUARD, F.lit(epoch).cast("long"))
        upsert_versioned(rows, store, [key])

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def freshness(states: DataFrame, now: str, stale_hours: int = 24) -> DataFrame:
    """State per source of (source, last_success_at, last_error, pending, expected, seen): lag in hours, coverage, and a verdict."""
    lag = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last_success_at")) / 3600.0
    coverage = F.when(F.col("expected") > 0, F.col("seen") / F.col("expected"))
    verdict = F.when(F.coalesce(F.col("last_error"), F.lit("")) != "", "error").when(lag.isNull(), "never").when(lag > stale_hours, "stale").when(F.col("pending") > 0, "pending").when(coverage < 1, "partial").otherwise("fresh")
    return states.select("source", F.round(lag, 2).alias("lag_hours"), F.round(coverage, 4).alias("coverage"), verdict.alias("state"))
