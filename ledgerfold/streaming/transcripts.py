"""Transcripts parsed as a stream: folders of growing session files become messages, each line once.

A landing lists the folder, finds the files that are new or changed since the last one, and lands their lines in a feed: of a file
that only grew the lines behind those already landed, of any other the whole file again. A Structured Streaming query reads the feed; a
stateful processor keeps, per file, which reading of it is current and the model carried forward, in the state store, and a timer
drops the state of files that stay idle. Its checkpoint makes a restart continue where it stopped. Lines are parsed by
the same expressions as in the batch readers.

Scale: listings are joined, never collected (a landing takes at most ``max_files`` changed files, as many paths reach the driver); the
prefix of a grown file is compared by a digest summed map-side; only files' new lines pass the stateful step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerfold.session import materialize
from ledgerfold.sources import transcripts
from ledgerfold.sources.tables import read_stored

FEED = "file string, landing long, restart boolean, landed_at timestamp, line long, value string, named string"
CARRIED = "file string, epoch long, line long, value string, model string"
#: What a line must name for the model to change, per provider.
MODELS = {"claude": transcripts.claude_model, "codex": transcripts.codex_model}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_GLOB = re.compile(r"([\[\]{}*?\\])")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, size, modified_at) of all session files under ``path``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def _stored(spark: SparkSession, feed: str) -> DataFrame | None:
    return read_stored(spark, f"{feed}/versions")


def newest_versions(versions: DataFrame) -> DataFrame:
    """Each file's latest landed version: (file, size, modified_at, lines, digest, landed_at, landing)."""
    kept = [c for c in versions.columns if c != "file"]
    return versions.groupBy("file").agg(F.max_by(F.struct(*kept), "landing").alias("v")).select("file", "v.*")


def land(spark: SparkSession, provider: str, path: str, feed: str, max_files: int = 1000, idle: str = "7 days", now: datetime | None = None) -> int:
    """Land the lines of up to ``max_files`` changed files, oldest first; returns how many files were landed.

    A file is changed if its path, size or time isn't that of its last landing. It is landed from the first line again (``restart``) if its
    former lines aren't what they were, or if its last landing is ``idle`` ago, so that its state may have expired. ``now`` is the time of the
    landing (default: the clock's, and later than all landings before). The table of versions is written last: lines of a landing that
    failed before are never read.
    """
    versions = _stored(spark, feed)
    found = listing(spark, path)
    now = now or datetime.now(UTC).replace(tzinfo=None)
    if versions is None:
        known, landing = None, 1
        changed = found
    else:
        known = materialize(newest_versions(versions))
        newest, landing = known.agg(F.max("landed_at"), F.max("landing")).first()
        landing, now = landing + 1, max(now, newest + timedelta(milliseconds=1))
        changed = found.join(known.select("file", "size", "modified_at"), ["file", "size", "modified_at"], "left_anti")
    taken = changed.orderBy("modified_at", "file").limit(max_files).collect()  # max_files rows at most
    if not taken:
        return 0
    lines = transcripts._lines(spark, [_GLOB.sub(r"\\\1", r["path"]) for r in taken])
    seen = spark.createDataFrame([(r["file"], r["size"], r["modified_at"]) for r in taken], "file string, size long, modified_at timestamp")
    mark = F.xxhash64("line", "value")
    if known is None:
        state = seen.withColumns({"lines": F.lit(0).cast("long"), "digest": F.lit(0).cast("long"), "stale": F.lit(False)})
    else:
        before = known.select("file", "lines", "digest", (F.col("landed_at") + F.expr(f"interval {idle}") <= F.lit(now)).alias("stale"))
        state = seen.join(before, "file", "left").fillna(0, ["lines", "digest"]).fillna(False, ["stale"])
    state = materialize(state)
    few = F.broadcast(state)  # max_files rows at most
    rows = materialize(lines.join(few, "file").select("file", "line", "value", "lines"))
    prefix = F.coalesce(F.bit_xor(F.when(F.col("line") <= F.col("lines"), mark)), F.lit(0))
    totals = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("whole"), prefix.alias("prefix"))
    totals = materialize(state.join(totals, "file", "left").withColumn("restart", (F.coalesce("prefix", F.lit(0)) != F.col("digest")) | F.col("stale") | (F.col("lines") > F.coalesce("n", F.lit(0)))))
    named = MODELS[provider]()
    out = rows.join(F.broadcast(totals.select("file", "restart")), "file").where(F.col("restart") | (F.col("line") > F.col("lines")))
    out = out.select("file", F.lit(landing).cast("long").alias("landing"), "restart", F.lit(now).alias("landed_at"), "line", "value", named.alias("named"))
    out.write.mode("append").parquet(f"{feed}/lines")
    done = totals.select("file", "size", "modified_at", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("whole", F.lit(0)).alias("digest"), F.lit(now).alias("landed_at"), F.lit(landing).cast("long").alias("landing"))
    done.coalesce(1).write.mode("append").parquet(f"{feed}/versions")
    return len(taken)


class CarryForward(StatefulProcessor):
    """Per file: which landing its current reading began with, and the model its lines have named last."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "epoch long, model string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows), ignore_index=True).drop_duplicates(["landing", "line"]).sort_values(["landing", "line"], ignore_index=True)
        epoch, model = self.carried.get() if self.carried.exists() else (None, None)
        for landing, part in df.groupby("landing", sort=True):
            if bool(part["restart"].iloc[0]) or epoch is None:
                epoch, model = int(landing), None
            models = part["named"].ffill()
            models = models.where(models.notna(), model).astype(object)
            last = models.iloc[-1]
            model = None if pd.isna(last) else last
            yield pd.DataFrame({"file": key[0], "epoch": epoch, "line": part["line"].to_numpy(), "value": part["value"].to_numpy(), "model": models.where(models.notna(), None).to_numpy()})
        self.carried.update((epoch, model))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(df["landed_at"].max().timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.carried.clear()
        yield pd.DataFrame(columns=["file", "epoch", "line", "value", "model"])

    def close(self) -> None:
        pass


def carried_lines(spark: SparkSession, feed: str, idle: str = "7 days") -> DataFrame:
    """The feed as a stream of (file, epoch, line, value, model): the lines of finished landings with the model carried forward to them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    lines = spark.readStream.schema(FEED).parquet(f"{feed}/lines")
    finished = spark.read.parquet(f"{feed}/versions").select("landing").distinct()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    held = lines.join(finished, "landing", "left_semi").withWatermark("landed_at", "0 seconds")
    return held.groupBy("file").transformWithStateInPandas(CarryForward(idle_ms), CARRIED, outputMode="Append", timeMode="EventTime")


def follow(spark: SparkSession, provider: str, path: str, home: str, max_files: int = 1000, idle: str = "7 days", now: datetime | None = None) -> int:
    """Land everything that changed under ``path`` and parse it; returns how many files were landed.

    ``home`` holds the feed, the checkpoint and the parsed lines (an append-only streaming sink, so each line is stored once also where a run
    fails and is started again). Call it again, or in a loop, to follow a folder.
    """
    landed = 0
    while found := land(spark, provider, path, f"{home}/feed", max_files, idle, now):
        landed += found
    if _stored(spark, f"{home}/feed") is not None:
        sink = carried_lines(spark, f"{home}/feed", idle).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint")
        sink.trigger(availableNow=True).start(f"{home}/lines").awaitTermination()
    return landed


def followed_messages(spark: SparkSession, provider: str, home: str) -> DataFrame:
    """The messages of all followed files in their current reading, equal to the batch reader's over the same folder.

    A file that was emptied or removed keeps its last reading: what has been archived stays.
    """
    lines = spark.read.schema(CARRIED).parquet(f"{home}/lines")
    lines = lines.join(lines.groupBy("file").agg(F.max("epoch").alias("epoch")), ["file", "epoch"])
    if provider == "claude":
        return transcripts.claude_messages(lines)
    declared = lines.withColumn("own", transcripts.codex_session()).where("own is not null").groupBy("file").agg(F.min_by("own", "line").alias("session"))
    return transcripts.codex_messages(lines.join(declared, "file", "left"))
