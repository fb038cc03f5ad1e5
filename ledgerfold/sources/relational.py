"""Sessions of a relational store in one database file, read by many tasks, and only where they changed.

A Python data source plans a table's read as ranges of row ids; each task opens the file read-only and reads its own. What tells whether a
session changed (number of messages, highest row id, latest times) is aggregated by the store within each range, so no message text is read for it;
the messages of changed sessions are then read session by session, over the store's own index.

The file must be reachable by its path from every machine (a shared mount).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ledgerfold.functions import text as T

ROWS_PER_TASK = 50_000
#: Rows of one Arrow batch.
BATCH = 2_000


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path.removeprefix('file:').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True))


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    """(name, Spark type) of a table's columns by their declared types."""
    with _open(path) as db:
        found = db.execute(f"PRAGMA table_info({_named(table)})").fetchall()
    kinds = (("INT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))
    return [(r[1], next((t for k, t in kinds if k in (r[2] or "").upper()), "string")) for r in found]


def _fit(value: object, kind: str) -> object:
    """A stored value as its column's type; values of other types in a text column become text, in other columns null."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if kind == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    return (int(value) if kind == "bigint" else float(value)) if isinstance(value, (int, float)) else None


def _batches(cursor: sqlite3.Cursor, schema: pa.Schema, kinds: list[str]) -> Iterator[pa.RecordBatch]:
    while rows := cursor.fetchmany(BATCH):
        columns = [pa.array([_fit(r[i], k) for r in rows], f.type) for i, (k, f) in enumerate(zip(kinds, schema))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow(kinds: list[tuple[str, str]]) -> pa.Schema:
    types = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, types[k]) for n, k in kinds])


class RowIds(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.table = options["path"], options["table"]
        self.rows, self.grouped, self.times = int(options.get("rows", ROWS_PER_TASK)), options.get("key"), options.get("times", "")

    def partitions(self) -> list[RowIds]:
        with _open(self.path) as db:
            first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
        if first is None:
            return [RowIds(0, -1)]
        return [RowIds(a, min(a + self.rows - 1, last)) for a in range(first, last + 1, self.rows)]

    def read(self, partition: RowIds) -> Iterator[pa.RecordBatch]:
        kinds = _shape(self.path, self.table, self.grouped, self.times)
        if self.grouped:
            what = ", ".join([_named(self.grouped), "count(*)", "max(rowid)", *(f"max({_named(t)})" for t in self.times.split(",") if t)])
            tail = f" GROUP BY {_named(self.grouped)}"
        else:
            what, tail = ", ".join(["rowid", *(_named(n) for n, _ in kinds[1:])]), " ORDER BY rowid"
        with _open(self.path) as db:
            cursor = db.execute(f"SELECT {what} FROM {_named(self.table)} WHERE rowid BETWEEN ? AND ?{tail}", (partition.first, partition.last))
            yield from _batches(cursor, _arrow(kinds), [k for _, k in kinds])


def _shape(path: str, table: str, key: str | None, times: str) -> list[tuple[str, str]]:
    if key:
        return [(key, "string"), ("messages", "bigint"), ("last_row", "bigint"), *((t, "string") for t in times.split(",") if t)]
    return [("row_id", "bigint"), *columns_of(path, table)]


class RowRanges(DataSource):
    """A table of a database file in ranges of row ids; with ``key``, its counts, highest row ids and latest ``times`` per key and range."""

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> str:
        kinds = _shape(self.options["path"], self.options["table"], self.options.get("key"), self.options.get("times", ""))
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in kinds)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A table with its ``row_id``, ``rows`` row ids a task."""
    spark.dataSource.register(RowRanges)
    return spark.read.format("row_ranges").options(path=path, table=table, rows=rows).load()


def session_signals(spark: SparkSession, path: str, messages: str, key: str, times: tuple[str, ...] = (), sessions: str | None = None, session_key: str = "id", rows: int = ROWS_PER_TASK) -> DataFrame:
    """(session_id, messages, last_row, signal) per session: what shows a change without reading messages.

    ``signal`` digests the latest ``times`` and, with ``sessions``, the session's own row.
    """
    spark.dataSource.register(RowRanges)
    parts = spark.read.format("row_ranges").options(path=path, table=messages, key=key, times=",".join(times), rows=rows).load()
    held = parts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("session_id")).agg(F.sum("messages").alias("messages"), F.max("last_row").alias("last_row"), *[F.max(t).alias(f"_{t}") for t in times])
    marks = [F.coalesce(F.col(f"_{t}"), F.lit("")) for t in times]
    if sessions:
        own = read_table(spark, path, sessions, rows)
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own.columns if c != "row_id"]))
        held = held.join(own.select(F.col(session_key).cast("string").alias("session_id"), row.alias("_row")), "session_id", "full").fillna(0, ["messages", "last_row"])
        marks.append(F.coalesce(F.col("_row"), F.lit("")))
    return held.select("session_id", "messages", "last_row", T.content_hash(*marks).alias("signal") if marks else F.lit("").alias("signal"))


def changed_sessions(signals: DataFrame, state: DataFrame | None) -> DataFrame:
    """Sessions whose signals aren't those of ``state``, the signals of the last read."""
    return signals if state is None else signals.join(state.select(signals.columns), signals.columns, "left_anti")


def read_sessions(spark: SparkSession, path: str, messages: str, key: str, changed: DataFrame) -> DataFrame:
    """The messages of ``changed`` sessions (session_id) with their ``row_id``; each task reads its sessions' rows over the store's index on ``key``."""
    kinds = _shape(path, messages, None, "")
    schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        what = ", ".join(["rowid", *(_named(n) for n, _ in kinds[1:])])
        with _open(path) as db:
            for b in batches:
                for session in b["session_id"].to_pylist():
                    cursor = db.execute(f"SELECT {what} FROM {_named(messages)} WHERE {_named(key)} = ? ORDER BY rowid", (session,))
                    yield from _batches(cursor, _arrow(kinds), [k for _, k in kinds])

    return changed.select("session_id").distinct().mapInArrow(run, schema)
