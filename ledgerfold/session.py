"""Session settings and scratch tables that every job of the library shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", app: str = "ledgerfold", **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE and skew-join handling."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where none is set, a local session gets a temporary folder; on a cluster that would be one machine's, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="ledgerfold-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession, limit: str = "4m") -> None:
    """Bound Arrow batches by bytes, so that a Python worker's memory doesn't grow with the length of texts.

    The bound must hold when a lazy result runs, so it stays in the session; a value that the user has set is left as it is.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, limit)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when its job ends, not when the driver next collects its garbage: for jobs that write a table at once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledgerfold/{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a job's own files in the shared folder; ``clear_scratch`` removes it."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike ``localCheckpoint`` the copy survives the loss of any executor, and unlike
    ``checkpoint`` later reads still prune columns. ``discard`` and ``clear_scratch`` remove the copies.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more, such as the last round's of a loop."""
    for table in tables:
        _remove(table.sparkSession, table.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application has materialized, once its results are stored elsewhere."""
    _remove(spark, _scratch(spark))
