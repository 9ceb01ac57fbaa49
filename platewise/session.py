"""Session settings and tables written in the middle of a job."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "platewise", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Local times in files are taken as UTC instants on read, so that time filters reach the scan.
        "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def measured_broadcasts(spark: SparkSession) -> None:
    """Join sides are broadcast by the size they turn out to have, not by the size of the files they come from.

    Packed files of a few MB can hold millions of rows, and rows that are exploded from them are not in any estimate: such
    sides went through the driver whole.  Adaptive execution still broadcasts what was measured to be small.
    """
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


#: Shuffled bytes of a task, about, and how many parts a shuffle is cut into before small ones are put together again.
TASK_BYTES, SHUFFLE_PARTS = "16m", 512


def even_tasks(spark: SparkSession) -> None:
    """Tasks after a shuffle take about as many bytes each, however large the input is.

    With as many parts as there are cores a task's sorts and hash maps grew with the tables.  What the session sets itself stays,
    and a session with more parts keeps them.
    """
    parts, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(parts, None) in (None, "None"):
        spark.conf.set(parts, str(max(SHUFFLE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if spark.conf.get(size) == "67108864b":  # the default
        spark.conf.set(size, TASK_BYTES)


#: Bytes of the rows that go to a Python worker together, about.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Rows of a MB or more, such as blocks of vectors, go to Python few at a time.  A batch is held by the JVM and, as Arrow and as
    arrays, by the worker, for each core of an executor.  What the session sets itself stays."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":  # the default
        spark.conf.set(size, BATCH_BYTES)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them has ended, not when the driver happens to collect garbage.

    Jobs that write tables on their way would else hold the files of all of them on disk to the end.  Where a frame is run
    again, Spark makes again what it needs.  Spark before 4.1 has no such setting.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session in spark.checkpoint.dir.

    Without one, a temporary folder serves a local master only: on a cluster every executor would write to its own
    disk and later reads would miss those rows.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="platewise-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables written mid-job."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/{name}-{os.urandom(6).hex()}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """A frame that several branches of a plan use, written once to the shared folder as a table."""
    drop_shuffles(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
