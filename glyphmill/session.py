"""Session defaults and the shared working folder.

``spark.checkpoint.dir`` names the folder every executor can reach.  It is read
from the session; only a local master without that setting (tests, a laptop)
falls back to a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", app: str = "glyphmill", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small test data: do not merge shuffle partitions below a core each.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables."""
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="glyphmill-")
    context.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results that still read them end here."""
    remove_path(spark, work_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def modest_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Spark hand Arrow batches of at most about ``size`` bytes to Python, so texts and their ids do not add up."""
    if int(spark.conf.get(_BATCH_BYTES).rstrip("b")) > size:
        spark.conf.set(_BATCH_BYTES, str(size))


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside leaves no shuffle files: they go once it is done, not when their last reference is collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written_at(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; the table read back, and its path."""
    path = work_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used between two passes over an expensive input: the second pass reads only
    the columns it needs and survives the loss of any executor.
    """
    return written_at(df, name, *partition_by)[0]


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a written table whose last reader is done."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
