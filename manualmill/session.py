"""Session, table and checkpoint helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "manualmill", cpus: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it; on a cluster the caller brings its own."""
    master = f"local[{cpus}]" if cpus else "local[*]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else (single-machine sessions only) a new one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix=f"checkpoints-{os.getpid()}-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared checkpoint folder, for tables that outlive one plan."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written as a table below the shared checkpoint folder; like checkpointed(), but compressed and
    by columns, for wide rows of which later plans read a part."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of an Arrow batch whose rows are whole texts.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as rows are whole texts; a size that the session was given stays.

    It is one number for all plans of a session, so it does not matter when a lazy plan runs.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
