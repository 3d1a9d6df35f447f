"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Every operator assumes these.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on dataset_id feeds a grouping on it: split a hot dataset even at the price of a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above 8000 bytecodes are never compiled by the JVM; split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings, and a checkpoint folder if the cluster names one."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        master = context.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldwise-"))
    return context.getCheckpointDir()


_RUN: ContextVar[str | None] = ContextVar("fieldwise_run", default=None)


def run_folder(spark: SparkSession) -> str:
    """Where settled tables go: the open workspace, or the shared part of the checkpoint folder."""
    run = _RUN.get()
    return f"{ensure_checkpoint_dir(spark)}/fieldwise" + (f"/{run}" if run else "")


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Owns what is settled inside it: the folder goes when the block ends, so write results before that."""
    token = _RUN.set(f"run-{uuid.uuid4().hex}")
    folder = run_folder(spark)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of settled tables, wherever the cluster keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write an inventory that many branches read into the checkpoint folder, and go on from that table.

    The scan behind it runs once, plans stay small, a lost executor rereads files instead of lineage,
    and the table's true size decides whether a join may broadcast it.
    """
    spark = df.sparkSession
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def local_session(cpus: int | None = None, app: str = "fieldwise") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cores = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FIELDWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.files.maxPartitionBytes", "4m")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)
