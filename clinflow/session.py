"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def send_by_value(module: str) -> None:
    """Send the functions of a module to the executors themselves, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(name: str = "clinflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="clinflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the application's part of the shared folder."""
    return os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}")


def work_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder, with all its work tables."""
    return os.path.join(shared_dir(spark), f"work-{spark.sparkContext.applicationId}")


def clear_work(spark: SparkSession) -> None:
    """Delete the work tables of this application: for jobs that have written their results."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_work: ContextVar[str | None] = ContextVar("work", default=None)


@contextmanager
def work_in(folder: str):
    """Within, intermediate tables go to `folder` under their label and replace those of the last time.

    Repeated jobs, such as micro-batches, keep one set of tables this way.
    """
    token = _work.set(folder)
    try:
        yield
    finally:
        _work.reset(token)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    folder = _work.get()
    path = os.path.join(folder, label) if folder else run_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
