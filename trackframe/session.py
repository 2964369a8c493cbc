"""Session settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "trackframe", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one the cluster names in spark.checkpoint.dir.

    Where driver and executors are one process (tests on one machine) and that is unset, a temporary
    folder stands in; on a cluster it must be set, since executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/trackframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if on_cluster(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{_local_folder()}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="trackframe-")


def checkpoint(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage of `df` by writing it to the shared folder and reading it back.

    The files outlive any executor, and their real size reaches the planner: estimates of a
    many-step plan would otherwise multiply with every join.
    """
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_cluster(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None


def clear_steps(spark: SparkSession) -> bool:
    """Delete the written steps of this session, once nothing reads them any more."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/trackframe-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def default_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
