"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs were measured with. All are plain Spark settings, and a
# session built elsewhere works too.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Two outcome partitions per task: keep both files open instead of sorting
    # every wide row by outcome before it is written.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


_local_root: tempfile.TemporaryDirectory | None = None


def build_session(app: str = "passagemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Intermediate tables must outlive any executor, so on a cluster the setting
    is required. Only a session in one process, ``local[...]``, gets a temporary
    folder without it, which goes when the program ends.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if _local_root is None:
            _local_root = tempfile.TemporaryDirectory(prefix="passagemill-", ignore_cleanup_errors=True)
        root = _local_root.name
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a table of fewer file splits than cores one partition per core.

    For plain scans ahead of costly per-row work. A table of many splits is
    returned as it is, so only small inputs are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
