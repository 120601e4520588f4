"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins whose smaller side is small in every partition need no sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Shuffled rows are packed some five times as tight as sorts and hash tables hold them, and a task has several of these.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tallyspark", **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_MADE: list[str] = []


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for written intermediate tables and stream checkpoints.

    It lies below the shared ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is used on a local master; on a cluster that is an error.
    ``clear_work`` removes all folders made so far.
    """
    folder = _new_folder(spark, label)
    _MADE.append(folder)
    return folder


def clear_work(spark: SparkSession) -> int:
    """Removes the intermediate tables of this process, once every result that reads them is written; returns their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def _new_folder(spark: SparkSession, label: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if base:
        return f"{base.rstrip('/')}/tallyspark-{label}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), label)
