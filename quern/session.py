"""Sessions: settings for the engine's plans, and imports on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Adaptive execution coalesces small partitions and splits those of hot keys; queries side by side share the cores; dates compare in UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` use _ for the dots of a name."""
    builder = SparkSession.builder.appName("quern")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the folder the driver has it in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def lean(spark: SparkSession) -> SparkSession:
    """ready, with Arrow batches of a thousand rows unless the session says otherwise: ten thousand long texts are much for a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ready(spark)


def spread(df: DataFrame) -> DataFrame:
    """A table's rows over all cores where its files have fewer splits than there are cores; large tables stay as read.

    For scans alone: the partitions of other plans are not known before they run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share, removed when the driver's JVM ends.

    That is spark.checkpoint.dir; only in local mode is it made up where the session names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/quern-{label}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path: the one that Spark's readers open."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at
