"""What the corpus operators share: table reading, the shared scratch folder, worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import spread

ROOT = str(Path(__file__).resolve().parents[2])

#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"

#: Whether the shuffle files of a query go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder the driver has it in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # Ten thousand long texts are too many for a worker to hold at a time.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, over all cores where its files have fewer splits than there are cores."""
    ready(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, a folder of our own, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jpath)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and reread from the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of this plan again; else they stay until the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for t in tables:
        if path := t.__dict__.get("_scratch"):
            forget(t.sparkSession, path)


def known_ids(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a long that is never null, `known` (whether it was not), and the columns.

    For Python: beside nulls pandas makes floats of longs, which cuts large ids.
    """
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), *columns)


def masked(ids, known):
    """The ids as a nullable column again."""
    import pandas as pd

    return pd.Series(pd.arrays.IntegerArray(ids.to_numpy("int64"), ~known.to_numpy(bool)), index=ids.index)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone.  The plain lower() is the same where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def key128(c: Column) -> Column:
    """Two 64-bit hashes of a string: short enough to shuffle, long enough not to collide in 10^12 keys."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("quern"), c).alias("b"))
