"""The append-only store of verified experience: Parquet folders, and a log that says which of them are the store.

A version is a small manifest, log/<number>.json: its folders and the last number of their rows.  A writer reads a version, writes
its rows in a folder of their own and makes the next manifest, which fails if another has made it first; then it
begins again from that one.  So ids stay single and numbers have no gaps whoever appends at once.  A reader that holds a
version sees its rows whatever is appended later: that is a round's frozen snapshot.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import file_system

FIELDS = ("memory_id", "question", "experience", "sql_before", "sql_first_execute", "sql_after", "source_task_id", "source_split", "initial_record_path", "retry_record_path")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", seq long"


def memory_id(df: DataFrame) -> DataFrame:
    """df with memory_id: sha256 of what identifies the evidence."""
    return df.withColumn("memory_id", F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("source_task_id", "initial_record_path", "retry_record_path"))), 256))


def invalid(records: DataFrame) -> DataFrame:
    """Records that may not be stored: fields missing, an experience too long, or a split other than train."""
    need = [c for c in FIELDS if c != "sql_first_execute"]
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull()
    return records.where(missing | (F.char_length("experience") > 1200) | (F.col("source_split") != "train"))


def new_rows(store: DataFrame, records: DataFrame) -> DataFrame:
    """Rows to append: ids the store lacks, one each, numbered on from the store's last.

    The numbers come from one window over what a round appends, which is small beside the store.
    """
    first = F.row_number().over(Window.partitionBy("memory_id").orderBy("question"))
    fresh = records.withColumn("_f", first).where("_f = 1").drop("_f", "seq").join(store.select("memory_id"), "memory_id", "left_anti")
    last = store.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))  # the manifest's last, read from the rows themselves
    return fresh.join(F.broadcast(last)).withColumn("seq", F.col("_last") + F.row_number().over(Window.orderBy("memory_id"))).drop("_last")


def conflicts(store: DataFrame, records: DataFrame) -> DataFrame:
    """Ids that the store has with another content."""
    theirs = store.select("memory_id", F.to_json(F.struct(*FIELDS)).alias("old"))
    return records.select("memory_id", F.to_json(F.struct(*FIELDS)).alias("new")).join(theirs, "memory_id").where("old <> new")


TRIES = 20


class Conflict(Exception):
    """Another writer has made the version first."""


def version(spark: SparkSession, path: str) -> int:
    """The store's last version; 0 where nothing was appended."""
    fs, log = file_system(spark, f"{path}/log")
    if not fs.exists(log):
        return 0
    return max((int(x.getPath().getName()[:-5]) for x in fs.listStatus(log) if x.getPath().getName().endswith(".json")), default=0)


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    if number == 0:
        return {"folders": [], "last": 0}
    return json.loads(spark.read.text(f"{path}/log/{number:08d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Makes a version, whole and once: written aside, then put in place if nothing is there, else Conflict.

    A local folder's files are linked, others renamed without overwriting, which HDFS and stores like it do as one step.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, target = file_system(spark, f"{path}/log/{number:08d}.json")
    fs.mkdirs(target.getParent())
    _, aside = file_system(spark, f"{path}/log/_{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        else:
            context = jvm.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
            context.rename(aside, target, spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
    except FileExistsError:
        raise Conflict from None
    except Exception as e:
        if fs.exists(target):
            raise Conflict from e
        raise
    finally:
        fs.delete(aside, False)


def append_verified(spark: SparkSession, path: str, records: DataFrame) -> int:
    """Appends what is new and returns how many rows that were; appending the same records again does nothing."""
    if not invalid(records).isEmpty():
        raise ValueError("records may not be stored")
    for _ in range(TRIES):
        number = version(spark, path)
        store, manifest = read(spark, path, number), _manifest(spark, path, number)
        if not conflicts(store, records).isEmpty():
            raise ValueError("stored evidence differs")
        folder = f"data/{uuid.uuid4().hex}"
        new_rows(store, records).select(*FIELDS, "seq").write.parquet(f"{path}/{folder}")
        n = spark.read.schema(SCHEMA).parquet(f"{path}/{folder}").count()
        fs, written = file_system(spark, f"{path}/{folder}")
        try:
            if n:
                _publish(spark, path, number + 1, {"folders": [*manifest["folders"], folder], "last": manifest["last"] + n})
                return n
        except Conflict:
            fs.delete(written, True)
            continue
        fs.delete(written, True)
        return 0
    raise Conflict(f"{path}: other writers were first {TRIES} times")


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """All memories of a version, the last where none is given; order by seq for insertion order."""
    folders = _manifest(spark, path, version(spark, path) if at is None else at)["folders"]
    return spark.read.schema(SCHEMA).parquet(*(f"{path}/{x}" for x in folders)) if folders else spark.createDataFrame([], SCHEMA)


def backfill(store: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the store with missing first SQL filled in, one row of counts).  found: memory_id, first_sql."""
    joined = store.join(found.select("memory_id", "first_sql"), "memory_id", "left")
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("sql_first_execute").isNotNull()).alias("already"),
        F.count_if(F.col("sql_first_execute").isNull() & F.col("first_sql").isNotNull()).alias("filled"), F.count_if(F.col("sql_first_execute").isNull() & F.col("first_sql").isNull()).alias("missing"),
    )
    return joined.withColumn("sql_first_execute", F.coalesce("sql_first_execute", "first_sql")).drop("first_sql"), counts
