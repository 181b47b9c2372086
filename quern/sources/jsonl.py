"""JSON record sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.ranks import small
from quern.session import file_system

TASK = "task_id string, source string, db_id string, db_path string, question string, reference_sql string, difficulty string, split string"
DIFFICULTIES = ("easy", "medium", "hard", "extra")
SPLITS = ("train", "internal_validation", "internal_holdout", "external_dev")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each line of text files with its number in its file, from 1.

    Files are read in splits, on all cores; a line's number is its row in the split and the lines of the file's splits
    before.  What the driver holds is nothing; counts of splits are joined by file and split.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *where).withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")
    splits = splits.select(F.col("file").alias("_f"), F.col("_start").alias("_s"), (before - F.col("_first") + 1).alias("_shift"))
    found = lines.join(small(splits), (F.col("file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return found.select("file", (F.col("_at") + F.col("_shift")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def load_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, numbered: bool = False) -> DataFrame:
    """A line for each record, blank lines skipped; numbered ones have file and line too.

    strict fails on a bad line and says its file and number; otherwise _corrupt_record has the line.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    record = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = lines.withColumn("_r", record)
    place = ("file", "line") if numbered else ()
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    if not strict:
        return lines.select(*place, *(F.col(f"_r.{c}").alias(c) for c in names), "_r._corrupt_record")
    bad = F.raise_error(F.concat(F.lit("Invalid record at "), "file", F.lit(":"), F.col("line").cast("string"))).cast("boolean")
    # The check is a filter, so that no choice of columns can leave it out.
    checked = lines.where(F.when(F.col("_r._corrupt_record").isNotNull(), bad).otherwise(F.lit(True)))
    return checked.select(*place, *(F.col(f"_r.{c}").alias(c) for c in names))


def load_tasks(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    return load_jsonl(spark, path, TASK, numbered=numbered)


def bad_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with a value that no enumeration has, or without an id."""
    return tasks.where(F.col("task_id").isNull() | ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)) | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))


def find_task(tasks: DataFrame, task_id: str | None = None) -> DataFrame:
    """The task of an id, without one any; of several the first by file and line, or by id where tasks are not numbered."""
    found = tasks.where(F.col("task_id") == task_id) if task_id is not None else tasks
    return found.orderBy(*([c for c in ("file", "line") if c in tasks.columns] or ["task_id"])).limit(1)


def load_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with the file's name to order by."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def create(df: DataFrame, path: str) -> None:
    """Writes, and refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def write_manifest(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file, whole or not at all: written beside its place and renamed, in any store that Spark writes to."""
    fs, target = file_system(spark, path)
    aside = target.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{path} could not be put in place")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What a manifest holds; None if there is none."""
    fs, target = file_system(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(target) else None


def ensure_manifest(spark: SparkSession, path: str, value: dict) -> None:
    """Creates the manifest, or fails if the one that is there differs."""
    found = read_manifest(spark, path)
    if found is None:
        write_manifest(spark, path, value)
    elif found != json.loads(json.dumps(value)):
        raise ValueError(f"{path} was written with another configuration")


def identity(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, length, modified) of each file by name: what tells one checkpoint from another without reading it."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified")).orderBy("file_name")


def _digest(df: DataFrame, shard: str) -> DataFrame:
    """(shard, rows, digest) of each shard's multiset of rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != shard)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.bit_xor(F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("long"))
    # Twelve digits of the sum of hashes keep rows that occur twice from cancelling.
    total = F.pmod(F.sum(F.conv(F.substring("_d", 37, 8), 16, 10).cast("decimal(38,0)")), F.lit(1 << 48)).cast("long")
    each = df.withColumn("_d", row).groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), part(0).alias("a"), part(1).alias("b"), total.alias("c"))
    return each.select(F.col(shard).cast("string").alias("shard"), "rows", F.concat_ws("-", "rows", "a", "b", "c").alias("digest"))


def save_shards(df: DataFrame, path: str, shard: str) -> None:
    """Writes rows (arrays of numbers and others) as shards, one folder for each value of `shard`, and their digests."""
    df.write.partitionBy(shard).parquet(f"{path}/rows")
    _digest(df, shard).write.parquet(f"{path}/digests")


def check_shards(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """(shard, rows, intact): whether each stored shard has the rows that its digest was taken of."""
    now, then = _digest(spark.read.parquet(f"{path}/rows"), shard), spark.read.parquet(f"{path}/digests")
    then = then.select(F.col("shard").alias("s"), F.col("digest").alias("want"))
    out = now.join(then, F.col("shard") == F.col("s"), "full_outer")
    return out.select(F.coalesce("shard", "s").alias("shard"), F.coalesce("rows", F.lit(0)).alias("rows"), F.col("digest").eqNullSafe(F.col("want")).alias("intact"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, length, sha256) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def differing(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Names whose digests differ between two manifests, or that one lacks."""
    x, y = a.select(key, F.col(value).alias("left")), b.select(F.col(key).alias("_k"), F.col(value).alias("right"))
    both = x.join(y, x[key] == y["_k"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
    return both.select(F.coalesce(key, "_k").alias(key), "left", "right")


def finalize(rows: DataFrame, totals: dict[str, int], stratum: str, path: str) -> DataFrame:
    """Writes a finished collection once, with a manifest of its counts; returns them.

    Refused with ValueError unless each stratum has just its total and no other has rows, and where the collection is there already.
    """
    spark = rows.sparkSession
    have = {r[0]: r[1] for r in rows.groupBy(stratum).agg(F.count(F.lit(1))).collect()}  # a row a stratum
    wrong = {k: (totals.get(k, 0), have.get(k, 0)) for k in totals.keys() | have.keys() if totals.get(k, 0) != have.get(k, 0)}
    if wrong:
        raise ValueError(f"expected and actual numbers differ: {wrong}")
    create(rows, f"{path}/records")
    write_manifest(spark, f"{path}/manifest.json", {k: n for k, n in have.items() if k is not None})
    return spark.createDataFrame(list(have.items()), f"{stratum} string, rows long")


def views(attempts: DataFrame, correct: str) -> tuple[DataFrame, DataFrame]:
    """All attempts, and the successful ones."""
    return attempts, attempts.where(F.col(correct))
