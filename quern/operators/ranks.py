"""Exact places within strata of any size: a range partition, counts of each part, prefix sums.

A window partitioned by a stratum puts the stratum into one task.  Here rows are sorted by stratum and order over all
partitions, written, and counted by partition and stratum; a row's place is its row in the partition, less where its
stratum begins there, plus what earlier partitions have of it.  Only the first stratum of a partition can have begun before, so
the driver adds up one number a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import ready, shared_folder

#: Rows of a table that is sent to all tasks; larger ones are joined by key.
SMALL = 100_000
ROW_BITS = 33  # of monotonically_increasing_id: a partition's number above, the row in it below


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has `most` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def same(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether all pairs are equal, nulls too."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs), F.lit(True))


def joined(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """df with the facts of its keys, null keys too; each row has one row of facts."""
    named = facts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in facts.columns if c not in keys))
    return df.join(small(named), same([(F.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)])).drop(*(f"_k{i}" for i in range(len(keys))))


def with_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with how many rows share its keys."""
    return joined(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys) if keys else df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def place_within(df: DataFrame, strata: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in its stratum (all rows, where there are no strata) by the order.

    The order should end with an id: rows equal in all of it have places of their own in no stated order, and lie in one
    partition.  Null strata are a stratum, nulls come first in the order; an empty table stays empty.  df is computed once,
    with all its columns, and written in the shared folder.
    """
    spark = ready(df.sparkSession)
    by = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(by, order))).repartitionByRange(*strata, *by).sortWithinPartitions(*strata, *by)
    path = shared_folder(spark, "places")
    keyed.drop(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    at = F.col("_at")
    rows = spark.read.parquet(path).withColumns({"_part": F.shiftright(at, ROW_BITS), "_row": at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("_at")
    counts = rows.groupBy("_part", *strata).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts_path = shared_folder(spark, "counts")
    counts.write.parquet(counts_path)
    counts = spark.read.schema(counts.schema).parquet(counts_path)
    key = F.struct(*strata, F.lit(0).alias("_"))
    parts = counts.groupBy("_part").agg(
        F.min_by(F.struct(key.alias("k"), "_n"), "_first").alias("first"), F.max_by(F.struct(key.alias("k"), "_n"), "_first").alias("last"), F.count(F.lit(1)).alias("strata")
    )
    before, running, current = [], 0, None
    for p in parts.orderBy("_part").collect():  # a row a partition
        offset = running if p["first"]["k"] == current else 0
        before.append((p["_part"], offset))
        current, running = p["last"]["k"], p["last"]["_n"] + (offset if p["strata"] == 1 else 0)
    offsets = spark.createDataFrame(before, "_p long, _before long")
    starts = counts.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).select("_part", *strata, (F.when(F.col("_first") == 0, F.col("_before")).otherwise(0) - F.col("_first")).alias("_shift"))
    place = (F.col("_row") + F.col("_shift") + 1).cast("int")
    return joined(rows, starts, ["_part", *strata]).withColumn(name, place if name == "place" else place.cast("long")).drop("_part", "_row", "_shift")
