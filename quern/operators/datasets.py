"""Task sets: splits, stratified and diverse selection, quotas, fingerprints, pools.

Seeded orders are by sha256 of "seed:id", which any engine reproduces; a selection is a place in that order within its
stratum, of any size (see ranks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import place_within, same, small, with_count


def seeded(seed: int, *ids: str) -> Column:
    """The sort key of a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)), 256)


def split_databases(tasks: DataFrame, db: str = "db_id", seed: int = 42, train: float = 0.7) -> DataFrame:
    """(db, split): whole databases to train, validation and holdout, 70 % and half of the rest each.

    Ranks the distinct databases, which are few; every task of a database is in one split.
    """
    dbs = tasks.select(db).where(F.col(db).isNotNull()).distinct()
    rank = F.row_number().over(Window.orderBy(seeded(seed, db), db))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    ranked = dbs.withColumns({"_r": rank, "_n": n})
    first = F.bround(F.col("_n") * train).cast("long")
    second = first + F.floor((F.col("_n") - first) / 2)
    split = F.when(F.col("_r") <= first, "train").when(F.col("_r") <= second, "internal_validation").otherwise("internal_holdout")
    return ranked.select(db, split.alias("split"))


def route_tasks(tasks: DataFrame, known_dbs: DataFrame, db: str = "db_id", task: str = "task_id") -> DataFrame:
    """tasks with `reason`: null where usable, else the first rule broken (missing_database, missing_question, duplicate_id)."""
    marked = tasks.join(known_dbs.select(F.col(db).alias("_db"), F.lit(True).alias("_known")), F.col(db) == F.col("_db"), "left")
    copies = F.count(F.lit(1)).over(Window.partitionBy(task))
    reason = F.when(F.col("_known").isNull(), "missing_database").when(F.trim(F.coalesce("question", F.lit(""))) == "", "missing_question").when(copies > 1, "duplicate_id")
    return marked.withColumn("reason", reason).drop("_db", "_known")


def split_statistics(tasks: DataFrame, split: str = "split", levels: tuple[str, ...] = ("en", "de", "fr", "es")) -> DataFrame:
    """For each split its tasks, distinct databases and tasks of each difficulty."""
    counts = [F.count_if(F.col("difficulty") == x).alias(x) for x in levels]
    return tasks.groupBy(split).agg(F.count(F.lit(1)).alias("tasks"), F.countDistinct("db_id").alias("databases"), *counts)


def diverse_order(tasks: DataFrame, seed: int, db: str, task: str, *strata: str) -> DataFrame:
    """tasks with `repeat` (not the first of its database) and, within strata, `place`: first ones before all repeats, in seeded order.

    Rows that repeat the id of a database's first task are first ones too.
    """
    h = seeded(seed, task)
    firsts = tasks.groupBy(*strata, db).agg(F.min(F.struct(h.alias("h"), F.col(task).alias("t")))["t"].alias("_t"))
    keys = [*strata, db]
    firsts = firsts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_t")
    is_first = same([*((F.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)), (F.col(task), F.col("_t"))])
    marked = tasks.withColumn("_h", h).join(small(firsts.withColumn("_is", F.lit(True))), is_first, "left")
    marked = marked.withColumn("repeat", F.col("_is").isNull()).drop("_is", "_t", *(f"_k{i}" for i in range(len(keys))))
    return place_within(marked, list(strata), [F.col("repeat"), F.col("_h"), F.col(task)]).drop("_h")


def select_diverse(tasks: DataFrame, stratum: str, count: int, seed: int, db: str = "db_id", task: str = "task_id") -> DataFrame:
    """`count` rows of each stratum, distinct databases first; `short` says how many are missing."""
    some = diverse_order(tasks, seed, db, task, stratum).where(F.col("place") <= count)
    return with_count(some, [stratum], "_n").withColumn("short", F.lit(count) - F.col("_n")).drop("_n")


def sample_per_stratum(tasks: DataFrame, stratum: str, n: int, seed: int, task: str = "task_id") -> DataFrame:
    """n rows of each stratum without replacement."""
    return place_within(tasks, [stratum], [seeded(seed, task), F.col(task)]).where(F.col("place") <= n)


def quota_table(tasks: DataFrame, quotas: dict[str, int], stratum: str) -> DataFrame:
    return tasks.sparkSession.createDataFrame(list(quotas.items()), f"{stratum} string, quota int")


def candidate_limits(done: DataFrame, targets: dict[str, int], factors: dict[str, int], least: dict[str, int], stratum: str) -> DataFrame:
    """How many candidates each stratum still needs: deficit times factor, at least a minimum, 0 without a deficit."""
    spark = done.sparkSession
    plan = spark.createDataFrame([(k, targets[k], factors[k], least[k]) for k in targets], f"{stratum} string, target int, factor int, least int")
    have = done.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("done"))
    out = plan.join(have, plan[stratum] == have["_s"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    deficit = F.greatest(F.lit(0), F.col("target") - F.col("done"))
    return out.withColumn("deficit", deficit).select(stratum, "deficit", F.when(deficit > 0, F.greatest("least", deficit * F.col("factor"))).otherwise(0).alias("candidates"))


def prepare_candidates(tasks: DataFrame, done: DataFrame, limits: DataFrame, stratum: str, seed: int, task: str = "task_id", db: str = "db_id") -> DataFrame:
    """Tasks not done yet, diverse first, up to each stratum's limit.  `limits` has a row for each stratum."""
    left = tasks.join(done.select(task), task, "left_anti")
    return diverse_order(left, seed, db, task, stratum).join(F.broadcast(limits), stratum).where(F.col("place") <= F.col("candidates"))


def fill_quotas(successes: DataFrame, deficits: DataFrame, stratum: str, db: str = "db_id", task: str = "task_id") -> DataFrame:
    """Successes up to each stratum's deficit, those of databases with few successes first."""
    placed = place_within(with_count(successes, [db], "db_count"), [stratum], [F.col("db_count"), F.col(db), F.col(task)])
    return placed.join(F.broadcast(deficits), stratum).where(F.col("place") <= F.col("deficit"))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts, white space collapsed and lower-cased."""
    clean = [F.lower(F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), r"\s+", " "))) for p in parts]
    return F.sha2(F.to_json(F.array(*clean)), 256)


def build_pool(tasks: DataFrame, excluded: DataFrame, mark: str = "fp", task: str = "task_id") -> DataFrame:
    """Tasks neither of whose id and fingerprint is excluded, one for each fingerprint: the smallest id."""
    left = tasks.join(excluded.select(task), task, "left_anti").join(excluded.select(mark), mark, "left_anti")
    first = F.row_number().over(Window.partitionBy(mark).orderBy(task))
    return left.withColumn("_first", first).where("_first = 1").drop("_first")


def source_for_count(count: Column, n: int) -> Column:
    """Where a task stands: never tried, never solved, always solved, or between."""
    return F.when(count.isNull(), "exploration").when(count == 0, "zero").when(count == n, "mastered").otherwise("boundary")


def curriculum_pool(tasks: DataFrame, quotas: DataFrame, seed: int, db: str = "db_id", task: str = "task_id") -> DataFrame:
    """Rows up to the quota of each (source, difficulty), diverse first.  quotas: source, difficulty, quota."""
    placed = diverse_order(tasks, seed, db, task, "source", "difficulty")
    return placed.join(F.broadcast(quotas), ["source", "difficulty"]).where(F.col("place") <= F.col("quota"))


def shortages(selected: DataFrame, quotas: DataFrame) -> DataFrame:
    """Quotas that were not met: source, difficulty, quota, selected."""
    have = selected.groupBy("source", "difficulty").agg(F.count(F.lit(1)).alias("selected"))
    out = quotas.join(have, ["source", "difficulty"], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return out.where("selected < quota")


def same_order(pool: DataFrame, metadata: DataFrame, seq: str, key: str) -> DataFrame:
    """Positions at which pool and metadata differ, absent ones included; none means the pool can be used again."""
    a = pool.select(F.col(seq).alias("seq"), F.col(key).alias("left_key"))
    b = metadata.select(F.col(seq).alias("_s"), F.col(key).alias("right_key"))
    joined = a.join(b, a["seq"] == b["_s"], "full_outer")
    return joined.select(F.coalesce("seq", "_s").alias("seq"), "left_key", "right_key").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def cyclic_batch(pool: DataFrame, seq: str, size: int, step: int, count: int) -> DataFrame:
    """The `count` rows of a step when steps go round the pool."""
    return pool.where(F.pmod(F.col(seq) - F.lit(step * count), F.lit(size)) < count)


def epoch_order(rows: DataFrame, length: str, task: str, seed: int, bucket: int = 256) -> DataFrame:
    """rows with bucket and place: shuffled, cut in buckets, each sorted by length, every other one downwards."""
    df = place_within(rows.withColumn("_h", seeded(seed, task)), [], [F.col("_h"), F.col(task)], "_rn")
    df = df.withColumn("bucket", F.floor((F.col("_rn") - 1) / bucket).cast("long"))
    sign = F.when(F.col("bucket") % 2 == 0, F.col(length)).otherwise(-F.col(length))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(sign, "_h", task))
    return df.withColumn("place", place).drop("_h", "_rn")


def quota_check(rows: DataFrame, totals: dict[str, int], stratum: str) -> DataFrame:
    """For each stratum the expected and actual number, and whether they agree."""
    want = quota_table(rows, totals, stratum)
    have = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("actual"))
    out = want.join(have, want[stratum] == have["_s"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.select(stratum, F.col("quota").alias("expected"), "actual", (F.col("quota") == F.col("actual")).alias("exact"))


def record_name(difficulty: Column, task: Column) -> Column:
    """difficulty-xxxxxxxxxxxx: twelve hexadecimal digits of the id's sha256."""
    return F.concat_ws("-", difficulty, F.substring(F.sha2(task, 256), 1, 12))


def generation_seed(base: int, task: Column, attempt: Column, turn: Column) -> Column:
    """base + the first four bytes of the id's sha256 + attempt * 1,000,003 + turn."""
    head = F.conv(F.substring(F.sha2(task, 256), 1, 8), 16, 10).cast("long")
    return F.lit(base) + head + attempt * 1_000_003 + turn
