"""Collection runs: tool results, observation limits, guards, quotas by attempt, metadata, configuration checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.datasets import seeded
from quern.operators.ranks import place_within
from quern.operators.scoring import TURN_LIMITS

ATTEMPT_STEP = 10_007


def tool_result(rows: DataFrame, group: str, order: str, value: str, limit: int) -> DataFrame:
    """What the execute tool shows of each result: rows up to a limit, whether there are more, the count if there are not."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    ranked = rows.withColumn("_p", place).where(F.col("_p") <= limit + 1)
    out = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_p") <= limit, F.struct("_p", F.col(value).alias("v"))))).alias("_v"))
    more = F.col("_n") > limit
    return out.select(group, F.transform("_v", lambda x: x["v"]).alias("shown"), more.alias("has_more"), F.when(~more, F.col("_n")).alias("total_row_count"))


#: In this order the limiter shortens the lists of an observation.
SHRINK = ("rows", "values", "foreign_keys", "columns", "tables", "tools")


def limit_observation(costs: dict[str, Column], base: Column, budget: int) -> Column:
    """How many leading entries of each list stay when an observation must fit a token budget.

    costs: an array of token costs for each list, in the order of SHRINK.  Lists are cut from their tails, the first
    kind completely before the next is touched; `minimal` says that even empty lists do not fit.
    """
    total = {k: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for k, c in costs.items()}
    used = base.cast("long")
    for t in total.values():
        used = used + t
    over = F.greatest(used - budget, F.lit(0))
    kept = []
    for k in [k for k in SHRINK if k in costs]:
        room = F.greatest(total[k] - over, F.lit(0))
        kept.append(_leading(costs[k], room).alias(k))
        over = F.greatest(over - total[k], F.lit(0))
    return F.struct(*kept, (over > 0).alias("minimal"))


def _leading(costs: Column, room: Column) -> Column:
    """How many leading entries fit; after the first that does not, none does."""

    def step(a, x):
        more = F.struct((a["s"] + x).cast("long").alias("s"), (a["n"] + 1).alias("n"))
        return F.when(a["s"] + x <= room, more).otherwise(F.struct((room + 1).cast("long").alias("s"), a["n"].alias("n")))

    return F.aggregate(costs, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n")), step, lambda a: a["n"])


def only_train(tasks: DataFrame, split: str = "split") -> DataFrame:
    """Tasks that must not be collected from: the guard passes when this is empty."""
    return tasks.where(~F.coalesce(F.col(split) == "train", F.lit(False)))


def attempt_plan(tasks: DataFrame, done: DataFrame, targets: dict[str, int], seed: int, attempt: int, stratum: str = "difficulty", task: str = "task_id") -> DataFrame:
    """Tasks to try in one attempt: not done, in the attempt's own order, as many of each stratum as are still missing.

    The order's seed moves by 10,007 an attempt, and by one more for all strata but the easiest (the first target).
    """
    easiest = next(iter(targets))
    have = done.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_done"))
    plan = tasks.sparkSession.createDataFrame(list(targets.items()), "_t string, _target int")
    need = plan.join(have, plan["_t"] == have["_s"], "left").select("_t", F.greatest(F.lit(0), F.col("_target") - F.coalesce("_done", F.lit(0))).alias("missing"))
    left = tasks.join(done.select(task), task, "left_anti")
    base = seed + attempt * ATTEMPT_STEP
    h = F.when(F.col(stratum) == easiest, seeded(base, task)).otherwise(seeded(base + 1, task))
    return place_within(left, [stratum], [h, F.col(task)]).join(F.broadcast(need), F.col(stratum) == F.col("_t")).where(F.col("place") <= F.col("missing")).drop("_t")


def bootstrap(records: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """records, and those of a finished earlier run whose keys they lack: copying again changes nothing."""
    return records.unionByName(prior.join(records.select(key), key, "left_anti").select(*records.columns))


def initial_sql(tasks: DataFrame, stored: DataFrame, key: str = "task_id", sql: str = "sql") -> tuple[DataFrame, DataFrame]:
    """(tasks with their stored SQL, tasks without a usable one); the second must be empty."""
    joined = tasks.join(stored.select(F.col(key).alias("_k"), F.col(sql).alias("initial_sql")), F.col(key) == F.col("_k"), "left").drop("_k")
    blank = F.trim(F.coalesce("initial_sql", F.lit(""))) == ""
    return joined.where(~blank), joined.where(blank)


def with_metadata(tasks: DataFrame, metadata: DataFrame | None, key: str = "task_id") -> DataFrame:
    """tasks with selection_source and prior_correct_count; without metadata, exploration and null."""
    if metadata is None:
        return tasks.withColumns({"selection_source": F.lit("exploration"), "prior_correct_count": F.lit(None).cast("long")})
    return tasks.join(metadata.select(key, "selection_source", "prior_correct_count"), key, "left")


def id_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that one side lacks, with the side that has them."""
    x = a.select(F.col(key).alias("l")).distinct().join(b.select(F.col(key).alias("r")).distinct(), F.col("l") == F.col("r"), "full_outer")
    return x.where("l is null or r is null").select(F.coalesce("l", "r").alias(key), F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def turn_limit(difficulty: Column, adaptive: bool, default: int) -> Column:
    """Assistant turns that an episode may take: by difficulty only in the adaptive mode."""
    if not adaptive:
        return F.lit(default)
    out = F.lit(default)
    for k, v in TURN_LIMITS.items():
        out = F.when(difficulty == k, v).otherwise(out)
    return out


def trainable(turns: DataFrame, key: str, turn: str, prefix: str) -> DataFrame:
    """Turns of episodes whose every turn extends the one before: forked suffixes are left out.

    prefix: how many of the turn's prompt ids equal the previous turn's whole sequence; null for a first turn.
    """
    broken = F.bool_or(F.coalesce(F.col(prefix) == 0, F.lit(False))).over(Window.partitionBy(key))
    return turns.withColumn("_b", broken).where(~F.col("_b")).drop("_b")


def schema_metrics(details: DataFrame, group: str) -> DataFrame:
    """One row of means over reward details, and of groups keyed as they are, whatever their size."""
    per = details.groupBy(group).agg(F.bool_or("rescued").alias("rescued"), F.max("reward").alias("best"))
    groups = per.agg(F.count(F.lit(1)).alias("groups"), F.count_if("rescued").alias("rescued_groups"), F.count_if(F.col("best") == 0).alias("all_zero_groups"))
    means = details.agg(F.avg("schema_score").alias("mean_schema_score"), F.avg(F.col("available").cast("int")).alias("candidate_coverage"), F.avg(F.col("parsed").cast("int")).alias("parse_rate"), F.avg("diagnostic").alias("mean_diagnostic"))
    return means.join(F.broadcast(groups)).withColumn("rescued_ratio", F.col("rescued_groups") / F.greatest(F.lit(1), F.col("all_zero_groups")))


@dataclass(frozen=True)
class RunConfig:
    """A training run's numbers that must agree with one another."""

    pool_size: int = 512
    group_size: int = 8
    difficulties: dict[str, int] = field(default_factory=lambda: {"easy": 128, "medium": 128, "hard": 128, "extra": 128})
    sources: dict[str, int] = field(default_factory=lambda: {"exploration": 256, "boundary": 256})
    clip_low: float = 0.2
    clip_high: float = 0.2
    kl_beta: float = 0.0
    turn_rewards: bool = False
    schema_rewards: bool = False

    def __post_init__(self):
        if sum(self.difficulties.values()) != self.pool_size or sum(self.sources.values()) != self.pool_size:
            raise ValueError("quotas must sum to the pool's size")
        if self.group_size < 2:
            raise ValueError("a group needs two rollouts")
        if not 0 <= self.clip_low <= self.clip_high < 1 or self.kl_beta < 0:
            raise ValueError("clip ratios or penalty out of range")
        if self.turn_rewards and self.schema_rewards:
            raise ValueError("one shaped reward at a time")


@dataclass(frozen=True)
class CollectConfig:
    targets: dict[str, int] = field(default_factory=lambda: {"easy": 1})

    def __post_init__(self):
        if any(v < 0 for v in self.targets.values()) or not any(self.targets.values()):
            raise ValueError("targets must not be negative, and one must be positive")

    def active(self) -> list[str]:
        return [k for k, v in self.targets.items() if v > 0]
