"""Group-relative advantages, ranks, rewards, token losses and weights, as column expressions and windows.

Every function takes and returns DataFrames; group keys are shuffled once, and window functions over the same keys
share that shuffle.  A group is one prompt's rollouts, so it is small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
#: Turns in which a task of a difficulty should be solved, and the most it may take.
BASELINES = {"easy": 4, "medium": 5, "hard": 7, "extra": 8}
TURN_LIMITS = {"easy": 6, "medium": 7, "hard": 9, "extra": 10}


def kind_of(share: Column) -> Column:
    """all_zero, all_one or mixed, from a group's mean outcome."""
    return F.when(share == 0, "all_zero").when(share == 1, "all_one").otherwise("mixed")


def group_advantages(df: DataFrame, group: str, reward: str, outcome: str | None = None, eps: float = EPS) -> DataFrame:
    """df with group_size, mean_reward, reward_std (population), advantage and group_kind.

    Groups of fewer than two rows have nothing to compare and are left out.  `outcome` is the column whose mean names
    the kind where rewards are shaped; by default the reward itself.
    """
    w = Window.partitionBy(group)
    df = df.withColumns({"group_size": F.count(F.lit(1)).over(w), "mean_reward": F.avg(reward).over(w), "reward_std": F.stddev_pop(reward).over(w)})
    share = F.avg(outcome).over(w) if outcome else F.col("mean_reward")
    df = df.withColumns({"group_kind": kind_of(share), "advantage": (F.col(reward) - F.col("mean_reward")) / (F.col("reward_std") + eps)})
    return df.where("group_size > 1")


def tied_centered_rank(score: str, *keys: str) -> Column:
    """Average rank among equals, moved and scaled to [-1, 1]; 0 where a group has one row."""
    by = Window.partitionBy(*keys)
    rank = F.rank().over(by.orderBy(score)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, score))
    middle = (F.count(F.lit(1)).over(by) - 1) / 2
    return F.when(middle == 0, 0.0).otherwise((rank + (ties - 1) / 2 - middle) / middle)


def hierarchical_advantages(
    df: DataFrame, group: str, reward: str, schema: str, submission: str, c_schema: float = 0.2, c_submission: float = 0.0, eta: float = 0.05
) -> DataFrame:
    """Execution advantages plus ranks of the schema and submission scores among a group's failures.

    rescued: the group failed as a whole and still has rows that differ.
    """
    df = group_advantages(df, group, reward).withColumn("failed", F.col(reward) == 0)
    ranks = {
        "schema_rank": F.when(F.col("failed"), tied_centered_rank(schema, group, "failed")).otherwise(0.0),
        "submission_rank": F.when(F.col("failed"), tied_centered_rank(submission, group, "failed")).otherwise(0.0),
    }
    df = df.withColumns(ranks)
    total = F.col("advantage") + c_schema * F.col("schema_rank") + c_submission * F.col("submission_rank")
    df = df.withColumns({"total_advantage": total, "diagnostic": F.col(reward) + (1 - F.col(reward)) * eta * F.col(schema)})
    w = Window.partitionBy(group)
    spread = F.max("total_advantage").over(w) > F.min("total_advantage").over(w)
    return df.withColumn("rescued", (F.col("group_kind") == "all_zero") & spread)


def summarize_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """One row: counts and shares of the kinds, mean of the groups' deviations and rewards."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std")).where("n > 1")
    kinds = ("all_zero", "all_one", "mixed")
    kind = kind_of(F.col("mean"))
    counts = [F.count_if(kind == k).alias(f"{k}_groups") for k in kinds]
    out = groups.agg(F.count(F.lit(1)).alias("groups"), *counts, F.avg("std").alias("mean_reward_std"), F.avg("mean").alias("mean_reward"))
    ratios = {f"{k}_ratio": F.coalesce(F.try_divide(f"{k}_groups", "groups"), F.lit(0.0)) for k in kinds}
    return out.withColumns({**ratios, "mean_reward_std": F.coalesce("mean_reward_std", F.lit(0.0)), "mean_reward": F.coalesce("mean_reward", F.lit(0.0))})


def by_difficulty(difficulty: Column, values: dict[str, float]) -> Column:
    """The value of a difficulty; an unknown one is null."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(difficulty == k, v).otherwise(out)
    return out


def turn_reward(correct: Column, difficulty: Column, turns: Column, step: float = 0.1, baselines: dict[str, int] = BASELINES) -> Column:
    """0 for a failure, else 1 plus `step` for each turn saved against the difficulty's baseline."""
    return F.when(correct, 1 + step * (by_difficulty(difficulty, baselines) - turns)).otherwise(0.0)


def f1(candidate: Column, gold: Column) -> Column:
    """precision, recall and f1 of two sets; both empty is perfect, one empty is nothing."""
    a, b = F.array_distinct(candidate), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, b))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    p, r = both / F.size(a), both / F.size(b)

    def of(value: Column) -> Column:
        return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(value)

    mean = F.when(both == 0, 0.0).otherwise(2 * p * r / (p + r))
    return F.struct(of(p).alias("precision"), of(r).alias("recall"), of(mean).alias("f1"))


def schema_score(
    table_f1: Column, column_f1: Column, edge_f1: Column, valid: Column, parsed: Column, source: Column, gold_tables: Column,
    weights=(0.4, 0.4, 0.2), single=None, multi=None, execute_factor: float = 1.0,
) -> Column:
    """Validity (1, 0.25 if it parsed, 0) times the source's factor times the weighted F1 of tables, columns, edges."""

    def mix(w):
        return w[0] * table_f1 + w[1] * column_f1 + w[2] * edge_f1

    phi = F.when(gold_tables > 1, mix(multi or weights)).otherwise(mix(single or weights))
    validity = F.when(valid, 1.0).when(parsed, 0.25).otherwise(0.0)
    return validity * F.when(source == "execute_sql", execute_factor).otherwise(0.0) * phi


def episode_weights(df: DataFrame, group: str, episode: str, equal_groups: bool = True) -> DataFrame:
    """Rows are an episode's tokens: df with episode_weight (1 / groups / group size, or 1 / episodes) and token_weight.

    The numbers of groups and episodes are two counts of the whole table, joined as one row.
    """
    episodes = df.select(group, episode).distinct()
    sizes = episodes.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.count(F.lit(1)).alias("_groups"), F.sum("_size").alias("_episodes"))
    df = df.join(sizes, group).join(F.broadcast(total))
    weight = 1 / (F.col("_groups") * F.col("_size")) if equal_groups else 1 / F.col("_episodes")
    tokens = F.count(F.lit(1)).over(Window.partitionBy(group, episode))
    return df.withColumns({"episode_weight": weight, "token_weight": 1 / tokens}).drop("_size", "_groups", "_episodes")


def token_loss(current: Column, old: Column, reference: Column | None, advantage: Column, low: float = 0.2, high: float | None = None, beta: float = 0.0) -> dict[str, Column]:
    """Clipped surrogate loss of one token with a reference penalty: ratio, policy_loss, kl, loss and the two flags."""
    high = low if high is None else high
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), current - old)))
    bounded = F.greatest(F.lit(1.0 - low), F.least(F.lit(1.0 + high), ratio))
    policy = -F.least(ratio * advantage, bounded * advantage)
    if reference is None or beta == 0:
        kl = F.lit(0.0)
    else:
        x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), reference - current))
        kl = F.exp(x) - x - 1
    moved = ((advantage > 0) & (ratio > 1 + high)) | ((advantage < 0) & (ratio < 1 - low))
    return {"ratio": ratio, "policy_loss": policy, "kl": kl, "loss": policy + beta * kl, "clipped": ratio != bounded, "policy_clipped": moved}


def clip_counts(tokens: DataFrame, origin: str, advantage: str, mask: str) -> DataFrame:
    """For each origin the clipped, eligible and outside tokens, and all; needs clipped and policy_clipped."""
    eligible = F.col(mask) & (F.col(advantage) != 0)
    return tokens.groupBy(origin).agg(
        F.count_if(F.col("policy_clipped") & eligible).alias("clipped"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(F.col("clipped") & F.col(mask)).alias("outside"),
        F.count_if(F.col(mask)).alias("tokens"),
    )


def action_mask(ids: Column, special: list[int]) -> Column:
    """True for ids that are no special tokens."""
    return F.transform(ids, lambda x: ~x.isin(*special) if special else F.lit(True))


def masked_sum(values: Column, mask: Column) -> Column:
    """The sum of the values at masked places."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """softplus(-beta * ((chosen - rejected) - (ref_chosen - ref_rejected)))."""
    return softplus(-beta * ((chosen - rejected) - (ref_chosen - ref_rejected)))


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine to zero."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    decay = peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress))
    return F.when(step <= warmup, peak * step / warmup).otherwise(decay) if warmup else decay


def entropy(probabilities: Column) -> Column:
    """-sum p ln p of an array; zeros add nothing."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def entropy_summary(df: DataFrame, tokens: str, total: str, *keys: str) -> DataFrame:
    """Mean entropy of a token in nats and bits, and of a call, over rows of calls with their token counts and sums."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.sum(total).alias("_sum"), F.avg(F.try_divide(total, tokens)).alias("call_mean_nats"))
    nats = F.coalesce(F.try_divide("_sum", "tokens"), F.lit(0.0))
    return out.withColumns({"token_mean_nats": nats, "token_mean_bits": nats / F.ln(F.lit(2.0))}).drop("_sum")


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether a token at the characters [start, end) overlaps [first, last)."""
    return (start < last) & (end > first)


def sql_token_mask(starts: Column, ends: Column, first: Column, last: Column) -> Column:
    """True for tokens, given as character ranges, that overlap [first, last)."""
    return F.zip_with(starts, ends, lambda a, b: overlaps(a, b, first, last))


def turn_entropy(df: DataFrame, entropies: str) -> DataFrame:
    """df with tokens, entropy_sum and entropy_mean of a turn's stored token entropies; an empty turn has a mean of 0."""
    total = F.aggregate(entropies, F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({"tokens": F.size(entropies), "entropy_sum": total, "entropy_mean": F.coalesce(F.try_divide(total, F.size(entropies)), F.lit(0.0))})
