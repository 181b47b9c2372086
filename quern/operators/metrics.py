"""Evaluation summaries: rates with guarded denominators, histograms, grouping sets, samples for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, correct: str, *keys: str) -> DataFrame:
    """For each key: count, correct and accuracy."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col(correct)).alias("correct"))
    return out.withColumn("accuracy", share(F.col("correct"), F.col("count")))


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def summary_columns() -> list[Column]:
    """The eleven rates of evaluation records; recovery is among those whose first SQL was wrong."""
    n = F.count(F.lit(1))
    flags = {"execution_accuracy": "success", "valid_action_rate": "valid_action", "valid_sql_rate": "valid_sql", "executable_sql_rate": "executable_sql"}
    means = {"average_turns": "turns", "average_tool_calls": "tool_calls", "average_tokens": "token_count", "average_latency_seconds": "latency_seconds"}
    wrong = ~F.col("first_sql_correct")
    return [
        n.alias("tasks"),
        F.count_if(F.col("success")).alias("successes"),
        *(share(F.count_if(F.col(c)), n).alias(name) for name, c in flags.items()),
        *(share(F.sum(c), n).alias(name) for name, c in means.items()),
        share(F.count_if(wrong & F.col("recovered")), F.count_if(wrong)).alias("recovery_rate"),
    ]


def summarize(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(*summary_columns())


def rollup_summary(records: DataFrame, mode: str = "mode", difficulty: str = "difficulty") -> DataFrame:
    """Overall, by mode and by difficulty in one pass: level, key and the rates."""
    out = records.groupingSets([[], [F.col(mode)], [F.col(difficulty)]], F.col(mode), F.col(difficulty)).agg(
        F.grouping(mode).alias("_m"), F.grouping(difficulty).alias("_d"), *summary_columns()
    )
    level = F.when(F.col("_m") == 0, "by_mode").when(F.col("_d") == 0, "by_difficulty").otherwise("overall")
    return out.select(level.alias("level"), F.coalesce(mode, difficulty).alias("key"), *[c for c in out.columns if c not in (mode, difficulty, "_m", "_d")])


def transitions(groups: DataFrame, prior: str, current: str, prior_size: int, size: str) -> DataFrame:
    """How many groups went from which prior label to which current one; a group without a prior count is unmapped."""
    before = F.when(F.col(prior).isNull(), "unmapped").otherwise(F.concat(F.col(prior).cast("string"), F.lit(f"/{prior_size}")))
    now = F.concat(F.col(current).cast("string"), F.lit("/"), F.col(size).cast("string"))
    return groups.groupBy(F.concat(before, F.lit("->"), now).alias("transition")).agg(F.count(F.lit(1)).alias("groups"))


def resampling(groups: DataFrame, size: str, kind: str, initial: int) -> DataFrame:
    """One row on groups that got more rollouts than at first, and whether that made them mixed."""
    more, mixed = F.col(size) > initial, F.col(kind) == "mixed"
    n = F.count(F.lit(1))
    first = F.count_if((F.col(size) == initial) & mixed)
    return groups.agg(
        first.alias("initial_mixed_groups"), share(first, n).alias("initial_mixed_group_ratio"), F.count_if(more).alias("supplemented_groups"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col(size) - initial)), F.lit(0)).alias("supplemental_episodes"),
        F.count_if(more & mixed).alias("supplemented_to_mixed_groups"),
        F.coalesce(F.try_divide(F.count_if(more & mixed), F.greatest(F.lit(1), F.count_if(more))), F.lit(0.0)).alias("supplement_rescue_ratio"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_group_size"),
    )


def group_signal(df: DataFrame, group: str, advantage: str, reward: str, rescued: str) -> DataFrame:
    """One row: groups whose advantages are all nil, rescued groups among the all-zero ones.  Keyed by group, whatever its size."""
    per = df.groupBy(group).agg(F.max(F.abs(advantage)).alias("top"), F.max(reward).alias("best"), F.bool_or(rescued).alias("saved"))
    zero = F.count_if(F.col("best") == 0)
    return per.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("top") <= 1e-12).alias("zero_advantage_groups"),
        share(F.count_if(F.col("top") <= 1e-12), F.count(F.lit(1))).alias("zero_advantage_ratio"), F.count_if(F.col("saved")).alias("rescued_groups"),
        F.count_if(F.col("saved")).cast("double").__truediv__(F.greatest(F.lit(1), zero)).alias("rescued_ratio"),
    )


def top_values(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The n most frequent values of each key with their counts; ties by value."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def error_bucket(status: Column, executable: Column, columns: Column, rows: Column) -> Column:
    """One of six classes of a wrong trajectory; an unknown executable flag counts as executable."""
    c, r = F.coalesce(columns, F.lit(False)), F.coalesce(rows, F.lit(False))
    return (
        F.when(F.coalesce(status, F.lit("")) != "submitted_sql", "no_submit")
        .when(~F.coalesce(executable, F.lit(True)), "not_executable")
        .when(~c & ~r, "col_and_row_mismatch")
        .when(~c, "column_count_mismatch")
        .when(~r, "row_count_mismatch")
        .otherwise("value_mismatch")
    )


def sample_per_bucket(df: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """The first n rows of each bucket in the order of a key."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def last_tool(turns: DataFrame, episode: str, turn: str, tool: str) -> DataFrame:
    """How many episodes end with which tool, and how many turns they took."""
    per = turns.groupBy(episode).agg(F.max_by(tool, turn).alias("last_tool"), F.count(F.lit(1)).alias("turns"))
    return per.groupBy("last_tool", "turns").agg(F.count(F.lit(1)).alias("episodes"))


def duration(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def latest(metrics: DataFrame, step: str) -> DataFrame:
    """The row with the largest step: what a status reader shows."""
    return metrics.agg(F.max_by(F.struct(*metrics.columns), step).alias("row")).select("row.*")


def progress(done: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """Rate, seconds to go and seconds a unit; null before anything is done."""
    rate = F.try_divide(done.cast("double"), elapsed)
    return {"rate": rate, "remaining_seconds": F.try_divide((total - done).cast("double"), rate), "average_seconds": F.try_divide(elapsed, done.cast("double"))}
