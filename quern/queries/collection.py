"""Collection operators over documents as tasks and conversations as episodes."""

from pyspark.sql import functions as F

from quern.operators import collection as C
from quern.queries.base import query
from quern.queries.datasets import h


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS shown, n > 5 AS has_more, CASE WHEN n <= 5 THEN n END AS total_row_count FROM r WHERE p <= 5 GROUP BY user_id, n""")
def g5_tool_result(t):
    out = C.tool_result(t("events"), "user_id", "event_id", "event_type", 5)
    return out.select("user_id", F.array_join("shown", ",").alias("shown"), "has_more", "total_row_count")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS r, count(*) FILTER (event_type <> 'view') AS k FROM events GROUP BY user_id), x AS (SELECT *, greatest(10 + 4 * r + 3 * k - 40, 0) AS over FROM c)
SELECT user_id, greatest(4 * r - over, 0) // 4 AS rows_kept, greatest(3 * k - greatest(over - 4 * r, 0), 0) // 3 AS columns_kept, over > 4 * r + 3 * k AS minimal FROM x""")
def g6_limit_observation(t):
    n = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("r"), F.count_if(F.col("event_type") != "view").alias("k"))
    costs = {"rows": F.array_repeat(F.lit(4), F.col("r").cast("int")), "columns": F.array_repeat(F.lit(3), F.col("k").cast("int"))}
    out = n.withColumn("x", C.limit_observation(costs, F.lit(10), 40))
    return out.select("user_id", F.col("x.rows").cast("long").alias("rows_kept"), F.col("x.columns").cast("long").alias("columns_kept"), "x.minimal")


@query("SELECT count(*) AS outside FROM {tasks} WHERE task_id % 10 = 0")
def g17_split_guard(t):
    tasks = t("tasks").withColumn("split", F.when(F.col("task_id") % 10 == 0, "external_dev").otherwise("train"))
    return C.only_train(tasks).agg(F.count(F.lit(1)).alias("outside"))


@query("SELECT task_id, db_id FROM {tasks} ORDER BY task_id LIMIT 25")
def g18_first_tasks(t):
    """The first tasks in order: a limit that is the feature."""
    return t("tasks").select("task_id", "db_id").orderBy("task_id").limit(25)


PLAN = f"""WITH done AS (SELECT id AS task_id, task AS difficulty FROM {{attempts}} WHERE won = 1), q(difficulty, target) AS (VALUES ('en', 300), ('de', 90), ('fr', 100)),
n AS (SELECT q.difficulty, greatest(0, target - coalesce(k, 0)) AS missing FROM q LEFT JOIN (SELECT difficulty, count(*) AS k FROM done GROUP BY 1) USING (difficulty)),
p AS (SELECT task_id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY CASE WHEN difficulty = 'en' THEN {h(20021)} ELSE {h(20022)} END, task_id) AS place FROM {{tasks}} WHERE task_id NOT IN (SELECT task_id FROM done))
SELECT task_id, difficulty, place FROM p JOIN n USING (difficulty) WHERE place <= missing"""


@query(PLAN)
def z21_attempt_plan(t):
    done = t("attempts").where("won = 1").select(F.col("id").alias("task_id"), F.col("task").alias("difficulty"))
    return C.attempt_plan(t("tasks").drop("question"), done, {"en": 300, "de": 90, "fr": 100}, 7, 2).select("task_id", "difficulty", "place")


@query("SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'now' ELSE 'before' END AS run FROM {tasks} WHERE task_id % 3 = 0 OR task_id % 2 = 0")
def z22_bootstrap(t):
    k = t("tasks").select("task_id")
    return C.bootstrap(k.where("task_id % 3 = 0").withColumn("run", F.lit("now")), k.where("task_id % 2 = 0").withColumn("run", F.lit("before")), "task_id")


@query("SELECT count(*) FILTER (task_id % 4 <> 1) AS usable, count(*) FILTER (task_id % 4 = 1) AS missing FROM {tasks}")
def z9_initial_sql(t):
    k = t("tasks").select("task_id")
    stored = k.where("task_id % 8 <> 1").withColumn("sql", F.when(F.col("task_id") % 4 == 1, " ").otherwise("SELECT 1"))
    good, bad = C.initial_sql(k, stored)
    return good.agg(F.count(F.lit(1)).alias("usable")).join(bad.agg(F.count(F.lit(1)).alias("missing")))


@query("SELECT task_id, CASE WHEN task_id % 5 = 0 THEN 'boundary' END AS selection_source, CASE WHEN task_id % 5 = 0 THEN task_id % 9 END AS prior_correct_count FROM {tasks}")
def z15_metadata(t):
    k = t("tasks").select("task_id")
    meta = k.where("task_id % 5 = 0").withColumns({"selection_source": F.lit("boundary"), "prior_correct_count": F.col("task_id") % 9})
    return C.with_metadata(k, meta)


@query("SELECT task_id, CASE WHEN task_id % 5 > 0 THEN 'left' ELSE 'right' END AS side FROM {tasks} WHERE (task_id % 5 > 0) <> (task_id % 3 > 0)")
def z15_id_mismatches(t):
    k = t("tasks").select("task_id")
    return C.id_mismatches(k.where("task_id % 5 > 0"), k.where("task_id % 3 > 0"), "task_id")


@query("SELECT id, CASE difficulty WHEN 'easy' THEN 6 WHEN 'medium' THEN 7 WHEN 'hard' THEN 9 ELSE 10 END AS turn_limit FROM {leveled}")
def z17_turn_limit(t):
    return t("leveled").select("id", C.turn_limit(F.col("difficulty"), True, 10).alias("turn_limit"))


@query("SELECT difficulty, count(*) AS successes, sum(CASE WHEN first THEN 1 ELSE 0 END)::BIGINT AS databases FROM (SELECT task AS difficulty, row_number() OVER (PARTITION BY task, db_id ORDER BY id) = 1 AS first FROM {attempts} WHERE won = 1) GROUP BY 1")
def z24_successes_by_difficulty(t):
    won = t("attempts").where("won = 1")
    return won.groupBy(F.col("task").alias("difficulty")).agg(F.count(F.lit(1)).alias("successes"), F.countDistinct("db_id").alias("databases"))


@query("SELECT conv_id, turn FROM {turns} WHERE conv_id NOT IN (SELECT conv_id FROM {turns} WHERE turn > 0 AND length(text) % 13 = 0)")
def z25_trainable_turns(t):
    df = t("turns").withColumn("prefix", F.when(F.col("turn") > 0, F.char_length("text") % 13))
    return C.trainable(df, "conv_id", "turn", "prefix").select("conv_id", "turn")


@query("""WITH p AS (SELECT grp, bool_or(reward = 0 AND schema_score > 0.8) AS saved, max(reward) AS best FROM {rollouts} GROUP BY grp), g AS (SELECT count(*) AS groups, count(*) FILTER (saved) AS rescued_groups, count(*) FILTER (best = 0) AS all_zero_groups FROM p)
SELECT round(avg(schema_score), 4) AS mean_schema_score, round(avg((turns > 1)::INT), 4) AS candidate_coverage, round(avg((turns > 2)::INT), 4) AS parse_rate, round(avg(reward + (1 - reward) * 0.05 * schema_score), 4) AS mean_diagnostic,
 any_value(groups) AS groups, any_value(rescued_groups) AS rescued_groups, any_value(all_zero_groups) AS all_zero_groups, round(any_value(rescued_groups / greatest(1, all_zero_groups)), 4) AS rescued_ratio FROM {rollouts}, g""")
def m7_schema_metrics(t):
    d = t("rollouts").withColumns({"rescued": (F.col("reward") == 0) & (F.col("schema_score") > 0.8), "available": F.col("turns") > 1, "parsed": F.col("turns") > 2, "diagnostic": F.col("reward") + (1 - F.col("reward")) * 0.05 * F.col("schema_score")})
    out = C.schema_metrics(d, "grp")
    exact = {"groups", "rescued_groups", "all_zero_groups"}
    return out.select(*(F.col(c) if c in exact else F.round(c, 4).alias(c) for c in out.columns))
