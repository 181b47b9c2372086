"""Evaluation summaries over orders as records, order lines as verifications, conversations as episodes."""

from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.operators import scoring as S
from quern.queries.base import query
from quern.queries.scoring import r

RATES = ["execution_accuracy", "valid_action_rate", "valid_sql_rate", "executable_sql_rate", "average_turns", "average_tool_calls", "average_tokens", "average_latency_seconds", "recovery_rate"]
RATE_SQL = """count(*) AS tasks, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS execution_accuracy,
 round(count(*) FILTER (valid_action) / count(*), 6) AS valid_action_rate, round(count(*) FILTER (valid_sql) / count(*), 6) AS valid_sql_rate,
 round(count(*) FILTER (executable_sql) / count(*), 6) AS executable_sql_rate, round(sum(turns) / count(*), 6) AS average_turns,
 round(sum(tool_calls) / count(*), 6) AS average_tool_calls, round(sum(token_count) / count(*), 6) AS average_tokens, round(sum(latency_seconds) / count(*), 6) AS average_latency_seconds,
 round(CASE WHEN count(*) FILTER (NOT first_sql_correct) = 0 THEN 0 ELSE count(*) FILTER (NOT first_sql_correct AND recovered) / count(*) FILTER (NOT first_sql_correct) END, 6) AS recovery_rate"""


@query("SELECT difficulty, count(*) AS count, count(*) FILTER (success) AS correct, round(count(*) FILTER (success) / count(*), 6) AS accuracy FROM {records} GROUP BY difficulty")
def m1_accuracy_by_difficulty(t):
    return M.accuracy(t("records"), "success", "difficulty").select("difficulty", "count", "correct", r("accuracy"))


@query("SELECT mode, failure_category, count(*) AS count FROM {records} WHERE NOT success GROUP BY ALL")
def m1_status_histogram(t):
    return M.histogram(t("records").where("not success"), "mode", "failure_category")


@query("SELECT mode, " + RATE_SQL + " FROM {records} GROUP BY mode")
def m2_summary_by_mode(t):
    return M.summarize(t("records"), "mode").select("mode", "tasks", "successes", *(r(c) for c in RATES))


@query("""SELECT CASE WHEN grouping(mode) = 0 THEN 'by_mode' WHEN grouping(difficulty) = 0 THEN 'by_difficulty' ELSE 'overall' END AS level, coalesce(mode, difficulty) AS "key", """ + RATE_SQL + " FROM {records} GROUP BY GROUPING SETS ((), (mode), (difficulty))")
def m4_rollup_summary(t):
    return M.rollup_summary(t("records")).select("level", "key", "tasks", "successes", *(r(c) for c in RATES))


def _groups(t):
    g = t("rollouts").groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("size"), F.sum("reward").cast("int").alias("current"), F.avg("reward").alias("m"), F.max("d").alias("d"))
    return g.withColumn("prior", F.when(F.col("d") < 3, F.col("d"))).withColumn("kind", S.kind_of(F.col("m")))


GROUPS = """WITH g AS (SELECT *, CASE WHEN d < 3 THEN d END AS prior, CASE WHEN m = 0 THEN 'all_zero' WHEN m = 1 THEN 'all_one' ELSE 'mixed' END AS kind
FROM (SELECT grp, count(*)::INT AS size, sum(reward)::INT AS "current", avg(reward) AS m, max(d) AS d FROM {rollouts} GROUP BY grp)) """


@query(GROUPS + """SELECT CASE WHEN prior IS NULL THEN 'unmapped' ELSE prior || '/8' END || '->' || "current" || '/' || size AS transition, count(*) AS groups FROM g GROUP BY 1""")
def m5_curriculum_transitions(t):
    return M.transitions(_groups(t), "prior", "current", 8, "size")


@query(GROUPS + """SELECT count(*) FILTER (size = 6 AND kind = 'mixed') AS initial_mixed_groups, round(count(*) FILTER (size = 6 AND kind = 'mixed') / count(*), 6) AS initial_mixed_group_ratio,
 count(*) FILTER (size > 6) AS supplemented_groups, sum(greatest(0, size - 6))::BIGINT AS supplemental_episodes, count(*) FILTER (size > 6 AND kind = 'mixed') AS supplemented_to_mixed_groups,
 round(count(*) FILTER (size > 6 AND kind = 'mixed') / greatest(1, count(*) FILTER (size > 6)), 6) AS supplement_rescue_ratio, round(avg(size), 6) AS mean_group_size FROM g""")
def m6_resampling(t):
    out = M.resampling(_groups(t), "size", "kind", 6)
    doubles = {"initial_mixed_group_ratio", "supplement_rescue_ratio", "mean_group_size"}
    return out.select(*(r(c) if c in doubles else F.col(c) for c in out.columns))


@query("""WITH a AS (SELECT grp, reward, (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 0.000001) AS adv, count(*) OVER w AS n, reward = 0 AND schema_score > 0.5 AS saved FROM {rollouts} WINDOW w AS (PARTITION BY grp)),
g AS (SELECT grp, max(abs(adv)) AS top, max(reward) AS best, bool_or(saved) AS saved FROM a WHERE n > 1 GROUP BY grp)
SELECT count(*) AS groups, count(*) FILTER (top <= 1e-12) AS zero_advantage_groups, round(count(*) FILTER (top <= 1e-12) / count(*), 6) AS zero_advantage_ratio, count(*) FILTER (saved) AS rescued_groups,
 round(count(*) FILTER (saved) / greatest(1, count(*) FILTER (best = 0)), 6) AS rescued_ratio FROM g""")
def m7_group_signal(t):
    df = S.group_advantages(t("rollouts"), "grp", "reward").withColumn("saved", (F.col("reward") == 0) & (F.col("schema_score") > 0.5))
    out = M.group_signal(df, "grp", "advantage", "reward", "saved")
    return out.select("groups", "zero_advantage_groups", r("zero_advantage_ratio"), "rescued_groups", r("rescued_ratio"))


@query("SELECT difficulty, error, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY count DESC, error) AS rank FROM (SELECT difficulty, coalesce(error, '(no_verification)') AS error, count(*) AS count FROM {verified} WHERE NOT correct GROUP BY ALL)) WHERE rank <= 5")
def m8_top_errors(t):
    wrong = t("verified").where("not correct").withColumn("error", F.coalesce("error", F.lit("(no_verification)")))
    return M.top_values(wrong, "difficulty", "error", 5)


@query("SELECT executable, column_match, row_match, value_match, count(*) AS count FROM {verified} WHERE NOT correct AND status = 'submitted_sql' GROUP BY ALL")
def m8_flag_combinations(t):
    return M.histogram(t("verified").where("not correct and status = 'submitted_sql'"), "executable", "column_match", "row_match", "value_match")


@query("SELECT last_tool, turns, count(*) AS episodes FROM (SELECT conv_id, arg_max(tool, turn) AS last_tool, count(*) AS turns FROM {turns} GROUP BY conv_id) GROUP BY ALL")
def m8_last_tool(t):
    return M.last_tool(t("turns"), "conv_id", "turn", "tool")


BUCKET = """CASE WHEN status <> 'submitted_sql' THEN 'no_submit' WHEN NOT executable THEN 'not_executable' WHEN NOT column_match AND NOT row_match THEN 'col_and_row_mismatch'
 WHEN NOT column_match THEN 'column_count_mismatch' WHEN NOT row_match THEN 'row_count_mismatch' ELSE 'value_mismatch' END"""


def _buckets(t):
    return t("verified").where("not correct").withColumn("bucket", M.error_bucket(*(F.col(c) for c in ("status", "executable", "column_match", "row_match"))))


@query(f"SELECT {BUCKET} AS bucket, count(*) AS count FROM {{verified}} WHERE NOT correct GROUP BY 1")
def m9_error_buckets(t):
    return M.histogram(_buckets(t), "bucket")


@query(f"SELECT bucket, task_id, rank FROM (SELECT task_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY task_id) AS rank FROM (SELECT task_id, {BUCKET} AS bucket FROM {{verified}} WHERE NOT correct)) WHERE rank <= 8")
def m9_bucket_samples(t):
    """Eight trajectories of each bucket, for reading: a report of that size by design."""
    return M.sample_per_bucket(_buckets(t), "bucket", "task_id", 8).select("bucket", "task_id", "rank")


@query("""SELECT event_id, event_type, strftime(to_timestamp(0) + to_seconds(event_id), '%H:%M:%S') AS elapsed FROM events ORDER BY event_id DESC LIMIT 1""")
def m10_latest_status(t):
    row = M.latest(t("events").select("event_id", "event_type"), "event_id")
    return row.withColumn("elapsed", M.duration(F.col("event_id") % 86400))


@query("""SELECT o_orderstatus AS mode, count(*) AS done, round(count(*) / sum(o_custkey)::DOUBLE, 9) AS rate, round(1000.0::DOUBLE / (count(*) / sum(o_custkey)::DOUBLE), 4) AS remaining_seconds, round(sum(o_custkey)::DOUBLE / count(*), 6) AS average_seconds FROM orders GROUP BY 1""")
def b29_progress(t):
    df = t("orders").groupBy(F.col("o_orderstatus").alias("mode")).agg(F.count(F.lit(1)).alias("done"), F.sum("o_custkey").cast("double").alias("elapsed"))
    df = df.withColumns(M.progress(F.col("done"), F.col("done") + 1000, F.col("elapsed")))
    return df.select("mode", "done", r("rate", 9), r("remaining_seconds", 4), r("average_seconds"))
