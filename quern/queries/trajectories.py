"""Episodes: conversations as turn tables, labelled documents as attempts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.protocol import EXTERNAL_REFERENCE
from quern.operators import trajectories as T
from quern.queries.base import query
from quern.sources import memory_store as M

TURNS = """tt AS (SELECT *, length(text) % 2 = 0 AS ok, CASE WHEN length(text) % 7 = 0 THEN 'turn_budget' END AS error, 1 + length(text) // 4 AS cost, CASE WHEN turn % 2 = 1 THEN 5 ELSE 0 END AS n_ids FROM {turns}) """


def turns(t):
    n = F.char_length("text")
    return t("turns").withColumns({"ok": n % 2 == 0, "error": F.when(n % 7 == 0, "turn_budget"), "cost": (1 + F.floor(n / 4)).cast("long"), "n_ids": F.when(F.col("turn") % 2 == 1, 5).otherwise(0)})


@query("WITH " + TURNS + """, a AS (SELECT *, row_number() OVER w AS turn_no, sum(cost) OVER w AS used FROM tt WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, turn_no, used::BIGINT AS used, CASE WHEN turn_no > 4 OR max((used > 500)::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'finalised' WHEN turn_no = 4 THEN 'reserved' ELSE 'open' END AS state FROM a""")
def g13_episode_budget(t):
    return T.episode_budget(turns(t), 4, 500).select("conv_id", "turn", "turn_no", "used", "state")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM {turns} GROUP BY conv_id")
def g14_transcript(t):
    return T.transcript(t("turns"))


@query("SELECT conv_id, turn, text || chr(10) || '[' || (10 - turn) || ' of 10 rounds remain]' AS text FROM {turns}")
def z8_remaining_rounds(t):
    from quern.functions.protocol import remaining_rounds

    return t("turns").select("conv_id", "turn", remaining_rounds(F.col("text"), F.col("turn"), 10).alias("text"))


@query("""SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (keep), '') AS transcript FROM (SELECT *, NOT (turn = max(turn) OVER (PARTITION BY conv_id) AND role <> 'assistant') AS keep FROM {turns}) GROUP BY conv_id""")
def z29_public_messages(t):
    return T.transcript(t("turns"), drop_last=True)


# A conversation is an episode; by its number one thing or another is wrong with it, and its texts are the reasoning.
STEPS = """SELECT *, CASE WHEN turn = lo AND conv_id % 7 > 0 THEN 'list_tables' WHEN turn = hi AND conv_id % 11 > 0 THEN 'submit_sql' ELSE 'execute_sql' END AS tool,
 concat('SELECT ', conv_id, CASE WHEN conv_id % 4 = 0 AND turn < hi THEN ' + 1' ELSE '' END) AS sql, CASE WHEN conv_id % 5 = 0 AND turn = hi - 1 THEN 'error' ELSE 'success' END AS status,
 concat(text, CASE WHEN conv_id % 13 = 0 AND turn = lo + 1 THEN ' as the Gold SQL shows' WHEN conv_id % 3 = 0 THEN ' what is the expected result of the join' ELSE '' END) AS reasoning,
 concat('rows ', turn) AS observation, concat('rows ', CASE WHEN conv_id % 29 = 0 AND turn = lo THEN 99 ELSE turn END) AS replayed
FROM (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM {conversations})"""

PHRASES = "(?i)" + "|".join(EXTERNAL_REFERENCE).replace("'", "''")
RULES = "s AS (" + STEPS + "), " + f"""r AS (SELECT conv_id, count(*) AS n, conv_id % 2 = 0 AS anew, arg_min(tool, turn) AS first_tool, arg_max(tool, turn) AS last_tool, bool_or(regexp_matches(reasoning, '{PHRASES}')) AS external, bool_or(tool = 'submit_sql' AND turn < hi) AS premature,
 bool_or(ran) AS executed, coalesce(arg_max(ran, turn) FILTER (turn < hi), FALSE) AS right_before FROM (SELECT *, tool = 'execute_sql' AND status = 'success' AND turn < hi AND conv_id % 4 > 0 AS ran FROM s) GROUP BY conv_id),
x AS (SELECT conv_id, CASE WHEN conv_id % 9 = 0 OR conv_id % 37 = 0 THEN 'wrong_split' WHEN conv_id % 41 = 0 THEN 'task_mismatch' WHEN anew AND (conv_id % 43 = 0 OR conv_id % 47 = 0) THEN 'partly_regenerated' WHEN conv_id % 31 = 0 THEN 'turn_mismatch'
 WHEN conv_id % 17 = 0 THEN 'teacher_text' WHEN conv_id % 53 = 0 THEN 'reference_failed' WHEN conv_id % 19 = 0 THEN 'response_mismatch' WHEN external THEN 'external_reference' WHEN first_tool <> 'list_tables' THEN 'wrong_first_tool' WHEN last_tool <> 'submit_sql' OR n < 2 THEN 'no_submission'
 WHEN premature THEN 'premature_submission' WHEN anew AND NOT right_before THEN 'not_executed_right_before' WHEN NOT executed THEN 'not_executed' WHEN conv_id % 23 = 0 THEN 'final_sql_mismatch' WHEN anew AND conv_id % 59 = 0 THEN 'not_the_reference' WHEN conv_id % 29 = 0 THEN 'observation_mismatch'
 WHEN conv_id % 61 = 0 THEN 'not_verified' END AS reason FROM r) """


def reviewed(t):
    """(conv_id, reason): the first rule of curation that an episode breaks."""
    steps = t.spark.sql(STEPS, conversations=t("conversations"))
    arguments = F.when(F.col("tool") == "list_tables", "{}").otherwise(F.concat(F.lit('{"sql": "'), "sql", F.lit('"}')))
    said = F.concat(F.lit("<reasoning>"), "reasoning", F.lit('</reasoning>\n<tool>{"name": "'), "tool", F.lit('", "arguments": '), arguments, F.lit("}</tool>"))
    n = F.col("conv_id")
    steps = steps.withColumns({"response": said, "arguments": arguments, "prompt": F.when(n % 17 == 0, "see <teacher_only_sql>").otherwise("go on")})
    facts = T.turn_facts(steps.withColumn("tool", F.when(n % 19 == 0, "inspect_tables").otherwise(F.col("tool"))))
    sql = F.concat(F.lit("SELECT "), n)
    records = facts.withColumns({
        "split": F.when(n % 9 == 0, "external_dev").otherwise("train"), "correct": n % 37 != 0, "question": F.lit("q"), "task_question": F.when(n % 41 == 0, "other").otherwise("q"), "db_id": F.lit(1), "task_db_id": F.lit(1),
        "messages": 2 * F.col("turns") + 1 + (n % 31 == 0).cast("int"), "reference_ok": n % 53 != 0, "final_sql": F.when(n % 23 == 0, "SELECT 0").otherwise(sql), "reference_sql": F.when(n % 59 == 0, "SELECT 0").otherwise(sql), "final_ok": n % 61 != 0,
        "regenerated": n % 2 == 0, "generation_mode": F.when(n % 43 == 0, "continuation").otherwise("full_regeneration_from_question"), "leak_audit": F.lit("accept"), "eligible": n % 47 != 0,
    })
    return records.select("conv_id", T.first_broken(T.curation_rules()).alias("reason"))


@query("WITH " + RULES + "SELECT conv_id, reason FROM x")
def b16_curation_rules(t):
    return reviewed(t).select("conv_id", "reason")


@query("WITH " + RULES + """, b AS (SELECT conv_id % 60 AS task, conv_id, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END AS priority, CASE WHEN conv_id % 4 = 0 THEN reason END AS reason FROM x),
k AS (SELECT task, arg_min(conv_id, priority * 1000000000 + conv_id) AS conv_id, min(priority) AS priority FROM b WHERE reason IS NULL GROUP BY task) SELECT * FROM k""")
def b17_curate(t):
    df = reviewed(t).select((F.col("conv_id") % 60).alias("task"), "conv_id", F.when(F.col("conv_id") % 4 == 0, F.col("reason")).alias("reason"))
    one = df.where("conv_id % 5 = 0").groupBy("task", "reason").agg(F.min("conv_id").alias("conv_id"))
    two = df.where("conv_id % 5 <> 0").groupBy("task", "reason").agg(F.min("conv_id").alias("conv_id"))
    kept, _ = T.curate(one, two, "task")
    return kept.select("task", "conv_id", "priority")


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN len(regexp_split_to_array(trim(text), '\\s+')) ELSE 0 END)::BIGINT AS assistant_tokens, count(*) FILTER (tool = 'execute_sql') AS tool_calls, len(list_slice(list(text ORDER BY turn) FILTER (role = 'assistant'), 1, 3)) AS n_excerpts FROM {turns} GROUP BY conv_id")
def b18_profile(t):
    p = T.profile(t("turns"))
    return p.select("conv_id", "assistant_tokens", "tool_calls", F.when(F.size("excerpts") > 0, F.size("excerpts").cast("long")).alias("n_excerpts"))


@query("SELECT id, size - 1000 AS size_difference, round(size / 1000, 6) AS size_ratio FROM {attempts}")
def b18_comparison(t):
    c = T.comparison(F.lit(1000), F.col("size"), "size")
    return t("attempts").select("id", c["size_difference"].cast("long").alias("size_difference"), F.round(c["size_ratio"], 6).alias("size_ratio"))


@query("""WITH a AS (SELECT *, min(CASE WHEN won = 1 THEN id END) OVER (PARTITION BY task, db_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, min(CASE WHEN won = 1 THEN id END) OVER (PARTITION BY task, db_id) AS first FROM {attempts})
SELECT task, db_id, coalesce(nxt, first) AS chosen, id AS rejected FROM a WHERE won = 0 AND coalesce(nxt, first) IS NOT NULL""")
def b19_preference_pairs(t):
    return T.preference_pairs(t("attempts"))


@query("""WITH a AS (SELECT *, min(CASE WHEN won = 1 THEN id END) OVER (PARTITION BY task) AS chosen FROM {attempts}) SELECT coalesce(CASE WHEN size % 5 = 0 THEN 'question_mismatch' WHEN size % 3 = 0 THEN 'leak' WHEN size % 2 = 0 THEN 'same_first_step' END, 'kept') AS reason, count(*) AS pairs FROM a WHERE won = 0 GROUP BY 1""")
def b20_pair_reasons(t):
    lost = t("attempts").where("won = 0")
    why = T.pair_reason(F.col("size") % 5 != 0, F.lit(True), F.col("won") == 1, F.col("size") % 3 == 0, F.col("size") % 2 != 0)
    return lost.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT id, task FROM (SELECT *, row_number() OVER (ORDER BY sha256('17:' || id::VARCHAR), id) AS r FROM {attempts} WHERE won = 0) WHERE r <= 20")
def b21_pilot_sample(t):
    """A seeded sample of twenty failures: a sampling operator, so that its size is the feature."""
    from quern.operators.datasets import seeded

    return t("attempts").where("won = 0").orderBy(seeded(17, "id"), "id").limit(20).select("id", "task")


@query("SELECT won, count(*) AS count, sum(size)::BIGINT AS usage, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM {attempts} GROUP BY won")
def b22_outcome_report(t):
    return T.outcome_report(t("attempts"), "won", "size").select("won", "count", "usage", F.round("rate", 6).alias("rate"))


@query("SELECT task, kind, sum(tokens)::BIGINT AS tokens FROM (SELECT task, 'prompt' AS kind, size AS tokens FROM {attempts} UNION ALL SELECT task, 'completion', size // 4 FROM {attempts}) GROUP BY ALL")
def b22_usage_totals(t):
    usage = F.create_map(F.lit("prompt"), F.col("size"), F.lit("completion"), F.floor(F.col("size") / 4).cast("long"))
    return T.usage_totals(t("attempts").withColumn("usage", usage), "usage", "task")


@query("SELECT a.id FROM {attempts} a WHERE won = 0 AND a.id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def b23_recovery_selection(t):
    fine = t("labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    return t("attempts").where("won = 0").join(fine, "id", "left_semi").select("id")


@query("WITH " + TURNS + "SELECT conv_id, arg_min(text, turn) FILTER (tool = 'execute_sql' AND error IS NULL) AS first_sql FROM tt GROUP BY conv_id")
def b24_first_executed(t):
    return T.first_executed(turns(t))


ROUND = """s AS (SELECT doc_id AS memory_id, l.quality = 1 AS initial_ok, d.n_chars % 3 > 0 AS retry_ok, d.n_chars % 5 > 0 AS submitted, d.n_chars % 7 > 0 AS verified, CASE WHEN d.n_chars % 11 = 0 THEN 'timeout' END AS error FROM documents d JOIN labels l USING (doc_id)),
m AS (SELECT *, NOT initial_ok AND retry_ok AND submitted AND verified AND error IS NULL AS admitted, memory_id % 4 = 0 AS old FROM s) """


def memory_tasks(t):
    n = F.col("n_chars")
    return t("documents").join(t("labels"), "doc_id").select(
        F.col("doc_id").alias("memory_id"), (F.col("quality") == 1).alias("initial_ok"), (n % 3 > 0).alias("retry_ok"), (n % 5 > 0).alias("submitted"), (n % 7 > 0).alias("verified"), F.when(n % 11 == 0, "timeout").alias("error")
    )


@query("WITH " + ROUND + """SELECT count(*) AS tasks, count(*) FILTER (initial_ok) AS initially_correct, count(*) FILTER (NOT initial_ok) AS eligible, count(*) FILTER (NOT initial_ok AND retry_ok) AS retried_correct, count(*) FILTER (admitted) AS admitted,
 count(*) FILTER (admitted AND old) AS already_stored, count(*) FILTER (admitted AND NOT old) AS appended, count(*) FILTER (NOT initial_ok AND NOT admitted) AS rejected FROM m""")
def b25_memory_round(t):
    tasks = memory_tasks(t)
    return T.memory_round(tasks, tasks.where("memory_id % 4 = 0").select("memory_id"))[1]


@query("WITH " + ROUND + "SELECT memory_id FROM m WHERE admitted AND NOT old")
def b26_admitted(t):
    tasks = memory_tasks(t)
    return T.memory_round(tasks, tasks.where("memory_id % 4 = 0").select("memory_id"))[0].select("memory_id")


@query("WITH " + TURNS + "SELECT conv_id, turn, error IS NULL AND (turn % 2 = 0 OR (tool = 'execute_sql' AND ok)) AS supervised FROM tt")
def b27_supervise(t):
    return turns(t).select("conv_id", "turn", T.supervise(F.col("error"), F.col("turn") % 2 != 0, F.col("tool"), F.col("ok")).alias("supervised"))


@query("SELECT task, count(*) AS attempts, count(*) FILTER (won = 1) AS successes, sum(size)::BIGINT AS tokens, count(DISTINCT db_id) AS databases FROM {attempts} GROUP BY task")
def b28_collection_summary(t):
    return t("attempts").groupBy("task").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("won") == 1).alias("successes"), F.sum("size").alias("tokens"), F.countDistinct("db_id").alias("databases"))


@query("SELECT task_id FROM {tasks} WHERE task_id NOT IN (SELECT doc_id FROM labels)")
def b31_pending(t):
    return T.pending(t("tasks").select("task_id"), t("labels").select(F.col("doc_id").alias("task_id")), "task_id")


@query("SELECT id, (list_sum([CASE WHEN i >= 4 AND (id + i) % 5 <> 0 THEN 1 ELSE 0 END FOR i IN range(1, 10)]))::BIGINT AS trained FROM {rollouts}")
def b32_turn_masks(t):
    ids = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("id") + i) % 5).cast("int"))
    mask = T.turn_masks(F.lit(4), ids, [0])
    return t("rollouts").select("id", F.size(F.filter(mask, lambda x: x)).cast("long").alias("trained"))


@query("""SELECT conv_id, min(turn) AS first_mismatch, count(*) AS mismatches FROM {turns} WHERE length(text) % 5 = 0 GROUP BY conv_id""")
def v11_replay(t):
    log = t("turns").withColumn("observation", F.md5("text"))
    again = t("turns").withColumn("observation", F.md5(F.when(F.char_length("text") % 5 == 0, "other").otherwise(F.col("text"))))
    return T.replay_mismatches(log, again)


AUDIT = "WITH " + TURNS + """, p AS (SELECT conv_id, arg_min(ok, turn) FILTER (tool = 'execute_sql') AS first_ok, arg_max(ok, turn) FILTER (tool = 'execute_sql') AS last_ok, coalesce(bool_or(ok) FILTER (tool = 'execute_sql'), FALSE) AS any_ok,
 count(*) FILTER (tool = 'execute_sql') AS calls, count(DISTINCT text) FILTER (tool = 'execute_sql') AS distinct_calls, count(*) AS turns FROM tt GROUP BY conv_id),
f AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 6 > 0 THEN 'x' END AS final_sql, conv_id % 3 = 0 AS strict, conv_id % 2 = 0 AS loose FROM {turns}),
x AS (SELECT f.*, coalesce(first_ok, strict) AS first_ok, coalesce(last_ok, strict) AS last_ok, any_ok, calls, distinct_calls, turns FROM f JOIN p USING (conv_id)) """


@query(AUDIT + """SELECT count(*) AS total, count(*) FILTER (strict) AS strict_final, count(*) FILTER (loose) AS loose_final, count(*) FILTER (first_ok) AS first_correct, count(*) FILTER (last_ok) AS last_correct, count(*) FILTER (any_ok OR strict) AS any_correct,
 count(*) FILTER (any_ok AND NOT strict) AS intermediate_right_final_wrong, count(*) FILTER (first_ok AND NOT strict) AS first_right_final_wrong, count(*) FILTER (NOT first_ok AND strict) AS first_wrong_final_right, count(*) FILTER (final_sql IS NULL) AS missing_final,
 count(*) FILTER (final_sql IS NULL AND any_ok) AS missing_final_with_right, count(*) FILTER (calls >= 3) AS many_calls, count(*) FILTER (calls >= 2 AND distinct_calls = 1) AS identical_calls, sum(turns)::BIGINT AS turns, count(*) FILTER (loose AND NOT strict) AS scorer_gained, count(*) FILTER (strict AND NOT loose) AS scorer_lost FROM x""")
def v12_audit(t):
    finals = t("turns").select("conv_id").distinct().withColumns({"final_sql": F.when(F.col("conv_id") % 6 > 0, "x"), "strict": F.col("conv_id") % 3 == 0, "loose": F.col("conv_id") % 2 == 0})
    return T.audit_counts(turns(t), finals)


@query("SELECT a AS left_ok, b AS right_ok, count(*) AS tasks FROM (SELECT task_id, task_id % 3 = 0 AS a, task_id % 2 = 0 AS b FROM {tasks}) GROUP BY ALL")
def v12_contingency(t):
    k = t("tasks").select("task_id")
    return T.contingency(k.withColumn("ok", F.col("task_id") % 3 == 0), k.withColumn("ok", F.col("task_id") % 2 == 0), "task_id", "ok")


@query("SELECT conv_id, arg_max(text, turn) FILTER (tool = 'execute_sql') AS candidate_sql, CASE WHEN count(*) FILTER (tool = 'execute_sql') = 0 THEN 'none' ELSE 'execute_sql' END AS source FROM {turns} GROUP BY conv_id")
def z2_last_candidate(t):
    return T.last_candidate(t("turns"))


@query("WITH " + TURNS + "SELECT conv_id, max(turn) AS final_turn FROM (SELECT tt.*, f.text AS final_sql FROM tt JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM tt GROUP BY conv_id) f ON tt.conv_id = f.conv_id) WHERE text = final_sql AND n_ids > 0 GROUP BY conv_id")
def z3_final_turn(t):
    df = turns(t)
    return T.final_turn(df, df.groupBy("conv_id").agg(F.max_by("text", "turn").alias("final_sql")))


LAST = "l AS (SELECT conv_id, arg_max(text, turn) FILTER (tool = 'submit_sql' AND length(text) % 3 = 0) AS submitted, arg_max(text, turn) FILTER (tool = 'execute_sql') AS last, arg_max(text, turn) FILTER (tool = 'execute_sql' AND ok) AS good FROM tt GROUP BY conv_id) "


def lasts(t):
    df = turns(t)
    pick = lambda c: F.max_by(F.when(c, F.col("text")), F.when(c, F.col("turn")))
    ran = F.col("tool") == "execute_sql"
    return df.groupBy("conv_id").agg(pick((F.col("tool") == "submit_sql") & (F.char_length("text") % 3 == 0)).alias("submitted"), pick(ran).alias("last"), pick(ran & F.col("ok")).alias("good"))


@query("WITH " + TURNS + ", " + LAST + "SELECT conv_id, coalesce(submitted, last) AS final_sql, CASE WHEN submitted IS NOT NULL THEN 'submitted' WHEN last IS NOT NULL THEN 'forced' ELSE 'missing_submission' END AS status FROM l")
def z5_forced_submission(t):
    return lasts(t).withColumns(T.forced_submission(F.col("submitted"), F.col("last"))).select("conv_id", "final_sql", "status")


@query("WITH " + TURNS + ", " + LAST + "SELECT conv_id, coalesce(submitted, good, last, 'SELECT NULL WHERE FALSE') AS final_sql, CASE WHEN submitted IS NOT NULL THEN 'proposed' WHEN good IS NOT NULL THEN 'last_successful' WHEN last IS NOT NULL THEN 'last' ELSE 'empty' END AS fallback FROM l")
def z6_fallback(t):
    return lasts(t).withColumns(T.fallback(F.col("submitted"), F.col("good"), F.col("last"))).select("conv_id", "final_sql", "fallback")


@query("SELECT task_id, mode FROM {tasks} CROSS JOIN (VALUES ('single_full_schema'), ('single_no_schema'), ('multi_turn'), ('single_oracle_tables')) m(mode)")
def z11_run_modes(t):
    return T.run_modes(t("tasks").select("task_id"))


@query("WITH " + TURNS + "SELECT conv_id, arg_min(ok, turn) AS first_correct, arg_max(ok, turn) AS final_correct, arg_max(ok, turn) AND NOT arg_min(ok, turn) AS recovered FROM tt WHERE tool = 'execute_sql' GROUP BY conv_id")
def z12_recovery(t):
    return T.recovery(turns(t).where("tool = 'execute_sql'"), "conv_id", "turn", "ok")


@query("SELECT id, CASE WHEN won = 1 THEN NULL WHEN size % 2 = 0 THEN 'no_final_sql' ELSE 'incorrect_final_sql' END AS reason FROM {attempts}")
def z20_failure_reason(t):
    return t("attempts").select("id", T.failure_reason(F.col("won") == 1, F.col("size") % 2 != 0).alias("reason"))


@query("SELECT conv_id, turn, greatest(0, m - n) AS pads, least(n, 20) AS attended FROM (SELECT conv_id, turn, n, max(n) OVER (PARTITION BY conv_id) AS m FROM (SELECT conv_id, turn, least(length(text) // 10, 20) AS n FROM {turns}))")
def z26_padding(t):
    n = F.least(F.floor(F.char_length("text") / 10), F.lit(20)).cast("int")
    ids = F.slice(F.sequence(F.lit(1), F.lit(20)), 1, n)
    df = t("turns").withColumn("ids", ids)
    df = df.withColumn("longest", F.max(F.size("ids")).over(Window.partitionBy("conv_id")))
    p = T.padded(F.col("ids"), F.col("longest"), 0)
    return df.select("conv_id", "turn", F.size(F.filter(p["input_ids"], lambda x: x == 0)).cast("long").alias("pads"), F.aggregate(p["attention"], F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


@query("SELECT id, round(cur0 + CASE WHEN keep1 THEN cur1 ELSE 0 END, 6) AS loss FROM {token_rows}")
def z27_masked_sum(t):
    from quern.operators.scoring import masked_sum

    return t("token_rows").select("id", F.round(masked_sum(F.array("cur0", "cur1"), F.array(F.lit(True), F.col("keep1"))), 6).alias("loss"))


@query("SELECT count(*) AS total, count(*) FILTER (id % 3 = 0) AS already, count(*) FILTER (id % 3 > 0 AND id % 2 = 0) AS filled, count(*) FILTER (id % 3 > 0 AND id % 2 > 0) AS missing FROM {corpus}")
def s12_backfill(t):
    store = t("corpus").select(F.col("id").cast("string").alias("memory_id"), F.when(F.col("id") % 3 == 0, "SELECT 1").alias("sql_first_execute"))
    found = t("corpus").where("id % 2 = 0").select(F.col("id").cast("string").alias("memory_id"), F.lit("SELECT 2").alias("first_sql"))
    return M.backfill(store, found)[1]


@query("SELECT count(*) AS appended, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT id, 100 + row_number() OVER (ORDER BY id) AS seq FROM {corpus} WHERE id >= 100)")
def s11_append(t):
    """A round's records against a store of the first hundred: only new ids get numbers, on from the last."""
    rows = t("corpus").select(F.col("id").cast("string").alias("memory_id"), F.col("id"), F.substring("text", 1, 20).alias("question"))
    store = rows.where("id < 100").select("memory_id", (F.col("id") + 1).alias("seq"))
    new = M.new_rows(store, rows.withColumn("seq", F.lit(0)))
    return new.agg(F.count(F.lit(1)).alias("appended"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
