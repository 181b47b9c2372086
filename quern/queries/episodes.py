"""Evaluators' bookkeeping: conversations as episodes, their turns as stored responses."""

from pyspark.sql import functions as F

from quern.operators import episodes as E
from quern.queries.base import query
from quern.session import shared_folder

# By its number a turn is a query that runs or does not, a submission, a text without tags, a tool, or a model's failure.
RESPONSES = """SELECT conv_id, turn, k, CONCAT('SELECT ', conv_id, ' + ', turn) AS sql, CASE WHEN conv_id % 3 = 0 THEN CONCAT('SELECT ', conv_id) END AS initial_sql, conv_id % 2 = 0 AS initial_ok,
 LENGTH(text) AS prompt_tokens, turn + 1 AS completion_tokens, CASE WHEN k = 9 THEN 'no answer' END AS error, k < 3 AS executed, text
 FROM (SELECT *, (conv_id * 7 + turn * 3) % 10 AS k FROM {conversations})"""


def responses(t):
    r = t.spark.sql(RESPONSES, conversations=t("conversations"))
    k = F.col("k")
    tool = F.when(k < 5, "execute_sql").when(k == 5, "submit_sql").when(k == 6, "list_tables").otherwise("execute_sql")
    arguments = F.when(k == 6, "{}").when(k == 7, '{"sql": " "}').otherwise(F.concat(F.lit('{"sql": "'), "sql", F.lit('"}')))
    said = F.concat(F.lit("<reasoning>"), "text", F.lit('</reasoning><tool>{"name": "'), tool, F.lit('", "arguments": '), arguments, F.lit("}"), F.when(k % 2 == 0, "</tool>").otherwise(""))
    return r.withColumns({"response": F.when(k == 8, F.col("text")).otherwise(said), "finish_reason": F.lit("stop")})


def oracle(max_turns: int, tools: bool) -> str:
    """In the order of turns the first that ends an episode; what was executed before it."""
    problem = "CASE WHEN k = 8 THEN 'invalid_format' WHEN k = 7 THEN 'invalid_arguments' " + ("" if tools else "WHEN k = 6 THEN 'invalid_action' ") + "END"
    return f"""WITH r AS ({RESPONSES}), p AS (SELECT *, {problem} AS problem, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS j, (initial_sql IS NOT NULL)::INT AS i FROM r),
e AS (SELECT conv_id, min(j) FILTER (k = 9 OR k = 5 OR j - 1 + i >= {max_turns}) AS ends, count(*) AS n FROM p GROUP BY conv_id),
x AS (SELECT p.*, ends, n, k < 5 AND j < coalesce(ends, n + 1) AS ran FROM p JOIN e USING (conv_id) WHERE j <= coalesce(ends, n)),
g AS (SELECT conv_id, any_value(i) AS i, any_value(ends) AS ends, count(*) AS took, sum(prompt_tokens) FILTER (k <> 9) AS prompt_tokens, sum(completion_tokens) FILTER (k <> 9) AS completion_tokens, max(k) FILTER (j = ends) AS how, max(problem) FILTER (j = ends) AS wrong,
 max(sql) FILTER (j = ends) AS last_said, any_value(initial_sql) AS initial_sql, bool_or(initial_ok) AS initial_ok, arg_max(sql, j) FILTER (ran) AS last_sql, arg_max(sql, j) FILTER (ran AND executed) AS last_good FROM x GROUP BY conv_id)
SELECT conv_id, CASE WHEN ends IS NULL THEN 'missing_submission' WHEN how = 9 THEN 'model_error' WHEN how = 5 THEN 'submitted_sql' ELSE 'forced_submit_sql' END AS status,
 (i + took + CASE WHEN ends IS NOT NULL AND how NOT IN (5, 9) THEN 1 ELSE 0 END)::INT AS turns,
 CASE WHEN ends IS NULL OR how = 9 THEN NULL WHEN how < 6 THEN last_said ELSE coalesce(last_good, CASE WHEN initial_ok THEN initial_sql END, last_sql, initial_sql, 'SELECT NULL WHERE FALSE') END AS final_sql,
 CASE WHEN ends IS NOT NULL AND how NOT IN (5, 9) THEN coalesce(wrong, 'wrong_tool_on_final_turn') END AS reason, coalesce(prompt_tokens, 0)::BIGINT AS prompt_tokens, coalesce(completion_tokens, 0)::BIGINT AS completion_tokens FROM g"""


TOLD = ("conv_id", "status", "turns", "final_sql", "reason", "prompt_tokens", "completion_tokens")


@query(oracle(3, False))
def z7_single_tool(t):
    """The evaluator with one tool besides the submission, three exploratory calls."""
    return E.evaluated(responses(t), max_turns=3).select(*TOLD)


@query(oracle(4, True))
def z7_all_tools(t):
    """The one that explores by all tools, four calls."""
    return E.evaluated(responses(t), max_turns=4, tools=E.ALL_TOOLS).select(*TOLD)


@query(oracle(3, False))
def z7_stream(t):
    """The same from a stream that is stopped after its first files and goes on."""
    base = shared_folder(t.spark, "episodes")
    r = responses(t)
    for part in (r.where("turn < 3"), r.where("turn >= 3")):
        part.write.mode("append").parquet(f"{base}/in")
        source = t.spark.readStream.schema(r.schema).parquet(f"{base}/in")

        def keep(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

        E.evaluated_stream(source, max_turns=3).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    told = t.spark.read.parquet(f"{base}/out")
    return told.groupBy("conv_id").agg(F.max_by(F.struct(*TOLD[1:]), "batch").alias("x")).select("conv_id", "x.*")


@query("WITH r AS (" + RESPONSES + """) SELECT 'model ' || conv_id % 3 AS model, count(*) AS calls, count(error) AS failures, sum(CASE WHEN error IS NULL THEN prompt_tokens ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN error IS NULL THEN completion_tokens ELSE 0 END)::BIGINT AS completion_tokens,
 sum(turn / 4)::DOUBLE AS seconds, max(turn / 4)::DOUBLE AS slowest, max(j)::BIGINT AS longest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS j FROM r) GROUP BY 1""")
def z32_call_log(t):
    """Calls of three models: usage, failures and times."""
    log = E.call_log(responses(t), "conv_id", "turn", F.concat(F.lit("model "), F.col("conv_id") % 3), F.col("turn") / 4)
    longest = log.groupBy("model").agg(F.max("call").alias("longest"))
    return E.call_totals(log, "model").join(longest, "model")
