"""Episodes as turn tables: bookkeeping, replay, curation, preference pairs, memory admission, audits.

A turn table has a row for each turn; an episode's turns meet in one window or one aggregate by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.protocol import TEACHER_TAG, external_reference, parse_response

#: Tool errors that spend no query: they do not count as a first execution.
BUDGET_ERRORS = ("turn_budget", "context_budget")
FALLBACK_SQL = "SELECT NULL WHERE FALSE"


def episode_budget(turns: DataFrame, max_turns: int, max_tokens: int, episode: str = "conv_id", turn: str = "turn", cost: str = "cost") -> DataFrame:
    """turns with turn_no, used, state: open, reserved (only a submission may follow) or finalised (past the end).

    The environment keeps the last turn for a submission; an episode whose context is spent is finalised.
    """
    w = Window.partitionBy(episode).orderBy(turn)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = turns.withColumns({"turn_no": F.row_number().over(w), "used": F.sum(cost).over(running)})
    over = F.max((F.col("used") > max_tokens).cast("int")).over(running)
    state = F.when((F.col("turn_no") > max_turns) | (over == 1), "finalised").when(F.col("turn_no") == max_turns, "reserved").otherwise("open")
    return df.withColumn("state", state)


def first_executed(turns: DataFrame, episode: str = "conv_id", turn: str = "turn", tool: str = "tool", sql: str = "text", error: str = "error") -> DataFrame:
    """The first executed SQL of each episode; refusals for lack of budget do not count, nor does the submission."""
    ran = (F.col(tool) == "execute_sql") & ~F.coalesce(F.col(error).isin(*BUDGET_ERRORS), F.lit(False))
    return turns.groupBy(episode).agg(F.min_by(F.when(ran, F.col(sql)), F.when(ran, F.col(turn))).alias("first_sql"))


def last_candidate(turns: DataFrame, episode: str = "conv_id", turn: str = "turn", tool: str = "tool", sql: str = "text") -> DataFrame:
    """The last executed SQL of each episode and its source: execute_sql or none."""
    ran = F.col(tool) == "execute_sql"
    out = turns.groupBy(episode).agg(F.max_by(F.when(ran, F.col(sql)), F.when(ran, F.col(turn))).alias("candidate_sql"))
    return out.withColumn("source", F.when(F.col("candidate_sql").isNull(), "none").otherwise("execute_sql"))


def final_turn(turns: DataFrame, final: DataFrame, episode: str = "conv_id", turn: str = "turn", sql: str = "text", ids: str = "n_ids") -> DataFrame:
    """The last turn whose SQL is the final one and which the model itself generated (it has ids)."""
    hit = turns.join(final.select(F.col(episode).alias("_e"), "final_sql"), F.col(episode) == F.col("_e")).where((F.col(sql) == F.col("final_sql")) & (F.col(ids) > 0))
    return hit.groupBy(episode).agg(F.max(turn).alias("final_turn"))


def forced_submission(submitted: Column, last_executed: Column) -> dict[str, Column]:
    """The submitted SQL, else the last executed one, even if it failed."""
    status = F.when(submitted.isNotNull(), "submitted").when(last_executed.isNotNull(), "forced").otherwise("missing_submission")
    return {"final_sql": F.coalesce(submitted, last_executed), "status": status}


def fallback(proposed: Column, last_good: Column, last: Column) -> dict[str, Column]:
    """Proposed, else the last that succeeded, else the last, else a query without rows; and which it was."""
    why = F.when(proposed.isNotNull(), "proposed").when(last_good.isNotNull(), "last_successful").when(last.isNotNull(), "last").otherwise("empty")
    return {"final_sql": F.coalesce(proposed, last_good, last, F.lit(FALLBACK_SQL)), "fallback": why}


def recovery(turns: DataFrame, episode: str, turn: str, correct: str) -> DataFrame:
    """first and final correctness of an episode's executed SQL, and whether it recovered."""
    out = turns.groupBy(episode).agg(F.min_by(correct, turn).alias("first_correct"), F.max_by(correct, turn).alias("final_correct"))
    return out.withColumn("recovered", F.col("final_correct") & ~F.col("first_correct"))


def failure_reason(success: Column, submitted: Column) -> Column:
    return F.when(success, None).when(~submitted, "no_final_sql").otherwise("incorrect_final_sql")


def replay_mismatches(log: DataFrame, replayed: DataFrame, episode: str = "conv_id", turn: str = "turn", seen: str = "observation") -> DataFrame:
    """The first turn of each episode whose observation is not what stepping again gives; absent turns count."""
    a = log.select(F.col(episode).alias("e"), F.col(turn).alias("t"), F.col(seen).alias("logged"))
    b = replayed.select(F.col(episode).alias("e2"), F.col(turn).alias("t2"), F.col(seen).alias("again"))
    both = a.join(b, (F.col("e") == F.col("e2")) & (F.col("t") == F.col("t2")), "full_outer").where(~F.col("logged").eqNullSafe(F.col("again")))
    return both.groupBy(F.coalesce("e", "e2").alias(episode)).agg(F.min(F.coalesce("t", "t2")).alias("first_mismatch"), F.count(F.lit(1)).alias("mismatches"))


def first_broken(rules: dict[str, Column]) -> Column:
    """The name of the first rule that does not hold, null if all do; a null rule does not hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))


def turn_facts(turns: DataFrame, episode: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What curation asks of an episode's turns, a row an episode.

    turns: episode, turn (ascending), response (the assistant's tagged text), prompt (the message before it), tool, arguments (JSON),
    status and observation of the recorded step, and replayed, the observation that stepping again gives.

    The submission is the last turn's; it was executed if an earlier turn ran the same SQL with success, and right before if the turn
    before it did.  Nulls in response, tool or arguments do not agree with anything.
    """
    said = parse_response(F.col("response"))
    same_text = lambda a, b: F.coalesce(F.get_json_object(a, "$").eqNullSafe(F.get_json_object(b, "$")), F.lit(False))
    sql = F.get_json_object("arguments", "$.sql")
    last = Window.partitionBy(episode)
    t = turns.withColumns({"_said": said, "_sql": sql, "_last": F.max(turn).over(last), "_first": F.min(turn).over(last)})
    t = t.withColumn("_final", F.max(F.when(F.col(turn) == F.col("_last"), F.col("_sql"))).over(last))
    ran = (F.col("tool") == "execute_sql") & (F.col("status") == "success") & (F.col("_sql") == F.col("_final")) & (F.col(turn) < F.col("_last"))
    ran = F.coalesce(ran, F.lit(False))
    ended = F.col(turn) == F.col("_last")
    return t.groupBy(episode).agg(
        F.count(F.lit(1)).alias("turns"),
        F.bool_or(F.coalesce(F.col("prompt").contains(TEACHER_TAG) | F.col("response").contains(TEACHER_TAG), F.lit(False))).alias("teacher_text"),
        F.bool_and(F.col("_said.error").isNull() & F.col("_said.tool").eqNullSafe(F.col("tool")) & same_text(F.col("_said.arguments"), F.col("arguments"))).alias("responses_agree"),
        F.bool_or(external_reference(F.col("_said.reasoning"))).alias("external"),
        F.min_by("tool", turn).alias("first_tool"),
        F.max_by("tool", turn).alias("last_tool"),
        F.bool_or((F.col("tool") == "submit_sql") & ~ended).alias("premature"),
        F.bool_or(ran).alias("executed"),
        # The turn before the last is the largest that is not the last.
        F.coalesce(F.max_by(ran, F.when(~ended, F.col(turn))), F.lit(False)).alias("executed_right_before"),
        F.bool_and(ended | F.col("observation").eqNullSafe(F.col("replayed"))).alias("observations_agree"),
        F.max("_final").alias("submitted"),
    )


def curation_rules(strict: bool = True) -> dict[str, Column]:
    """What a record must satisfy to be curated, in the order in which it is checked.

    Columns: those of turn_facts, and of the record split, correct, question and task_question, db_id and task_db_id, messages (how
    many it stores), reference_ok (the reference query ran), final_sql, reference_sql, final_ok (the submission verified again), and for records made
    anew regenerated, generation_mode, leak_audit, eligible.  Strict: what is submitted was executed before with success.
    """
    c = F.col
    kept, anew = F.lit(True) if not strict else F.lit(False), c("regenerated")
    return {
        "wrong_split": (c("split") == "train") & c("correct"),
        "task_mismatch": c("question").eqNullSafe(c("task_question")) & c("db_id").eqNullSafe(c("task_db_id")),
        "partly_regenerated": ~anew | ((c("generation_mode") == "full_regeneration_from_question") & (c("leak_audit") == "accept") & c("eligible")),
        "turn_mismatch": c("messages") == 2 * c("turns") + 1,
        "teacher_text": ~c("teacher_text"),
        "reference_failed": c("reference_ok"),
        "response_mismatch": c("responses_agree"),
        "external_reference": ~c("external"),
        "wrong_first_tool": c("first_tool") == "list_tables",
        "no_submission": (c("last_tool") == "submit_sql") & (c("turns") >= 2),
        "premature_submission": ~c("premature"),
        "not_executed_right_before": kept | ~anew | c("executed_right_before"),
        "not_executed": kept | c("executed"),
        "final_sql_mismatch": c("final_sql") == c("submitted"),
        "not_the_reference": kept | ~anew | (c("submitted") == c("reference_sql")),
        "observation_mismatch": c("observations_agree"),
        "not_verified": c("final_ok"),
    }


def curate(original: DataFrame, regenerated: DataFrame, key: str, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): of the records that pass, originals win over regenerated ones, one for each key."""
    every = original.withColumn("priority", F.lit(0)).unionByName(regenerated.withColumn("priority", F.lit(1)))
    rejected = every.where(F.col(reason).isNotNull())
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority"))
    return every.where(F.col(reason).isNull()).withColumn("_r", rank).where("_r = 1").drop("_r"), rejected


def profile(turns: DataFrame, episode: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tool: str = "tool", excerpts: int = 3, chars: int = 240) -> DataFrame:
    """Assistant tokens, tool calls, and the first excerpts of an episode's assistant turns.

    Episodes have a handful of turns (the environment limits them), so their lists are short.
    """
    mine = F.col(role) == "assistant"
    cut = F.when(mine, F.struct(F.col(turn).alias("t"), F.substring(text, 1, chars).alias("x")))
    out = turns.groupBy(episode).agg(
        F.sum(F.when(mine, F.size(F.split(F.trim(text), r"\s+"))).otherwise(0)).alias("assistant_tokens"),
        F.count_if(F.col(tool) == "execute_sql").alias("tool_calls"),
        F.array_sort(F.collect_list(cut)).alias("_x"),
    )
    return out.withColumn("excerpts", F.transform(F.slice("_x", 1, excerpts), lambda x: x["x"])).drop("_x")


def comparison(before: Column, after: Column, name: str) -> dict[str, Column]:
    """Difference and ratio, null where the base is 0."""
    return {f"{name}_difference": after - before, f"{name}_ratio": F.try_divide(after.cast("double"), before.cast("double"))}


def preference_pairs(attempts: DataFrame, task: str = "task", db: str = "db_id", won: str = "won", key: str = "id") -> DataFrame:
    """(task, db, chosen, rejected): each loser with the winner nearest after it in key order of the same task and database, else the first.

    One pair for a loser keeps the result linear where a task has many winners.
    """
    w = Window.partitionBy(task, db)
    nxt = F.min(F.when(F.col(won) == 1, F.col(key))).over(w.orderBy(key).rowsBetween(1, Window.unboundedFollowing))
    first = F.min(F.when(F.col(won) == 1, F.col(key))).over(w)
    losers = attempts.withColumn("chosen", F.coalesce(nxt, first)).where((F.col(won) == 0) & F.col("chosen").isNotNull())
    return losers.select(task, db, "chosen", F.col(key).alias("rejected"))


def pair_reason(same_question: Column, chosen_correct: Column, rejected_correct: Column, leak: Column, diverges: Column) -> Column:
    """Why a pair is skipped, null if it is not."""
    return first_broken({"question_mismatch": same_question, "chosen_not_correct": chosen_correct, "rejected_not_wrong": ~rejected_correct, "leak": ~leak, "same_first_step": diverges})


def outcome_report(attempts: DataFrame, outcome: str, usage: str) -> DataFrame:
    """For each outcome its count and summed usage, and its share of all."""
    out = attempts.groupBy(outcome).agg(F.count(F.lit(1)).alias("count"), F.sum(usage).alias("usage"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("rate", F.col("count") / total)


def usage_totals(df: DataFrame, usage: str, *keys: str) -> DataFrame:
    """Sums over a map column by its keys."""
    return df.select(*keys, F.explode(usage).alias("kind", "tokens")).groupBy(*keys, "kind").agg(F.sum("tokens").alias("tokens"))


def admit(initial_ok: Column, retry_ok: Column, submitted: Column, verified: Column, error: Column) -> Column:
    """Whether an experience enters the memory: wrong at first, right on retry by the student's own verified submission."""
    resource = F.coalesce(error.isin("timeout", "result_too_large"), F.lit(False))
    return ~initial_ok & retry_ok & submitted & verified & ~resource


def memory_round(tasks: DataFrame, store: DataFrame, key: str = "memory_id") -> tuple[DataFrame, DataFrame]:
    """(new rows, one row of counters) of one round against the snapshot that the round began with.

    tasks: memory_id, initial_ok, retry_ok, submitted, verified, error and the record.  The snapshot is read, not
    changed: rows are appended after all retries.
    """
    ok = admit(*(F.col(c) for c in ("initial_ok", "retry_ok", "submitted", "verified", "error")))
    marked = tasks.withColumn("admitted", F.coalesce(ok, F.lit(False))).join(store.select(F.col(key).alias("_k"), F.lit(True).alias("_old")), F.col(key) == F.col("_k"), "left")
    counters = marked.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("initial_ok").alias("initially_correct"), F.count_if(~F.col("initial_ok")).alias("eligible"),
        F.count_if(~F.col("initial_ok") & F.col("retry_ok")).alias("retried_correct"), F.count_if("admitted").alias("admitted"),
        F.count_if(F.col("admitted") & F.col("_old").isNotNull()).alias("already_stored"), F.count_if(F.col("admitted") & F.col("_old").isNull()).alias("appended"),
        F.count_if(~F.col("initial_ok") & ~F.col("admitted")).alias("rejected"),
    )
    return marked.where(F.col("admitted") & F.col("_old").isNull()).drop("admitted", "_k", "_old"), counters


def supervise(error: Column, verified: Column, tool: Column, correct: Column) -> Column:
    """Whether a turn is trained on: no error, and a verified turn only if it is a correct execution."""
    return error.isNull() & F.when(verified, (tool == "execute_sql") & correct).otherwise(True)


def audit_counts(turns: DataFrame, finals: DataFrame, episode: str = "conv_id", turn: str = "turn", sql: str = "text", ok: str = "ok", tool: str = "tool") -> DataFrame:
    """One row: what stored trajectories had right first, last, anywhere and in the end, and how often they ran SQL.

    finals: episode, final_sql, strict, loose (two scorers of the final SQL).
    """
    ran = F.col(tool) == "execute_sql"
    per = turns.groupBy(episode).agg(
        F.min_by(F.when(ran, F.col(ok)), F.when(ran, F.col(turn))).alias("first_ok"), F.max_by(F.when(ran, F.col(ok)), F.when(ran, F.col(turn))).alias("last_ok"),
        F.coalesce(F.bool_or(F.when(ran, F.col(ok))), F.lit(False)).alias("any_ok"), F.count_if(ran).alias("calls"), F.countDistinct(F.when(ran, F.col(sql))).alias("distinct_calls"), F.count(F.lit(1)).alias("turns"),
    )
    x = finals.join(per, episode, "left").withColumns({"first_ok": F.coalesce("first_ok", "strict"), "last_ok": F.coalesce("last_ok", "strict"), "any_ok": F.coalesce("any_ok", F.lit(False)), "calls": F.coalesce("calls", F.lit(0))})
    c = F.count_if
    strict, loose, first, every = F.col("strict"), F.col("loose"), F.col("first_ok"), F.col("any_ok")
    return x.agg(
        F.count(F.lit(1)).alias("total"), c(strict).alias("strict_final"), c(loose).alias("loose_final"), c(first).alias("first_correct"), c("last_ok").alias("last_correct"),
        c(every | strict).alias("any_correct"), c(every & ~strict).alias("intermediate_right_final_wrong"), c(first & ~strict).alias("first_right_final_wrong"), c(~first & strict).alias("first_wrong_final_right"),
        c(F.col("final_sql").isNull()).alias("missing_final"), c(F.col("final_sql").isNull() & every).alias("missing_final_with_right"), c(F.col("calls") >= 3).alias("many_calls"),
        c((F.col("calls") >= 2) & (F.col("distinct_calls") == 1)).alias("identical_calls"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), c(loose & ~strict).alias("scorer_gained"), c(strict & ~loose).alias("scorer_lost"),
    )


def contingency(a: DataFrame, b: DataFrame, key: str, ok: str) -> DataFrame:
    """How often two runs agree on the tasks both have."""
    x = a.select(key, F.col(ok).alias("left_ok")).join(b.select(key, F.col(ok).alias("right_ok")), key)
    return x.groupBy("left_ok", "right_ok").agg(F.count(F.lit(1)).alias("tasks"))


def turn_masks(prompt_length: Column, ids: Column, special: list[int]) -> Column:
    """A mask one shorter than ids: places after the prompt whose id is not special."""
    return F.transform(F.slice(ids, 2, F.size(ids) - 1), lambda x, i: (i + 1 >= prompt_length) & (~x.isin(*special) if special else F.lit(True)))


def padded(ids: Column, longest: Column, pad: int) -> dict[str, Column]:
    """ids filled up to the batch's longest, and the attention mask."""
    gap = F.greatest(longest - F.size(ids), F.lit(0))
    return {"input_ids": F.concat(ids, F.array_repeat(F.lit(pad), gap)), "attention": F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))}


def transcript(turns: DataFrame, episode: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", drop_last: bool = False) -> DataFrame:
    """One text for each episode, its turns in order; drop_last leaves out a last turn that is not the assistant's."""
    rows = turns.groupBy(episode).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x")))).alias("m"))
    m = F.when(F.element_at("m", -1)["r"] != "assistant", F.slice("m", 1, F.size("m") - 1)).otherwise(F.col("m")) if drop_last else F.col("m")
    return rows.select(episode, F.array_join(F.transform(m, lambda x: F.concat(x["r"], F.lit(": "), x["x"])), "\n").alias("transcript"))


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a stored result: what a resumed run has left to do."""
    return tasks.join(done.select(key), key, "left_anti")


def run_modes(tasks: DataFrame, modes: tuple[str, ...] = ("single_full_schema", "single_no_schema", "multi_turn", "single_oracle_tables")) -> DataFrame:
    """A row for each task and mode; the modes are a handful."""
    return tasks.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
