"""Evaluators' bookkeeping: each way an episode can end, on a table and on a stream."""

import pytest
from pyspark.sql import functions as F

from quern.operators import episodes as E

SCHEMA = f"conv_id int, turn int, {E.TURN}"


def call(tool, sql=None):
    arguments = f'{{"sql": "{sql}"}}' if sql is not None else "{}"
    return f'<reasoning>r</reasoning><tool>{{"name": "{tool}", "arguments": {arguments}}}</tool>'


def turn(response, executed=None, error=None, finish="stop", initial=None, ok=None):
    return (response, finish, 10, 3, error, executed, initial, ok)


#: Turns of an episode with two exploratory calls; status, turns, final SQL, reason, prompt tokens.
CASES = {
    "submits": ([turn(call("execute_sql", "a"), True), turn(call("submit_sql", "b"))], ("submitted_sql", 2, "b", None, 20)),
    "stops": ([turn(call("execute_sql", "a"), True)], ("missing_submission", 1, None, None, 10)),
    "fails": ([turn(call("execute_sql", "a"), True), turn(None, error="down"), turn(call("submit_sql", "b"))], ("model_error", 2, None, None, 10)),
    "forced_by_proposal": ([turn(call("execute_sql", "a"), True), turn(call("execute_sql", "b"), True), turn(call("execute_sql", "c"), True)], ("forced_submit_sql", 4, "c", "wrong_tool_on_final_turn", 30)),
    "forced_by_success": ([turn(call("execute_sql", "a"), True), turn(call("execute_sql", "b"), False), turn("no tags")], ("forced_submit_sql", 4, "a", "invalid_format", 30)),
    "forced_by_last": ([turn(call("execute_sql", "a"), False), turn(call("list_tables")), turn(None)], ("forced_submit_sql", 4, "a", "invalid_format", 30)),
    "forced_empty": ([turn("x"), turn(call("list_tables")), turn(call("list_tables"))], ("forced_submit_sql", 4, "SELECT NULL WHERE FALSE", "invalid_action", 30)),
    "replayed": ([turn("x", initial="i", ok=True), turn("y", initial="i", ok=True)], ("forced_submit_sql", 4, "i", "invalid_format", 20)),
    "replay_failed": ([turn(call("execute_sql", "a"), True, initial="i", ok=False), turn(call("submit_sql", "s"), initial="i")], ("submitted_sql", 3, "s", None, 20)),
    "tag_cut_off": ([turn(call("submit_sql", "b").removesuffix("</tool>"))], ("submitted_sql", 1, "b", None, 10)),
    "cut_by_length": ([turn(call("submit_sql", "b").removesuffix("</tool>"), finish="length")], ("missing_submission", 1, None, None, 10)),
    "goes_on_too_long": ([turn(call("submit_sql", "b"))] * 9, ("submitted_sql", 1, "b", None, 10)),
}


@pytest.fixture(scope="module")
def rows():
    return [(i, n, *t) for i, (turns, _) in enumerate(CASES.values()) for n, t in enumerate(turns)]


def told(r):
    return r["status"], r["turns"], r["final_sql"], r["reason"], r["prompt_tokens"]


def test_each_end(spark, rows):
    df = spark.createDataFrame(rows + [(None, 0, *turn("x"))], SCHEMA).withColumns({"_p": F.lit(1), "status": F.lit("mine")}).repartition(4)
    got = {r["conv_id"]: told(r) for r in E.evaluated(df, max_turns=2).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES.values())} | {None: ("missing_submission", 1, None, None, 10)}
    twice = E.evaluated(df.union(df), max_turns=2)  # repeated turns count once
    assert {r["conv_id"]: told(r) for r in twice.collect()} == got
    assert E.evaluated(df.limit(0)).count() == 0


def test_more_tools(spark):
    df = spark.createDataFrame([(1, 0, *turn(call("list_tables"))), (1, 1, *turn(call("submit_sql", "z")))], SCHEMA)
    assert told(E.evaluated(df, max_turns=1, tools=E.ALL_TOOLS).first()) == ("submitted_sql", 2, "z", None, 20)


def test_a_stream_goes_on_after_a_stop(spark, rows, tmp_path):
    got = {}

    def run():
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        keep = lambda batch, _: got.update({r["conv_id"]: told(r) for r in batch.collect()})
        E.evaluated_stream(source, max_turns=2).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()

    for part in (lambda r: r[1] == 0, lambda r: r[1] == 1, lambda r: r[1] >= 1):  # the last brings old turns again
        spark.createDataFrame([r for r in rows if part(r)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert got == {i: want for i, (_, want) in enumerate(CASES.values())}
