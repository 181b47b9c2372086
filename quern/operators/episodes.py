"""The bookkeeping of multi-turn evaluation over stored responses: repair, budgets, statuses, final SQL and usage.

Responses are taken apart in the plan; what depends on the turns before is a fold of a small state, the same on a table, where an
episode's first turns meet in one group, and on a stream, where the state is kept between batches and goes on after a stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.protocol import parse_action, parse_response
from quern.operators.trajectories import FALLBACK_SQL
from quern.session import ready

#: What the two evaluators let a model call; the second one explores the schema by itself.
SINGLE_TOOL = ("execute_sql", "submit_sql")
ALL_TOOLS = ("list_tables", "inspect_tables", "inspect_values", "execute_sql", "submit_sql")

TURN = "response string, finish_reason string, prompt_tokens long, completion_tokens long, error string, executed boolean, initial_sql string, initial_ok boolean"


@dataclass
class Episode:
    """What is known of an episode after some of its turns.

    turns counts the replay of a stored query, the model's turns and a forced submission; remaining are exploratory calls.
    """

    remaining: int
    turns: int = 0
    last_turn: int = -1
    last_sql: str | None = None
    last_successful: str | None = None
    status: str = "missing_submission"
    final_sql: str | None = None
    reason: str | None = None
    prompt_tokens: int = 0
    completion_tokens: int = 0
    ended: bool = False

    @classmethod
    def begin(cls, max_turns: int, initial_sql: str | None, initial_ok: bool | None) -> Episode:
        """With the replay of a stored query, if there is one, as the first call."""
        e = cls(max_turns)
        if initial_sql is not None:
            e.remaining, e.turns, e.last_sql = max_turns - 1, 1, initial_sql
            e.last_successful = initial_sql if initial_ok else None
        return e

    def take(self, turn: int, tool: str | None, sql: str | None, problem: str | None, error: str | None, executed: bool, prompt: int, completion: int) -> None:
        """One more response; what follows the end, or was taken before, changes nothing."""
        if self.ended or turn <= self.last_turn:
            return
        self.last_turn, self.turns = turn, self.turns + 1
        if error is not None:
            self.status, self.ended = "model_error", True
            return
        self.prompt_tokens += prompt
        self.completion_tokens += completion
        if problem is None and tool == "submit_sql":
            self.status, self.final_sql, self.ended = "submitted_sql", sql, True
        elif self.remaining == 0:  # the last turn may only submit
            proposed = sql if problem is None and tool == "execute_sql" else None
            self.status, self.ended, self.turns = "forced_submit_sql", True, self.turns + 1
            self.reason = problem or "wrong_tool_on_final_turn"
            self.final_sql = proposed or self.last_successful or self.last_sql or FALLBACK_SQL
        else:
            self.remaining -= 1
            if problem is None and tool == "execute_sql":
                self.last_sql = sql
                self.last_successful = sql if executed else self.last_successful


STATE = "remaining int, turns int, last_turn int, last_sql string, last_successful string, status string, final_sql string, reason string, prompt_tokens long, completion_tokens long, ended boolean"
NAMES = [f.name for f in fields(Episode)]


def closed(response: Column, finish_reason: Column) -> Column:
    """A response that stopped by itself before its closing tag, with that tag."""
    cut = (finish_reason == "stop") & response.contains("<tool>") & ~response.contains("</tool>")
    return F.when(cut, F.concat(response, F.lit("</tool>"))).otherwise(response)


def taken_apart(turns: DataFrame, episode: str, turn: str, tools: tuple[str, ...]) -> DataFrame:
    """What a fold needs of each turn: tool, SQL, what is wrong with the response, and its usage."""
    said = parse_response(closed(F.col("response"), F.col("finish_reason")))
    t = turns.withColumn("_s", said)
    name, arguments = F.col("_s.tool"), F.col("_s.arguments")
    problem = F.coalesce(F.col("_s.error"), F.when(~name.isin(*tools), "invalid_action"), parse_action(name, arguments))
    return t.select(
        F.col(episode), F.col(turn).cast("int").alias("turn"), name.alias("tool"), F.get_json_object(arguments, "$.sql").alias("sql"), problem.alias("problem"), "error", F.coalesce("executed", F.lit(False)).alias("executed"),
        F.coalesce("prompt_tokens", F.lit(0)).cast("long").alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).cast("long").alias("completion_tokens"), "initial_sql", F.coalesce("initial_ok", F.lit(False)).alias("initial_ok"),
    )


def _none(v):
    return None if v is None or v != v else v


def _folded(e: Episode | None, rows: pd.DataFrame, max_turns: int) -> Episode:
    for r in rows.sort_values("turn", kind="stable").itertuples():
        if e is None:
            e = Episode.begin(max_turns, _none(r.initial_sql), r.initial_ok)
        e.take(int(r.turn), _none(r.tool), _none(r.sql), _none(r.problem), _none(r.error), bool(r.executed), int(r.prompt_tokens), int(r.completion_tokens))
    return e


def evaluated(turns: DataFrame, episode: str = "conv_id", turn: str = "turn", max_turns: int = 10, tools: tuple[str, ...] = SINGLE_TOOL) -> DataFrame:
    """A row an episode: the fields of Episode after its stored turns.

    turns: episode, turn (ascending; of turns with one number the first counts), and the columns of TURN: the response, how it finished, its tokens, a model's
    error, whether its query ran, and on each row the stored query that was replayed first, if any, and whether that ran.

    An episode cannot take more than max_turns + 1 turns, so that many of each are grouped, whatever a table holds of it.  Null episodes
    are one, a null response does not parse, an empty table gives no rows.
    """
    ready(turns.sparkSession)
    kind = dict(turns.dtypes)[episode]
    parts = taken_apart(turns, episode, turn, tools)
    place = F.dense_rank().over(Window.partitionBy(episode).orderBy("turn"))
    first = F.row_number().over(Window.partitionBy(episode, "turn").orderBy("tool", "sql"))
    some = parts.withColumn("_p", place).where(F.col("_p") <= max_turns + 1).withColumn("_f", first).where("_f = 1").drop("_p", "_f")

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *astuple(_folded(None, rows, max_turns)))], columns=[episode, *NAMES])

    return some.groupBy(episode).applyInPandas(fold, f"`{episode}` {kind}, {STATE}")


def evaluated_stream(turns: DataFrame, episode: str = "conv_id", turn: str = "turn", max_turns: int = 10, tools: tuple[str, ...] = SINGLE_TOOL) -> DataFrame:
    """evaluated on a stream: a row for each episode that a batch brought something new of, in update mode.

    An episode's turns must come in order from batch to batch; within one they may come in any.  Turns that come again
    change nothing, so a source may be read again.  The state is the fields of Episode and lasts with the query's checkpoint.
    """
    ready(turns.sparkSession)
    kind = dict(turns.dtypes)[episode]

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        e = Episode(*(_none(v) for v in state.get)) if state.exists else None
        e = _folded(e, pd.concat(list(frames)), max_turns)
        state.update(astuple(e))
        yield pd.DataFrame([(key[0], *astuple(e))], columns=[episode, *NAMES])

    return taken_apart(turns, episode, turn, tools).groupBy(episode).applyInPandasWithState(fold, f"`{episode}` {kind}, {STATE}", STATE, "update", "NoTimeout")


# The log of calls

CALLS = "episode string, call long, model string, prompt_tokens long, completion_tokens long, elapsed_seconds double, error string"


def call_log(turns: DataFrame, episode: str, turn: str, model: Column, elapsed: Column) -> DataFrame:
    """CALLS: a row a call of a model, numbered within its episode; a failed call has its error and no usage."""
    number = F.row_number().over(Window.partitionBy(episode).orderBy(turn)).cast("long")
    used = lambda c: F.when(F.col("error").isNull(), F.col(c).cast("long"))
    return turns.select(
        F.col(episode).cast("string").alias("episode"), number.alias("call"), model.alias("model"), used("prompt_tokens").alias("prompt_tokens"), used("completion_tokens").alias("completion_tokens"), elapsed.cast("double").alias("elapsed_seconds"), "error"
    )


def call_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, failures, tokens and seconds, the slowest call's too."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failures"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.sum("elapsed_seconds").alias("seconds"), F.max("elapsed_seconds").alias("slowest"),
    )
