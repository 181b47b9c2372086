"""The registry, and stand-ins for the engine's record kinds made from the fixture tables.

A stand-in is one SQL text that both engines read alike; queries get it as a DataFrame, oracles as a WITH clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import ready, spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Stand-ins, by name.  {x} is a table or another stand-in.
FIXTURES = {
    # An event is a rollout, a user's events are a group.
    "rollouts": """SELECT event_id AS id, user_id AS grp, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS reward,
        CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS DOUBLE) AS submission, CAST(event_id % 11 AS DOUBLE) / 10 AS schema_score,
        CAST(1 + event_id % 9 AS INT) AS turns, event_type AS origin, value, CAST(event_id % 4 AS INT) AS d
        FROM {events} WHERE event_id % 11 < 11""",
    "leveled": """SELECT id, grp, reward, turns, CASE d WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extra' END AS difficulty FROM {rollouts}""",
    # An order is an evaluation record.
    "records": """SELECT o_orderkey AS task_id, o_orderstatus AS mode, o_orderpriority AS difficulty, o_orderkey % 3 = 0 AS success,
        o_orderkey % 13 > 0 AS valid_action, o_orderkey % 7 > 0 AS valid_sql, o_orderkey % 5 > 0 AS executable_sql,
        CAST(1 + o_orderkey % 10 AS INT) AS turns, CAST(o_orderkey % 6 AS INT) AS tool_calls, CAST(o_custkey % 2000 AS INT) AS token_count,
        CAST(o_custkey % 97 AS DOUBLE) AS latency_seconds, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS first_sql_correct,
        o_orderkey % 6 = 3 AS recovered, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 8 < 3 THEN 'wrong_table' WHEN o_orderkey % 8 < 6 THEN 'join_error' ELSE 'timeout' END AS failure_category
        FROM {orders}""",
    # An order line is a trajectory's verification; NULL flags where it was never submitted.
    "verified": """SELECT l_orderkey * 8 + l_linenumber AS task_id, CASE l_returnflag WHEN 'A' THEN 'easy' WHEN 'N' THEN 'medium' ELSE 'hard' END AS difficulty,
        CASE WHEN l_partkey % 9 = 0 THEN 'turn_limit' ELSE 'submitted_sql' END AS status, l_partkey % 10 < 6 AS correct,
        l_suppkey % 5 > 0 AS executable, l_partkey % 4 > 0 AS column_match, l_suppkey % 3 > 0 AS row_match, FALSE AS value_match,
        CASE WHEN l_partkey % 10 < 6 THEN NULL WHEN l_suppkey % 6 = 0 THEN 'unknown_column' WHEN l_suppkey % 6 < 3 THEN 'timeout' ELSE 'wrong_result' END AS error,
        CAST(l_linenumber AS INT) AS turns FROM {lineitem}""",
    # A document is a task: its language the difficulty, its source the database.
    "tasks": """SELECT doc_id AS task_id, lang AS difficulty, source AS db_id, lower(trim(text)) AS question, CAST(n_chars AS BIGINT) AS n_chars FROM {documents}""",
    "turns": """SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN 'execute_sql' WHEN role = 'system' THEN 'list_tables' ELSE 'submit_sql' END AS tool FROM {conversations}""",
    "corpus": """SELECT doc_id AS id, text FROM {documents}""",
    "questions": """SELECT item_id AS id, text FROM {benchmark}""",
    # A labelled document is an attempt; good ones won, others lost.
    "attempts": """SELECT d.doc_id AS id, d.lang AS task, d.source AS db_id, CAST(l.quality AS INT) AS won, CAST(d.n_chars AS BIGINT) AS size FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Token log-probabilities of an event's two policies.
    "token_rows": """SELECT event_id AS id, event_type AS origin, CAST(event_id % 5 - 2 AS DOUBLE) / 2 AS advantage,
        CAST(-(event_id % 17) AS DOUBLE) / 10 AS cur0, CAST(-(event_id % 13) AS DOUBLE) / 10 AS old0, CAST(-(event_id % 7) AS DOUBLE) / 10 AS ref0,
        CAST(-(user_id % 19) AS DOUBLE) / 10 AS cur1, CAST(-(user_id % 23) AS DOUBLE) / 10 AS old1, CAST(-(user_id % 11) AS DOUBLE) / 10 AS ref1,
        event_id % 3 > 0 AS keep1 FROM {events}""",
}


class Tables:
    """Tables and stand-ins of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ready(spark), sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            text = FIXTURES[name]
            of = {x: self(x) for x in set(re.findall(r"\{(\w+)\}", text))}
            if name == "corpus":  # texts are much work for one task
                of = {x: spread(df) for x, df in of.items()}
            return self.spark.sql(text, **of)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _with(sql: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for x in re.findall(r"\{(\w+)\}", text):
            if x in FIXTURES and x not in need:
                visit(FIXTURES[x])
                need.append(x)

    visit(sql)
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    parts = [f"{x} AS (" + re.sub(r"\{(\w+)\}", r"\1", FIXTURES[x]) + ")" for x in need]
    if not parts:
        return body
    if body[:15].upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[14:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def query(sql: str | None = None):
    """Registers f(tables) under its name; sql is its oracle."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        REGISTRY[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = _with(sql)
        return f

    return add


def register(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)
