"""python -m quern: list the queries, run one, score pairs of SQL, or verify candidates.

    python -m quern list
    python -m quern run NAME TABLES [--out PATH]
    python -m quern score PAIRS.jsonl TABLES --out PATH [--left pred_sql] [--right gold_sql]
    python -m quern verify CANDIDATES.jsonl TABLES --out PATH [--at-once 8]

TABLES is a folder of Parquet tables, which score and verify take as a read-only database.  Results are JSON lines in a new
folder; one that is there is refused.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern import queries
from quern.operators.verify import verify_table
from quern.plans.gate import Gate
from quern.plans.similarity import score_table
from quern.queries.base import TABLES
from quern.session import session
from quern.sources import jsonl
from quern.sources.catalog import namespace


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quern", description="Queries, SQL similarity and verification over Parquet tables.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out")
    for name, left, right in (("score", "pred_sql", "gold_sql"), ("verify", "candidate", "reference")):
        x = sub.add_parser(name)
        x.add_argument("input")
        x.add_argument("tables")
        x.add_argument("--out", required=True)
        x.add_argument("--left", default=left)
        x.add_argument("--right", default=right)
        x.add_argument("--at-once", type=int, default=8)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    if a.command == "list":
        print(*sorted(queries.queries()), sep="\n")
        return 0
    spark = spark or session()
    if a.command == "run":
        df = queries.queries()[a.name](spark, a.tables)
        if a.out:
            jsonl.create(df, a.out)
        else:
            df.show(50, truncate=False)
        return 0
    gate = Gate(spark, namespace(spark, a.tables, TABLES[:7]))
    # Other fields of a record pass through as they are; a bad line is a record without queries.
    lines = jsonl.load_jsonl(spark, a.input, f"task_id string, {a.left} string, {a.right} string", strict=False, numbered=True)
    if a.command == "score":
        out = score_table(gate, lines, a.left, a.right)
        out = out.withColumn("status", F.when(F.col("_corrupt_record").isNotNull(), "unscorable:invalid_json").otherwise(F.col("status")))
        jsonl.create(out.drop("file", "_corrupt_record"), a.out)
    else:
        jsonl.create(verify_table(gate, lines.withColumn("line", F.col("line").cast("long")), "line", a.left, a.right, a.at_once), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
