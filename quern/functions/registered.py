"""The engine's own functions under SQL names, for queries that users write."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import TOKEN
from quern.plans.similarity import Node, edit_distance
from quern.session import ready

NAMES = ("quern_tokens", "quern_token_count", "quern_tree_distance")


def register(spark: SparkSession) -> None:
    """quern_tokens(text), quern_token_count(text), and quern_tree_distance(left, right) of two trees as JSON.

    The first two are SQL expressions and stay in generated code; the third runs in Arrow batches.  A null text has no
    tokens, a null tree no distance.  The gate lets none of them into a candidate's query unless it is told to.
    """
    ready(spark)
    pattern = TOKEN.replace("\\", "\\\\")
    words = f"regexp_extract_all(lower(coalesce(x, '')), '{pattern}', 0)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quern_tokens(x STRING) RETURNS ARRAY<STRING> RETURN {words}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quern_token_count(x STRING) RETURNS INT RETURN size({words})")

    @F.pandas_udf("int")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        trees = [(None if a is None or b is None else edit_distance(Node.unpacked(json.loads(a)), Node.unpacked(json.loads(b)))) for a, b in zip(left, right)]
        return pd.Series(trees, dtype="Int32")

    spark.udf.register("quern_tree_distance", distance)
