"""Places within strata against sorting in Python; no stratum in one task."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import collection, datasets
from quern.operators.ranks import place_within, with_count


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_places_equal_sorting(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["hot"] * 12 + ["a", "b", None]), rng.randint(0, 30)) for i in range(900)] + [(1000 + i, f"alone{i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string, x int").withColumns({"place": F.lit("old"), "_n": F.lit(1)}).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = place_within(df, ["s"], [F.col("x"), F.col("id")])
        whole = place_within(df, [], [F.col("x"), F.col("id")], "n")
        plan = got._jdf.queryExecution().executedPlan().toString()
        told, every = {r["id"]: r["place"] for r in got.collect()}, {r["id"]: r["n"] for r in whole.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for i, s, x in rows:
        groups[s].append((x, i))
    assert told == {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert every == {i: n for n, (_, i) in enumerate(sorted((x, i) for i, _, x in rows), 1)}
    assert "Window" not in plan and "Exchange hashpartitioning(s" not in plan
    assert place_within(df.limit(0), ["s"], [F.col("id")]).count() == 0


def test_counts_of_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    assert {r["id"]: r["n"] for r in with_count(df, ["k"], "n").collect()} == {1: 2, 2: 2, 3: 1}
    assert {r["n"] for r in with_count(df, [], "n").collect()} == {3}


def test_selections_have_no_window_by_stratum(spark):
    tasks = spark.createDataFrame([(i, f"db{i % 4}" if i % 9 else None, "x" if i % 5 else None, i % 7) for i in range(300)], "task_id int, db_id string, difficulty string, n int")
    quotas = spark.createDataFrame([("x", 11)], "difficulty string, deficit int")
    done = tasks.where("task_id < 20")
    plans = {
        "diverse": datasets.diverse_order(tasks, 1, "db_id", "task_id", "difficulty"), "select": datasets.select_diverse(tasks, "difficulty", 9, 1), "sample": datasets.sample_per_stratum(tasks, "difficulty", 9, 1),
        "fill": datasets.fill_quotas(tasks, quotas, "difficulty"), "attempts": collection.attempt_plan(tasks, done, {"x": 30}, 3, 1),
    }
    for name, df in plans.items():
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString(), name
    first = [r for r in plans["diverse"].collect() if not r["repeat"]]
    assert Counter((r["difficulty"], r["db_id"]) for r in first) == Counter({(d, b): 1 for d in ("x", None) for b in ("db0", "db1", "db2", "db3", None)})
    assert plans["sample"].groupBy("difficulty").count().select("count").distinct().collect() == [(9,)]
    assert plans["fill"].count() == 11 and plans["attempts"].count() == 30 - sum(i % 5 > 0 for i in range(20))
    assert {r["short"] for r in datasets.select_diverse(tasks, "difficulty", 100, 1).collect()} == {0, 100 - 60}
