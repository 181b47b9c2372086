"""Closed-form values and invariants of the engine's own operators, on literal rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.limits import Limits
from quern.operators import datasets, metrics, retrieval, scoring, trajectories, verify
from quern.plans import similarity
from quern.plans.gate import Gate, GateError, statements
from quern.plans.similarity import Node, edit_distance
from quern.sources import jsonl, memory_store
from quern.sources.catalog import Namespace, quote


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def gate(spark):
    people = spark.createDataFrame([(i, f"p{i:02d}", 1 + i % 2, 1000.0 + i) for i in range(25)], "id int, name string, dept int, salary double")
    dept = spark.createDataFrame([(1, "Engineering"), (2, "Sales")], "id int, name string")
    return Gate(spark, Namespace(spark, {"people": people, "dept": dept}, {"people": ["id"]}, [("people", "dept", "dept", "id")]), Limits(query_seconds=60, verifier_seconds=60))


def test_balanced_group_advantages(spark):
    df = spark.createDataFrame([(1, float(i % 2)) for i in range(8)] + [(2, 1.0), (2, 1.0), (3, 0.0)], "g int, r double")
    out = rows(scoring.group_advantages(df, "g", "r").select("g", "reward_std", "advantage", "group_kind"))
    one = [x for x in out if x[0] == 1]
    assert all(x[1] == 0.5 for x in one) and abs(sum(x[2] for x in one)) < 1e-9 and {x[3] for x in one} == {"mixed"}
    assert {(x[2], x[3]) for x in out if x[0] == 2} == {(0.0, "all_one")}
    assert not [x for x in out if x[0] == 3]  # a single row has nothing to compare


def test_tied_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "g string, s double")
    out = sorted(rows(df.select("g", "s", scoring.tied_centered_rank("s", "g"))))
    assert out == [("a", 1.0, -1.0), ("a", 2.0, 0.0), ("a", 2.0, 0.0), ("a", 3.0, 1.0), ("b", 5.0, 0.0)]


def test_turn_rewards(spark):
    df = spark.createDataFrame([(True, "easy", 3), (True, "easy", 6), (False, "easy", 1), (True, "extra", 8)], "ok boolean, d string, n int")
    out = [round(r[0], 6) for r in df.select(scoring.turn_reward(F.col("ok"), F.col("d"), F.col("n"))).collect()]
    assert out == [1.1, 0.8, 0.0, 1.0]


def test_f1_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(scoring.f1(F.col("a"), F.col("b"))["f1"]).collect()] == [1.0, 0.0, 0.5]


def test_entropy_means(spark):
    df = spark.createDataFrame([(1, 1.0), (3, 6.0)], "n int, s double")
    r = scoring.entropy_summary(df, "n", "s").first()
    assert (r["token_mean_nats"], r["call_mean_nats"]) == (1.75, 1.5) and math.isclose(r["token_mean_bits"], 1.75 / math.log(2))


def test_token_loss_clips_one_side(spark):
    df = spark.createDataFrame([(0.0, -1.0, 1.0), (0.0, -1.0, -1.0), (0.0, 0.0, 2.0)], "c double, o double, a double")
    out = rows(df.select(*(v.alias(k) for k, v in scoring.token_loss(F.col("c"), F.col("o"), None, F.col("a")).items())).select("policy_loss", "clipped", "policy_clipped"))
    assert out[0] == (-1.2, True, True) and out[1][2] is False and math.isclose(out[1][0], math.e) and out[2] == (-2.0, False, False)


def test_split_counts(spark):
    tasks = spark.createDataFrame([(f"db{i}",) for i in range(146)], "db_id string")
    out = dict(rows(datasets.split_databases(tasks).groupBy("split").count()))
    assert out == {"train": 102, "internal_validation": 22, "internal_holdout": 22}


def test_diverse_order_has_each_database_first(spark):
    tasks = spark.createDataFrame([(i, f"db{i % 5}", "x") for i in range(30)], "task_id int, db_id string, s string")
    first = rows(datasets.diverse_order(tasks, 1, "db_id", "task_id", "s").where("place <= 5").select("db_id"))
    assert len(set(first)) == 5


def test_epoch_order_is_a_permutation(spark):
    df = spark.createDataFrame([(i, i % 37) for i in range(500)], "t int, n int")
    out = rows(datasets.epoch_order(df, "n", "t", 3, 64).orderBy("bucket", "place").select("bucket", "n", "t"))
    assert len({x[2] for x in out}) == 500
    assert [x[1] for x in out if x[0] == 0] == sorted(x[1] for x in out if x[0] == 0)
    assert [x[1] for x in out if x[0] == 1] == sorted((x[1] for x in out if x[0] == 1), reverse=True)


def test_bm25_and_tfidf_closed_forms(spark):
    docs = spark.createDataFrame([(1, "rare rare common"), (2, "common filler filler filler filler")], "id int, text string")
    q = spark.createDataFrame([(9, "rare rare")], "id int, text string")
    want = math.log(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 4))
    assert rows(retrieval.bm25_scores(docs, q, digits=9)) == [(9, 1, round(want, 9))]
    two = spark.createDataFrame([(1, "common rare rare"), (2, "common")], "id int, text string")
    idf = 1 + math.log(3 / 2)
    weights = {(r["id"], r["term"]): r["weight"] for r in retrieval.tfidf(two)[0].collect()}
    assert math.isclose(weights[1, "rare"], 2 * idf / math.sqrt(1 + (2 * idf) ** 2))


def test_tokens_split_cjk_and_accents(spark):
    df = spark.createDataFrame([("Ab_1 數據x é",), (None,)], "t string")
    assert [r[0] for r in df.select(retrieval.tokens(F.col("t"))).collect()] == [["ab_1", "數", "據", "x"], []]


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([([5, 9, 4, 1],)], "c array<int>")
    assert df.select(retrieval.pack_blocks(F.col("c"), 10)).first()[0] == [0, 2, 3]


def test_zero_and_broken_vectors_match_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "id int, vector array<double>")
    assert rows(retrieval.cosine_scores(v, v)) == [(1, 1, 1.0)]


def test_gate_refuses_and_names_errors(gate):
    for sql, kind in {"": "empty_sql", "SELECT 1; SELECT 2": "multiple_statements", "DELETE FROM people": "forbidden_sql", "SELECT x FROM people": "unknown_column", "SELECT 1 FROM nope": "unknown_table", "SELECT * FROM csv.`/etc/passwd`": "forbidden_sql"}.items():
        assert gate.error_of(sql) == kind, sql
    with pytest.raises(GateError):
        gate.validate("SELECT (SELECT java_method('a', 'b'))")
    assert gate.error_of("WITH people2 AS (SELECT * FROM people) SELECT count(*) FROM people2") is None


def test_row_limit_tells_whether_there_are_more(gate):
    assert gate.execute("SELECT * FROM people", rows=20, seconds=60).has_more
    assert not gate.execute("SELECT * FROM people WHERE id < 20", rows=20, seconds=60).has_more
    with pytest.raises(GateError):
        gate.execute("SELECT name FROM people", rows=20, size=5, seconds=60)


def test_statement_split_knows_quotes_and_comments():
    assert statements("SELECT ';' -- ; \n; /* ; */") == ["SELECT ';' -- ; \n"]


def test_verdicts(gate):
    same = verify.verify(gate, "SELECT name FROM people ORDER BY id DESC", "SELECT name FROM people")
    assert same.correct and same.reward == 1.0 and not same.order_sensitive
    assert not verify.verify(gate, "SELECT name FROM people ORDER BY id DESC", "SELECT name FROM people ORDER BY id").correct
    assert verify.verify(gate, "SELECT dept FROM people", "SELECT DISTINCT dept FROM people").row_match is False


def test_tolerance_pairs_rows_that_rounding_splits(spark):
    a = spark.createDataFrame([(1.0,), (1.0000005,), (2.0,)], "x double")
    b = spark.createDataFrame([(2.0000001,), (1.0000001,), (1.0,)], "x double")
    assert verify.unordered_equal(a, b)
    assert not verify.unordered_equal(a, b.union(spark.createDataFrame([(9.0,)], "x double")).limit(4))


def test_vote_takes_the_first_of_the_largest_group(gate):
    assert verify.vote_sql(gate, ["SELECT 1", "SELECT 2", "SELECT 2 AS other", "SELECT nothing FROM people"]) == {"selected_sample": 1, "votes": 2, "valid": 3, "status": "voted"}
    assert verify.vote_sql(gate, [None, "SELEC"])["status"] == "all_invalid"


def test_edit_distance():
    a = Node("f", [Node("d", [Node("a"), Node("c", [Node("b")])]), Node("e")])
    b = Node("f", [Node("c", [Node("d", [Node("a"), Node("b")])]), Node("e")])
    assert edit_distance(a, b) == 2 == edit_distance(b, a) and edit_distance(a, a) == 0


def test_catalog(gate):
    ns = gate.namespace
    assert ns.tables() == ["dept", "people"] and quote("a`b") == "`a``b`"
    got = {r["column_name"]: r for r in ns.columns(["PEOPLE"]).collect()}
    assert got["dept"]["references"] == "dept.id" and got["id"]["key_place"] == 1
    assert ns.columns(["nope"]).first()["error"] == "unknown_table"
    assert "PRIMARY KEY" in ns.render({"people"}).first()["ddl"]
    with pytest.raises(LookupError):
        ns.values("people", "nope")


def test_memory_is_append_only(spark, tmp_path):
    path = str(tmp_path / "memories")
    row = {"question": "q", "experience": "e", "sql_before": "a", "sql_first_execute": None, "sql_after": "b", "source_task_id": "t", "source_split": "train", "initial_record_path": "i", "retry_record_path": "r"}
    one = memory_store.memory_id(spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)))
    assert memory_store.append_verified(spark, path, one) == 1
    assert memory_store.append_verified(spark, path, one) == 0
    two = one.withColumn("retry_record_path", F.lit("r2"))
    assert memory_store.append_verified(spark, path, memory_store.memory_id(two)) == 1
    assert [r["seq"] for r in memory_store.read(spark, path).orderBy("seq").collect()] == [1, 2]
    with pytest.raises(ValueError):
        memory_store.append_verified(spark, path, one.withColumn("experience", F.lit("other")))
    with pytest.raises(ValueError):
        memory_store.append_verified(spark, path, one.withColumn("source_split", F.lit("external_dev")))


def test_records_and_manifests(spark, tmp_path):
    path = tmp_path / "tasks.jsonl"
    path.write_text('{"task_id": "a", "difficulty": "easy", "split": "train"}\n\n{"task_id": "b", "difficulty": "odd", "split": "train"}\n')
    tasks = jsonl.load_tasks(spark, str(path))
    assert tasks.count() == 2 and rows(jsonl.bad_tasks(tasks).select("task_id")) == [("b",)]
    assert jsonl.find_task(tasks).first()["task_id"] == "a" and jsonl.find_task(tasks, "b").count() == 1
    m = str(tmp_path / "m.json")
    jsonl.ensure_manifest(spark, m, {"a": 1})
    jsonl.ensure_manifest(spark, m, {"a": 1})
    with pytest.raises(ValueError):
        jsonl.ensure_manifest(spark, m, {"a": 2})
    jsonl.create(tasks, str(tmp_path / "out"))
    with pytest.raises(Exception):
        jsonl.create(tasks, str(tmp_path / "out"))


def test_stream_ingest_twice_adds_nothing(spark, tmp_path):
    from quern.streaming.incremental import ingest

    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, x string").write.parquet(str(tmp_path / "in"))
    for i in range(2):
        source = spark.readStream.schema("id int, x string").parquet(str(tmp_path / "in"))
        ingest(source, str(tmp_path / "out"), "id", str(tmp_path / f"c{i}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_empty_denominators_are_zero(spark):
    empty = spark.createDataFrame([], "mode string, success boolean, valid_action boolean, valid_sql boolean, executable_sql boolean, turns int, tool_calls int, token_count int, latency_seconds double, first_sql_correct boolean, recovered boolean")
    r = metrics.summarize(empty).first()
    assert r["tasks"] == 0 and r["execution_accuracy"] == 0.0 and r["recovery_rate"] == 0.0


def test_fallback_chain(spark):
    df = spark.createDataFrame([("p", "g", "l"), (None, "g", "l"), (None, None, "l"), (None, None, None)], "p string, g string, l string")
    out = [r[0] for r in df.select(trajectories.fallback(F.col("p"), F.col("g"), F.col("l"))["fallback"]).collect()]
    assert out == ["proposed", "last_successful", "last", "empty"]


def test_limits():
    with pytest.raises(ValueError):
        Limits(rows=0)
    with pytest.raises(ValueError):
        Limits.from_dict({"unknown": 1})


def test_results_match_one_to_one():
    """The pairing is a perfect matching: neither order nor exact equals decide it."""
    rng = random.Random(1)
    assert verify.rows_equal([(1.0, 5.0), (1.0000001, 3.0)], [(1.0000001, 5.0), (1.0, 3.0)])
    for _ in range(1500):
        n = rng.randint(1, 5)
        left, right = ([tuple(1 + rng.choice([0, 4e-7, 8e-7, 12e-7, 16e-7]) for _ in range(2)) for _ in range(n)] for _ in range(2))
        want = any(all(map(verify.row_equal, left, p)) for p in itertools.permutations(right))
        assert verify.rows_equal(left, right) == want, (left, right)
    assert verify.rows_equal([(None, 1)], [(None, 1.0)]) and not verify.rows_equal([(None,)], [(0,)])
    assert not verify.rows_equal([("1",)], [(1,)]) and not verify.rows_equal([(True,)], [(1,)])
    assert verify.rows_equal([(1.0,)] * 5000, [(1.0000005,)] * 5000) and not verify.rows_equal([(1.0,)] * 2, [(1.0,)])


def test_columns_are_placed_without_trying_every_order():
    rows_ = [tuple(range(i, i + 12)) for i in range(40)]
    assert verify.permuted_equal(rows_, [r[::-1] for r in rows_])
    assert not verify.permuted_equal([(1, 2), (2, 1)], [(1, 1), (2, 2)])
    assert verify.permuted_equal([(1, 2), (3, 4)], [(2, 1), (4, 3)], ordered=True) and not verify.permuted_equal([(1, 2), (3, 4)], [(4, 3), (2, 1)], ordered=True)


def test_verification_stops_in_time(spark):
    space = Namespace(spark, {"n": spark.range(3000).repartition(4).withColumnRenamed("id", "x")})
    g = Gate(spark, space, Limits(verifier_seconds=2))
    v = verify.verify(g, "SELECT count(*) FROM n a, n b, n c WHERE a.x + b.x + c.x = -1", "SELECT 0")
    assert (v.valid, v.executable, v.error) == (True, False, "timeout")
    few = Gate(spark, space, Limits(verifier_rows=100, verifier_seconds=60))
    assert verify.verify(few, "SELECT x FROM n", "SELECT x FROM n").error == "result_too_large"


def test_similarity_counts_what_the_query_has(spark, tmp_path):
    for name in ("id_a", "id_b"):
        spark.createDataFrame([(1, "x")], "id_x int, id_y string").write.parquet(str(tmp_path / name))
    space = Namespace(spark, {name: spark.read.parquet(str(tmp_path / name)) for name in ("id_a", "id_b")})
    g = Gate(spark, space)
    for a, b in [("SELECT id_x FROM id_a", "SELECT id_x FROM id_b"), ("SELECT id_x FROM id_a WHERE id_y IS NOT NULL", "SELECT id_x FROM id_a"), ("SELECT CAST(id_x AS STRING) AS v FROM id_a", "SELECT id_x AS v FROM id_a")]:
        assert 0 < similarity.similarity(g, a, b) < 1, (a, b)
        assert similarity.similarity(g, a, a) == 1
