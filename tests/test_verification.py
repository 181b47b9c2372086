"""Many verifications at once, tables of result pairs, and what curation asks of a record."""

import itertools
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import protocol
from quern.limits import Limits
from quern.operators import trajectories as T
from quern.operators import verify
from quern.plans.gate import Gate
from quern.sources.catalog import Namespace


@pytest.fixture(scope="module")
def gate(spark):
    space = Namespace(spark, {"n": spark.range(0, 2000, 1, 1).withColumnRenamed("id", "x"), "few": spark.range(40).coalesce(1).withColumnRenamed("id", "x")})
    return Gate(spark, space, Limits(verifier_seconds=4))


def test_two_hundred_candidates_one_of_which_never_ends(spark, gate):
    endless = "SELECT count(*) FROM n a, n b, n c WHERE (a.x * b.x + c.x) % 7 = 9"
    pairs = [(i, f"SELECT count(*) FROM few WHERE x < {i % 50}", "SELECT 7 AS a") for i in range(200)]
    pairs[30] = (30, endless, "SELECT 7 AS a")
    pairs[60] = (60, "SELECT nothing FROM few", "SELECT 7 AS a")
    pairs[90] = (90, "SELECT 7 AS a", "SELECT missing FROM few")
    pairs[120] = (120, "SELECT x FROM few ORDER BY x DESC", "SELECT x FROM few ORDER BY x")
    began = time.time()
    told = dict(verify.verify_many(gate, pairs))
    took = time.time() - began
    assert list(told) == list(range(200))
    assert told[30].error == "timeout" and told[60].error == "unknown_column" and told[90].error == "reference_unknown_column" and told[120].order_sensitive and not told[120].correct
    for i in set(range(200)) - {30, 60, 90, 120}:
        assert told[i].correct == (min(i % 50, 40) == 7) and told[i].executable, (i, told[i])
    alone = time.time()
    for i in range(40, 50):
        verify.verify(gate, *pairs[i][1:])
    assert took < 4 + 200 * (time.time() - alone) / 10  # the endless one's limit is beside the others, not after them
    table = spark.createDataFrame([(*p[:2], p[2]) for p in pairs[:20]] + [(500, None, "SELECT 7 AS a")], "id long, candidate string, reference string")
    got = {r["id"]: r for r in verify.verify_table(gate, table, chunk=7).collect()}
    assert len(got) == 21 and got[500]["error"] == "empty_sql" and [i for i in range(20) if got[i]["correct"]] == [7]


def test_work_is_taken_as_it_is_needed(spark):
    begun = []

    def work():
        for i in range(40):
            begun.append(i)
            yield lambda i=i: i * i

    results = verify.side_by_side(spark, work(), at_once=3)
    assert next(results) == 0 and len(begun) <= 7
    assert [0, *results] == [i * i for i in range(40)]

    def broken():
        raise KeyError("x")

    with pytest.raises(KeyError):
        list(verify.side_by_side(spark, [broken], 2))


def brute_permuted(a, b):
    return len(a) == len(b) and any(sorted(map(repr, a)) == sorted(repr(tuple(r[i] for i in p)) for r in b) for p in itertools.permutations(range(len((a or b or [()])[0]))))


def test_permuted_results_equal_trying_all_orders(spark):
    rng = random.Random(8)
    left, right, want = [], [], {}
    for task in range(160):
        a = [tuple(rng.choice([None, 0, 1, 2**53 + rng.randint(0, 1)]) for _ in range(3)) for _ in range(rng.randint(0, 5))]
        order = rng.sample(range(3), 3)
        b = [tuple(r[i] for i in order) for r in rng.sample(a, len(a))]
        if b and rng.random() < 0.5:
            i, c = rng.randrange(len(b)), rng.randrange(3)
            b[i] = (*b[i][:c], rng.choice([None, 0, 1]), *b[i][c + 1 :])
        left += [(task, *r) for r in a]
        right += [(task, *r) for r in b]
        if a or b:
            want[task] = brute_permuted(a, b)
    left, right = left + [(None, 1, 2, 3), (900, 1, 1, 1)], right + [(None, 3, 1, 2), (901, 1, 1, 1)]
    want |= {None: True, 900: False, 901: False}
    l, r = (spark.createDataFrame(x, f"task long, {n}0 long, {n}1 long, {n}2 long").repartition(3) for x, n in ((left, "a"), (right, "b")))
    assert {x["task"]: x["equal"] for x in verify.permuted_results(l, r, "task").collect()} == want
    assert {x["equal"] for x in verify.permuted_results(l, r.drop("b2"), "task").collect()} == {False}
    assert verify.permuted_results(l.limit(0), r.limit(0), "task").count() == 0


def test_numbers_agree_whatever_their_type(spark):
    l = spark.sql("SELECT 1 AS task, CAST(2 AS INT) AS a, CAST(1.50 AS DECIMAL(9,2)) AS b UNION ALL SELECT 2, 3, 2.25")
    r = spark.sql("SELECT 1 AS task, CAST(2.00 AS DECIMAL(9,2)) AS a, 1.5D AS b UNION ALL SELECT 2, 3.01, 2.25D")
    x = {k: verify.exact_text(kind, F.col(k)) for k, kind in r.dtypes}
    assert [tuple(v) for v in r.select(x["a"], x["b"]).collect()][0] == ("2", "d1.5")
    assert {v["task"]: v["equal"] for v in verify.permuted_results(l.drop("b"), r.drop("b"), "task").collect()} == {1: True, 2: False}
    a, b = spark.createDataFrame([(2**53,)], "x long"), spark.createDataFrame([(2**53 + 1,)], "x long")
    assert verify.set_mark(a).first() != verify.set_mark(b).first()
    assert verify.set_mark(spark.sql("SELECT NULL AS a, 'x' AS b")).first() != verify.set_mark(spark.sql("SELECT 'x' AS a, NULL AS b")).first()


def test_many_alike_columns_are_placed_in_time():
    rng = random.Random(3)
    base = [tuple(rng.randint(0, 1) for _ in range(9)) for _ in range(12)]
    assert verify.permuted_equal(base, [r[::-1] for r in base])
    other = [(*r[:8], 1 - r[8]) for r in base]
    began = time.time()
    verify.permuted_equal(base, [r[::-1] for r in other])
    assert time.time() - began < 20


# Curation

GIVEN = ["I use the golden query", "the gold_sql says", "Gold-Answer", "the provided hint says so", "a privileged  hint", "the teacher answer is 3", "teacher's SQL", "internally supplied value", "an internal calibration", "continuation instruction", "内部校准", "按参考答案", "教师答案", "提供的查询", "指定的最终 SQL"]
PLAIN = ["I check the expected result of the join", "I look at the reference result set", "goldfish query", "the marigold sql", "a hint", "internal join", "answer of the teacher", "指定的列", "", None]


def test_phrases_that_give_an_answer_away(spark):
    df = spark.createDataFrame([(x, x in GIVEN) for x in GIVEN + PLAIN], "text string, want boolean")
    assert df.where(protocol.external_reference(F.col("text")) != F.col("want")).collect() == []


def step(tool, reasoning="I think", sql="SELECT 1", status="success", said=None, observation="seen", replayed="seen", prompt="go on"):
    arguments = "{}" if tool == "list_tables" else f'{{"sql": "{sql}"}}'
    return dict(response=f'<reasoning>{reasoning}</reasoning>\n<tool>{{"name": "{said or tool}", "arguments": {arguments}}}</tool>', prompt=prompt, tool=tool, arguments=arguments, status=status, observation=observation, replayed=replayed)


FINE = [step("list_tables"), step("execute_sql"), step("submit_sql", observation="verified", replayed=None)]
RECORD = dict(
    split="train", correct=True, question="q", task_question="q", db_id="d", task_db_id="d", messages=7, reference_ok=True, final_sql="SELECT 1", reference_sql="SELECT 1", final_ok=True, regenerated=True,
    generation_mode="full_regeneration_from_question", leak_audit="accept", eligible=True,
)
CASES = [
    (None, FINE, {}), ("wrong_split", FINE, {"split": "dev"}), ("wrong_split", FINE, {"correct": None}), ("task_mismatch", FINE, {"question": "other"}), ("partly_regenerated", FINE, {"generation_mode": "continuation"}), (None, FINE, {"generation_mode": None, "regenerated": False}),
    ("turn_mismatch", FINE, {"messages": 6}), ("teacher_text", [FINE[0], step("execute_sql", prompt="see <teacher_only_sql>x"), FINE[2]], {}), ("reference_failed", FINE, {"reference_ok": False}), ("response_mismatch", [FINE[0], step("execute_sql", said="inspect_values"), FINE[2]], {}),
    ("external_reference", [FINE[0], step("execute_sql", "as the golden SQL has it"), FINE[2]], {}), ("wrong_first_tool", FINE[1:], {"messages": 5}), ("no_submission", FINE[:2], {"messages": 5}), ("premature_submission", [FINE[0], FINE[2], FINE[2]], {}),
    ("not_executed_right_before", [FINE[0], FINE[1], step("execute_sql", sql="SELECT 2"), FINE[2]], {"messages": 9}), (None, [FINE[0], FINE[1], step("execute_sql", sql="SELECT 2"), FINE[2]], {"messages": 9, "regenerated": False}),
    ("not_executed", [FINE[0], step("execute_sql", status="error"), FINE[2]], {"regenerated": False}), ("final_sql_mismatch", FINE, {"final_sql": "SELECT 2"}), ("not_the_reference", FINE, {"reference_sql": "SELECT 1 "}),
    ("observation_mismatch", [step("list_tables", replayed="other"), *FINE[1:]], {}), ("not_verified", FINE, {"final_ok": None}),
]


def test_each_rule_of_curation(spark):
    turns = [dict(conv_id=i, turn=n, **s) for i, (_, steps, _) in enumerate(CASES) for n, s in enumerate(steps)]
    facts = T.turn_facts(spark.createDataFrame(turns, "conv_id int, turn int, response string, prompt string, tool string, arguments string, status string, observation string, replayed string"))
    kinds = {True: "boolean", 7: "int"}
    records = spark.createDataFrame([dict(conv_id=i, **{**RECORD, **more}) for i, (_, _, more) in enumerate(CASES)], "conv_id int, " + ", ".join(f"{k} {'int' if k == 'messages' else kinds.get(v, 'string') if isinstance(v, bool) else 'string'}" for k, v in RECORD.items()))
    told = {r["conv_id"]: r["reason"] for r in facts.join(records, "conv_id").select("conv_id", T.first_broken(T.curation_rules()).alias("reason")).collect()}
    assert told == {i: c[0] for i, c in enumerate(CASES)}


def _random_value(rng, kind):
    if rng.random() < 0.15:
        return None
    if kind == "double":
        x = rng.choice([0.0, -0.0, 1.0, 2.5, 1e300, float("inf"), float("-inf"), float("nan")])
        return x * (1 + rng.choice([0, 4e-7, 8e-7, -8e-7, 3e-6])) if x == x and abs(x) < 1e301 else x
    return rng.choice([1, 2, 2**53, 2**53 + 1]) if kind == "long" else rng.choice(["1", "a", "ab", "", ":"]) if kind == "string" else rng.choice([True, False])


@pytest.mark.parametrize("ordered", [False, True])
def test_tables_of_results_agree_with_results_one_by_one(spark, ordered):
    """F1 to F4: the tasks of a batch are compared together, whatever they hold and wherever a batch ends."""
    rng = random.Random(5)
    kinds, left, right, want = ("double", "double", "long", "string", "boolean"), [], [], {}
    for task in range(600):
        use = rng.sample(range(5), rng.randint(1, 5))
        row = lambda: tuple(_random_value(rng, k) if i in use else None for i, k in enumerate(kinds))
        a = [row() for _ in range(rng.choice([0, 1, 1, 2, 3, 8, 40]))]
        b = list(a) if ordered and rng.random() < 0.7 else rng.sample(a, len(a))
        b = [tuple(v * (1 + rng.choice([0, 0, 9e-7, -9e-7])) if isinstance(v, float) and abs(v) < 1e300 else v for v in r) for r in b]
        if b and rng.random() < 0.3:
            b[rng.randrange(len(b))] = row()
        if b and rng.random() < 0.1:
            b.pop()
        if a or b:
            key = task if task else None
            want[key] = verify.rows_equal(a, b, ordered)
            left += [(key, i, *r) for i, r in enumerate(a)]
            right += [(key, i, *r) for i, r in enumerate(b)]
    assert 50 < sum(want.values()) < len(want) - 50
    schema = "task long, place int, " + ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    l, r = (spark.createDataFrame(rng.sample(x, len(x)), schema).repartition(3) for x in (left, right))
    if not ordered:
        l, r = l.drop("place"), r.drop("place")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = verify.results_equal(l, r, "task", "place" if ordered else None)
        assert "CoGroup" not in got._jdf.queryExecution().toString()  # a call of Python a task takes a millisecond
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rows) == len(want) and {x["task"]: x["equal"] for x in rows} == want


def test_few_results_of_many_rows_and_many_of_few_come_in_few_batches(spark):
    """F2 to F4: calls of Python grow with rows, not with tasks; results are whole wherever a batch or a table ends."""
    tasks = [*range(15_000), *[15_000] * 12_000, *sorted([*range(15_001, 15_011)] * 2_900), None]
    batches = [pa.RecordBatch.from_arrays([pa.array(tasks[i : i + 1_000], pa.int64())], ["task"]) for i in range(0, len(tasks), 1_000)]
    tables = [rows["task"].to_pylist() for rows, _ in verify.whole_tasks(iter(batches))]
    # A table leaves its last task to the next, so that any two in a row have TOGETHER rows at least.
    assert [t for x in tables for t in x] == tasks and len(tables) <= 2 * len(tasks) / verify.TOGETHER + 1
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
    # Nine results of 9,000 rows: equal, one number off at either end, two rows that change places.
    rows = spark.range(81_000).selectExpr("id % 9 AS task", "id DIV 9 AS place", "CAST(id AS DOUBLE) AS x", "'s' AS s")
    off = "CASE WHEN task = 3 AND place = 0 OR task = 4 AND place = 8999 THEN x + 1 ELSE x * (1 + 5e-7) END AS x"
    other = rows.selectExpr("task", "CASE WHEN task = 5 AND place < 2 THEN 1 - place ELSE place END AS place", off, "s")
    got = {ordered: {r["task"]: r["equal"] for r in verify.results_equal(*(x if ordered else x.drop("place") for x in (rows, other)), "task", "place" if ordered else None).collect()} for ordered in (False, True)}
    assert got[False] == {t: t not in (3, 4) for t in range(9)} and got[True] == {t: t not in (3, 4, 5) for t in range(9)}


def test_pairs_within_the_tolerance_need_not_be_neighbours_in_order(spark):
    a = spark.createDataFrame([("t", 1.0, 5.0), ("t", 1.0 + 5e-7, 7.0), ("u", 1.0, 5.0), ("u", 1.0 + 5e-7, 7.0)], "task string, x double, y double")
    b = spark.createDataFrame([("t", 1.0 + 5e-7, 5.0), ("t", 1.0, 7.0), ("u", 1.0, 5.0), ("u", 1.0 + 5e-6, 7.0)], "task string, z double, x double")
    assert {r["task"]: r["equal"] for r in verify.results_equal(a, b, "task").collect()} == {"t": True, "u": False}
    assert {r["equal"] for r in verify.results_equal(a, b.drop("z"), "task").collect()} == {False}


def test_nested_values_in_tables_of_results(spark):
    a = spark.sql("SELECT * FROM VALUES (1, array(1, 2), DATE'2020-01-01', X'00ff'), (2, array(1), DATE'2020-01-02', NULL) AS x(task, a, d, b)")
    b = spark.sql("SELECT * FROM VALUES (1, array(1, 2), DATE'2020-01-01', X'00ff'), (2, array(2), DATE'2020-01-02', NULL) AS x(task, a, d, b)")
    assert {r["task"]: r["equal"] for r in verify.results_equal(a, b, "task").collect()} == {1: True, 2: False}


def test_orders_of_columns_are_tried_by_signatures(spark):
    """results whose columns have several places are told in the plan; rows meet in Python only beyond TRIED choices."""
    left = [(t, i % 2, (i + t) % 2, i // 2) for t in range(40) for i in range(4)]
    right = [(t, c, a, b if t % 3 else a) for t, a, b, c in left]
    l, r = (spark.createDataFrame(x, "task long, a long, b long, c long") for x in (left, right))
    rows = {t: [[tuple(x[1:]) for x in side if x[0] == t] for side in (left, right)] for t in range(40)}
    got = verify.permuted_results(l, r, "task")
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    assert {x["task"]: x["equal"] for x in got.collect()} == {t: brute_permuted(a, b) for t, (a, b) in rows.items()}
    old, verify.TRIED = verify.TRIED, 1
    try:
        assert {x["task"]: x["equal"] for x in verify.permuted_results(l, r, "task").collect()} == {t: brute_permuted(a, b) for t, (a, b) in rows.items()}
    finally:
        verify.TRIED = old


def test_results_stay_on_the_executors(spark, gate, monkeypatch):
    """the driver gets one row of a result; verdicts are those of the rows, with order and tolerance."""
    got, plain = [], Gate.collect
    monkeypatch.setattr(Gate, "collect", lambda self, df, seconds=None: got.append(r := plain(self, df, seconds)) or r)
    wide = "SELECT x, concat('n', x) AS s, x * {} AS d FROM n{}"
    cases = [
        (wide.format("1.0D", " ORDER BY x DESC"), wide.format("1.0D", ""), True, False),
        (wide.format("1.0D", " ORDER BY x DESC"), wide.format("1.0D", " ORDER BY x"), False, True),
        (wide.format("1.0D", " ORDER BY concat(x, '') DESC, x"), wide.format("1.0D", " ORDER BY concat(x, '') DESC"), True, True),
        (wide.format("1.0000005D", ""), wide.format("1.0D", ""), True, False),
        (wide.format("1.0000005D", " ORDER BY x"), wide.format("1.0D", " ORDER BY x"), True, True),
        (wide.format("1.001D", ""), wide.format("1.0D", ""), False, False),
        ("SELECT a.x, b.x FROM few a JOIN few b ON a.x = b.x ORDER BY 1 LIMIT 7", "SELECT x AS p, x AS q FROM few WHERE x < 7 ORDER BY x", True, True),
        ("SELECT 'a' AS s, array(x) AS l FROM few", "SELECT 'a' AS s, array(x + 1) AS l FROM few", False, False),
        ("SELECT NULL AS x", "SELECT CAST(NULL AS INT) AS x", True, False), ("SELECT '1' AS x", "SELECT 1 AS x", False, False), ("SELECT x FROM few WHERE x < 0", "SELECT x FROM few WHERE x > 90", True, False),
    ]
    for candidate, reference, correct, ordered in cases:
        v = verify.verify(gate, candidate, reference)
        assert (v.correct, v.order_sensitive, v.error) == (correct, ordered, None if correct else "wrong_result"), (candidate, v)
    assert len(got) > len(cases) and max(map(len, got)) == 1
    tight = Gate(spark, gate.namespace, Limits(verifier_seconds=30, verifier_rows=39))
    assert verify.verify(tight, "SELECT x FROM few", "SELECT 1").error == "result_too_large"
    assert verify.verify(Gate(spark, gate.namespace, Limits(verifier_seconds=30, verifier_bytes=69)), "SELECT x FROM few", "SELECT 1").error == "result_too_large"
