"""What SQL similarity holds equal, what it tells apart, and that its edits are the cheapest."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quern.plans import similarity as S
from quern.plans.gate import Gate
from quern.plans.similarity import Matching, Node
from quern.sources.catalog import Namespace


@pytest.fixture(scope="module")
def gate(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "x", 30, 2)], "id int, name string, age int, boss int").write.parquet(f"{base}/staff")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(f"{base}/team")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(f"{base}/club")
    return Gate(spark, Namespace(spark, {n: spark.read.parquet(f"{base}/{n}") for n in ("staff", "team", "club")}))


EQUAL = {
    "spelling": ("SELECT s.name FROM staff s", " select st.NAME from STAFF as st; -- same"), "backticks": ("SELECT name FROM staff", "SELECT `name` FROM `staff`"),
    "and": ("SELECT name FROM staff WHERE age > 18 AND id = 1", "SELECT name FROM staff WHERE id = 1 AND (age > 18)"),
    "nested_and": ("SELECT name FROM staff WHERE (age > 18 AND id = 1) AND boss = 2", "SELECT name FROM staff WHERE boss = 2 AND (id = 1 AND age > 18)"),
    "or": ("SELECT name FROM staff WHERE id = 1 OR id = 2", "SELECT name FROM staff WHERE id = 2 OR id = 1"), "turned": ("SELECT name FROM staff WHERE age > 18", "SELECT name FROM staff WHERE 18 < age"),
    "unequal": ("SELECT name FROM staff WHERE age <> 18", "SELECT name FROM staff WHERE age != 18"), "in": ("SELECT name FROM staff WHERE id IN (1, 2, NULL)", "SELECT name FROM staff WHERE id IN (NULL, 2, 1)"),
    "asc": ("SELECT name FROM staff ORDER BY age", "SELECT name FROM staff ORDER BY age ASC"), "order_alias": ("SELECT name AS a FROM staff ORDER BY a", "SELECT name AS b FROM staff ORDER BY b"),
    "order_column": ("SELECT name AS a FROM staff ORDER BY a", "SELECT name FROM staff ORDER BY name"), "order_place": ("SELECT name FROM staff ORDER BY 1", "SELECT name FROM staff ORDER BY name"),
    "derived": ("SELECT x.n FROM (SELECT name AS n FROM staff) x", "SELECT y.m FROM (SELECT name AS m FROM staff) y"), "cte": ("WITH x AS (SELECT name FROM staff) SELECT name FROM x", "WITH y AS (SELECT name FROM staff) SELECT name FROM y"),
    "self_join": ("SELECT a.name FROM staff a JOIN staff b ON a.boss = b.id", "SELECT x.name FROM staff x JOIN staff y ON x.boss = y.id"),
    "join_block": ("SELECT s.name FROM staff s JOIN team t ON s.id = t.id WHERE t.name = 'A'", "SELECT s.name FROM team t JOIN staff s ON s.id = t.id AND t.name = 'A'"),
    "exists": ("SELECT a.name FROM staff a WHERE EXISTS (SELECT 1 FROM staff b WHERE b.id = a.boss)", "SELECT x.name FROM staff x WHERE EXISTS (SELECT 1 FROM staff y WHERE y.id = x.boss)"),
    "star": ("SELECT * FROM staff", "SELECT id, name, age, boss FROM staff"), "table_star": ("SELECT staff.* FROM staff", "SELECT s.* FROM staff s"), "star_limit": ("SELECT * FROM staff LIMIT 2", "SELECT id, name, age, boss FROM staff LIMIT 2"),
    "twice": ("SELECT name FROM staff WHERE age > 18 AND age > 18", "SELECT name FROM staff WHERE age > 18"), "true": ("SELECT name FROM staff WHERE age > 18 AND 1 = 1", "SELECT name FROM staff WHERE age > 18"),
    "cte_inlined": ("WITH x AS (SELECT name FROM staff) SELECT name FROM x", "SELECT name FROM staff"), "derived_inlined": ("SELECT x.n FROM (SELECT name AS n FROM staff) x", "SELECT name FROM staff"),
    "null_order": ("SELECT name FROM staff ORDER BY name", "SELECT name FROM staff ORDER BY name NULLS FIRST"), "cte_twice": ("WITH x AS (SELECT id, boss FROM staff) SELECT a.id FROM x a JOIN x b ON a.id = b.boss", "SELECT a.id FROM staff a JOIN staff b ON a.id = b.boss"),
}

#: Pairs that differ, and the distance where it is certain.
DIFFERENT = {
    "number": ("SELECT name FROM staff WHERE age > 18", "SELECT name FROM staff WHERE age > 20", 1), "column": ("SELECT name FROM staff", "SELECT age FROM staff", 1),
    "comparison": ("SELECT name FROM staff WHERE age > 18", "SELECT name FROM staff WHERE age >= 18", 1), "letter": ("SELECT name FROM staff WHERE name = 'A'", "SELECT name FROM staff WHERE name = 'a'", 1),
    "literal_type": ("SELECT 1 AS x FROM staff", "SELECT '1' AS x FROM staff", 1), "compared_type": ("SELECT name FROM staff WHERE age = 18", "SELECT name FROM staff WHERE age = '18'", 1),
    "nulls": ("SELECT name FROM staff ORDER BY name", "SELECT name FROM staff ORDER BY name NULLS LAST", 1), "direction": ("SELECT name FROM staff ORDER BY age ASC", "SELECT name FROM staff ORDER BY age DESC", 1),
    "below_limit": ("SELECT name FROM staff LIMIT 5", "SELECT age FROM staff LIMIT 5", 1), "below_filter_limit": ("SELECT name FROM staff WHERE id = 1 LIMIT 1", "SELECT age FROM staff WHERE id = 1 LIMIT 1", 1),
    "swapped": ("SELECT name, id FROM staff LIMIT 2", "SELECT id, name FROM staff LIMIT 2", 2), "arm": ("SELECT id FROM staff UNION ALL SELECT id FROM team", "SELECT age FROM staff UNION ALL SELECT id FROM team", 1),
    "from_derived": ("SELECT x FROM (SELECT name AS x, id AS y FROM staff LIMIT 5)", "SELECT y FROM (SELECT name AS x, id AS y FROM staff LIMIT 5)", None),
    "arms_joined": ("SELECT * FROM team t JOIN club c ON t.id = c.id UNION ALL SELECT * FROM team t JOIN club c ON t.id = c.id", "SELECT * FROM club c JOIN team t ON t.id = c.id UNION ALL SELECT * FROM team t JOIN club c ON t.id = c.id", None),
    "distinct": ("SELECT name FROM staff", "SELECT DISTINCT name FROM staff", None), "count": ("SELECT count(*) FROM staff", "SELECT count(id) FROM staff", 1), "count_distinct": ("SELECT count(id) FROM staff", "SELECT count(DISTINCT id) FROM staff", 1),
    "function": ("SELECT max(age) FROM staff", "SELECT min(age) FROM staff", 1), "cast": ("SELECT CAST(age AS INT) FROM staff", "SELECT CAST(age AS STRING) FROM staff", 1), "limit": ("SELECT name FROM staff LIMIT 1", "SELECT name FROM staff LIMIT 2", None),
    "places": ("SELECT name, age FROM staff", "SELECT age, name FROM staff", 2), "orders": ("SELECT name FROM staff ORDER BY age, id", "SELECT name FROM staff ORDER BY id, age", None), "not": ("SELECT name FROM staff WHERE age = 18", "SELECT name FROM staff WHERE NOT age = 18", 1),
    "role": ("SELECT a.name FROM staff a JOIN staff b ON a.boss = b.id", "SELECT b.name FROM staff a JOIN staff b ON a.boss = b.id", None), "outer": ("SELECT a.name FROM staff a JOIN team b ON a.id = b.id", "SELECT a.name FROM staff a LEFT JOIN team b ON a.id = b.id", None),
    "star_places": ("SELECT * FROM staff s JOIN team c ON s.id = c.id", "SELECT * FROM team c JOIN staff s ON s.id = c.id", None),
    "collation": ("SELECT name FROM staff WHERE name COLLATE UNICODE_CI = 'a'", "SELECT name FROM staff WHERE name COLLATE UTF8_BINARY = 'a'", None),
    "correlation": ("SELECT a.name FROM staff a WHERE EXISTS (SELECT 1 FROM staff b WHERE b.id = a.boss)", "SELECT a.name FROM staff a WHERE EXISTS (SELECT 1 FROM staff b WHERE b.id = b.boss)", None),
    "union": ("SELECT name FROM staff UNION SELECT name FROM team", "SELECT name FROM staff UNION ALL SELECT name FROM team", None), "window": ("SELECT row_number() OVER (ORDER BY age) FROM staff", "SELECT row_number() OVER (ORDER BY age DESC) FROM staff", None),
    "having": ("SELECT age, count(*) FROM staff GROUP BY age HAVING count(*) > 1", "SELECT age, count(*) FROM staff WHERE age > 1 GROUP BY age", None),
    "counts_of_two": ("SELECT a.c FROM (SELECT age, count(*) AS c FROM staff GROUP BY age) a JOIN (SELECT boss, count(*) AS c FROM staff GROUP BY boss) b ON a.age = b.boss", "SELECT b.c FROM (SELECT age, count(*) AS c FROM staff GROUP BY age) a JOIN (SELECT boss, count(*) AS c FROM staff GROUP BY boss) b ON a.age = b.boss", None),
    "constant_of_outer": ("SELECT s.id, x.k FROM staff s LEFT JOIN (SELECT id, 1 AS k FROM team) x ON s.id = x.id", "SELECT s.id, 1 FROM staff s LEFT JOIN (SELECT id, 1 AS k FROM team) x ON s.id = x.id", None),
    "is_null": ("SELECT name FROM staff WHERE name IS NOT NULL", "SELECT name FROM staff", None), "never": ("SELECT name FROM staff WHERE 1 = 0", "SELECT age FROM staff WHERE 1 = 0", None), "escape": ("SELECT name FROM staff WHERE name LIKE 'a%' ESCAPE '/'", "SELECT name FROM staff WHERE name LIKE 'a%' ESCAPE '#'", None),
    "same_shape": ("SELECT t.name FROM team t", "SELECT c.name FROM club c", None), "frame": ("SELECT sum(age) OVER (ORDER BY id ROWS 1 PRECEDING) FROM staff", "SELECT sum(age) OVER (ORDER BY id ROWS 2 PRECEDING) FROM staff", None),
}

UNSCORABLE = ["", "SELECT FROM", "SELECT 1; SELECT 2", "DELETE FROM staff", "SELECT missing FROM staff", "SELECT count(*) FROM nowhere", "SELECT name FROM staff JOIN team ON staff.id = team.id", None]


@pytest.fixture(scope="module")
def scored(gate):
    rows = [(n, a, b) for n, (a, b) in EQUAL.items()] + [(n, a, b) for n, (a, b, _) in DIFFERENT.items()]
    rows += [(f"{n} back", b, a) for n, a, b in rows] + [(f"no {i}", x, "SELECT name FROM staff") for i, x in enumerate(UNSCORABLE)]
    df = gate.spark.createDataFrame(rows, "id string, left string, right string").withColumn("more", F.lit(7))
    return {r["id"]: r for r in S.score_table(gate, df).collect()}


@pytest.mark.parametrize("name", EQUAL)
def test_held_equal(scored, name):
    r = scored[name]
    assert (r["status"], r["distance"], r["similarity"], r["edits"], r["more"]) == ("scored", 0, 1.0, [], 7), r


@pytest.mark.parametrize("name", DIFFERENT)
def test_told_apart(scored, name):
    r, back, want = scored[name], scored[f"{name} back"], DIFFERENT[name][2]
    assert r["distance"] > 0 and r["similarity"] < 1, r
    assert want is None or r["distance"] == want, r
    assert len(r["edits"]) == r["distance"] == back["distance"] and r["similarity"] == back["similarity"] == 1 - r["distance"] / max(r["left_size"], r["right_size"])
    assert sum(e["op"] == "insert" for e in r["edits"]) == sum(e["op"] == "delete" for e in back["edits"])


def test_what_cannot_be_scored(gate, scored):
    for i, _ in enumerate(UNSCORABLE):
        r = scored[f"no {i}"]
        assert r["status"].startswith("unscorable") and r["distance"] is None and r["similarity"] is None and r["edits"] is None
    with pytest.raises(S.GateError):
        S.prepare(gate, "SELECT name FROM staff", max_nodes=2)
    assert gate.spark.conf.get(S.EXCLUDED, None) is None
    assert S.score_table(gate, gate.spark.createDataFrame([], "left string, right string")).count() == 0


def test_edits_name_what_changed(scored):
    (e,) = scored["number"]["edits"]
    assert (e["op"], e["left"], e["right"]) == ("replace", "literal int 18", "literal int 20") and e["left_path"] == e["right_path"]


def forest_distance(a: Node, b: Node) -> int:
    """By trying everything: forests as nested tuples."""
    pack = lambda n: (n.label, tuple(map(pack, n.children)))
    size = lambda f: sum(1 + size(c) for _, c in f)

    @lru_cache(None)
    def go(f, g):
        if not f or not g:
            return size(f or g)
        (x, cx), (y, cy) = f[-1], g[-1]
        return min(go(f[:-1] + cx, g) + 1, go(f, g[:-1] + cy) + 1, go(f[:-1], g[:-1]) + go(cx, cy) + (x != y))

    return go((pack(a),), (pack(b),))


def test_edits_of_random_trees_cost_the_least():
    rng = random.Random(2)

    def grow(n):
        nodes = [Node(rng.choice("abc")) for _ in range(n)]
        for i in range(1, n):
            nodes[rng.randrange(i)].children.append(nodes[i])
        return nodes[0]

    for _ in range(400):
        a, b = grow(rng.randint(1, 9)), grow(rng.randint(1, 9))
        m = Matching(a, b)
        pairs, edits = m.pairs(), m.edits()
        assert m.distance == forest_distance(a, b) == len(edits)
        left, right = ([p[i] for p in pairs if p[i] is not None] for i in (0, 1))
        assert sorted(left) == list(range(a.size())) and sorted(right) == list(range(b.size()))
        both = sorted(p for p in pairs if None not in p)
        # A mapping of ordered trees keeps post-order, and ancestors.
        assert [q for _, q in both] == sorted(q for _, q in both)
        (_, fa, _), (_, fb, _) = m.a, m.b
        assert all((fa[p2] <= p1) == (fb[q2] <= q1) for p1, q1 in both for p2, q2 in both if p1 < p2)


def test_a_pair_of_texts_is_matched_once_for_all_its_rows(spark, monkeypatch):
    """rows of the same pair, repeated or null, share one match."""
    gate = Gate(spark, Namespace(spark, {"n": spark.range(3)}))
    a, b = "SELECT id FROM n WHERE id > 1", "SELECT id FROM n WHERE id > 2"
    rows = [(i, a if i % 5 else None, b if i % 3 else "SELEC") for i in range(300)] + [(0, None, "SELEC")]
    taken, plain = [], S._matched

    def matched(pairs, *x):
        taken.append(pairs.count())
        return plain(pairs, *x)

    monkeypatch.setattr(S, "_matched", matched)
    got = S.score_table(gate, spark.createDataFrame(rows, "i int, left string, right string")).select("i", "status", "distance").collect()
    want = [(i, "unscorable:empty_sql" if x is None else "unscorable:parse_error" if y != b else "scored", 1 if x and y == b else None) for i, x, y in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert taken == [2]
