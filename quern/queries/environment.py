"""The SQL environment: gate, catalog, verification, votes, similarity, over the star schema.

Oracles of checks on fixed SQL texts state the verdicts that the checks must reach.
"""

from pyspark.sql import functions as F

from quern.functions import protocol as P
from quern.functions.counting import token_counts
from quern.limits import Limits
from quern.operators import verify as V
from quern.plans import similarity as Q
from quern.plans.gate import Gate, text_size
from quern.queries.base import TABLES, query
from quern.session import shared_folder
from quern.sources import jsonl
from quern.sources.catalog import FOREIGN, PRIMARY, Namespace, namespace

STAR = TABLES[:7]


def gate(t):
    # A busy session may take long to plan; the time limits are not what these queries show.
    return Gate(t.spark, namespace(t.spark, t.sf_dir, STAR), Limits(query_seconds=120, verifier_seconds=120))


def values(columns: str, rows: list[tuple]) -> str:
    def lit(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) x({columns})"


def frame(t, schema: str, rows: list[tuple]):
    return t.spark.createDataFrame(rows, schema)


GATE_CASES = [
    ("empty", "  ", "empty_sql"), ("comment", "-- nothing", "empty_sql"), ("syntax", "SELEC 1", "parse_error"), ("two", "SELECT 1; SELECT 2", "multiple_statements"),
    ("trailing", "SELECT 1 AS x;", None), ("insert", "INSERT INTO nation VALUES (1, 'x', 2)", "forbidden_sql"), ("drop", "DROP TABLE nation", "forbidden_sql"),
    ("create", "CREATE TABLE x AS SELECT 1", "forbidden_sql"), ("set", "SET a = b", "forbidden_sql"), ("show", "SHOW TABLES", "forbidden_sql"), ("path", "SELECT * FROM parquet.`/etc`", "forbidden_sql"),
    ("range", "SELECT * FROM range(10)", "forbidden_sql"), ("java", "SELECT java_method('java.lang.System', 'exit', 1)", "forbidden_sql"), ("nested", "SELECT (SELECT reflect('a', 'b')) AS x", "forbidden_sql"),
    ("unknown_table", "SELECT * FROM nowhere", "unknown_table"), ("unknown_column", "SELECT nothing FROM nation", "unknown_column"), ("ambiguous", "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", "ambiguous_column"),
    ("ungrouped", "SELECT n_name, count(*) FROM nation", "execution_error"), ("routine", "SELECT no_such(1)", "execution_error"), ("cte", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", None),
    ("semicolon_in_string", "SELECT ';' AS x", None), ("nul", "SELECT 1\0", "parse_error"), ("fine", "SELECT n_name FROM nation WHERE n_regionkey = 1", None),
]


@query(values("name, error", [(n, e) for n, _, e in GATE_CASES]))
def g1_gate(t):
    g = gate(t)
    return frame(t, "name string, error string", [(n, g.error_of(sql)) for n, sql, _ in GATE_CASES])


@query("SELECT 'nation' AS name, 20 AS n_rows, TRUE AS has_more UNION ALL SELECT 'region', 5, FALSE UNION ALL SELECT 'exact', 20, FALSE")
def g3_bounded_execution(t):
    g = gate(t)
    cases = {"nation": "SELECT * FROM nation", "region": "SELECT * FROM region", "exact": "SELECT * FROM nation WHERE n_nationkey < 20"}
    out = []
    for name, sql in cases.items():
        r = g.execute(sql, rows=20, seconds=60)
        out.append((name, len(r.rows), r.has_more))
    return frame(t, "name string, n_rows int, has_more boolean", out)


@query("SELECT count(*) AS rows, sum(length(n_nationkey::VARCHAR) + length(n_name) + length(n_regionkey::VARCHAR))::BIGINT AS size FROM nation")
def g3_result_size(t):
    return text_size(t("nation"))


@query("SELECT id, least(length(text), 40 + 3)::BIGINT AS n_chars, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS cell FROM {corpus}")
def g6_cell_truncation(t):
    c = P.cell(F.col("text"), 40)
    return t("corpus").select("id", F.least(F.char_length("text"), F.lit(43)).cast("long").alias("n_chars"), c.alias("cell"))


@query("""WITH w AS (SELECT conv_id, turn, 1 + length(text) // 4 AS cost FROM {turns}), r AS (SELECT *, 10 + sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM w)
SELECT conv_id, count(*) FILTER (used <= 300) AS fitting FROM r GROUP BY conv_id""")
def g6_fitting_rows(t):
    b = t("turns").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.floor(1 + F.floor(F.char_length("text") / 4)).cast("long").alias("cost")))).alias("b"))
    return b.select("conv_id", P.fitting_rows(F.transform("b", lambda x: x["cost"]), 300, F.lit(10)).cast("long").alias("fitting"))


@query("""SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS json FROM events""")
def g7_canonical_json(t):
    return t("events").select("event_id", P.canonical_json({"user": F.col("user_id"), "kind": F.col("event_type")}).alias("json"))


@query("SELECT id, strlen(coalesce(text, '')) AS bytes, TRUE AS fewer FROM {corpus}")
def g8_token_count(t):
    """Counts by a byte-level vocabulary: the tokens of a text are its bytes, none lost or made, and fewer than these."""
    from public_tokenizers import path

    n = token_counts(F.col("text"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    df = t("corpus").select("id", "text", n.alias("n"))
    return df.select("id", F.col("n.chars").alias("bytes"), (F.col("n.tokens") <= F.octet_length(F.coalesce("text", F.lit("")))).alias("fewer"))


@query("SELECT id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n_tokens FROM {corpus}")
def g8_word_count(t):
    """Where there is no vocabulary, tokens are runs without white space."""
    return t("corpus").select("id", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0))).cast("long").alias("n_tokens"))


ACTIONS = [
    ("list", "list_tables", "{}", None), ("list_extra", "list_tables", '{"x": 1}', "invalid_arguments"), ("tables", "inspect_tables", '{"tables": ["a", "b"]}', None), ("tables_same", "inspect_tables", '{"tables": ["a", "A"]}', "invalid_arguments"),
    ("tables_none", "inspect_tables", '{"tables": []}', "invalid_arguments"), ("values", "inspect_values", '{"table": "a", "column": "b"}', None), ("values_half", "inspect_values", '{"table": "a"}', "invalid_arguments"),
    ("sql", "execute_sql", '{"sql": "SELECT 1"}', None), ("sql_blank", "submit_sql", '{"sql": " "}', "invalid_arguments"), ("tool", "drop_all", "{}", "invalid_action"), ("json", "execute_sql", "{sql", "invalid_json"),
]


@query("SELECT conv_id, turn, CASE (conv_id + turn) % " + str(len(ACTIONS)) + " " + " ".join(f"WHEN {i} THEN {chr(39) + x[3] + chr(39) if x[3] else 'NULL'}" for i, x in enumerate(ACTIONS)) + " END AS error FROM {conversations}")
def g9_parse_action(t):
    """Each turn of a conversation as one kind of action."""
    kind = F.element_at(F.array(*(F.struct(F.lit(x[1]).alias("tool"), F.lit(x[2]).alias("arguments")) for x in ACTIONS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ACTIONS))).cast("int") + 1)
    df = t("conversations").select("conv_id", "turn", kind.alias("a"))
    return df.select("conv_id", "turn", P.parse_action(F.col("a.tool"), F.col("a.arguments")).alias("error"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE 'thinking ' || turn END AS reasoning, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_tool' ELSE 'invalid_format' END AS error,
 CASE WHEN turn % 3 = 0 THEN 'SELECT ' || conv_id END AS sql FROM (SELECT conv_id, turn FROM {turns} WHERE turn % 3 <> 1) UNION ALL SELECT conv_id, turn, NULL, 'unknown_tool', NULL FROM {turns} WHERE turn % 3 = 1""")
def g10_parse_response(t):
    n, k = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    good = F.concat(F.lit("<reasoning>thinking "), n, F.lit("</reasoning>\n<tool>{\"name\": \""), F.when(F.col("turn") % 3 == 0, "execute_sql").otherwise("other"), F.lit("\", \"arguments\": {\"sql\": \"SELECT "), k, F.lit("\"}}</tool>"))
    text = F.when(F.col("turn") % 3 == 2, F.lit("no tags at all")).otherwise(good)
    r = t("turns").select("conv_id", "turn", P.parse_response(text).alias("r"))
    return r.select("conv_id", "turn", "r.reasoning", "r.error", F.get_json_object("r.arguments", "$.sql").alias("sql"))


@query("SELECT conv_id, turn, TRUE AS parses FROM {turns}")
def g11_repair(t):
    whole = F.concat(F.lit("<reasoning>r</reasoning><tool>{\"name\": \"list_tables\", \"arguments\": {}}"), F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "</tool").otherwise("</tool>"))
    return t("turns").select("conv_id", "turn", P.parse_response(P.repair_completion(whole))["error"].isNull().alias("parses"))


@query("SELECT conv_id, turn, 'SELECT ' || conv_id AS sql FROM {turns}")
def g12_extract_sql(t):
    sql = F.concat(F.lit("SELECT "), F.col("conv_id").cast("string"))
    shapes = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```sql\n"), sql, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"sql": "'), sql, F.lit('"}'))).otherwise(F.concat(F.lit("  "), sql))
    return t("turns").select("conv_id", "turn", P.extract_sql(shapes).alias("sql"))


@query("SELECT doc_id, source FROM documents")
def g15_public_columns(t):
    df = t("documents").select("doc_id", "source", F.col("text").alias("private_text"))
    return df.select(*P.public(df.columns))


#: Additions to the texts of turns, by turn; the first ones give an answer away, the others are plain reasoning.
ADDED = [
    " I use the golden query", " the gold_sql says", " the provided hint says so", " the teacher answer is 3", " internally supplied value", " continuation instruction", " 内部校准", " as the Gold SQL shows",
    " I check the expected result of the join", " I look at the reference result set", " goldenrod sqlite", "",
]


@query("SELECT conv_id, turn, regexp_matches(text || CASE (conv_id + turn) % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ADDED)) + " END, '(?i)" + "|".join(P.EXTERNAL_REFERENCE).replace("'", "''") + "') AS leak FROM {conversations}")
def g16_external_reference(t):
    """The texts of conversations, with a phrase after each."""
    added = F.element_at(F.array(*map(F.lit, ADDED)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(12)).cast("int") + 1)
    return t("conversations").select("conv_id", "turn", P.external_reference(F.concat("text", added)).alias("leak"))


@query("SELECT max(task_id)::VARCHAR AS task_id, 1 AS line FROM {tasks}")
def s3_find_task(t):
    """The first line of a file of tasks, which holds them from the last to the first."""
    path = shared_folder(t.spark, "tasks")
    rows = t("tasks").select(F.col("task_id").cast("string").alias("task_id"), "db_id", F.col("task_id").alias("n"))
    rows.repartition(1).sortWithinPartitions(F.desc("n")).drop("n").write.json(path)
    return jsonl.find_task(jsonl.load_tasks(t.spark, path, numbered=True)).select("task_id", F.col("line").cast("int").alias("line"))


@query("SELECT source, count(*) AS attempts, count(*) FILTER (won = 1) AS successes FROM (SELECT db_id AS source, won FROM {attempts}) GROUP BY source")
def s9_views(t):
    every, good = jsonl.views(t("attempts").withColumn("ok", F.col("won") == 1), "ok")
    good = good.groupBy(F.col("db_id").alias("s")).agg(F.count(F.lit(1)).alias("successes"))
    out = every.groupBy(F.col("db_id").alias("source")).agg(F.count(F.lit(1)).alias("attempts"))
    return out.join(good, F.col("source") == F.col("s"), "left").select("source", "attempts", F.coalesce("successes", F.lit(0)).alias("successes"))


NATION_FILES = "SELECT n_nationkey AS k, '{\"n_name\":\"' || n_name || '\"}' || chr(10) AS content FROM nation"


def nation_files(t):
    """A folder with a file a nation, which holds a line of JSON."""
    path = shared_folder(t.spark, "files")
    t("nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").json(path)
    return f"{path}/*/*.json"


def _key(path):
    return F.regexp_extract(path, r"n_nationkey=(\d+)", 1).cast("int").alias("k")


@query(f"SELECT k::INT AS k, strlen(content)::BIGINT AS length, sha256(content) AS sha256 FROM ({NATION_FILES})")
def s13_file_digests(t):
    """Digests of written files, against those of the bytes that they must hold."""
    return jsonl.file_digests(t.spark, nation_files(t)).select(_key("path"), "length", "sha256")


@query("""SELECT coalesce(a.name, b.name) AS name, a.digest AS "left", b.digest AS "right" FROM (SELECT n_name AS name, md5(n_name) AS digest FROM nation WHERE n_nationkey < 20) a
FULL JOIN (SELECT n_name AS name, md5(CASE WHEN n_nationkey % 7 = 0 THEN 'x' ELSE n_name END) AS digest FROM nation WHERE n_nationkey > 2) b ON a.name = b.name WHERE a.digest IS DISTINCT FROM b.digest""")
def s14_differing_digests(t):
    n = t("nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.md5("n_name").alias("digest"))
    b = n.where("n_nationkey > 2").select(F.col("n_name").alias("name"), F.md5(F.when(F.col("n_nationkey") % 7 == 0, "x").otherwise(F.col("n_name"))).alias("digest"))
    return jsonl.differing(a, b, "name", "digest")


SCHEMA = "SELECT table_name, column_name, ordinal_position - 1 AS position, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ('" + "', '".join(STAR) + "')"


@query(f"SELECT row_number() OVER (ORDER BY table_name) - 1 AS place, table_name AS name FROM (SELECT DISTINCT table_name FROM ({SCHEMA}))")
def s15_list_tables(t):
    return frame(t, "place int, name string", list(enumerate(namespace(t.spark, t.sf_dir, STAR).tables())))


REFS = values("t, c, r", [(a, b, f"{c}.{d}") for a, b, c, d in FOREIGN])
KEYS = values("t, c, k", [(table, c, i) for table, cs in PRIMARY.items() for i, c in enumerate(cs, 1)])


@query(f"""SELECT table_name, position, column_name, type, coalesce(k, 0) AS key_place, r AS references_column, NULL AS error FROM ({SCHEMA}) s LEFT JOIN ({KEYS}) k ON k.t = table_name AND k.c = column_name LEFT JOIN ({REFS}) r ON r.t = table_name AND r.c = column_name
UNION ALL SELECT 'nowhere', NULL, NULL, NULL, NULL, NULL, 'unknown_table'""")
def s16_inspect_tables(t):
    """All tables, some by names in other letters, and one that isn't there."""
    out = namespace(t.spark, t.sf_dir, STAR).columns(["Nation", "REGION", *(n for n in STAR if n not in ("nation", "region")), "nowhere"])
    return out.select("table_name", "position", "column_name", "type", "key_place", F.col("references").alias("references_column"), "error")


@query("SELECT DISTINCT p_brand AS value FROM part ORDER BY 1 LIMIT 51")
def s17_inspect_values(t):
    return namespace(t.spark, t.sf_dir, STAR).values("PART", "P_Brand")


#: Columns of the star schema with their types.
TYPES = {
    "region": "r_regionkey INT, r_name STRING", "nation": "n_nationkey INT, n_name STRING, n_regionkey INT", "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE", "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def ddl_sql(table: str) -> str:
    """The DDL of a table with the first and last texts of each column, out of the table's own rows."""
    parts = []
    for column in TYPES[table].split(", "):
        c, kind = column.split()
        v = f"nullif(substr({c}::VARCHAR, 1, 40), '')"
        key = " PRIMARY KEY" if PRIMARY[table] == [c] else ""
        parts.append(f"'  `{c}` {kind}{key} -- ' || min({v}) || CASE WHEN max({v}) <> min({v}) THEN ', ' || max({v}) ELSE '' END")
    if len(PRIMARY[table]) > 1:
        parts.append("'  PRIMARY KEY (" + ", ".join(f"`{c}`" for c in PRIMARY[table]) + ")'")
    parts += [f"'  FOREIGN KEY (`{c}`) REFERENCES `{r}` (`{rc}`)'" for t, c, r, rc in FOREIGN if t == table]
    return f"SELECT '{table}' AS table_name, 'CREATE TABLE `{table}` (' || chr(10) || concat_ws(',' || chr(10), {', '.join(parts)}) || chr(10) || ')' AS ddl FROM {table}"


@query(" UNION ALL ".join(map(ddl_sql, STAR)))
def s18_render_schema(t):
    return namespace(t.spark, t.sf_dir, STAR).render()


@query(f"SELECT table_name, count(*)::INT AS n_columns FROM ({SCHEMA}) GROUP BY 1")
def s19_schema_map(t):
    return frame(t, "table_name string, n_columns int", [(k, len(v)) for k, v in namespace(t.spark, t.sf_dir, STAR).schema_map().items()])


@query("SELECT n_nationkey AS id, kind, CASE kind WHEN 'text' THEN 1 WHEN 'long' THEN 1 WHEN 'same' THEN 0 WHEN 'null' THEN 1 ELSE 1 END AS distance FROM nation, (SELECT unnest(['same', 'text', 'long', 'null', 'double']) AS kind)")
def z13_literals(t):
    """Literals count with their type: a number against itself, as text, as a long, a null and a double."""
    kinds = {"same": "n_nationkey", "text": "concat(char(39), n_nationkey, char(39))", "long": "concat(n_nationkey, 'L')", "null": "'NULL'", "double": "concat(n_nationkey, 'D')"}
    forms = ", ".join(f"named_struct('kind', '{k}', 'right', concat('SELECT n_name FROM nation WHERE n_nationkey = ', {x}))" for k, x in kinds.items())
    pairs = t("nation").selectExpr("n_nationkey AS id", "concat('SELECT n_name FROM nation WHERE n_nationkey = ', n_nationkey) AS left", f"inline(array({forms}))")
    return Q.score_table(gate(t), pairs).select("id", "kind", "distance")


PAIRS = [
    ("same_text", "SELECT n_name FROM nation", "SELECT n_name FROM nation", True, False, None),
    ("alias", "SELECT n_name AS x FROM nation", "SELECT n_name FROM nation", True, False, None),
    ("other_order", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation", True, False, None),
    ("order_matters", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name", False, True, "wrong_result"),
    ("duplicates", "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation", False, False, "wrong_result"),
    ("tolerance", "SELECT 1.0000005D AS x", "SELECT 1.0D AS x", True, False, None),
    ("too_far", "SELECT 1.01D AS x", "SELECT 1.0D AS x", False, False, "wrong_result"),
    ("int_real", "SELECT 1 AS x", "SELECT 1.0D AS x", True, False, None),
    ("text_number", "SELECT '1' AS x", "SELECT 1 AS x", False, False, "wrong_result"),
    ("width", "SELECT n_name, n_nationkey FROM nation", "SELECT n_name FROM nation", False, False, "wrong_result"),
    ("nulls", "SELECT CAST(NULL AS INT) AS x", "SELECT 0 AS x", False, False, "wrong_result"),
    ("unknown", "SELECT nothing FROM nation", "SELECT n_name FROM nation", False, False, "unknown_column"),
    ("forbidden", "DROP TABLE nation", "SELECT n_name FROM nation", False, False, "forbidden_sql"),
]


@query(values("name, correct, order_sensitive, error", [(n, c, o, e) for n, _, _, c, o, e in PAIRS]))
def v1_verify(t):
    g = gate(t)
    rows = []
    for name, a, b, *_ in PAIRS:
        v = V.verify(g, a, b)
        rows.append((name, v.correct, v.order_sensitive, v.error))
    return frame(t, "name string, correct boolean, order_sensitive boolean, error string", rows)


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY 1), p AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM {nation}),
v AS (SELECT 4 * a AS id, coalesce(x.n, 0) = coalesce(y.n, 0) AS correct, FALSE AS order_sensitive, TRUE AS executable FROM p LEFT JOIN n x ON x.k = a LEFT JOIN n y ON y.k = b
 UNION ALL SELECT 4 * a + 1, TRUE, FALSE, TRUE FROM p UNION ALL SELECT 4 * a + 2, coalesce(n, 0) < 2, TRUE, TRUE FROM p LEFT JOIN n ON k = a UNION ALL SELECT 4 * a + 3, FALSE, FALSE, FALSE FROM p)
SELECT id, correct, order_sensitive, CASE WHEN NOT executable THEN 'unknown_column' WHEN NOT correct THEN 'wrong_result' END AS error FROM v""")
def v1_verify_table(t):
    """A hundred candidates side by side: other counts, the same rows in another order, orders turned round, columns that aren't there."""
    n, other = "n_nationkey", "(n_nationkey + 1) % 25"
    rows = "concat('SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ', n_nationkey, ' ORDER BY c_custkey"
    kinds = [
        (f"concat('SELECT count(*) FROM customer WHERE c_nationkey = ', {n})", f"concat('SELECT count(*) FROM customer WHERE c_nationkey = ', {other})"),
        (f"{rows} DESC')", f"concat('SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ', {n})"), (f"{rows} DESC')", f"{rows}')"),
        (f"concat('SELECT c_nothing FROM customer WHERE c_nationkey = ', {n})", f"concat('SELECT count(*) FROM customer WHERE c_nationkey = ', {n})"),
    ]
    pairs = t("nation").selectExpr("n_nationkey", "inline(array(" + ", ".join(f"named_struct('i', {i}, 'candidate', {a}, 'reference', {b})" for i, (a, b) in enumerate(kinds)) + "))")
    # A nation's customers are as many as the tables have; the limit on bytes holds.
    g = Gate(t.spark, namespace(t.spark, t.sf_dir, STAR), Limits(query_seconds=120, verifier_seconds=120, verifier_rows=10_000_000))
    out = V.verify_table(g, pairs.select((4 * F.col("n_nationkey") + F.col("i")).alias("id"), "candidate", "reference"))
    return out.select("id", "correct", "order_sensitive", "error")


ORDERS = [("plain", "SELECT n_name FROM nation", False), ("order", "SELECT n_name FROM nation ORDER BY 1", True), ("limit", "SELECT n_name FROM nation ORDER BY 1 LIMIT 3", True), ("inner", "SELECT * FROM (SELECT n_name FROM nation ORDER BY 1 LIMIT 3) x", False), ("cte", "WITH x AS (SELECT 1 AS a) SELECT a FROM x ORDER BY a", True)]


@query(values("name, ordered", [(n, o) for n, _, o in ORDERS]))
def v2_order_sensitive(t):
    g = gate(t)
    return frame(t, "name string, ordered boolean", [(n, bool(g.ordered(s))) for n, s, _ in ORDERS])


# A customer's orders are a result; the other side has them in another order, some off by a little, some by more.
OFF = "CASE WHEN o_custkey % 5 = 1 THEN 1e-3 WHEN o_custkey % 5 = 2 THEN 5e-7 ELSE 0 END"
SIDES = f"SELECT o_custkey AS task, o_orderkey AS k, o_orderstatus AS mode, CAST(o_totalprice AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) * (1 + {OFF}) AS y, CAST(o_totalprice AS DOUBLE) + o_custkey % 3 AS q FROM {{orders}}"
NEAR = "abs(x - y) <= greatest(1e-6 * greatest(abs(x), abs(y)), 1e-9)"


def _sides(t):
    s = t.spark.sql(SIDES, orders=t("orders"))
    return s.select("task", "k", "mode", "x", "q"), s.select("task", "k", "mode", F.col("y").alias("x"), "q")


@query(f"WITH s AS ({SIDES}) SELECT task, bool_and({NEAR}) AS equal FROM s GROUP BY task")
def v3_unordered_results(t):
    """Each customer's orders as a multiset against those that are a little off."""
    a, b = _sides(t)
    return V.results_equal(a, b, "task")


@query(f"WITH s AS ({SIDES}), n AS (SELECT *, count(*) OVER (PARTITION BY task) AS n FROM s) SELECT task, bool_and({NEAR}) AND (min(task % 2) = 0 OR max(n) = 1) AS equal FROM n GROUP BY task")
def v4_ordered_results(t):
    """As lists; the other side of odd customers is turned round, which is the same only where there is one order."""
    a, b = _sides(t)
    turned = F.when(F.col("task") % 2 == 1, -F.col("k")).otherwise(F.col("k"))
    return V.results_equal(a.withColumn("n", F.col("k")), b.withColumn("n", turned), "task", order="n")


@query(f"WITH s AS ({SIDES}) SELECT k, {NEAR} AS equal FROM s")
def v5_value_tolerance(t):
    """Value by value: each order is a result of one row."""
    a, b = _sides(t)
    return V.results_equal(a.select("k", "x"), b.select("k", "x"), "k")


@query(f"WITH s AS ({SIDES}) SELECT task, bool_and(x = q) AS equal FROM s GROUP BY task")
def v6_positions_fixed(t):
    """Columns compare by position, whatever their names: two prices change places on one side."""
    a, _ = _sides(t)
    return V.results_equal(a.select("task", "k", "x", "q"), a.select("task", "k", F.col("q").alias("x"), F.col("x").alias("q")), "task")


PERMUTED = [("swapped", "SELECT n_name, n_nationkey FROM nation", "SELECT n_nationkey, n_name FROM nation", True), ("shifted", "SELECT n_nationkey, n_regionkey FROM nation", "SELECT n_regionkey, n_nationkey FROM nation", True), ("broken_rows", "SELECT n_nationkey, 24 - n_nationkey FROM nation", "SELECT n_nationkey, n_nationkey FROM nation", False), ("width", "SELECT n_name FROM nation", "SELECT n_name, n_name FROM nation", False)]


@query(values("name, equal", [(n, e) for n, _, _, e in PERMUTED]))
def v7_permutation_equal(t):
    g = gate(t)
    return frame(t, "name string, equal boolean", [(n, V.permutation_equal(g.dataframe(a), g.dataframe(b))) for n, a, b, _ in PERMUTED])


# A customer's orders as a result of three columns of small numbers; the other side has them in an order of its own, and for some
# customers one column turned round, so that columns agree and rows may not.
TRIPLES = """SELECT o_custkey AS task, CAST(o_orderkey % 3 AS INT) AS c0, CAST(o_orderkey % 2 + o_custkey % 2 AS INT) AS c1, CAST(extract(day FROM o_orderdate) AS INT) % 4 AS c2,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS down FROM {orders}"""
TURNED = """SELECT a.task, CASE a.task % 3 WHEN 0 THEN x WHEN 1 THEN a.c1 ELSE a.c2 END AS d0, CASE a.task % 3 WHEN 0 THEN a.c1 WHEN 1 THEN a.c2 ELSE x END AS d1, CASE a.task % 3 WHEN 0 THEN a.c2 WHEN 1 THEN x ELSE a.c1 END + CASE WHEN a.task % 11 = 0 THEN 9 ELSE 0 END AS d2
 FROM (SELECT a.*, CASE WHEN a.task % 5 = 0 THEN b.c0 ELSE a.c0 END AS x FROM s a JOIN s b ON a.task = b.task AND a.up = b.down) a"""
ORDERS_OF_THREE = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


@query("WITH s AS (" + TRIPLES + "), d AS (" + TURNED + "), l AS (SELECT task, list_sort(list([c0, c1, c2])) AS l FROM s GROUP BY task), r AS (SELECT task, " + ", ".join(f"list_sort(list([d{a}, d{b}, d{c}])) AS r{a}{b}{c}" for a, b, c in ORDERS_OF_THREE)
       + " FROM d GROUP BY task) SELECT task, " + " OR ".join(f"l = r{a}{b}{c}" for a, b, c in ORDERS_OF_THREE) + " AS equal FROM l JOIN r USING (task)")
def v7_permuted_results(t):
    """Every customer's orders against a copy whose columns are permuted, turned or wrong; the oracle tries all six orders."""
    s = t.spark.sql(TRIPLES, orders=t("orders"))
    d = t.spark.sql("WITH s AS (SELECT * FROM {s}) " + TURNED, s=s)
    return V.permuted_results(s.select("task", "c0", "c1", "c2"), d, "task")


@query("SELECT n_nationkey AS id, count(c_custkey) FILTER (c_custkey % 2 = 0 AND c_acctbal > 0) = count(c_custkey) FILTER (c_custkey % 2 = 0) AND count(c_custkey) FILTER (c_custkey % 3 = 0 AND c_acctbal > 0) = count(c_custkey) FILTER (c_custkey % 3 = 0) AS equal FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY 1")
def v8_two_databases(t):
    """Whether two counts agree on a database of the even customers and on one of every third."""
    gates = [Gate(t.spark, Namespace(t.spark, {"customer": t("customer").where(x)}), Limits(verifier_seconds=120)) for x in ("c_custkey % 2 = 0", "c_custkey % 3 = 0")]
    count = "SELECT count(*) FROM customer WHERE c_nationkey = {}"
    keys = [r[0] for r in t("nation").select("n_nationkey").collect()]  # 25 rows
    return frame(t, "id long, equal boolean", [(k, V.equal_everywhere(gates, count.format(k) + " AND c_acctbal > 0", count.format(k))) for k in keys])


LOOSE = [("distinct", "SELECT DISTINCT n_name FROM nation", "SELECT n_name FROM nation", True), ("spacing", "SELECT n_name FROM nation WHERE n_nationkey > = 3", "SELECT n_name FROM nation WHERE n_nationkey >= 3", True), ("year", "SELECT YEAR(CURDATE()) AS y", "SELECT 2020 AS y", True), ("other", "SELECT n_name FROM nation WHERE n_nationkey > 3", "SELECT n_name FROM nation", False)]


@query(values("name, equal", [(n, e) for n, _, _, e in LOOSE]))
def v8_equal_everywhere(t):
    g = gate(t)
    return frame(t, "name string, equal boolean", [(n, V.equal_everywhere([g, g], a, b)) for n, a, b, _ in LOOSE])


@query("""WITH n AS (SELECT k, count(c_custkey) AS n FROM (SELECT unnest(range(5)) AS k) LEFT JOIN {customer} ON c_nationkey = k GROUP BY 1), g AS (SELECT n, count(*) AS votes, min(k) AS first FROM n GROUP BY 1)
SELECT first::INT AS selected_sample, votes::INT AS votes, 5 AS valid, 'voted' AS status FROM g ORDER BY votes DESC, first LIMIT 1""")
def v9_vote_sql(t):
    """Six candidates, five of which count the customers of a nation; the sixth does not resolve."""
    x = V.vote_sql(gate(t), [f"SELECT count(*) AS n FROM customer WHERE c_nationkey = {k}" for k in range(5)] + ["SELECT nothing FROM nation"])
    return frame(t, "selected_sample int, votes int, valid int, status string", [(x["selected_sample"], x["votes"], x["valid"], x["status"])])


@query("""WITH c AS (SELECT user_id AS task, event_id AS i, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS mark FROM events), g AS (SELECT task, mark, count(*) AS votes, min(i) AS s FROM c GROUP BY ALL),
r AS (SELECT *, coalesce(sum(votes) FILTER (mark IS NOT NULL) OVER (PARTITION BY task), 0) AS valid, row_number() OVER (PARTITION BY task ORDER BY mark IS NULL, votes DESC, s) AS k FROM g)
SELECT task, CASE WHEN mark IS NOT NULL THEN s END AS selected_sample, CASE WHEN mark IS NULL THEN 0 ELSE votes END AS votes, valid::BIGINT AS valid, CASE WHEN mark IS NULL THEN 'all_invalid' ELSE 'voted' END AS status FROM r WHERE k = 1""")
def v9_vote(t):
    c = t("events").select(F.col("user_id").alias("task"), F.col("event_id").alias("i"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("mark"))
    return V.vote(c, "task", "i", "mark")


@query("""WITH c AS (SELECT user_id AS task, event_id AS i, event_type = 'purchase' AS ok, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS s FROM events),
p AS (SELECT task, coalesce(max(CASE WHEN i = s THEN ok::INT END), 0) AS w, arg_min(ok::INT, i) AS f, max(ok::INT) AS a FROM c GROUP BY task) SELECT count(*) AS tasks, round(avg(w), 6) AS accuracy, round(avg(f), 6) AS first_sample, round(avg(a), 6) AS any_sample FROM p""")
def v10_voting_summary(t):
    from pyspark.sql import Window

    s = F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).over(Window.partitionBy("user_id"))
    c = t("events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"), s.alias("s"))
    out = V.voting_summary(c, "user_id", "ok", "event_id", "s")
    return out.select("tasks", *(F.round(x, 6).alias(x) for x in ("accuracy", "first_sample", "any_sample")))


FAILURES = [
    ("error", "timeout", "SELECT 1", "SELECT 2", "timeout"), ("missing", None, None, "SELECT 2", "wrong_result"), ("table", "wrong_result", "SELECT n_name FROM nation", "SELECT r_name FROM region", "wrong_table"),
    ("join", "wrong_result", "SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT 1 FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", "join_error"),
    ("aggregate", "wrong_result", "SELECT sum(n_nationkey) FROM nation", "SELECT max(n_nationkey) FROM nation", "aggregation_error"), ("where", "wrong_result", "SELECT n_name FROM nation WHERE n_nationkey = 1", "SELECT n_name FROM nation WHERE n_nationkey = 2", "condition_error"),
    ("select", "wrong_result", "SELECT n_name FROM nation", "SELECT n_nationkey FROM nation", "wrong_result"), ("column", "unknown_column", "SELECT x FROM nation", "SELECT 1", "schema_understanding"),
]


@query(values("name, category", [(x[0], x[4]) for x in FAILURES]))
def v13_failure_category(t):
    g = gate(t)
    return frame(t, "name string, category string", [(n, Q.failure_category(g, e, s, r)) for n, e, s, r, _ in FAILURES])


GRAPHS = [
    ("join", "SELECT c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1", "customer,orders", "customer.c_custkey,customer.c_name,orders.o_custkey,orders.o_totalprice", "customer.c_custkey=orders.o_custkey", True),
    ("unknown", "SELECT wrong FROM nation", "nation", "!unknown_wrong", "", False), ("ambiguous", "SELECT n_name FROM nation a, nation b", "nation", "nation.n_name", "", True), ("missing_table", "SELECT x FROM nowhere", "!unknown_nowhere", "!unknown_x", "", False),
    ("broken", "SELEC", "", "", "", False), ("subquery", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)", "nation,region", "nation.n_regionkey,region.r_name,region.r_regionkey", "nation.n_regionkey=region.r_regionkey", True),
]


@query(values("name, tables, columns, edges, valid", [(n, *x) for n, _, *x in GRAPHS]))
def k7_schema_graph(t):
    g = gate(t)
    rows = []
    for name, sql, *_ in GRAPHS:
        x = Q.schema_graph(g, sql)
        rows.append((name, *(",".join(x[k]) for k in ("tables", "columns", "edges")), x["valid"]))
    return frame(t, "name string, tables string, columns string, edges string, valid boolean", rows)


#: Pairs of queries and their distance, 0 where they are the same.
SIMILAR = [
    ("identity", "SELECT n_name FROM nation", "SELECT n_name FROM nation", 0), ("alias", "SELECT n.n_name AS x FROM nation n", "SELECT n_name FROM nation", 0),
    ("conjuncts", "SELECT n_name FROM nation WHERE n_nationkey > 3 AND n_regionkey = 1", "SELECT n_name FROM nation WHERE 1 = n_regionkey AND 3 < n_nationkey", 0),
    ("true", "SELECT n_name FROM nation WHERE n_nationkey > 3 AND 1 = 1", "SELECT n_name FROM nation WHERE n_nationkey > 3", 0), ("in_list", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3)", "SELECT n_name FROM nation WHERE n_nationkey IN (3, 2, 1)", 0),
    ("derived", "SELECT n_name FROM (SELECT n_name, n_nationkey FROM nation) x WHERE n_nationkey > 3", "SELECT n_name FROM nation WHERE n_nationkey > 3", 0),
    ("cte", "WITH x AS (SELECT * FROM nation) SELECT n_name FROM x", "SELECT n_name FROM nation", 0), ("join_order", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey", 0),
    ("literal", "SELECT n_name FROM nation WHERE n_nationkey > 3", "SELECT n_name FROM nation WHERE n_nationkey > 4", 1), ("aggregate", "SELECT max(n_nationkey) FROM nation", "SELECT min(n_nationkey) FROM nation", 1),
    ("direction", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name ASC NULLS LAST", 1), ("column", "SELECT n_name FROM nation", "SELECT n_regionkey FROM nation", 1),
    ("limit", "SELECT n_name FROM nation LIMIT 3", "SELECT n_name FROM nation LIMIT 4", 2), ("below_limit", "SELECT n_name FROM nation LIMIT 5", "SELECT n_regionkey FROM nation LIMIT 5", 1),
    ("below_filter", "SELECT n_name FROM nation WHERE n_nationkey = 1 LIMIT 1", "SELECT n_regionkey FROM nation WHERE n_nationkey = 1 LIMIT 1", 1), ("swapped", "SELECT n_name, n_nationkey FROM nation LIMIT 2", "SELECT n_nationkey, n_name FROM nation LIMIT 2", 2),
    ("arm", "SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region", 1), ("type", "SELECT 1 AS x FROM nation", "SELECT '1' AS x FROM nation", 1),
    ("nulls", "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name NULLS LAST", 1), ("compared_type", "SELECT n_name FROM nation WHERE n_nationkey = 18", "SELECT n_name FROM nation WHERE n_nationkey = '18'", 1),
]


@query(values("id, distance, mirrored, edits", [(n, d, True, d) for n, _, _, d in SIMILAR]))
def q7_similarity(t):
    """Equal pairs are at distance 0, others as far as stated, both ways; there are as many edits."""
    g = gate(t)
    one = Q.score_pairs(g, [(n, a, b) for n, a, b, _ in SIMILAR])
    two = Q.score_pairs(g, [(n, b, a) for n, a, b, _ in SIMILAR]).select(F.col("id").alias("i"), F.col("distance").alias("back"))
    return one.join(two, one["id"] == two["i"]).select("id", "distance", (F.col("distance") == F.col("back")).alias("mirrored"), F.size("edits").alias("edits"))


@query("""SELECT n_nationkey AS id, op, count(*)::INT AS edits FROM (
    SELECT n_nationkey, 'replace' AS op, unnest([n_nationkey <> n_regionkey, n_regionkey <> 1]) AS there FROM {nation}
    UNION ALL SELECT n_nationkey, 'insert', unnest([n_nationkey % 2 = 0] || [n_nationkey % 2 = 0] || [n_nationkey % 2 = 0]) FROM {nation}) WHERE there GROUP BY ALL""")
def q7_edits(t):
    """What has to be edited between queries made from the rows of a table: literals replaced, a condition added."""
    more = "CASE WHEN n_nationkey % 2 = 0 THEN concat(' AND n_name = ', char(39), 'x', char(39)) ELSE '' END"
    pairs = t("nation").selectExpr(
        "n_nationkey AS id", "concat('SELECT n_name FROM nation WHERE n_nationkey > ', n_nationkey, ' AND n_regionkey = ', n_regionkey) AS left",
        f"concat('SELECT n_name FROM nation WHERE n_nationkey > ', n_regionkey, ' AND n_regionkey = 1', {more}) AS right",
    )
    edits = Q.score_table(gate(t), pairs).select("id", F.explode("edits.op").alias("op"))
    return edits.groupBy("id", "op").agg(F.count(F.lit(1)).cast("int").alias("edits"))


@query("SELECT c_custkey AS id, 3 + (c_nationkey <> c_custkey % 25)::INT AS distance, TRUE AS scored FROM {customer}")
def q8_pair_table(t):
    """A table of pairs, a row a customer: each distinct query is analysed once, trees meet pairs by a join."""
    pairs = t("customer").selectExpr(
        "c_custkey AS id", "concat('SELECT c_name FROM customer WHERE c_nationkey = ', c_nationkey) AS left",
        "concat('SELECT c_name FROM customer WHERE c_acctbal > 0 AND c_nationkey = ', c_custkey % 25) AS right",
    )
    return Q.score_table(gate(t), pairs).select("id", "distance", (F.col("status") == "scored").alias("scored"))


REWRITES = [
    ("conjunct_twice", "{} WHERE {} > 3 AND {} > 3", "{} WHERE {} > 3"), ("always_true", "{} WHERE {} > 3 AND 1 = 1", "{} WHERE 3 < {}"), ("derived", "SELECT * FROM ({} WHERE {} > 3) x", "{} WHERE {} > 3"),
    ("pushed", "SELECT * FROM ({}) x WHERE {} > 3", "{} WHERE {} > 3"), ("negated", "{} WHERE NOT {} <= 3", "{} WHERE {} > 3"),
]


@query("SELECT t || '.' || n AS id, 0 AS distance FROM (SELECT unnest(['nation', 'region', 'customer', 'supplier']) AS t), (SELECT unnest(['conjunct_twice', 'always_true', 'derived', 'pushed', 'negated']) AS n)")
def q4_optimiser_rewrites(t):
    """Queries that the optimiser's logical rewrites make one, over four tables."""
    keys = {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey", "supplier": "s_suppkey"}
    form = lambda text, table, key: text.replace("{}", f"SELECT {', '.join(t(table).columns)} FROM {table}", 1).replace("{}", key)
    return Q.score_pairs(gate(t), [(f"{x}.{n}", form(a, x, k), form(b, x, k)) for x, k in keys.items() for n, a, b in REWRITES]).select("id", "distance")


UNSCORABLE = [("broken", "SELEC 1"), ("unknown", "SELECT x FROM nation"), ("two", "SELECT 1; SELECT 2"), ("write", "DROP TABLE nation"), ("recursive", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 3) SELECT n FROM s")]


@query(values("id, scored", [(n, False) for n, _ in UNSCORABLE]))
def q8_unscorable(t):
    out = Q.score_pairs(gate(t), [(n, s, "SELECT n_name FROM nation") for n, s in UNSCORABLE])
    return out.select("id", (F.col("status") == "scored").alias("scored"))


@query(values("name, differs", [("reordered_tables", False), ("reordered_columns", True)]))
def q1_schema_mark(t):
    s = namespace(t.spark, t.sf_dir, STAR).schema_map()
    turned = {k: s[k] for k in reversed(list(s))}
    other = {**s, "nation": s["nation"][::-1]}
    return frame(t, "name string, differs boolean", [("reordered_tables", Q.schema_mark(turned) != Q.schema_mark(s)), ("reordered_columns", Q.schema_mark(other) != Q.schema_mark(s))])


@query(values("name, tables", [("join", "customer,orders"), ("cte", "nation"), ("nested", "nation,region")]))
def z1_oracle_tables(t):
    g = gate(t)
    cases = [("join", "SELECT * FROM Customer c, orders"), ("cte", "WITH x AS (SELECT * FROM nation) SELECT * FROM x"), ("nested", "SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)")]
    return frame(t, "name string, tables string", [(n, ",".join(g.tables(s))) for n, s in cases])
