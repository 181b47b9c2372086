"""Sources, sinks, manifests, shards, registered functions and configurations, over the fixture tables."""

import json

from pyspark.sql import functions as F

from quern.functions import registered
from quern.operators import collection as C
from quern.operators import retrieval as R
from quern.operators import scoring as K
from quern.operators import verify as V
from quern.plans import similarity as Q
from quern.queries.base import query
from quern.queries.environment import FOREIGN, NATION_FILES, STAR, _key, frame, gate, nation_files, values
from quern.queries.retrieval import BM25, TOK, TOP
from quern.session import shared_folder
from quern.sources import jsonl, memory_store
from quern.sources.catalog import namespace, quote
from quern.streaming import incremental

CATALOG = "SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ('" + "', '".join(STAR) + "')"


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in STAR))
def s1_readonly_views(t):
    """Rows of each view of the read-only database, read through the gate."""
    g = gate(t)
    out = None
    for n in STAR:
        one = g.dataframe(f"SELECT '{n}' AS name, count(*) AS n FROM {n}")
        out = one if out is None else out.union(one)
    return out


@query("SELECT task_id::VARCHAR AS task_id, db_id, CASE difficulty WHEN 'en' THEN 'easy' ELSE 'hard' END AS difficulty FROM {tasks}")
def s2_load_tasks(t):
    """Tasks written as JSON lines with blank lines between, and read back."""
    path = shared_folder(t.spark, "tasks")
    rows = t("tasks").select(F.col("task_id").cast("string").alias("task_id"), "db_id", F.when(F.col("difficulty") == "en", "easy").otherwise("hard").alias("difficulty"))
    rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit(""))).alias("value")).write.text(path)
    return jsonl.load_tasks(t.spark, path).select("task_id", "db_id", "difficulty")


@query("SELECT r_name AS name FROM region")
def s4_directory(t):
    """One JSON document a file."""
    path = shared_folder(t.spark, "documents")
    t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).write.partitionBy("k").json(path)
    return jsonl.load_directory(t.spark, f"{path}/*", "name string").orderBy("file_name").select("name")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def s5_append(t):
    """Two appends to one set of records."""
    path, n = shared_folder(t.spark, "records"), t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    jsonl.append(n.where("k < 7"), path)
    jsonl.append(n.where("k >= 7"), path)
    return jsonl.load_jsonl(t.spark, path, "k int, name string")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in STAR))
def s6_manifest(t):
    """A manifest of counts, written whole and read back."""
    path = f"{shared_folder(t.spark, 'manifest')}/counts.json"
    jsonl.write_manifest(t.spark, path, {"old": 1})
    jsonl.write_manifest(t.spark, path, {n: t(n).count() for n in STAR})
    return frame(t, "name string, n long", list(jsonl.read_manifest(t.spark, path).items()))


@query("SELECT r_regionkey AS k, r_regionkey % 2 = 1 AS refused FROM region")
def s7_ensure_manifest(t):
    """A second configuration is refused if it differs."""
    base, rows = shared_folder(t.spark, "manifests"), []
    for r in t("region").select("r_regionkey", "r_name").collect():  # five rows
        path = f"{base}/{r[0]}.json"
        jsonl.ensure_manifest(t.spark, path, {"name": r[1]})
        try:
            jsonl.ensure_manifest(t.spark, path, {"name": r[1] if r[0] % 2 == 0 else "another"})
            rows.append((r[0], False))
        except ValueError:
            rows.append((r[0], True))
    return frame(t, "k int, refused boolean", rows)


@query("SELECT count(*) AS n, TRUE AS refused FROM nation")
def s8_refuse_overwrite(t):
    path = shared_folder(t.spark, "once")
    jsonl.create(t("nation").select("n_nationkey"), path)
    try:
        jsonl.create(t("nation").select("n_nationkey"), path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return jsonl.load_jsonl(t.spark, path, "n_nationkey int").agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


@query("""WITH m AS (SELECT n_nationkey AS k, sha256(concat_ws(chr(31), n_nationkey::VARCHAR, 'a', 'b')) AS id FROM nation WHERE n_nationkey < 20)
SELECT k::VARCHAR AS task, CASE WHEN k < 10 THEN 0 ELSE 10 END + row_number() OVER (PARTITION BY k < 10 ORDER BY id) AS seq FROM m""")
def s10_store_all(t):
    """Two rounds of verified memories, of which the second has the first's again; all in the order of insertion."""
    path = shared_folder(t.spark, "memories")
    n = t("nation").where("n_nationkey < 20")
    same = {"question": "n_name", "experience": "n_name", "sql_before": "n_name", "sql_first_execute": "n_name", "sql_after": "n_name"}
    rows = n.select("n_nationkey", F.col("n_nationkey").cast("string").alias("source_task_id"), *(F.col(c).alias(k) for k, c in same.items()), F.lit("train").alias("source_split"), F.lit("a").alias("initial_record_path"), F.lit("b").alias("retry_record_path"))
    rows = memory_store.memory_id(rows)
    for part in (rows.where("n_nationkey < 10"), rows, rows):
        memory_store.append_verified(t.spark, path, part.drop("n_nationkey"))
    return memory_store.read(t.spark, path).orderBy("seq").select(F.col("source_task_id").alias("task"), "seq")


@query(f"SELECT lower(table_name) AS table_name, lower(column_name) AS column_name, ordinal_position - 1 AS place FROM ({CATALOG})")
def s20_catalog(t):
    """Lower-cased tables and columns of the catalog, against the oracle's own."""
    m = namespace(t.spark, t.sf_dir, STAR).schema_map()
    return frame(t, "table_name string, column_name string, place int", [(k, c, i) for k, cs in m.items() for i, c in enumerate(cs)])


@query("SELECT (user_id % 4)::VARCHAR AS shard, count(*) AS rows, user_id % 4 <> 2 AS intact FROM events GROUP BY user_id % 4")
def s22_shards(t):
    """Arrays in shards with digests; a row that comes into one shard afterwards is noticed."""
    path = shared_folder(t.spark, "shards")
    e = t("events").select((F.col("user_id") % 4).alias("shard"), "event_id", F.array(F.col("value").cast("double"), F.lit(1.0)).alias("tensor"))
    jsonl.save_shards(e, path, "shard")
    first = e.where("shard = 2").limit(1)
    first.withColumn("event_id", -F.col("event_id")).write.mode("append").partitionBy("shard").parquet(f"{path}/rows")
    out = jsonl.check_shards(t.spark, path, "shard")
    return out.select("shard", F.when(F.col("shard") == "2", F.col("rows") - 1).otherwise(F.col("rows")).alias("rows"), "intact")


@query(f"""SELECT table_name, kind, CASE kind WHEN 'select' THEN NULL ELSE 'forbidden_sql' END AS error FROM (SELECT DISTINCT table_name FROM ({CATALOG})), (SELECT unnest(['select', 'insert', 'drop', 'create', 'truncate', 'refresh']) AS kind)""")
def g2_authorizer(t):
    """Every statement but a query is refused on every table."""
    g, rows = gate(t), []
    for n in STAR:
        for kind, sql in {"select": f"SELECT count(*) FROM {n}", "insert": f"INSERT INTO {n} SELECT * FROM {n}", "drop": f"DROP VIEW {n}", "create": f"CREATE VIEW x AS SELECT * FROM {n}", "truncate": f"TRUNCATE TABLE {n}", "refresh": f"REFRESH TABLE {n}"}.items():
            rows.append((n, kind, g.error_of(sql)))
    return frame(t, "table_name string, kind string, error string", rows)


PAIRED = f"WITH c AS ({CATALOG}), k AS (SELECT DISTINCT column_name AS asked FROM c), n AS (SELECT DISTINCT table_name FROM c) SELECT n.table_name, k.asked, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.table_name = n.table_name AND c.column_name = k.asked) THEN NULL ELSE 'unknown_column' END AS error FROM n, k"


def _asked(t):
    m = {n: [c for c in t(n).columns] for n in STAR}
    return [(n, c) for n in STAR for c in sorted({c for cs in m.values() for c in cs})]


@query(f"SELECT table_name, asked, error FROM ({PAIRED})")
def g4_error_classes(t):
    """Every column of the catalog asked of every table: unknown where the table lacks it."""
    g = gate(t)
    return frame(t, "table_name string, asked string, error string", [(n, c, g.error_of(f"SELECT {c} FROM {n}")) for n, c in _asked(t)])


@query(f"SELECT table_name, asked, error FROM ({PAIRED})")
def v14_reference_errors(t):
    """Reference queries run before a split; those with an error are told by class."""
    told = V.reference_errors(gate(t), [(f"{n}.{c}", f"SELECT max({c}) AS x FROM {n}") for n, c in _asked(t)])
    return frame(t, "table_name string, asked string, error string", [(*key.split("."), kind) for key, kind, _ in told])


@query(f"SELECT DISTINCT table_name AS id, TRUE AS same FROM ({CATALOG})")
def q2_star_expanded(t):
    """A star is the list of the columns."""
    out = Q.score_pairs(gate(t), [(n, f"SELECT * FROM {n}", f"SELECT {', '.join(t(n).columns)} FROM {n}") for n in STAR])
    return out.select("id", (F.col("similarity") == 1).alias("same"))


JOINS = [(f"{a}.{b}.{kind}", a, b, c, d, kind) for a, b, c, d in FOREIGN for kind in ("JOIN", "LEFT JOIN")]


@query(values("id, same", [(j[0], j[5] == "JOIN") for j in JOINS]))
def q3_join_blocks(t):
    """Inputs of an inner join are a set, those of an outer join are not."""
    pairs = [(i, f"SELECT {b}, {d} FROM {a} {kind} {c} ON {b} = {d} AND {d} > 1", f"SELECT {b}, {d} FROM {c} {kind} {a} ON {d} = {b} AND 1 < {d}") for i, a, b, c, d, kind in JOINS]
    return Q.score_pairs(gate(t), pairs).select("id", (F.col("similarity") == 1).alias("same"))


COUNTED = [
    ("not_null", "SELECT n_name FROM nation WHERE n_name IS NOT NULL", "SELECT n_name FROM nation"), ("cast", "SELECT CAST(n_nationkey AS STRING) FROM nation", "SELECT n_nationkey FROM nation"),
    ("sides", "SELECT a.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", "SELECT b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey"),
    ("table", "SELECT n_name FROM nation", "SELECT r_name FROM region"), ("number", "SELECT n_name FROM nation WHERE n_nationkey > 3", "SELECT n_name FROM nation WHERE n_nationkey >= 3"),
]


@query(values("id, same", [(n, False) for n, _, _ in COUNTED]))
def q6_what_counts(t):
    return Q.score_pairs(gate(t), COUNTED).select("id", (F.col("similarity") == 1).alias("same"))


@query(values("id, status", [("turned", "unscorable:unscorable"), ("equal", "scored"), ("plain", "scored")]))
def q5_collated_comparisons(t):
    """Sides of a comparison with a collation of its own are not interchangeable; plain text's are."""
    sub = "(SELECT n_name COLLATE UNICODE_CI AS a, n_name COLLATE UNICODE_CI AS b FROM nation)"
    pairs = [("turned", f"SELECT 1 FROM {sub} WHERE a < b", f"SELECT 1 FROM {sub} WHERE b > a"), ("equal", f"SELECT 1 FROM {sub} WHERE a < b", f"SELECT 1 FROM {sub} WHERE a < b"), ("plain", "SELECT n_name FROM nation JOIN region ON n_name = r_name", "SELECT n_name FROM nation JOIN region ON r_name = n_name")]
    return Q.score_pairs(gate(t), pairs).select("id", "status")


@query("SELECT count(DISTINCT event_id) AS events, count(DISTINCT event_id) AS keys FROM events")
def x2_incremental(t):
    """A stream of the table, ingested twice: the second time adds nothing."""
    base = shared_folder(t.spark, "stream")
    for i in range(2):
        source = t.spark.readStream.schema(t("events").schema).parquet(f"{t.sf_dir}/events.parquet*")
        incremental.ingest(source.select("event_id", "user_id"), f"{base}/table", "event_id", f"{base}/checkpoint{i}").awaitTermination()
    return t.spark.read.parquet(f"{base}/table").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("keys"))


@query(f"SELECT id, len({TOK})::INT AS n, coalesce(list_aggregate(list_slice({TOK}, 1, 2), 'string_agg', ' '), '') AS head, (id % 3)::INT AS distance FROM {{corpus}}")
def x3_registered_functions(t):
    """The engine's functions by their SQL names."""
    registered.register(t.spark)
    trees = [json.dumps(["a", [["b", []]] * n]) for n in range(3)]
    t("corpus").createOrReplaceTempView("quern_corpus")
    return t.spark.sql(f"SELECT id, quern_token_count(text) AS n, array_join(slice(quern_tokens(text), 1, 2), ' ') AS head, quern_tree_distance('{trees[0]}', element_at(array('{trees[0]}', '{trees[1]}', '{trees[2]}'), CAST(1 + id % 3 AS INT))) AS distance FROM quern_corpus")


@query("SELECT id, 2 AS tokens, round(-cur0 - cur1, 6) AS entropy_sum, round((-cur0 - cur1) / 2, 6) AS entropy_mean FROM {token_rows}")
def z4_turn_entropy(t):
    df = K.turn_entropy(t("token_rows").select("id", F.array(-F.col("cur0"), -F.col("cur1")).alias("e")), "e")
    return df.select("id", "tokens", F.round("entropy_sum", 6).alias("entropy_sum"), F.round("entropy_mean", 6).alias("entropy_mean"))


@query("""WITH c AS (SELECT user_id AS task, event_id AS i, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS mark FROM events), g AS (SELECT task, mark, count(*) AS votes, min(i) AS s FROM c GROUP BY ALL),
r AS (SELECT *, coalesce(sum(votes) FILTER (mark IS NOT NULL) OVER (PARTITION BY task), 0) AS valid, row_number() OVER (PARTITION BY task ORDER BY mark IS NULL, votes DESC, s) AS k FROM g)
SELECT task, CASE WHEN mark IS NOT NULL THEN s END AS selected_sample, CASE WHEN mark IS NULL THEN 0 ELSE votes END AS votes, valid::BIGINT AS valid, CASE WHEN mark IS NULL THEN 'all_invalid' ELSE 'voted' END AS status, coalesce(mark = 'purchase', FALSE) AS correct FROM r WHERE k = 1""")
def z10_vote_tasks(t):
    c = t("events").select(F.col("user_id").alias("task"), F.col("event_id").alias("i"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("mark"), (F.col("event_type") == "purchase").alias("ok"))
    return V.vote_tasks(c, "task", "i", "mark", "ok")


@query(BM25 + TOP.replace("rank <= 5", "rank <= 1"))
def z14_retriever(t):
    return R.top_k(R.retriever("bm25")(t("corpus"), t("questions"), k=1), 1).select("query_id", "id", "score", "rank")


@query("SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS accepted FROM nation")
def z16_run_config(t):
    """Quotas that do not sum to the pool's size are refused."""
    rows = []
    for (k,) in t("nation").select("n_nationkey").collect():  # 25 rows
        try:
            C.RunConfig(pool_size=100, difficulties={"easy": k, "hard": 100 - k - k % 2}, sources={"exploration": 100})
            rows.append((k, True))
        except ValueError:
            rows.append((k, False))
    return frame(t, "k int, accepted boolean", rows)


@query("SELECT n_nationkey AS k, n_nationkey > 3 AS accepted, CASE WHEN n_nationkey > 3 THEN 'easy' END AS active FROM nation")
def z18_collect_config(t):
    """Targets must not be negative, and one must be positive."""
    rows = []
    for (k,) in t("nation").select("n_nationkey").collect():  # 25 rows
        try:
            rows.append((k, True, ",".join(C.CollectConfig({"easy": k - 3, "hard": 0}).active())))
        except ValueError:
            rows.append((k, False, None))
    return frame(t, "k int, accepted boolean, active string", rows)


@query("""WITH s AS (SELECT conv_id, turn, (conv_id + turn) % 7 = 0 AS bad FROM {turns}), b AS (SELECT conv_id, count(*) AS turns, min(turn) FILTER (bad) AS first FROM s GROUP BY conv_id)
SELECT b.conv_id, turns, CASE WHEN first IS NULL THEN turns ELSE (SELECT count(*) FROM s WHERE s.conv_id = b.conv_id AND s.turn < first) END AS matching, first IS NULL AS complete FROM b""")
def z30_matching_prefix(t):
    """Saved episodes against a replay that shows something else at some turns, or nothing."""
    saved = t("turns").select("conv_id", "turn", "text")
    bad = (F.col("conv_id") + F.col("turn")) % 7 == 0
    replayed = saved.where(~bad | (F.col("conv_id") % 2 == 0)).withColumn("text", F.when(bad, "another").otherwise(F.col("text")))
    return V.matching_prefix(saved, replayed, "conv_id", "turn", "text")


@query(f"SELECT k::INT AS k, strlen(content)::BIGINT AS length, TRUE AS dated FROM ({NATION_FILES})")
def z31_checkpoint_identity(t):
    """What tells files apart without reading them: their exact sizes, and times of this session."""
    return jsonl.identity(t.spark, nation_files(t)).select(_key("path"), "length", (F.col("modified") > F.current_timestamp() - F.expr("interval 1 day")).alias("dated"))


@query("SELECT difficulty, count(*) AS rows, TRUE AS short_refused, TRUE AS again_refused FROM {tasks} GROUP BY 1")
def z23_finalize(t):
    """A collection is finished once its totals are met: not when one is short, and not twice."""
    path, rows = shared_folder(t.spark, "final"), t("tasks").drop("question")
    totals = {r[0]: r[1] for r in rows.groupBy("difficulty").count().collect()}  # a row a language

    def refused(x) -> bool:
        try:
            jsonl.finalize(rows, x, "difficulty", path)
        except Exception as e:
            return isinstance(e, ValueError) or "PATH_ALREADY_EXISTS" in str(e)
        return False

    short = refused({**totals, "en": totals.get("en", 0) + 1})
    jsonl.finalize(rows, totals, "difficulty", path)
    found = jsonl.load_jsonl(t.spark, f"{path}/records", "difficulty string").groupBy("difficulty").agg(F.count(F.lit(1)).alias("rows"))
    return found.withColumns({"short_refused": F.lit(short), "again_refused": F.lit(refused(totals))})


@query("SELECT n_name AS name, '`' || replace(n_name || CASE WHEN n_nationkey % 2 = 0 THEN '`x' ELSE '' END, '`', '``') || '`' AS quoted FROM nation")
def z34_quoted(t):
    rows = t("nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, "`x").otherwise("")).collect()  # 25 rows
    return frame(t, "name string, quoted string", [(a, quote(a + b)) for a, b in rows])
