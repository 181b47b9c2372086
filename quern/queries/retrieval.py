"""Retrieval over documents as memories and benchmark items as questions; all rows of both."""

from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.queries.base import query

TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[㐀-䶿一-鿿]')"
BASE = f"""WITH ct AS (SELECT id, unnest({TOK}) AS term FROM {{corpus}}), qt AS (SELECT id AS query_id, unnest({TOK}) AS term FROM {{questions}}),
tf AS (SELECT id, term, count(*) AS tf FROM ct GROUP BY ALL), n AS (SELECT count(*) AS n FROM {{corpus}}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), """
TFIDF = BASE + """idf AS (SELECT term, 1 + ln((1 + n) / (1 + df)) AS idf FROM df, n),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)), wn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w),
qw AS (SELECT query_id, term, tf * idf AS w FROM (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL) JOIN idf USING (term)), qn AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qw),
s AS (SELECT query_id, id, round(sum(wn.weight * qn.weight), 4) AS score FROM wn JOIN qn USING (term) GROUP BY ALL) """
BM25 = BASE + f"""l AS (SELECT id, len({TOK}) AS len FROM {{corpus}}), a AS (SELECT avg(len) AS avg_len FROM l), q AS (SELECT DISTINCT query_id, term FROM qt),
s AS (SELECT query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 4) AS score
 FROM q JOIN df USING (term) JOIN tf USING (term) JOIN l ON l.id = tf.id, n, a GROUP BY ALL) """
TOP = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 5"


@query(f"SELECT id, len({TOK}) AS n_tokens, coalesce(list_aggregate(list_slice({TOK}, 1, 3), 'string_agg', ' '), '') AS head FROM {{corpus}}")
def t1_tokens(t):
    x = R.tokens(F.col("text"))
    return t("corpus").select("id", F.size(x).cast("long").alias("n_tokens"), F.array_join(F.slice(x, 1, 3), " ").alias("head"))


@query(TFIDF + TOP)
def t2_tfidf_top(t):
    return R.top_k(R.tfidf_scores(t("corpus"), t("questions"), k=5), 5).select("query_id", "id", "score", "rank")


@query(BM25 + TOP)
def t3_bm25_top(t):
    return R.top_k(R.bm25_scores(t("corpus"), t("questions"), k=5), 5).select("query_id", "id", "score", "rank")


@query("""WITH v AS (SELECT vec_id AS id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), q AS (SELECT id AS query_id, v AS q FROM v WHERE id % 50 = 0),
s AS (SELECT query_id, id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 4) AS score FROM v, q) """ + TOP)
def t4_cosine_top(t):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.top_k(R.cosine_scores(v, v.where("id % 50 = 0"), k=5), 5).select("query_id", "id", "score", "rank")


@query(f"WITH n AS (SELECT id % 40 AS query_id, id, (id % 7)::DOUBLE / 4 AS score FROM {{corpus}}), s AS (SELECT * FROM n) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 3")
def t5_top_k_ties(t):
    s = t("corpus").select((F.col("id") % 40).alias("query_id"), "id", ((F.col("id") % 7).cast("double") / 4).alias("score"))
    return R.top_k(s, 3).select("query_id", "id", "score", "rank")


PACK = """WITH RECURSIVE w AS (SELECT conv_id, turn, 1 + length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM {turns}),
f AS (SELECT conv_id, i, CASE WHEN cost <= 400 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 400 THEN [i - 1] ELSE [] END AS kept FROM w WHERE i = 1
 UNION ALL SELECT w.conv_id, w.i, CASE WHEN used + cost <= 400 THEN used + cost ELSE used END, CASE WHEN used + cost <= 400 THEN list_append(kept, w.i - 1) ELSE kept END FROM f JOIN w ON w.conv_id = f.conv_id AND w.i = f.i + 1)
SELECT conv_id, coalesce(list_aggregate(arg_max(kept, i), 'string_agg', ','), '') AS kept FROM f GROUP BY conv_id"""


@query(PACK)
def t6_greedy_packing(t):
    """A conversation's turns as ranked blocks, 400 characters of room."""
    blocks = t("turns").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (1 + F.char_length("text")).alias("cost")))).alias("b"))
    return blocks.select("conv_id", F.array_join(R.pack_blocks(F.transform("b", lambda x: x["cost"]), 400).cast("array<string>"), ",").alias("kept"))


@query("SELECT count(*) FILTER (keep) AS usable, count(*) FILTER (NOT keep) AS excluded FROM (SELECT conv_id % 5 > 0 AS keep FROM {turns})")
def t7_sql_memories(t):
    m = t("turns").withColumn("sql_before", F.when(F.col("conv_id") % 5 > 0, F.col("text")))
    usable, excluded = R.sql_memories(m, "sql_before")
    return usable.agg(F.count(F.lit(1)).alias("usable")).join(excluded)


@query(BM25.replace("WITH ct", "WITH RECURSIVE ct") + f""", top AS ({TOP}), w AS (SELECT query_id, rank AS i, top.id, len AS cost FROM top JOIN l ON l.id = top.id),
f AS (SELECT query_id, i, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 600 THEN [id] ELSE [] END AS kept FROM w WHERE i = 1
 UNION ALL SELECT w.query_id, w.i, CASE WHEN used + cost <= 600 THEN used + cost ELSE used END, CASE WHEN used + cost <= 600 THEN list_append(kept, w.id) ELSE kept END FROM f JOIN w ON w.query_id = f.query_id AND w.i = f.i + 1)
SELECT query_id, coalesce(list_aggregate(arg_max(kept, i), 'string_agg', ','), '') AS ids, arg_max(used, i)::BIGINT AS tokens FROM f GROUP BY query_id""")
def t8_contexts(t):
    corpus = t("corpus")
    out = R.contexts(R.top_k(R.bm25_scores(corpus, t("questions"), k=5), 5), corpus, 600)
    return out.select("query_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "tokens")


@query("""SELECT conv_id, turn, tool = 'execute_sql' AND ok AND wins = 1 AS first_success, tool = 'execute_sql' AND runs = 1 AS first_execute, tool = 'execute_sql' AND runs >= 2 AS every_execute
FROM (SELECT *, count(*) FILTER (tool = 'execute_sql') OVER w AS runs, count(*) FILTER (tool = 'execute_sql' AND ok) OVER w AS wins FROM (SELECT *, length(text) % 2 = 0 AS ok FROM {turns}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))""")
def t9_triggers(t):
    df = t("turns").withColumn("ok", F.char_length("text") % 2 == 0)
    for policy in ("first_success", "first_execute", "every_execute"):
        df = R.triggers(df, policy).withColumnRenamed("retrieve", policy)
    return df.select("conv_id", "turn", "first_success", "first_execute", "every_execute")


@query("SELECT vec_id, round(list_dot_product(v, v), 6) AS norm2, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)")
def t10_stored_vectors(t):
    """Stored encodings stand in for the encoder: their norms and normalised heads."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", F.round(R.dot(d, d), 6).alias("norm2"), F.round(R.unit(F.col("embedding"))[0], 6).alias("first"))
