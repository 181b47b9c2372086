"""Task sets from documents: language as difficulty, source as database."""

from pyspark.sql import functions as F

from quern.operators import datasets as D
from quern.queries.base import query

H = "sha256('{0}:' || {1}::VARCHAR)"


def h(seed, col="task_id"):
    return H.format(seed, col)


SPLIT = f"""WITH d AS (SELECT DISTINCT db_id FROM {{tasks}}), x AS (SELECT db_id, row_number() OVER (ORDER BY {h(42, 'db_id')}, db_id) AS r, count(*) OVER () AS n FROM d),
s AS (SELECT db_id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + floor((n - round_even(n * 0.7, 0)) / 2) THEN 'internal_validation' ELSE 'internal_holdout' END AS split FROM x) """


@query(SPLIT + "SELECT * FROM s")
def b1_split_databases(t):
    return D.split_databases(t("tasks"))


@query("""WITH k AS (SELECT DISTINCT db_id FROM {tasks} WHERE db_id <> 'src3') SELECT reason, count(*) AS tasks FROM (SELECT CASE WHEN k.db_id IS NULL THEN 'missing_database' WHEN trim(coalesce(question, '')) = '' THEN 'missing_question' WHEN count(*) OVER (PARTITION BY task_id) > 1 THEN 'duplicate_id' END AS reason
FROM {tasks} a LEFT JOIN k ON a.db_id = k.db_id) GROUP BY reason""")
def b2_routing(t):
    tasks = t("tasks")
    known = tasks.select("db_id").distinct().where("db_id <> 'src3'")
    return D.route_tasks(tasks, known).groupBy("reason").agg(F.count(F.lit(1)).alias("tasks"))


@query(SPLIT + "SELECT split, count(*) AS tasks, count(DISTINCT a.db_id) AS databases, count(*) FILTER (difficulty = 'en') AS en, count(*) FILTER (difficulty = 'de') AS de, count(*) FILTER (difficulty = 'fr') AS fr, count(*) FILTER (difficulty = 'es') AS es FROM {tasks} a JOIN s ON a.db_id = s.db_id GROUP BY split")
def b3_split_statistics(t):
    tasks = t("tasks")
    return D.split_statistics(tasks.join(F.broadcast(D.split_databases(tasks)), "db_id"))


DIVERSE = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY difficulty, db_id ORDER BY {h(7)}, task_id) > 1 AS repeat FROM {{tasks}}),
p AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY repeat, {h(7)}, task_id) AS place, count(*) OVER (PARTITION BY difficulty) AS n FROM a) """


@query(DIVERSE + "SELECT task_id, difficulty, repeat, place FROM p")
def b4_diverse_order(t):
    return D.diverse_order(t("tasks").drop("question"), 7, "db_id", "task_id", "difficulty").select("task_id", "difficulty", "repeat", "place")


@query(DIVERSE + "SELECT task_id, difficulty, place, greatest(0, 30 - n)::BIGINT AS short FROM p WHERE place <= 30")
def b5_select_diverse(t):
    return D.select_diverse(t("tasks").drop("question"), "difficulty", 30, 7).select("task_id", "difficulty", "place", F.col("short").cast("long").alias("short"))


@query(f"SELECT task_id, difficulty, place FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY {h(3)}, task_id) AS place FROM {{tasks}}) WHERE place <= 25")
def b6_stratified_sample(t):
    return D.sample_per_stratum(t("tasks").drop("question"), "difficulty", 25, 3).select("task_id", "difficulty", "place")


@query(f"""WITH w AS (SELECT id AS task_id, task AS difficulty, db_id FROM {{attempts}} WHERE won = 1), q(difficulty, quota) AS (VALUES ('en', 40), ('de', 15), ('fr', 15), ('es', 10)),
a AS (SELECT *, row_number() OVER (PARTITION BY difficulty, db_id ORDER BY {h(5)}, task_id) > 1 AS repeat FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY repeat, {h(5)}, task_id) AS place FROM a)
SELECT task_id, difficulty, place FROM p JOIN q USING (difficulty) WHERE place <= quota""")
def b7_trim_successes(t):
    won = t("attempts").where("won = 1").select(F.col("id").alias("task_id"), F.col("task").alias("difficulty"), "db_id")
    placed = D.diverse_order(won, 5, "db_id", "task_id", "difficulty")
    quotas = D.quota_table(won, {"en": 40, "de": 15, "fr": 15, "es": 10}, "difficulty")
    return placed.join(F.broadcast(quotas), "difficulty").where("place <= quota").select("task_id", "difficulty", "place")


TARGETS = {"en": 400, "de": 120, "fr": 130, "es": 40}
FACTORS, LEAST = {"en": 2, "de": 3, "fr": 4, "es": 8}, {"en": 32, "de": 64, "fr": 70, "es": 12}
LIMITS = """q(difficulty, target, factor, least) AS (VALUES ('en', 400, 2, 32), ('de', 120, 3, 64), ('fr', 130, 4, 70), ('es', 40, 8, 12)), done AS (SELECT id AS task_id, task AS difficulty FROM {attempts} WHERE won = 1),
l AS (SELECT q.difficulty, greatest(0, target - coalesce(k, 0)) AS deficit, factor, least FROM q LEFT JOIN (SELECT difficulty, count(*) AS k FROM done GROUP BY 1) USING (difficulty)),
lim AS (SELECT difficulty, deficit, CASE WHEN deficit > 0 THEN greatest(least, deficit * factor) ELSE 0 END AS candidates FROM l) """


@query(f"""WITH {LIMITS}, a AS (SELECT *, row_number() OVER (PARTITION BY difficulty, db_id ORDER BY {h(9)}, task_id) > 1 AS repeat FROM {{tasks}} WHERE task_id NOT IN (SELECT task_id FROM done)),
p AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY repeat, {h(9)}, task_id) AS place FROM a)
SELECT task_id, difficulty, place, deficit::BIGINT AS deficit FROM p JOIN lim USING (difficulty) WHERE place <= candidates""")
def b8_prepare_candidates(t):
    done = t("attempts").where("won = 1").select(F.col("id").alias("task_id"), F.col("task").alias("difficulty"))
    limits = D.candidate_limits(done, TARGETS, FACTORS, LEAST, "difficulty")
    out = D.prepare_candidates(t("tasks").drop("question"), done, limits, "difficulty", 9)
    return out.select("task_id", "difficulty", "place", F.col("deficit").cast("long").alias("deficit"))


@query("""WITH w AS (SELECT id AS task_id, task AS difficulty, db_id, count(*) OVER (PARTITION BY db_id) AS db_count FROM {attempts} WHERE won = 1), q(difficulty, deficit) AS (VALUES ('en', 50), ('de', 20), ('fr', 20), ('es', 10)),
p AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY db_count, db_id, task_id) AS place FROM w) SELECT task_id, difficulty, db_id, db_count, place FROM p JOIN q USING (difficulty) WHERE place <= deficit""")
def b9_fill_quotas(t):
    won = t("attempts").where("won = 1").select(F.col("id").alias("task_id"), F.col("task").alias("difficulty"), "db_id")
    deficits = D.quota_table(won, {"en": 50, "de": 20, "fr": 20, "es": 10}, "difficulty").withColumnRenamed("quota", "deficit")
    return D.fill_quotas(won, deficits, "difficulty").select("task_id", "difficulty", "db_id", "db_count", "place")


FP = r"""fps AS (SELECT task_id, db_id, sha256('["' || lower(trim(regexp_replace(coalesce(db_id, ''), '\s+', ' ', 'g'))) || '","' || replace(replace(lower(trim(regexp_replace(coalesce(question, ''), '\s+', ' ', 'g'))), '\', '\\'), '"', '\"') || '"]') AS fp FROM {tasks}) """


def prints(t):
    return t("tasks").withColumn("fp", D.fingerprint(F.col("db_id"), F.col("question")))


@query("WITH " + FP + "SELECT task_id, fp FROM fps")
def b10_fingerprint(t):
    return prints(t).select("task_id", "fp")


@query("WITH " + FP + """, ex AS (SELECT * FROM fps WHERE db_id = 'src1') SELECT fp, min(task_id) AS task_id FROM fps WHERE task_id NOT IN (SELECT task_id FROM ex) AND fp NOT IN (SELECT fp FROM ex) GROUP BY fp""")
def b11_build_pool(t):
    df = prints(t)
    return D.build_pool(df, df.where("db_id = 'src1'")).select("fp", "task_id")


SOURCES = "s AS (SELECT task_id, difficulty, db_id, CASE WHEN k IS NULL THEN 'exploration' WHEN k = 0 THEN 'zero' WHEN k = 4 THEN 'mastered' ELSE 'boundary' END AS source FROM (SELECT *, CASE WHEN n_chars % 7 > 0 THEN n_chars % 5 END AS k FROM {tasks})) "


def sourced(t):
    return t("tasks").withColumn("k", F.when(F.col("n_chars") % 7 > 0, F.col("n_chars") % 5)).withColumn("source", D.source_for_count(F.col("k"), 4))


@query("WITH " + SOURCES + "SELECT source, difficulty, count(*) AS tasks FROM s GROUP BY ALL")
def b12_sources(t):
    return sourced(t).groupBy("source", "difficulty").agg(F.count(F.lit(1)).alias("tasks"))


QUOTAS = [("exploration", "en", 20), ("zero", "en", 10), ("boundary", "en", 30), ("boundary", "de", 12), ("mastered", "fr", 5), ("zero", "es", 4000)]
QUOTA_SQL = "q(source, difficulty, quota) AS (VALUES " + ", ".join(map(str, QUOTAS)) + ") "
POOL = "WITH " + SOURCES + ", " + QUOTA_SQL + f""", a AS (SELECT *, row_number() OVER (PARTITION BY source, difficulty, db_id ORDER BY {h(11)}, task_id) > 1 AS repeat FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY source, difficulty ORDER BY repeat, {h(11)}, task_id) AS place FROM a), sel AS (SELECT * FROM p JOIN q USING (source, difficulty) WHERE place <= quota) """


def pool(t):
    df = sourced(t).drop("question")
    quotas = df.sparkSession.createDataFrame(QUOTAS, "source string, difficulty string, quota int")
    return D.curriculum_pool(df, quotas, 11), quotas


@query(POOL + "SELECT task_id, source, difficulty, place FROM sel")
def b13_curriculum_pool(t):
    return pool(t)[0].select("task_id", "source", "difficulty", "place")


@query(POOL + "SELECT source, difficulty, quota, coalesce(k, 0) AS selected FROM q LEFT JOIN (SELECT source, difficulty, count(*) AS k FROM sel GROUP BY ALL) USING (source, difficulty) WHERE coalesce(k, 0) < quota")
def b13_shortages(t):
    return D.shortages(*pool(t))


@query("""SELECT coalesce(a.seq, b.seq) AS seq, left_key, right_key FROM (SELECT task_id AS seq, db_id AS left_key FROM {tasks}) a FULL JOIN (SELECT task_id AS seq, CASE WHEN task_id % 50 = 3 THEN 'other' ELSE db_id END AS right_key FROM {tasks} WHERE task_id % 97 <> 1) b ON a.seq = b.seq WHERE left_key IS DISTINCT FROM right_key""")
def b14_pool_reuse(t):
    a = t("tasks")
    b = a.where("task_id % 97 <> 1").withColumn("db_id", F.when(F.col("task_id") % 50 == 3, "other").otherwise(F.col("db_id")))
    return D.same_order(a, b, "task_id", "db_id")


@query("SELECT task_id, db_id FROM {tasks} WHERE ((task_id - 7 * 64) % 200 + 200) % 200 < 64")
def b15_cyclic_batch(t):
    return D.cyclic_batch(t("tasks"), "task_id", 200, 7, 64).select("task_id", "db_id")


@query(f"""WITH a AS (SELECT task_id, n_chars, {h(13)} AS h FROM {{tasks}}), b AS (SELECT *, (row_number() OVER (ORDER BY h, task_id) - 1) // 64 AS bucket FROM a)
SELECT task_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket % 2 = 0 THEN n_chars ELSE -n_chars END, h, task_id) AS place FROM b""")
def b33_epoch_order(t):
    return D.epoch_order(t("tasks").drop("question"), "n_chars", "task_id", 13, 64).select("task_id", "bucket", "place")


@query("SELECT difficulty, quota AS expected, coalesce(k, 0) AS actual, quota = coalesce(k, 0) AS exact FROM (VALUES ('en', 620), ('de', 100), ('xx', 0)) q(difficulty, quota) LEFT JOIN (SELECT difficulty, count(*) AS k FROM {tasks} GROUP BY 1) USING (difficulty)")
def b30_quota_check(t):
    return D.quota_check(t("tasks"), {"en": 620, "de": 100, "xx": 0}, "difficulty")


@query("SELECT task_id, difficulty || '-' || substr(sha256(task_id::VARCHAR), 1, 12) AS name, 42 + ('0x' || substr(sha256(task_id::VARCHAR), 1, 8))::BIGINT + 2 * 1000003 + 3 AS seed FROM {tasks}")
def z19_names_and_seeds(t):
    key = F.col("task_id").cast("string")
    return t("tasks").select("task_id", D.record_name(F.col("difficulty"), key).alias("name"), D.generation_seed(42, key, F.lit(2), F.lit(3)).alias("seed"))
