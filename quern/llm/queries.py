"""The registered queries of the corpus operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import centroids, embedding_dedup, html_extract, language_id, line_dedup, ngram_join, packing, quality, ranked_search, sampled_pieces, secrets, toxicity, warc
from quern.llm.common import table


def op1_pack(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality(spark, sf_dir):
    out = quality.score_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


def op4_html_extract(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_secrets(spark, sf_dir):
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), mark=None)
    return out.select("doc_id", "scan.n_assign", "scan.n_access", "scan.n_hex", "scan.base_sha256", "scan.spans")


def _fold(n):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(_fold(4) != 2))
    out = language_id.predict_language(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_sampled_pieces(spark, sf_dir):
    return sampled_pieces.encoded_digest(table(spark, sf_dir, "documents"), key="doc_id")


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(_fold(5) != 0))
    out = toxicity.score_toxicity(docs, model)
    held = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_lloyd(spark, sf_dir):
    return centroids.lloyd(table(spark, sf_dir, "embeddings"))


def op12_warc(spark, sf_dir):
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def conversation_packing(spark, sf_dir):
    """Whole conversations under limits on tokens, turns and loss-bearing tokens (operator 1 in its general form)."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"))


def quality_base(spark, sf_dir):
    return op3_quality(spark, sf_dir).drop("kept", "votes", "quality")


def secret_counts(spark, sf_dir):
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def language_folds(spark, sf_dir):
    return op7_language(spark, sf_dir).select("doc_id", "held_out")


def toxicity_folds(spark, sf_dir):
    return op10_toxicity(spark, sf_dir).select("doc_id", "held_out")


def queries():
    operators = (op1_pack, op2_line_dedup, op3_quality, op4_html_extract, op5_secrets, op6_ngram_join, op7_language, op8_embedding_dedup, op9_sampled_pieces, op10_toxicity, op11_lloyd, op12_warc, op13_ranked_search)
    # What SQL can say of queries that it cannot express whole, and the general form of packing.
    parts = (conversation_packing, quality_base, secret_counts, language_folds, toxicity_folds)
    return {f.__name__: f for f in (*operators, *parts)}


# Each row is a document.
OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT row, doc_id, i, parts[i] AS line,
         trim(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT row, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs)),
common AS (
  SELECT k, max(doc_id) AS hi FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT row) >= 3),
told AS (
  SELECT l.row, l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id IS DISTINCT FROM c.hi AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY row, doc_id
"""


WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{WORDS}') GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
       coalesce(hit.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(w) AS base_failed
FROM t LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)
"""

SECRET_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

JOIN_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

EMBEDDING_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept FROM embeddings m LEFT JOIN k ON k.a = m.vec_id JOIN c ON c.node = m.vec_id
"""


def _folds_sql(n: int, held: int) -> str:
    """DuckDB has no crc32: the polynomial's remainder, bit by bit over the digits of doc_id."""
    bit = "CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    step = "xor(acc, ascii(c)::BIGINT)"
    for _ in range(8):
        step = f"(SELECT {bit} FROM (SELECT {step} AS x))"
    return f"""
WITH RECURSIVE r(doc_id, digits, i, acc) AS (
  SELECT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM documents
  UNION ALL SELECT doc_id, digits, i + 1, {step} FROM (SELECT doc_id, digits, i, acc, substr(digits, i, 1) AS c FROM r WHERE i <= length(digits)))
SELECT doc_id, xor(acc, 4294967295) % {n} = {held} AS held_out FROM r WHERE i = length(digits) + 1
"""


def _lloyd_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds are common table expressions: a0 assigns to c0, c1 has the floors of its means, and so on."""
    text = [r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS j, v AS c FROM v QUALIFY j < """ + f"{clusters})"]
    for i in range(rounds + 1):
        text.append(f"d{i} AS (SELECT row, vec_id, v, j, list_sum([((v[p] - c[p]) * (v[p] - c[p]))::HUGEINT FOR p IN range(1, 65)])::BIGINT AS d FROM v CROSS JOIN c{i})")
        text.append(f"a{i} AS MATERIALIZED (SELECT row, vec_id, v, j, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, j) = 1)")
        if i < rounds:
            text.append(f"s{i} AS (SELECT j, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY j, p)")
            text.append(f"m{i} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{i} GROUP BY j)")
            text.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))")
    return ",\n".join(text) + f"""
SELECT vec_id, a.j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
"""


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN r THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r THEN first END AS refers_to
FROM (SELECT p.*, first, first IS NOT NULL AND coalesce(page_id > first, TRUE) AS r FROM p LEFT JOIN f USING (h)) p
"""

SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, row, unnest(regexp_extract_all(TEXT, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS row FROM documents)),
n AS (SELECT row, count(*) AS n FROM t GROUP BY row),
whole AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(TEXT, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * whole.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY term, whole.n),
f AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * whole.n) // whole.l)) AS f FROM p JOIN n USING (row), whole),
s AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * f)::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) GROUP BY item_id, row)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""".replace("TEXT", LOWER)


def oracle_sql():
    return {
        "op2_line_dedup": OP2_SQL, "op6_ngram_join": JOIN_SQL, "op8_embedding_dedup": EMBEDDING_SQL, "op11_lloyd": _lloyd_sql(), "op12_warc": WARC_SQL, "op13_ranked_search": SEARCH_SQL, "quality_base": QUALITY_SQL, "secret_counts": SECRET_SQL,
        "language_folds": _folds_sql(4, 2), "toxicity_folds": _folds_sql(5, 0),
    }
