"""Exact top-k although documents and blocks are skipped."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as R


def texts(rng, n, words):
    return [" ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.choice(words))) for _ in range(n)]


def counts_of(rows):
    return [(i, Counter(re.findall(r"[a-z0-9_]+", (t or "").lower()))) for i, t in rows]


def brute_tfidf(docs, queries):
    docs, queries = counts_of(docs), counts_of(queries)
    df = Counter(t for _, c in docs for t in c)
    idf = {t: 1 + math.log((1 + len(docs)) / (1 + n)) for t, n in df.items()}

    def vector(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = [(i, vector(c)) for i, c in docs]
    return {(q, i): sum(x * v[t] for t, x in a.items() if t in v) for q, a in ((q, vector(c)) for q, c in queries) for i, v in vectors if a.keys() & v.keys()}


def brute_bm25(docs, queries):
    docs, queries = counts_of(docs), counts_of(queries)
    df, n = Counter(t for _, c in docs for t in c), len(docs)
    mean = sum(sum(c.values()) for _, c in docs) / n
    part = lambda c, t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
    return {(q, i): sum(part(c, t) for t in a if t in c) for q, a in queries for i, c in docs if a.keys() & c.keys()}


def best(scores, k, digits):
    out = []
    for q in {q for q, _ in scores}:
        ranked = sorted((-round(s, digits), i) for (a, i), s in scores.items() if a == q and round(s, digits) > 0)
        out += [(q, i, -s, n) for n, (s, i) in enumerate(ranked[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind,brute", [("tfidf", brute_tfidf), ("bm25", brute_bm25)])
def test_lexical_top_k_equals_brute_force(spark, monkeypatch, kind, brute):
    rng = random.Random(4)
    docs = list(enumerate(texts(rng, 300, [0, 1, 4, 30, 120]))) + [(300 + i, "w1 w2") for i in range(20)] + [(400, None), (401, "w3 " * 3000)]
    queries = list(enumerate(texts(rng, 25, [1, 3, 15]))) + [(50, None), (51, "nowhere"), (52, "nowhere w7 w7")]
    d, q = (spark.createDataFrame(x, "id long, text string").withColumn("term", F.lit("extra")) for x in (docs, queries))
    d = d.repartition(3)
    want = brute(docs, queries)
    score = R.retriever(kind)
    monkeypatch.setattr(R, "POSTINGS", 900)  # many blocks, so that many are skipped
    monkeypatch.setattr(R, "ASKED", 20)
    for k in (1, 7):
        found = score(d, q, digits=6, k=k)
        got = R.top_k(found, k).select("query_id", "id", "score", "rank")
        assert [(a, b, round(c, 6), r) for a, b, c, r in sorted(tuple(x) for x in got.collect())] == best(want, k, 6)
        assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    every = {(r["query_id"], r["id"]): r["score"] for r in score(d, q, digits=6).collect()}
    assert every == {key: round(v, 6) for key, v in want.items()}
    monkeypatch.setattr(R, "SMALL", 10)  # tables of terms are joined, all terms are counted
    assert [tuple(r) for r in R.top_k(score(d, q, digits=6, k=7), 7).select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()] == sorted(best(want, 7, 6), key=lambda x: (x[0], x[3]))
    assert score(d.limit(0), q, k=3).count() == 0 and score(d, q.limit(0), k=3).count() == 0


def test_lists_leave_out_only_what_cannot_reach():
    import pandas as pd

    rng = np.random.default_rng(5)
    terms = [f"t{i}" for i in range(12)]
    frame = pd.DataFrame({"id": range(200), "terms": [list(rng.choice(terms, rng.integers(0, 6), replace=False)) for _ in range(200)]})
    frame["w"] = [rng.pareto(1.5, len(t)) for t in frame["terms"]]
    lists = R._Lists(frame, {t: i for i, t in enumerate(terms)})
    asked, weights = np.arange(8), rng.random(8)
    full = dict(zip(*lists.hits(asked, weights, None)))
    for least in (0.0, 0.5, 2.0, 10.0, 1e9):
        some = dict(zip(*lists.hits(asked, weights, least)))
        assert {d: s for d, s in some.items() if s >= least} == pytest.approx({d: s for d, s in full.items() if s >= least})
    assert len(lists.hits(asked, weights, 10.0)[0]) < len(full)


def test_cosine_top_k_equals_brute_force_and_skips(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)] + [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [1.0, 2.0]), (6004, [2.0, 1.0]), (6005, [])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("v", F.lit("x")).repartition(4)
    q = v.where("id % 50 = 0 or id >= 6000")
    monkeypatch.setattr(R, "BLOCK", 50)
    monkeypatch.setattr(R, "NUMBERS", 400)
    fine = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and np.isfinite(x).all() and np.linalg.norm(x) > 0}
    want = {(a, b): float(fine[a] @ fine[b]) for a in fine if a % 50 == 0 or a >= 6000 for b in fine if len(fine[a]) == len(fine[b])}
    got = R.top_k(R.cosine_scores(v, q, digits=6, k=5), 5).select("query_id", "id", "score", "rank").collect()
    assert sorted(tuple(r) for r in got) == best(want, 5, 6)
    seen = R.cosine_search(v, q, 6, 5, seen=True).agg(F.sum("looked"), F.sum("skipped")).first()
    assert seen[1] > seen[0]  # of queries and blocks most pairs are passed over
    assert R.cosine_scores(v.limit(0), q, k=2).count() == 0 and R.cosine_scores(v, q.limit(0), k=2).count() == 0


def test_queries_meet_a_block_in_slices(spark, monkeypatch):
    """products of queries and a block are bounded, whatever the number of queries; lengths and ties are as by brute force."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6 if i % 4 else 9).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    monkeypatch.setattr(R, "TOGETHER", 7)
    got = R.top_k(R.cosine_scores(df, df.where("id % 5 = 0"), k=4), 4).collect()
    want = set()
    for q, a in rows[::5]:
        scores = [(i, round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 4)) for i, b in rows if len(a) == len(b) and any(a) and any(b)]
        best = sorted((x for x in scores if x[1] > 0), key=lambda x: (-x[1], x[0]))[:4]
        want |= {(q, i, s, n) for n, (i, s) in enumerate(best, 1)}
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in got} == want


def test_the_retriever_hands_on_its_best_alone(spark, monkeypatch):
    """z14 asks for one hit a query and partition, and texts come in batches of a thousand at most."""
    from quern import queries

    asked, plain = [], R.bm25_scores
    monkeypatch.setattr(R, "bm25_scores", lambda *a, **k: asked.append(k) or plain(*a, **k))
    queries.queries()["z14_retriever"](spark, "/root/testdata/sf0.001")
    assert asked == [{"k": 1}]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


@pytest.mark.parametrize("small,rest", [(1_000_000, False), (190, False), (40, True)])
def test_texts_are_read_again_rather_than_written(spark, monkeypatch, small, rest):
    """of TF-IDF the frequencies of terms are written, and squares of rare terms where not all frequent ones go to all tasks; scores are as by brute force."""
    rng = random.Random(9)
    docs = [(i, " ".join([f"v{min(int(rng.paretovariate(0.8)), 150)}" for _ in range(rng.choice([0, 3, 40]))] + [f"once{i}"] * (i % 3))) for i in range(300)] + [(900, None)]
    queries = [(i, f"v{i} v{i + 3} once{i} once{i + 1} nowhere") for i in range(12)]
    d, q = (spark.createDataFrame(x, "id long, text string").repartition(3) for x in (docs, queries))
    labels, written = [], R._written
    monkeypatch.setattr(R, "_written", lambda df, label: labels.append(label) or written(df, label))
    monkeypatch.setattr(R, "SMALL", small)
    monkeypatch.setattr(R, "HELD", 25)
    monkeypatch.setattr(R, "ASKED", 20)
    got = R.top_k(R.tfidf_scores(d, q, digits=6, k=4), 4).select("query_id", "id", "score", "rank")
    assert [(a, b, round(c, 6), r) for a, b, c, r in sorted(tuple(x) for x in got.collect())] == best(brute_tfidf(docs, queries), 4, 6)
    assert labels == ["frequencies"] + ["rare"] * rest
