"""Clustering, archives and ranked search against brute force, and their edges."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import centroids, ranked_search, warc

def clash(df):
    """With further columns whose names the operators use themselves."""
    return df.withColumns({"cluster": F.lit("x"), "rank": F.lit(1), "key": F.lit("y"), "known": F.lit(None), "v": F.lit(2), "score": F.lit("z"), "first": F.lit(0)})


# Lloyd


def brute_lloyd(rows, k=40, rounds=5, dims=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(256 * float(x)) for x in e]))
    marks = [(i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept]
    cents = [list(v) for _, _, v in sorted(marks)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        told = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, x) in zip(kept, told) if x == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    told = assign()
    sums = Counter()
    for d, j in told:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    fit = lambda x: min(x, 2**63 - 1)
    return sorted(((i, j, fit(d), fit(sums[j]), fit(sum(sums.values())), sha[j]) for (i, _), (d, j) in zip(kept, told)), key=repr)


@pytest.mark.parametrize("scale", [0.3, 1000.0, 2.0**22])
def test_lloyd_equals_brute_force(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, scale) for _ in range(64)]) for i in range(90)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, []), (202, [0.1] * 63), (203, [float("nan")] + [0.0] * 63), (204, [None] + [0.0] * 63), (205, [float("inf")] * 64)]
    rows += [(300 + i, [0.0] * 64) for i in range(60)]  # copies, and clusters that get nothing
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").transform(clash).repartition(5)
    got = centroids.lloyd(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lloyd(rows)
    assert [c for c, _ in got.dtypes] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_lloyd_of_few_or_no_rows(spark):
    few = [(2**62 + i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in centroids.lloyd(df).collect()) == brute_lloyd(few)
    assert centroids.lloyd(df.limit(0)).count() == 0


def test_nearest_takes_the_lower_index_and_does_not_wrap():
    c = np.array([[2, 0], [0, 2], [2, 0]])
    assert centroids.nearest(np.array([[1, 1], [2, 0]]), c)[0].tolist() == [0, 0]
    far = np.array([[2**61, -(2**61)]])
    cluster, distance = centroids.nearest(far, np.array([[-(2**61), 2**61], [2**61, -(2**61) + 1]]))
    assert (cluster.tolist(), distance.tolist()) == ([1], [1])


# WARC


def odd_pages(n=150):
    rng = random.Random(5)
    same = "<p>" + "équal " * 40 + "</p>"
    rows = [(i, f"http://h{i % 7}.example.com/{i}", rng.choice([None, "", "tiny", same, "x" * 99, "y" * 100, f"<html>{rng.random()}{'z' * rng.randint(0, 3000)}</html>"])) for i in range(n)]
    rows += [(3, "http://again.example.com/", same), (None, "http://none.example.com/", same), (None, None, "no id " * 40), (None, None, "no id " * 40)]
    return [*rows, (500, None, "a\r\n\r\nWARC/1.1\r\n" * 30), (501, "http://bad.example.com/\r\nX-Evil: 1", "u" * 200), (2**62, "http://ü.example.com/ a", "v" * 300), (-4, "", same)]


def brute_pages(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and html is not None and len(html.encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    count = Counter(html for _, _, html in rows)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(html) if count[html] > 1 else None
        again = f is not None and (i is None or i > f)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def files_of(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


def test_archives_hold_every_page(spark, tmp_path):
    rows = odd_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").transform(clash)
    folder = warc.write_warc(df.repartition(6), str(tmp_path / "a"), shards=5, roll_bytes=3000)
    got = warc.read_warc(spark, folder)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute_pages(rows)
    text = {(i, u, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for i, u, h in rows}
    for r in got.where("record_type = 'response'").collect():
        assert bytes(r["payload"]) == text[r["page_id"], r["url"], r["payload_digest"]]
    assert sorted(((r["page_id"], r["url"]) for r in got.collect()), key=repr) == sorted(((i, u) for i, u, _ in rows), key=repr)
    files = files_of(folder)
    assert len(files) > 5 and {n.rsplit("-", 1)[0] for n in files} <= {f"shard-{i:06d}" for i in range(5)}
    assert not (tmp_path / "a" / "_temporary").exists()
    # All but the last file of a shard have reached the size; ids ascend from shard to shard, null ids first.
    for name, data in files.items():
        if f"{name.rsplit('-', 1)[0]}-{int(name[-12:-8]) + 1:04d}.warc.gz" in files:
            assert len(data) >= 3000
    ids = [[-(2**63) if r["page_id"] is None else r["page_id"] for r in got.orderBy("file", "number").collect()]]
    assert ids[0] == sorted(ids[0])
    evil = [gzip.decompress(d) for d in files.values()]
    assert not any(re.search(rb"^X-Evil", d, re.M) for d in evil)
    with pytest.raises(FileExistsError):
        warc.write_warc(df, folder)


def test_archives_are_the_same_bytes_on_any_partitioning(spark, tmp_path):
    rows = [r for r in odd_pages(90) if r[0] is not None]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = warc.write_warc(df.coalesce(1), str(tmp_path / "a"), shards=4, roll_bytes=2000)
    b = warc.write_warc(df.orderBy(F.desc("url")).repartition(7), str(tmp_path / "b"), shards=4, roll_bytes=2000)
    assert files_of(a) == files_of(b)


def test_equal_rows_are_dealt_over_shards(spark, tmp_path):
    rows = [(None, None, "same " * 50)] * 400 + [(i, None, f"other {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.read_warc(spark, warc.write_warc(df, str(tmp_path / "a"), shards=8))
    assert got.count() == 440
    assert got.groupBy("file").count().agg(F.max("count")).first()[0] < 200


def test_no_pages_and_damaged_files(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"text {i}") for i in range(20)], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), str(tmp_path / "none"))).count() == 0
    folder = warc.write_warc(df, str(tmp_path / "a"), shards=2)
    Path(folder, "stray.warc.gz").write_bytes(b"left by nobody")  # not in the manifest
    assert warc.read_warc(spark, folder).count() == 20
    path = sorted(Path(folder).glob("shard*"))[0]
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"\r\n\r\ntext ", b"\r\n\r\ntexT ", 1)))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, folder).collect()
    path.write_bytes(b"")
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_warc(spark, folder).collect()


# Ranked search


def brute_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counts = [(i, Counter(find(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(find(t))
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, terms in queries.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "Straße", "ÄB", "x1", *(f"w{int(rng.paretovariate(0.7))}" for _ in range(6))]) for _ in range(n))


@pytest.mark.parametrize("block,vocabulary", [(ranked_search.BLOCK_TERMS, True), (25, True), (40, False)])
def test_search_equals_brute_force(spark, monkeypatch, block, vocabulary):
    rng = random.Random(block)
    docs = [(i, words(rng, rng.choice([0, 1, 5, 40, 400]))) for i in range(220)]
    docs += [(4, docs[9][1]), (5, docs[9][1]), (None, docs[9][1]), (None, None), (999, "\n\t -- "), (1000, "the " * 20000), (2**62, "w1 w2")]
    items = [(i, words(rng, rng.choice([1, 3, 12]))) for i in range(12)] + [(3, "w1 extra"), (None, "the w2"), (50, None), (51, "  "), (52, "neverseen")]
    if not vocabulary:
        monkeypatch.setattr(ranked_search, "VOCABULARY", 0)
    d = spark.createDataFrame(docs, "doc_id long, text string").transform(clash).repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").transform(clash)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    index = None if vocabulary else ranked_search.build_index(d)
    pairs = ranked_search._queries(q)
    got = ranked_search.search(index, pairs, 10, block) if index else ranked_search.rank_documents(d, q)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items)
    assert ranked_search.rank_documents(d.limit(0), q).count() == 0
    assert ranked_search.rank_documents(d, q.limit(0)).count() == 0


def test_bytes_bound_every_share():
    tf = np.array([1, 2, 3, 10, 1000, 10**9, 1, 1], np.int64)
    m = np.array([10, 100, 5000, 77, 10, 10, 10**9, 10**12], np.int64)
    share = ranked_search.shares(tf, m)
    q = ranked_search.impacts(share)
    assert (ranked_search.UPPER[q] >= share).all() and (ranked_search.LOWEST[q] <= share).all() and (share <= ranked_search.LARGEST).all()
    every = np.arange(ranked_search.LARGEST + 1)
    q = ranked_search.impacts(every)
    assert (ranked_search.UPPER[q] >= every).all() and (ranked_search.LOWEST[q] <= every).all()
    assert ranked_search.lengths(np.array([2**40]), 2**40, 2**41)[0] == 10 + 90 * 2**40 * 2**40 // 2**41
