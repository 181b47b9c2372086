"""Retrieval of experience: TF-IDF, BM25 and cosine top-k, and packing of the hits under a token budget.

Lexical search.  For BM25 the corpus is read and tokenised once, a row a document with its terms and frequencies, written in the shared
folder; for TF-IDF, where a document's length needs all its terms, it is read for the frequencies of terms and again for each
block of queries, and nothing but frequencies is written.  Documents stay where they lie: a task turns the documents it reads into inverted lists, in blocks of a bounded
number of postings, with each term's largest impact in the block.  Queries come in blocks of a bounded number of terms, which are
sent to all tasks.  Once a query has k hits in a partition, a block whose largest impacts cannot reach the k-th score is
skipped for it, and within a block terms are taken by impact: when those that are left cannot lift a new document to
the k-th score, only documents met so far go on.  Shuffled are k hits of a query and partition.

Cosine search.  Vectors are dealt to the nearest of some pivots and written by pivot in blocks, with the least and largest angle
to it.  By the triangle inequality a block is skipped for a query that has k better hits.

Scores are exact: what is skipped is below the k-th score by more than rounding can hide.  Ranks are per query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import lean, shared_folder

#: A word of ASCII letters, digits and underscores, or one CJK character.
TOKEN = r"[a-z0-9_]+|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
WORD = re.compile("[a-z0-9_]+|[\u3400-\u4dbf\u4e00-\u9fff]")

#: Terms of a table that is sent to all tasks; larger ones are joined by term.
SMALL = 1_000_000
#: Terms that a task counts before it hands them on.
HELD = 200_000
#: (query, term) pairs of a block of queries, and postings that a task takes together.
ASKED, POSTINGS = 200_000, 400_000
#: Pivots, vectors of a block, and numbers in the vectors of a block of queries.
PIVOTS, BLOCK, NUMBERS = 256, 512, 4_000_000
#: Queries that meet a block of vectors together.
TOGETHER = 1_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf): how often each document has each term."""
    return docs.select(F.col(key).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """(id, len, terms, tf) of each document, written; of vocabulary's terms alone, where it is given, but len counts all."""
    spark = lean(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(frames):
        known = frozenset(shared.value) if shared is not None else None
        for f in frames:
            sizes, counts = np.zeros(len(f), np.int64), []
            for i, t in enumerate(f["text"]):  # words of one text at a time
                found = WORD.findall(t.lower()) if t else []
                sizes[i] = len(found)
                counts.append(Counter(found) if known is None else Counter(y for y in found if y in known))
            yield pd.DataFrame({"id": f["id"], "len": sizes, "terms": [list(c) for c in counts], "tf": [list(c.values()) for c in counts]})

    return _written(docs.select("id", "text").mapInPandas(run, f"id {dict(docs.dtypes)['id']}, len long, terms array<string>, tf array<long>"), "terms")


def _frequencies(counted: DataFrame) -> DataFrame:
    """(term, df)."""
    return counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _sizes(counted: DataFrame) -> tuple[int, int]:
    """Documents, and the tokens of all."""
    r = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return r[0], r[1]


def _idf(df: DataFrame, documents: int) -> DataFrame:
    """(term, idf); idf = 1 + ln((1 + N) / (1 + df))."""
    return df.select("term", (1 + F.ln(F.lit(1 + documents) / (1 + F.col("df")))).alias("idf"))


def _weighted(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, terms, w): TF-IDF vectors of length 1.  A table of SMALL terms goes to all tasks, a larger one is joined."""
    spark, kind = counted.sparkSession, dict(counted.dtypes)["id"]
    if idf.limit(SMALL + 1).count() > SMALL:
        each = counted.select("id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
        each = each.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        rows = each.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("x"))
        return rows.select("id", F.col("x.term").alias("terms"), F.transform("x", lambda x: x["w"] / F.col("norm")).alias("w"))
    table = idf.toPandas()
    shared = spark.sparkContext.broadcast((table["term"].tolist(), table["idf"].to_numpy(float)))

    def run(frames):
        of = dict(zip(*shared.value))
        for f in frames:
            w = [np.array([of[t] for t in terms]) * tf for terms, tf in zip(f["terms"], f["tf"])]
            yield pd.DataFrame({"id": f["id"], "terms": f["terms"], "w": [x / np.sqrt((x * x).sum()) if len(x) else x for x in w]})

    return counted.select("id", "terms", "tf").mapInPandas(run, f"id {kind}, terms array<string>, w array<double>")


def tfidf(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, weight) with L2 norm 1, and (term, idf)."""
    counted = _counted(docs)
    idf = _idf(_frequencies(counted), _sizes(counted)[0])
    each = _weighted(counted, idf).select("id", F.explode(F.arrays_zip("terms", "w")).alias("x"))
    return each.select("id", F.col("x.terms").alias("term"), F.col("x.w").alias("weight")), idf


def _asked(queries: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (id, {term: times}) in the order of ids, of about ASKED terms each."""
    block, size = [], 0
    for r in postings(queries).orderBy("id", "term").toLocalIterator():
        if not block or block[-1][0] != r["id"]:
            if size >= ASKED:
                yield block
                block, size = [], 0
            block.append((r["id"], {}))
        block[-1][1][r["term"]] = r["tf"]
        size += 1
    if block:
        yield block


def _known(df: DataFrame, block: list[tuple]) -> dict[str, int]:
    """Document frequencies of a block's terms."""
    terms = df.sparkSession.createDataFrame([(t,) for t in sorted({t for _, x in block for t in x})], "term string")
    return {r["term"]: r["df"] for r in df.join(F.broadcast(terms), "term").collect()}


class _Lists:
    """Inverted lists of some documents: for each term of a block of queries the documents and impacts, and the largest impact."""

    def __init__(self, frame: pd.DataFrame, number: dict[str, int]):
        """frame: id, terms (texts, or their numbers) and w of each document."""
        sizes = frame["terms"].map(len).to_numpy(np.int64)
        if len(frame) and getattr(frame["terms"].iloc[0], "dtype", None) == np.int32:
            term = np.concatenate(list(frame["terms"])).astype(np.int64)
        else:
            term = np.array([number.get(t, -1) for ts in frame["terms"] for t in ts], np.int64)
        order = np.argsort(term, kind="stable")
        order = order[np.searchsorted(term[order], 0) :]
        self.ids = frame["id"].to_numpy()
        self.docs = np.repeat(np.arange(len(frame)), sizes)[order]
        self.impacts = np.concatenate([np.zeros(0), *frame["w"]])[order]
        self.starts = np.searchsorted(term[order], np.arange(len(number) + 1))
        self.largest = np.zeros(len(number))
        some = np.nonzero(np.diff(self.starts))[0]
        if len(some):
            self.largest[some] = np.maximum.reduceat(self.impacts, self.starts[some])

    def hits(self, terms: np.ndarray, weights: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may reach `least`, or of all with a term."""
        reach = weights * self.largest[terms]
        order = np.argsort(-reach, kind="stable")
        left = np.append(np.cumsum(reach[order][::-1])[::-1], 0.0)  # what the terms from here on can add
        if least is not None and left[0] < least:
            return np.zeros(0, np.int64), np.zeros(0)
        total, met = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        for n, i in enumerate(order):
            a, b = self.starts[terms[i]], self.starts[terms[i] + 1]
            docs, impacts = self.docs[a:b], self.impacts[a:b]
            if least is not None and left[n] < least:  # no new document can reach it
                keep = met[docs] & (total[docs] + left[n] >= least)
                docs, impacts = docs[keep], impacts[keep]
            total[docs] += weights[i] * impacts
            met[docs] = True
        found = np.nonzero(met)[0]
        return found, total[found]


def _best(ids: np.ndarray, scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties by id."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")[:k]]
    return ids[order], scores[order]


def _scores(vectors: DataFrame, block: list[tuple], weights: list[dict[str, float]], digits: int, k: int | None) -> DataFrame:
    """(query_id, id, score) of a block of queries against (id, terms, w); with k each partition's k best of a query."""
    spark = vectors.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for x in weights for t in x}))}
    asked = [(np.array([number[t] for t in x], np.int64), np.array(list(x.values()))) for x in weights]
    ids = pd.DataFrame({"query_id": [q for q, _ in block]})
    shared = spark.sparkContext.broadcast((number, asked))
    slack = 10.0**-digits  # rounding may lift a score by half of that
    kind = dict(vectors.dtypes)["id"]

    def run(frames):
        number, asked = shared.value
        best: list = [(np.zeros(0, object), np.zeros(0))] * len(asked)
        held, size = [], 0

        def score(frame):
            lists = _Lists(frame, number)
            for n, (terms, w) in enumerate(asked):
                if not len(terms):
                    continue
                full = k is not None and len(best[n][0]) == k
                docs, s = lists.hits(terms, w, best[n][1][-1] - slack if full and k else None)
                if len(docs):
                    s = np.round(s, digits) + 0.0
                    if k is None:
                        yield pd.DataFrame({"n": np.int32(n), "id": lists.ids[docs], "score": s})
                    else:
                        best[n] = _best(np.concatenate([best[n][0], lists.ids[docs]]), np.concatenate([best[n][1], s]), k)

        for f in frames:
            held.append(f)
            size += int(f["terms"].map(len).sum())
            if size >= POSTINGS:
                yield from score(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if held:
            yield from score(pd.concat(held, ignore_index=True))
        some = [n for n in range(len(best)) if len(best[n][0])]
        if some:
            yield pd.DataFrame({"n": np.repeat(np.array(some, np.int32), [len(best[n][0]) for n in some]), "id": np.concatenate([best[n][0] for n in some]), "score": np.concatenate([best[n][1] for n in some])})

    found = vectors.mapInPandas(run, f"n int, id {kind}, score double")
    names = spark.createDataFrame(ids.reset_index(names="n").astype({"n": "int32"}))
    return found.join(F.broadcast(names), "n").select("query_id", "id", "score")


def _union(parts: list[DataFrame], spark, docs: DataFrame, queries: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.union(p)
    return out if out is not None else spark.createDataFrame([], f"query_id {dict(queries.dtypes)['id']}, id {dict(docs.dtypes)['id']}, score double")


def _document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df), written; a task adds up the texts it reads, HELD terms at a time."""
    spark = lean(docs.sparkSession)

    def run(frames):
        held: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                held.update(set(WORD.findall(t.lower())) if t else ())
                if len(held) >= HELD:
                    yield pd.DataFrame({"term": list(held), "df": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"term": list(held), "df": list(held.values())})

    each = docs.select("text").mapInPandas(run, "term string, df long")
    return _written(each.groupBy("term").agg(F.sum("df").alias("df")), "frequencies")


def _frequent(df: DataFrame) -> int:
    """The least power of two, or 0, such that at most SMALL terms are in more documents than that."""
    least = [0, *(1 << i for i in range(62))]
    found = df.agg(*(F.count(F.when(F.col("df") > x, 1)) for x in least)).first()
    return next(x for x, n in zip(least, found) if n <= SMALL)


def _rare_squares(docs: DataFrame, frequent, rare: int, n: int) -> DataFrame:
    """(id, rest), written: what terms in at most `rare` documents, which `frequent` lacks, add to a document's squared length.

    Only their postings are shuffled; a term has `rare` at most.
    """

    def run(frames):
        known = frozenset(frequent.value[0])
        for f in frames:
            counts = [Counter(y for y in WORD.findall(t.lower()) if y not in known) if t else Counter() for t in f["text"]]
            sizes = [len(c) for c in counts]
            yield pd.DataFrame({"id": f["id"].repeat(sizes), "term": [t for c in counts for t in c], "tf": [x for c in counts for x in c.values()]})

    each = docs.select("id", "text").mapInPandas(run, f"id {dict(docs.dtypes)['id']}, term string, tf long")
    terms = each.groupBy("term").agg(F.collect_list(F.struct("id", "tf")).alias("x"))
    rows = terms.select((1 + F.ln(F.lit(1 + n) / (1 + F.size("x")))).alias("idf"), F.explode("x").alias("x"))
    w = F.col("x.tf") * F.col("idf")
    return _written(rows.select(F.col("x.id").alias("id"), (w * w).alias("w")).groupBy("id").agg(F.sum("w").alias("rest")), "rare")


def _asked_vectors(docs: DataFrame, frequent, rare: int, rest: DataFrame | None, n: int, known: dict[str, int]) -> DataFrame:
    """(id, terms, w): of TF-IDF vectors of length 1 the numbers and weights of the terms of `known`, numbered as sorted.

    Texts are read where they lie.  Terms that `frequent` lacks are in one document where `rare` is 1; else `rest` has their squares.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["id"]
    asked = sorted(known)
    shared = spark.sparkContext.broadcast((asked, 1 + np.log((1 + n) / (1 + np.array([known[t] for t in asked], float)))))
    single = 1 + np.log((1 + n) / 2) if rare <= 1 else 0.0

    def run(frames):
        idf = dict(zip(*frequent.value))
        terms, of = shared.value
        number = {t: i for i, t in enumerate(terms)}
        for f in frames:
            found, weights, squares = [], [], np.zeros(len(f))
            for i, t in enumerate(f["text"]):
                c = Counter(WORD.findall(t.lower())) if t else {}
                w = np.array([idf.get(x, single) for x in c]) * np.fromiter(c.values(), float, len(c))
                squares[i] = (w * w).sum()
                at = np.array([number.get(x, -1) for x in c], np.int32)
                some = at >= 0
                found.append(at[some])
                weights.append(of[at[some]] * np.fromiter(c.values(), float, len(c))[some])
            yield pd.DataFrame({"id": f["id"], "terms": found, "w": weights, "squares": squares})

    rows = docs.select("id", "text").mapInPandas(run, f"id {kind}, terms array<int>, w array<double>, squares double").where(F.size("terms") > 0)
    squares = F.col("squares")
    if rest is not None:
        rows, squares = rows.join(rest, "id", "left"), squares + F.coalesce("rest", F.lit(0.0))
    return rows.select("id", "terms", F.transform("w", lambda x: x / F.sqrt(squares)).alias("w"))


def tfidf_scores(docs: DataFrame, queries: DataFrame, digits: int = 4, k: int | None = None) -> DataFrame:
    """(query_id, id, score): cosine of TF-IDF vectors; query terms that no document has are dropped.

    With k the k best of a query in each partition alone, which is enough for top_k.  Texts are read for the frequencies of terms and for
    each block of queries; only frequencies are written.  The SMALL most frequent terms go to all tasks; if the rest are
    in more than one document each, their postings are met by term.
    """
    spark, docs = docs.sparkSession, docs.select("id", "text")
    df = _document_frequencies(docs)
    n, rare = docs.count(), _frequent(df)
    table = _idf(df.where(F.col("df") > rare), n).toPandas()
    frequent = spark.sparkContext.broadcast((table["term"].tolist(), table["idf"].to_numpy(float)))
    rest = _rare_squares(docs, frequent, rare, n) if rare > 1 else None

    def parts():
        for block in _asked(queries):
            known = _known(df, block)
            weights = []
            for _, x in block:
                w = {t: tf * (1 + np.log((1 + n) / (1 + known[t]))) for t, tf in x.items() if t in known}
                norm = np.sqrt(sum(v * v for v in w.values()))
                weights.append({t: v / norm for t, v in w.items()})
            yield _scores(_asked_vectors(docs, frequent, rare, rest, n, known), block, weights, digits, k)

    return _union(parts(), spark, docs, queries)


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, digits: int = 4, k: int | None = None) -> DataFrame:
    """(query_id, id, score); each query term counts once, the mean length is over all documents, empty ones included.

    With k the k best of a query in each partition alone, which is enough for top_k.
    """
    spark = docs.sparkSession
    terms = queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    some = [r["term"] for r in terms.limit(SMALL + 1).collect()]
    counted = _counted(docs, some if len(some) <= SMALL else None)
    n, total = _sizes(counted)
    df = _written(_frequencies(counted), "frequencies")
    length = F.try_divide(F.col("len") * F.lit(n), F.lit(total))
    part = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.coalesce(length, F.lit(0.0))))
    vectors = counted.select("id", "terms", F.transform("tf", part).alias("w"))

    def parts():
        for block in _asked(queries):
            known = _known(df, block)
            weights = [{t: float(np.log(1 + (n - known[t] + 0.5) / (known[t] + 0.5))) for t in x if t in known} for _, x in block]
            yield _scores(vectors, block, weights, digits, k)

    return _union(parts(), spark, docs, queries)


def unit(v: Column) -> Column:
    """The vector over its length; null where it is zero, empty, or has a null or non-finite entry."""
    d = F.transform(v, lambda x: x.cast("double"))
    fine = ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    # An array of one binds the length, which is else summed for each entry.
    scaled = F.transform(F.array(norm), lambda n: F.transform(d, lambda x: x / n))[0]
    return F.when(fine & (norm > 0), scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Of each number of dimensions a few vectors: those with the smallest hashes, PIVOTS in all."""
    out: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect():
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {d: np.unique(np.array(v), axis=0) for d, v in out.items()}


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def pivot_blocks(corpus: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(dim, pivot, low, high, ids, v), written: blocks of unit vectors with the least and largest angle to their pivot; the pivots.

    Vectors without one of their dimensions among the sampled pivots are blocks of pivot -1, which nothing skips.  A pivot's
    vectors are sorted by angle and cut into blocks, so that a hot pivot is many blocks with narrow bounds.
    """
    spark, kind = lean(corpus.sparkSession), dict(corpus.dtypes)["id"]
    rows = corpus.select("id", unit(F.col("vector")).alias("v")).where("v is not null")
    pivots = _pivots(rows)
    shared = spark.sparkContext.broadcast(pivots)

    def deal(frames):
        for f in frames:
            dims = f["v"].map(len)
            for d in dims.unique():
                part = f[dims == d]
                near = np.full(len(part), -1, np.int32), np.zeros(len(part))
                if d in shared.value:
                    angle = _angles(np.stack(part["v"].to_numpy()), shared.value[d])
                    near = angle.argmin(axis=1).astype(np.int32), angle.min(axis=1)
                yield pd.DataFrame({"dim": np.int32(d), "pivot": near[0], "angle": near[1], "id": part["id"].to_numpy(), "v": part["v"].to_numpy()})

    dealt = rows.mapInPandas(deal, f"dim int, pivot int, angle double, id {kind}, v array<double>")
    many = max(spark.sparkContext.defaultParallelism, -(-corpus.count() // (16 * BLOCK)))
    # By range, so that a pivot with many vectors has several partitions.
    ordered = dealt.repartitionByRange(many, "dim", "pivot", "angle", F.xxhash64("id")).sortWithinPartitions("dim", "pivot", "angle")

    def cut(frames):
        for f in frames:
            for (d, p), g in f.groupby(["dim", "pivot"], sort=False):
                for at in range(0, len(g), BLOCK):
                    x = g.iloc[at : at + BLOCK]
                    yield pd.DataFrame({"dim": [d], "pivot": [p], "low": [x["angle"].min()], "high": [x["angle"].max()], "ids": [x["id"].tolist()], "v": [np.concatenate(x["v"].to_list()).tobytes()]})

    return _written(ordered.mapInPandas(cut, f"dim int, pivot int, low double, high double, ids array<{kind}>, v binary"), "blocks"), pivots


def _vector_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (id, unit vector), of about NUMBERS numbers."""
    block, size = [], 0
    for r in queries.select("id", unit(F.col("vector")).alias("v")).where("v is not null").orderBy("id").toLocalIterator():
        block.append((r["id"], r["v"]))
        size += len(r["v"])
        if size >= NUMBERS:
            yield block
            block, size = [], 0
    if block:
        yield block


def cosine_search(corpus: DataFrame, queries: DataFrame, digits: int = 4, k: int | None = None, seen: bool = False) -> DataFrame:
    """(query_id, id, score); with seen (looked, skipped): pairs of a query and a block that were compared and passed over.

    First each query meets the blocks of its nearest pivot, for a k-th score to begin with; then each block, nearest
    first within a partition, meets the queries that it could still serve.  With k the k best of a query in each partition (ties
    by id); without it all pairs of equal dimensions, and nothing is skipped.
    """
    spark = corpus.sparkSession
    blocks, pivots = pivot_blocks(corpus)
    kind, digit = dict(corpus.dtypes)["id"], 10.0**-digits

    def scan(shared, only_near):
        def run(frames):
            matrices, dims, near, least = shared.value
            best: list = [(np.zeros(0, object), np.zeros(0))] * len(dims)
            kth = np.full(len(dims), -2.0)  # scores that a query's k hits have at least
            looked = skipped = 0
            for f in frames:
                for r in f.itertuples():
                    if r.dim not in matrices:
                        continue
                    mine, q = matrices[r.dim]
                    if k is not None and r.pivot >= 0:
                        angle = _angles(q, pivots_of.value[r.dim][r.pivot][None, :])[:, 0]
                        gap = np.maximum(0.0, np.maximum(r.low - angle, angle - r.high))  # no vector of the block is nearer
                        take = np.cos(gap) + 1e-9 >= np.maximum(least[mine], kth[mine]) - digit
                        if only_near:
                            take = near[mine] == r.pivot
                    else:
                        take = np.ones(len(mine), bool)
                    looked, skipped = looked + int(take.sum()), skipped + int((~take).sum())
                    ids, v, some = np.array(r.ids), np.frombuffer(r.v).reshape(len(r.ids), -1).T, np.flatnonzero(take)
                    for at in range(0, len(some), TOGETHER):
                        part = some[at : at + TOGETHER]
                        got = np.round(q[part] @ v, digits) + 0.0
                        if k is None:
                            if not seen:
                                for n, s in zip(mine[part], got):
                                    yield pd.DataFrame({"n": np.int32(n), "id": ids, "score": s})
                            continue
                        for i in np.flatnonzero(got.max(axis=1) >= kth[mine[part]]):
                            n = mine[part[i]]
                            best[n] = _best(np.concatenate([best[n][0], ids]), np.concatenate([best[n][1], got[i]]), k)
                            if k and len(best[n][0]) == k:
                                kth[n] = best[n][1][-1]
            if seen and not only_near:
                yield pd.DataFrame({"looked": [looked], "skipped": [skipped]})
                return
            some = [n for n in range(len(best)) if len(best[n][0])]
            if some:
                yield pd.DataFrame({"n": np.repeat(np.array(some, np.int32), [len(best[n][0]) for n in some]), "id": np.concatenate([best[n][0] for n in some]), "score": np.concatenate([best[n][1] for n in some])})

        return run

    hits = f"n int, id {kind}, score double"
    pivots_of = spark.sparkContext.broadcast(pivots)
    out = None
    for block in _vector_blocks(queries):
        dims, near, matrices = np.array([len(v) for _, v in block]), np.full(len(block), -2), {}
        for d in np.unique(dims):
            mine = np.flatnonzero(dims == d)
            matrices[int(d)] = mine, np.array([block[n][1] for n in mine])
            if d in pivots:
                for at in range(0, len(mine), TOGETHER):
                    near[mine[at : at + TOGETHER]] = _angles(matrices[int(d)][1][at : at + TOGETHER], pivots[d]).argmin(axis=1)
        least = np.full(len(block), -2.0)
        if k:
            first = blocks.mapInPandas(scan(spark.sparkContext.broadcast((matrices, dims, near, least)), True), hits)
            place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score")))
            for r in first.withColumn("i", place).where(F.col("i") == k).collect():  # a row a query
                least[r["n"]] = r["score"]
        shared = spark.sparkContext.broadcast((matrices, dims, near, least))
        part = blocks.mapInPandas(scan(shared, False), "looked long, skipped long" if seen else hits)
        if not seen:
            names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"n int, query_id {dict(queries.dtypes)['id']}")
            part = part.join(F.broadcast(names), "n").select("query_id", "id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "looked long, skipped long") if seen else _union([], spark, corpus, queries)
    return out


def cosine_scores(corpus: DataFrame, queries: DataFrame, digits: int = 4, k: int | None = None) -> DataFrame:
    """(query_id, id, score) for a stated set of queries against all of corpus (id, vector).

    With k the k best of a query in each partition alone (ties by id), which is enough for top_k.  Null, zero or non-finite vectors
    have no score.
    """
    return cosine_search(corpus, queries, digits, k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with a score above 0, ties in insertion order (by id)."""
    if k < 0:
        raise ValueError("k must not be negative")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def pack_blocks(costs: Column, budget: int) -> Column:
    """Indexes (from 0) of the blocks that a greedy pass keeps: one that does not fit is skipped, later ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    indexed = F.transform(costs, lambda c, i: F.struct(c.cast("long").alias("c"), i.alias("i")))

    def step(acc, x):
        fits = acc["used"] + x["c"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["c"]).alias("used"), F.concat(acc["kept"], F.array(x["i"])).alias("kept"))).otherwise(acc)

    return F.aggregate(indexed, start, step, lambda acc: acc["kept"])


def contexts(hits: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """For each query the ids of the ranked hits that fit a token budget, and the tokens they take.

    A query has k hits, so the collected lists are short.
    """
    # Texts of hits alone are tokenised.
    costs = hits.join(docs.select(F.col("id").alias("_id"), "text"), F.col("id") == F.col("_id")).withColumn("cost", F.size(tokens(F.col("text"))))
    ranked = costs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("hits"))
    kept = pack_blocks(F.transform("hits", lambda h: h["cost"]), budget)
    out = ranked.withColumn("kept", F.transform(kept, lambda i: F.element_at("hits", i + 1)))
    return out.select("query_id", F.transform("kept", lambda h: h["id"]).alias("ids"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, h: a + h["cost"]).alias("tokens"))


def sql_memories(memories: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Memories that can be searched by a SQL column, and one row with the number of those left out for lack of it."""
    if column not in ("sql_before", "sql_first_execute"):
        raise ValueError(f"no searchable column {column}")
    usable = memories.where(F.col(column).isNotNull())
    return usable, memories.agg(F.count_if(F.col(column).isNull()).alias("excluded"))


def triggers(turns: DataFrame, policy: str, episode: str = "conv_id", turn: str = "turn", tool: str = "tool", ok: str = "ok") -> DataFrame:
    """turns with `retrieve`: whether memory is asked after this turn.

    Policies: none, first_success, first_execute, every_execute (from the second execution on).
    """
    w = Window.partitionBy(episode).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    runs = F.count_if(F.col(tool) == "execute_sql").over(w)
    wins = F.count_if((F.col(tool) == "execute_sql") & F.col(ok)).over(w)
    now = F.col(tool) == "execute_sql"
    by = {"none": F.lit(False), "first_success": now & F.col(ok) & (wins == 1), "first_execute": now & (runs == 1), "every_execute": now & (runs >= 2)}
    if policy not in by:
        raise ValueError(f"no policy {policy}")
    return turns.withColumn("retrieve", by[policy])


def retriever(kind: str):
    """The scoring function of a name."""
    kinds = {"tfidf": tfidf_scores, "bm25": bm25_scores, "embedding": cosine_scores, "embedding_experience": cosine_scores}
    if kind not in kinds:
        raise ValueError(f"no retriever {kind}")
    return kinds[kind]
