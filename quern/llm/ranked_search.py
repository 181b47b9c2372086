"""Ranked lexical search over a two-level quantised index.

A document's row of the index has two levels: its terms with one byte each, an upward-rounded share of the largest term
score there is, and its exact frequencies and length.  The bytes bound a term's share from above and, less one step,
from below; weights of terms come in when a query is asked, so that the index serves any query.

A search reads the first level alone and adds up bounds: of each query the k highest lower bounds of every partition give the
global k-th lower bound.  The second pass scores again, in exact integers, each document whose upper bound reaches it; no
other document can be among the k best.  Both passes work on the documents where they lie; shuffled are k rows a query
and partition.  Queries are taken in blocks with a bounded number of terms, each block against all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, masked, ready, written

#: Maximal runs of ASCII letters, digits and any character beyond ASCII.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: The share of a term cannot exceed this, whatever its frequency.
LARGEST = 1_000_000
STEPS = 255
#: Bounds of a share by its byte.  Shares are integers: the lower one is the first above the step below.
UPPER = np.array([q * LARGEST // STEPS for q in range(STEPS + 1)], np.int64)
LOWEST = np.array([0, *((q - 1) * LARGEST // STEPS + 1 for q in range(1, STEPS + 1))], np.int64)

VOCABULARY = 1_000_000  # query terms that are sent to all tasks; with more, all terms are indexed
BLOCK_TERMS = 200_000  # (query, term) pairs of a block of queries
CHUNK = 1_000_000  # postings that a task looks at together


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Length parts of the score: 100 - 90 + (90 * n * N) div L.  In Python's integers where a long is too short."""
    if len(n) and 90 * int(n.max()) * documents >= 2**63:
        return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)
    return 10 + 90 * n * documents // max(total, 1)


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def impacts(share: np.ndarray) -> np.ndarray:
    """Bytes, rounded upwards."""
    return (-(-share * STEPS // LARGEST)).astype(np.uint8)


def count_terms(docs: DataFrame, vocabulary=None) -> DataFrame:
    """(doc_id, known, n, terms, tf) of each document with a term; of vocabulary's terms alone, where it is given."""

    def run(frames):
        known = frozenset(vocabulary.value) if vocabulary is not None else None
        for f in frames:
            ids, flags, ns, terms, tfs = [], [], [], [], []
            for i, flag, text in zip(f["doc_id"].to_numpy(), f["known"].to_numpy(), f["text"]):
                found = terms_of(text)
                if found:
                    counts = Counter(found) if known is None else Counter(x for x in found if x in known)
                    ids.append(i)
                    flags.append(flag)
                    ns.append(len(found))
                    terms.append(list(counts))
                    tfs.append(list(counts.values()))
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "known": np.array(flags, bool), "n": np.array(ns, np.int64), "terms": terms, "tf": tfs})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return rows.mapInPandas(run, "doc_id long, known boolean, n long, terms array<string>, tf array<long>")


class Index:
    """levels: doc_id, known, n, terms, bytes (first level), tf (second level); documents and total: N and L."""

    def __init__(self, levels: DataFrame, documents: int, total: int):
        self.levels, self.documents, self.total = levels, documents, total


def build_index(docs: DataFrame, vocabulary: list[str] | None = None) -> Index:
    """The index of (doc_id, text), in the shared folder.  N and L count all documents, whatever the vocabulary."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(vocabulary) if vocabulary is not None else None
    counted = written(count_terms(docs, shared), "terms")
    r = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = r["documents"], int(r["total"] or 0)

    def run(frames):
        for f in frames:
            sizes = f["tf"].map(len).to_numpy(np.int64)
            tf = np.concatenate([np.zeros(0, np.int64), *f["tf"]])
            q = impacts(shares(tf, np.repeat(lengths(f["n"].to_numpy(np.int64), documents, total), sizes)))
            ends = np.cumsum(sizes)
            yield f.assign(bytes=[q[e - s : e].tobytes() for s, e in zip(sizes, ends)])

    levels = written(counted.where(F.size("terms") > 0).mapInPandas(run, "doc_id long, known boolean, n long, terms array<string>, bytes binary, tf array<long>"), "index")
    discard(counted)
    return Index(levels, documents, total)


class Block:
    """Some queries: their ids, and their terms as numbers with weights."""

    def __init__(self, queries: list[tuple[int, list[str]]], df: dict[str, int], documents: int):
        self.ids = [q for q, _ in queries]
        self.number = {t: i for i, t in enumerate(sorted({t for _, ts in queries for t in ts}))}
        self.terms = [np.array([self.number[t] for t in ts], np.int64) for _, ts in queries]
        # In doubles; a term of no document cannot score.
        self.weight = np.array([int(np.floor(1000 * np.log((2 * documents + 2) / (2 * df.get(t, 0) + 1)))) for t in self.number], np.int64)


def _chunks(frames, number: dict[str, int], columns: list[str]):
    """Postings of the block's terms in several frames at a time, by term: (frame of documents, document, position starts...)."""
    held, size = [], 0

    def joined():
        f = pd.concat(held, ignore_index=True)
        sizes = f["terms"].map(len).to_numpy(np.int64)
        term = np.array([number.get(t, -1) for ts in f["terms"] for t in ts], np.int64)
        posting = {"bytes": np.frombuffer(b"".join(f["bytes"]), np.uint8)}
        if "tf" in columns:
            posting["tf"] = np.concatenate([np.zeros(0, np.int64), *f["tf"]])
        doc = np.repeat(np.arange(len(f)), sizes)
        order = np.argsort(term, kind="stable")
        order = order[np.searchsorted(term[order], 0) :]
        term = term[order]
        starts = np.searchsorted(term, np.arange(len(number) + 1))
        return f, doc[order], {k: v[order] for k, v in posting.items()}, starts

    for f in frames:
        held.append(f)
        size += int(f["terms"].map(len).sum())
        if size >= CHUNK:
            yield joined()
            held, size = [], 0
    if size:
        yield joined()


def _of_query(terms: np.ndarray, starts: np.ndarray):
    """Places of all postings of a query's terms, and each one's term."""
    a, b = starts[terms], starts[terms + 1]
    n = b - a
    at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return at, np.repeat(terms, n)


def _bounds(shared, k: int):
    """(query, low): a partition's k highest positive lower bounds of each query."""

    def run(frames):
        block = shared.value
        best = [np.zeros(0, np.int64) for _ in block.ids]
        for f, doc, posting, starts in _chunks(frames, block.number, ["bytes"]):
            low = LOWEST[posting["bytes"]]
            for j, terms in enumerate(block.terms):
                at, term = _of_query(terms, starts)
                if len(at):
                    s = np.zeros(len(f), np.int64)
                    np.add.at(s, doc[at], low[at] * block.weight[term])
                    s = np.concatenate([best[j], s[s > 0]])
                    best[j] = np.sort(s)[::-1][:k]
        if any(map(len, best)):
            yield pd.DataFrame({"query": np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best]), "low": np.concatenate(best)})

    return run


def _scores(shared, k: int, documents: int, total: int):
    """(query, doc_id, score): exact scores of the documents whose upper bound reaches the query's k-th lower one; k a partition."""

    def run(frames):
        block, least = shared.value
        best = [[] for _ in block.ids]
        for f, doc, posting, starts in _chunks(frames, block.number, ["bytes", "tf"]):
            high = UPPER[posting["bytes"]]
            m = lengths(f["n"].to_numpy(np.int64), documents, total)
            ids, known = f["doc_id"].to_numpy(np.int64), f["known"].to_numpy(bool)
            for j, terms in enumerate(block.terms):
                at, term = _of_query(terms, starts)
                if not len(at):
                    continue
                bound = np.zeros(len(f), np.int64)
                np.add.at(bound, doc[at], high[at] * block.weight[term])
                reach = bound >= max(least[j], 1)
                again = reach[doc[at]]
                at, term = at[again], term[again]
                score = np.zeros(len(f), np.int64)
                np.add.at(score, doc[at], block.weight[term] * shares(posting["tf"][at], m[doc[at]]))
                for d in np.nonzero(score > 0)[0]:
                    best[j].append((-int(score[d]), not known[d], int(ids[d])))
                best[j] = sorted(best[j])[:k]
        rows = [(j, i, not unknown, -s) for j, x in enumerate(best) for s, unknown, i in x]
        if rows:
            j, i, known, s = (pd.Series(c) for c in zip(*rows))
            yield pd.DataFrame({"query": j.astype("int32"), "doc_id": masked(i.astype("int64"), known), "score": s.astype("int64")})

    return run


def _queries(items: DataFrame):
    """(item_id, terms): an item is all rows of its id; its terms count once each."""

    def run(frames):
        for f in frames:
            rows = [(i, k, t) for i, k, text in zip(f["item_id"], f["known"], f["text"]) for t in set(terms_of(text))]
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "known", "term"])

    rows = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"), F.col("item_id").isNotNull().alias("known"), "text")
    return rows.mapInPandas(run, "item_id long, known boolean, term string").distinct()


def _blocks(pairs: DataFrame, limit: int):
    """Lists of (item_id or None, terms), in the order of ids, of about `limit` pairs each."""
    block, size, last = [], 0, None
    for r in pairs.orderBy("known", "item_id", "term").toLocalIterator():
        item = r["item_id"] if r["known"] else None
        if not block or item != last:
            if size >= limit:
                yield block
                block, size = [], 0
            block.append((item, []))
            last = item
        block[-1][1].append(r["term"])
        size += 1
    if block:
        yield block


def search(index: Index, pairs: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents; pairs: (item_id, known, term), once each."""
    spark = index.levels.sparkSession
    out = None
    for queries in _blocks(pairs, block_terms):
        terms = spark.createDataFrame([(t,) for t in sorted({t for _, ts in queries for t in ts})], "term string")
        held = index.levels.select(F.explode("terms").alias("term"))
        df = {r["term"]: r["n"] for r in held.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        block = Block(queries, df, index.documents)
        lows = index.levels.select("terms", "bytes").mapInPandas(_bounds(spark.sparkContext.broadcast(block), k), "query int, low long")
        kth = lows.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).where(f"i = {k}")
        least = np.zeros(len(queries), np.int64)
        for r in kth.collect():  # a row a query of the block
            least[r["query"]] = r["low"]
        found = index.levels.mapInPandas(_scores(spark.sparkContext.broadcast((block, least)), k, index.documents, index.total), "query int, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
        names = spark.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")
        part = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by doc_id.

    Texts without a term, null ones too, are no documents and no queries.  Rows of one item_id are one item, a null id
    is an id; each row of docs is a document, null doc_ids come last among equals.  Empty tables give no rows; other
    columns are left out.
    """
    spark = docs.sparkSession
    ready(spark)
    pairs = written(_queries(items), "queries")
    terms = pairs.select("term").distinct()
    few = terms.count() <= VOCABULARY
    vocabulary = [r["term"] for r in terms.collect()] if few else None
    return search(build_index(docs, vocabulary), pairs, k)
