"""Documents whose sets of word n-grams have a Jaccard similarity of at least a given per cent.

N-grams are hashed, and the order of the hashes is the global order.  It is cut into vertical fragments, twice:

* Finding candidates.  Two sets of a size class differ in at most d n-grams if they link, so that of d + 1 + z
  fragments of the order at least z + 1 have the same n-grams in both.  A document whose fragments are found in other
  documents fewer times than that links with nothing and is left; then those that remain, and they alone, hang together
  where they share a fragment.  Fragments of few n-grams, which chance or a common passage makes equal, are left out as far as the
  remaining ones must still agree in one.  Of its fragments a document that needs k in common hangs by all but the k - 1 most
  frequent: the rarest common one of two that link is followed by k - 1 more in both, so both hang by it.
* Counting overlaps.  Candidates that hang together are compared in blocks of bounded size: fragment by fragment the
  partial overlaps of a block's pairs are counted, and summed for each pair.  The sum decides.

Documents with equal sets stand for each other, so copies are never compared.  Pairs are not emitted: a block gives
a spanning forest of its links, and the components of those are the components of all links.  A group of more than a
block's documents is first compared within blocks, each of which also has the group's pivots; then only documents that
are not connected yet are compared, so that a large group of near copies costs little more than its size: fragment by fragment,
as a pair that links has one in common, or all with all, whichever is less.  Groups that hang together by chains of
fragments cost what their fragments hold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, known_ids, ready, written
from quern.llm.components import components, forest

BLOCK = 200  # documents of a block
WEIGHT = 4_000_000  # n-grams of a block's documents together, where they are long
COLUMNS = 4096  # n-grams of one fragment when overlaps are counted
CHUNK = 250_000  # signatures that a task sorts at a time

_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's word n-grams; with fewer words, of the whole sequence."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    get, out = _WORDS.get, []
    for w in tokens:
        h = get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    h = np.array(out, np.uint64)
    k = min(words, n)
    x = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        x = _mix(x * np.uint64(0x9FB21C651E98DF25) + h[i : n - k + 1 + i])
    x.sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


class Classes:
    """Size classes [low, high] of sets, and in how many fragments each class cuts the order."""

    def __init__(self, percent: int):
        self.percent = percent
        self.growth = max(1.3, 100 / percent + 0.05)
        self.high: list[int] = [0]  # class 0 is the empty set
        self.shape: list[tuple[int, int, int]] = [(1, 0, 0)]  # fragments d + 1 + z, z, and the least size that counts

    def _grow(self) -> None:
        low = self.high[-1] + 1
        high = max(low, int(low * self.growth))
        # A set of this class and one up to the next class: at most so many n-grams are in one only.
        d = high * (100 - self.percent) // self.percent
        z = (d + 2) // 2 if d else 0
        f, rate, least, below, term = d + 1 + z, 0.0, 0, 0.0, 1.0
        rate = math.sqrt(low * high) / f
        term = math.exp(-rate)
        for size in range(1, 5):  # sizes of fragments are about Poisson
            below += term
            term *= rate / size
            if z + 1 - 1.3 * f * below >= max(1.0, f / 10):
                least = size
        self.high.append(high)
        self.shape.append((f, z, least))

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self._grow()
        return int(np.searchsorted(self.high, n))

    def both(self, n: int) -> list[int]:
        """The set's own class, and the one below if a set there can link with it."""
        k = self.of(n)
        return [k, k - 1] if k > 1 and -(-self.percent * n // 100) <= self.high[k - 1] else [k]


def signatures(x: np.ndarray, classes: Classes) -> list[tuple[np.ndarray, int]]:
    """For each class of a set a 64-bit word for each fragment that counts, and how many of them another set must share.

    Fragments of fewer than the class's least number of n-grams do not count: of the z + 1 that are equal in another set
    at most those that this set has are such, and the rest must be shared.  A set that has more than z of them (few
    do) gives all its fragments, and must share one: what counts of the other set's is among them, as the other set
    has z at most, or gives all too.
    """
    out = []
    value = _mix(x + np.uint64(0x5851F42D4C957F2D))
    for k in classes.both(len(x)):
        f, z, least = classes.shape[k]
        at = ((x >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)  # rises with x: a cut of the order
        size = np.bincount(at.astype(np.int64), minlength=f)
        first = np.cumsum(size) - size
        full = size > 0
        sums = np.zeros(f, np.uint64)
        sums[full] = np.add.reduceat(value, first[full])
        tag = np.arange(f, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(k)
        word = _mix(_mix(sums + tag) + size.astype(np.uint64))
        need = z + 1 - int((size < least).sum())
        out.append((word[size >= least], need) if need > 0 else (word, 1))
    return out


def whole(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, as two signed words."""
    a = np.uint64(len(x)) + (_mix(x + np.uint64(1)).sum(dtype=np.uint64) if len(x) else np.uint64(0))
    b = np.bitwise_xor.reduce(_mix(x + np.uint64(0xC2B2AE3D27D4EB4F))) if len(x) else np.uint64(0)
    return _signed(_mix(np.array([a]))[0]), _signed(_mix(np.array([b]))[0])


def _signed(x) -> int:
    return int(np.array([x], np.uint64).view(np.int64)[0])


#: Kinds of candidate rows.
BUCKET, HELD, NEED, COPY, COUNT = range(5)


def _candidate_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (key, kind, node, class, other, n) of five kinds.

    BUCKET: a node is the first of a task that has the fragment `key`, n being how many others of the task have it too;
    HELD: each of those others, whose fragment is in `other`; NEED: how many fragments a node must share, in n;
    COPY: a document whose set equals that of `other` in the task; COUNT: the size n of a row's set, `other` being 0
    for a null doc_id.  A node is a document in its own size class (class 0) or in the one below (class 1).

    Only bucket rows are dealt out by fragment, so that one of a large group lands there once for each task.
    """

    def run(frames):
        classes = Classes(percent)
        sigs, nodes, kinds, needs, copies, counts, n, seen = [], [], [], [], [], [], 0, {}

        def table(kind, key, node, cls, other, n):
            step = 50_000
            for at in range(0, len(node), step):
                to = slice(at, at + step)
                f = {"key": key[to], "kind": np.int8(kind), "node": node[to], "class": cls[to], "other": other[to], "n": n[to]}
                yield pd.DataFrame(f).astype({"key": "int64", "kind": "int8", "node": "int64", "class": "int8", "other": "int64", "n": "int64"})

        def flush():
            none = lambda k: np.zeros(k, np.int64)
            if sigs:
                s, c = np.concatenate(sigs).view(np.int64), np.concatenate(kinds)
                order, start, size = _by_fragment(s, np.concatenate(nodes))
                s, d, c = s[order], np.concatenate(nodes)[order], c[order]
                yield from table(BUCKET, s[start], d[start], c[start], none(int(start.sum())), (size - 1).astype(np.int64))
                yield from table(HELD, d[~start], d[~start], c[~start], s[~start], np.ones(int((~start).sum()), np.int64))
                x = np.array(needs, np.int64).reshape(-1, 3)
                yield from table(NEED, x[:, 0], x[:, 0], x[:, 1], none(len(x)), x[:, 2])
            x = np.array(copies, np.int64).reshape(-1, 2)
            yield from table(COPY, x[:, 0], x[:, 0], none(len(x)), x[:, 1], none(len(x)))
            x = np.array(counts, np.int64).reshape(-1, 3)
            # Dealt out by row, not by id: a null or repeated one may be frequent.
            yield from table(COUNT, x[:, 0] + 7919 * np.arange(len(x)), x[:, 0], none(len(x)), x[:, 1], x[:, 2])

        for f in frames:
            for doc, known, text in zip(f["doc_id"].tolist(), f["known"].tolist(), f["text"]):
                x = shingles(text, words)
                counts.append((doc, int(known), len(x)))
                if known and len(x):
                    key = whole(x)
                    if key in seen:
                        copies.append((doc, seen[key]))
                    else:
                        seen[key] = doc
                        for i, (words_, need) in enumerate(signatures(x, classes)):
                            needs.append((doc, i, need))
                            sigs.append(words_)
                            nodes.append(np.full(len(words_), doc, np.int64))
                            kinds.append(np.full(len(words_), i, np.int8))
                            n += len(words_)
                if n >= CHUNK or len(counts) > 50_000:
                    yield from flush()
                    sigs, nodes, kinds, needs, copies, counts, n, seen = [], [], [], [], [], [], 0, {}
        yield from flush()

    return known_ids(docs, "text").mapInPandas(run, "key long, kind byte, node long, class byte, other long, n long")


def _by_fragment(s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of fragments s and their nodes d; where a fragment's rows begin in it; how many rows each has."""
    order = np.lexsort((d, s))
    t = s[order]
    start = np.ones(len(t), bool)
    start[1:] = t[1:] != t[:-1]
    return order, start, np.bincount(np.cumsum(start) - 1)


def _hanging(frames):
    """frames: node, class, kind, other, n of kinds up to NEED, sorted by node and class -> (fragments, nodes), some at a time.

    Nodes that share fewer fragments than they need are left; of those that remain the fragments by which they hang.
    n is how many rows have a fragment, or how many a node needs.
    """

    def remaining(node, cls, kind, key, n):
        """Of the whole groups of these rows."""
        start = np.ones(len(node), bool)
        start[1:] = (node[1:] != node[:-1]) | (cls[1:] != cls[:-1])
        group = np.cumsum(start) - 1
        fragment = kind <= HELD
        has = np.bincount(group[fragment], minlength=group[-1] + 1)
        least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        # Rows of one doc_id may need different numbers; the least counts.
        np.minimum.at(least, group[~fragment], n[~fragment])
        sel = fragment & (has >= least)[group]
        key, node, n, group = key[sel], node[sel], n[sel], group[sel]
        order = np.lexsort((key, n, group))  # the same order of fragments in every node
        key, node, group = key[order], node[order], group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        hangs = place <= (has - least)[group]
        return key[hangs], node[hangs]

    wait: list[list[np.ndarray]] = []  # frames that are not done, of which the first row's node may have more
    for f in frames:
        if not len(f):
            continue
        wait.append([f[c].to_numpy(np.int64) for c in ("node", "class", "kind", "other", "n")])
        first, last = wait[0], wait[-1]
        if first[0][0] == last[0][-1] and first[1][0] == last[1][-1]:
            continue  # one node's rows so far
        node, cls, *_ = every = [np.concatenate(x) for x in zip(*wait)]
        to = int(np.nonzero((node != node[-1]) | (cls != cls[-1]))[0][-1]) + 1
        key, who = remaining(*(x[:to] for x in every))
        wait = [[x[to:] for x in every]]
        if len(key):
            yield key, who
    if wait:
        yield remaining(*(np.concatenate(x) for x in zip(*wait)))


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "class").sortWithinPartitions("node", "class")


def _cells(rows: DataFrame) -> DataFrame:
    """rows: as for _hung -> (node, cell): the fragments by which the nodes hang."""

    def run(frames):
        for key, who in _hanging(frames):
            for at in range(0, len(key), 50_000):
                yield pd.DataFrame({"node": who[at : at + 50_000], "cell": key[at : at + 50_000]})

    return _by_node(rows).mapInPandas(run, "node long, cell long")


def _hung(rows: DataFrame) -> DataFrame:
    """rows: as _hanging has them, by node and class -> rows (key, node, other).

    Only nodes that remain are hung on each other, so a link never goes through one that is ruled out.  With `other` a node and the smallest node of the task that common fragments
    connect it with; without it such a smallest node, and a fragment `key` of one that it stands for.
    """

    def run(frames):
        s, d, n = [], [], 0

        def flush():
            ss, dd = np.concatenate(s), np.concatenate(d)
            order, start, _ = _by_fragment(ss, dd)
            ss, dd = ss[order], dd[order]
            lead = dd[start][np.cumsum(start) - 1]
            a, b = forest(dd[~start], lead[~start])
            for at in range(0, len(a), 50_000):
                to = slice(at, at + 50_000)
                yield pd.DataFrame({"key": a[to], "node": a[to], "other": pd.array(b[to], "Int64")})
            ss, root = ss[start], dd[start]
            if len(a):
                at = np.minimum(np.searchsorted(a, root), len(a) - 1)
                root = np.where(a[at] == root, b[at], root)
            for at in range(0, len(ss), 50_000):
                to = slice(at, at + 50_000)
                yield pd.DataFrame({"key": ss[to], "node": root[to], "other": pd.array([None] * len(ss[to]), "Int64")})

        for key, who in _hanging(frames):
            s.append(key), d.append(who)
            n += len(key)
            if n >= CHUNK:
                yield from flush()
                s, d, n = [], [], 0
        if n:
            yield from flush()

    return rows.mapInPandas(run, "key long, node long, other long")


def _candidates(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(node, component) of documents that may link; the links (a, b) of copies; (doc_id, n_shingles) for each row; rows of fragments and needs, for _cells."""
    have = F.sum(F.col("n") + 1).over(_window(["key", "kind"]))
    rows = _candidate_rows(docs, words, percent).withColumn("have", have)
    # Of the buckets the shared ones stay; most fragments are not.
    bucket = F.col("kind") == BUCKET
    rows = rows.where(~bucket | (F.col("have") > 1))
    rows = rows.select("kind", "node", "class", F.when(bucket, F.col("key")).otherwise(F.col("other")).alias("other"), F.when(bucket, F.col("have")).otherwise(F.col("n")).alias("n"), (bucket & (F.col("n") > 0)).alias("more"))
    rows = written(rows, "shared")
    copies = rows.where(F.col("kind") == COPY).select(F.col("node").alias("a"), F.col("other").alias("b"))
    sizes = rows.where(F.col("kind") == COUNT).select(F.when(F.col("other") == 1, F.col("node")).alias("doc_id"), F.col("n").alias("n_shingles"))
    # Held rows have their fragment's number from its bucket rows.
    numbers = written(rows.where("more").groupBy(F.col("other").alias("fragment")).agg(F.max("n").alias("have")), "numbers")
    held = rows.where(F.col("kind") == HELD).join(numbers, F.col("other") == F.col("fragment")).select("node", "class", "kind", "other", F.col("have").alias("n"))
    held = rows.where(bucket | (F.col("kind") == NEED)).select("node", "class", "kind", "other", "n").unionByName(held)
    hung = written(_hung(_by_node(held)), "hung")
    # A fragment's row stands for all of a task's; the smallest of them connects the tasks.
    least = F.min("node").over(_window(["key"]))
    across = hung.where("other is null").select("node", least.alias("other")).where("node <> other").groupBy("node", "other").agg(F.lit(1).alias("x"))
    found = components(across.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(hung.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    discard(hung)
    return found, copies, sizes, held


def _sets(members: DataFrame, words: int) -> DataFrame:
    """members: doc_id, text, grp -> the set of the first document of a task that has it; the others name that one."""

    names = ["grp", "doc_id", "first", "ka", "kb", "n", "set"]

    def run(frames):
        seen: dict = {}
        for f in frames:
            out = []
            for doc, text, grp in zip(f["doc_id"], f["text"], f["grp"]):
                x = shingles(text, words)
                if not len(x):
                    continue
                key = whole(x)
                first = seen.get(key)
                if first is None:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = doc
                    out.append((grp, doc, doc, *key, len(x), x.tobytes()))
                else:
                    out.append((grp, doc, first, *key, len(x), None))
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return members.mapInPandas(run, "grp long, doc_id long, first long, ka long, kb long, n long, set binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common n-grams of each pair: partial counts of each fragment of the order, summed."""
    every = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.ones(len(every), bool)
    start[1:] = every[1:] != every[:-1]
    column = np.cumsum(start) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column = (np.cumsum(shared) - 1)[column[keep]]
    owner = owner[keep]
    out = np.zeros((len(left), len(right)), np.float64)
    bounds = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - i * COLUMNS] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verified(blocks: DataFrame, percent: int) -> DataFrame:
    """blocks, sorted by grp, i, j: links (a, b) of a spanning forest of each block's pairs.  side: 0, 1, or 2 for both."""

    def links(rows: list[tuple]):
        # A row stands on the left, on the right, or on both where a block meets itself.
        left = [r for r in rows if r[3] in (0, 2)]
        right = [r for r in rows if r[3] in (1, 2)]
        if not left or not right or len(rows) < 2:
            return None
        a, b = np.array([r[4] for r in left]), np.array([r[4] for r in right])
        na, nb = np.array([r[5] for r in left], float), np.array([r[5] for r in right], float)
        o = overlaps([r[6] for r in left], [r[6] for r in right])
        hit = (100 * o >= percent * (na[:, None] + nb[None, :] - o)) & (a[:, None] != b[None, :])
        i, j = np.nonzero(hit)
        if not len(i):
            return None
        x, y = forest(a[i], b[j])
        return pd.DataFrame({"a": x, "b": y})

    def run(frames):
        now, rows = None, []
        for f in frames:
            for g, i, j, side, rep, n, s in zip(f["grp"], f["i"], f["j"], f["side"], f["rep"], f["n"], f["set"]):
                if (g, i, j) != now:
                    if rows and (out := links(rows)) is not None:
                        yield out
                    now, rows = (g, i, j), []
                rows.append((g, i, j, side, rep, n, np.frombuffer(s, np.uint64)))
        if rows and (out := links(rows)) is not None:
            yield out

    return blocks.mapInPandas(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep")


def _within(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links within blocks of each group; and the groups (g) of more than one block."""
    first, longest, third = F.min("rep"), F.max_by("rep", "n"), F.min_by("rep", F.xxhash64("rep"))
    sizes = reps.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.array_distinct(F.array(first, longest, third)).alias("pivots"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / WEIGHT)).cast("int")
    sizes = written(sizes.where("m > 1").select(F.col("grp").alias("g"), blocks.alias("blocks"), "pivots"), "sizes")
    placed = reps.join(sizes, reps["grp"] == sizes["g"])
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # The group's pivots stand in all of its blocks, so that what links with one is connected at once.
    every = F.when(F.array_contains("pivots", F.col("rep")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    return placed.select("grp", F.explode(every).alias("i"), "rep", "n", "set").select("grp", "i", F.lit(0).alias("j"), F.lit(2).alias("side"), "rep", "n", "set"), sizes.where("blocks > 1").select("g")


def _meeting(of: DataFrame, sets: DataFrame, reps: DataFrame, fragments: DataFrame) -> DataFrame:
    """(grp, rep, part) of what must still meet: large groups cut into cells, or whole where that is less work.

    A cell is the documents that hang by a fragment; of cells with the same members one is left, and those of one part alone go.
    Less work is fewer rows in blocks, each of which carries a set.
    grp names the cell or the group.
    """
    rows = lambda m: m * F.greatest(m / BLOCK, F.lit(1.0))  # noqa: E731  of sets that its blocks hold, about
    size = of.groupBy("grp").agg(rows(F.count(F.lit(1))).alias("work"))
    size = written(size, "work")
    large = sets.join(size.select(F.col("grp").alias("g")), F.col("grp") == F.col("g"), "left_semi").select("doc_id", "grp", "ka", "kb").distinct()
    keyed = reps.select(F.col("grp").alias("g"), F.col("ka").alias("a"), F.col("kb").alias("b"), "rep")
    stands = large.join(keyed, (F.col("grp") == F.col("g")) & (F.col("ka") == F.col("a")) & (F.col("kb") == F.col("b"))).select("doc_id", "rep")
    cells = _cells(fragments.join(large.select("doc_id").distinct(), F.col("node") == F.col("doc_id"), "left_semi"))
    held = cells.join(stands, cells["node"] == F.col("doc_id")).select("cell", "rep").distinct()
    held = written(held.join(of.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("cell", "grp", "rep", "part"), "held")
    mark = F.struct(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("b"))
    kept = held.groupBy("cell", "grp").agg(mark.alias("mark"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    kept = written(kept.groupBy("grp", "mark").agg(F.min("cell").alias("cell")).select("grp", "cell", "mark.m"), "cells")
    spent = kept.groupBy(F.col("grp").alias("g")).agg(F.sum(rows(F.col("m"))).alias("spent"))
    cut = size.join(spent, F.col("grp") == F.col("g"), "left").select("grp", (F.coalesce("spent", F.lit(0.0)) <= F.col("work")).alias("cut"))
    cut = written(cut, "cut")
    chosen = kept.join(cut.where("cut").select(F.col("grp").alias("g")), F.col("grp") == F.col("g"), "left_semi").select(F.col("cell").alias("c"))
    by_cell = held.join(chosen, F.col("cell") == F.col("c")).select(F.xxhash64(F.lit("cell"), "cell").alias("grp"), "rep", "part")
    whole_ = of.join(cut.where("not cut").select(F.col("grp").alias("g")), F.col("grp") == F.col("g"), "left_semi").select(F.xxhash64(F.lit("group"), "grp").alias("grp"), "rep", "part")
    out = written(by_cell.unionByName(whole_), "meeting")
    discard(size, held, kept, cut)
    return out


def _across(reps: DataFrame, large: DataFrame, links: DataFrame, sets: DataFrame, fragments: DataFrame) -> DataFrame:
    """Blocks for the pairs of large groups that the links so far do not connect.

    A part (connected so far) of more than BLOCK documents is cut into blocks of its own, which never meet each other;
    smaller parts share blocks.  Everything else meets in its cell, or in its group (see _meeting).
    """
    parts = components(links)
    of = reps.select("grp", "rep").join(large, F.col("grp") == F.col("g"), "left_semi").join(parts, F.col("rep") == F.col("node"), "left")
    of = written(of.select("grp", "rep", F.coalesce("component", "rep").alias("part")), "parts")
    of = _meeting(of, sets, reps, fragments)
    sizes = of.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("m"))
    big = F.col("m") > BLOCK
    unit = F.when(big, F.col("part").cast("string")).otherwise("")  # "" are the small parts together
    sizes = written(sizes.select("grp", "part", "m", unit.alias("unit")), "part_sizes")
    units = sizes.groupBy("grp", "unit").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    units = written(units, "units")
    x, y = units.toDF("grp", "u", "bu"), units.toDF("grp2", "v", "bv")
    met = x.join(y, (F.col("grp") == F.col("grp2")) & ((F.col("u") < F.col("v")) | (F.col("u") == "") & (F.col("v") == "")))
    met = met.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("bu") - 1))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("bv") - 1)))
    met = met.where("u <> v or p <= q").select("grp", F.concat_ws(":", "u", "p").alias("i"), F.concat_ws(":", "v", "q").alias("j"))
    met = written(met.where("i <> j").select("grp", "i", "j", F.col("i").alias("at"), F.lit(0).alias("side")).unionByName(met.where("i <> j").select("grp", "i", "j", F.col("j").alias("at"), F.lit(1).alias("side"))).unionByName(met.where("i = j").select("grp", "i", "j", F.col("i").alias("at"), F.lit(2).alias("side"))), "met")
    where = of.join(sizes.select(F.col("grp").alias("g"), F.col("part").alias("pt"), "unit"), (F.col("grp") == F.col("g")) & (F.col("part") == F.col("pt")))
    where = where.join(units.toDF("g2", "u2", "blocks"), (F.col("grp") == F.col("g2")) & (F.col("unit") == F.col("u2")))
    # Small parts stay whole in a block, the documents of a big one are spread.
    seed = F.when(F.col("unit") == "", F.xxhash64("part")).otherwise(F.xxhash64("rep"))
    where = where.select(F.col("grp").alias("g3"), "rep", F.concat_ws(":", "unit", F.pmod(seed, F.col("blocks")).cast("int")).alias("place"))
    rows = where.join(met, (F.col("g3") == F.col("grp")) & (F.col("place") == F.col("at"))).select("grp", "i", "j", "side", F.col("rep").alias("r"))
    return rows.join(reps.select("rep", "n", "set"), F.col("r") == F.col("rep")).select("grp", "i", "j", "side", "rep", "n", "set")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(node, component) for the documents that link with another one; docs: doc_id, text.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased.  Documents without a word link
    with nothing, nor do rows without a doc_id.  Rows that share a doc_id are one node, with the links of each.
    """
    return _linked(docs, words, percent)[0]


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """link_components, and (doc_id, n_shingles) for each row of docs."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, copies, counts, fragments = _candidates(docs, words, percent)
    # A merge join at every size: the texts are shuffled once, and the candidates, which grow with them, never broadcast.
    near = found.select("node", F.col("component").alias("grp")).hint("merge")
    members = docs.where("doc_id is not null and text is not null")
    members = members.join(near, members["doc_id"] == F.col("node")).select("doc_id", "text", "grp")
    sets = written(_sets(members, words), "sets")
    same = sets.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    firsts = sets.where("set is not null")
    alike = firsts.select(F.col("doc_id").alias("a"), F.lag("doc_id").over(_window(["ka", "kb"], "doc_id")).alias("b"))
    reps = written(firsts.groupBy("grp", "ka", "kb").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("set").alias("set")), "reps")
    blocks, large = _within(reps)
    links = written(_verified(_blocks(blocks), percent), "links")
    if not large.isEmpty():
        more = written(_verified(_blocks(_across(reps, large, links, sets, fragments)), percent), "links")
        every = links.unionByName(more)
    else:
        every = links
    out = components(every.unionByName(copies).unionByName(same).unionByName(alike))
    discard(found, sets, reps, links)
    return out, counts


def _window(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order) if order else Window.partitionBy(*keys)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts have 0 n-grams and their own doc_id as component; so have rows that link with nothing, and
    a null doc_id has a null component.  An empty table gives no rows; other columns are left out.
    """
    found, counts = _linked(docs, words, percent)
    out = counts.join(found, counts["doc_id"] == found["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
