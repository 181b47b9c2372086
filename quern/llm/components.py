"""Connected components of an edge table, by contraction.

Each round every root takes the smallest neighbouring root as its parent, chains of parents are cut short by
pointer jumping, and the edges are redrawn between the new roots.  At least half of the roots of a component that is
not done yet disappear in a round.  Before the first round each partition contracts the edges it has by itself.

Nothing is collected but counts; each table is written in the shared folder, where lineage ends and where a lost
executor's work can be read again.  Joins read both sides from there, so that adaptive execution can split the
partition of a root that has a large part of the nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, ready, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges (a, b), as stars: each node but the smallest with the smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    p = np.arange(len(nodes))
    while True:
        rx, ry = p[x], p[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if (lo == hi).all():
            break
        np.minimum.at(p, hi, lo)
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
    sel = p != np.arange(len(nodes))
    return nodes[sel], nodes[p[sel]]


def _contract(frames):
    a, b, n = [], [], 0
    for f in frames:
        a.append(f["a"].to_numpy(np.int64))
        b.append(f["b"].to_numpy(np.int64))
        n += len(f)
        if n > 1_000_000:  # bounded memory: what is left to do is done by the rounds
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": x, "b": y})
            a, b, n = [], [], 0
    if n:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pd.DataFrame({"a": x, "b": y})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge its smallest reachable node.

    edges: a, b (long).  Nulls and loops are left out; repeated edges count once; without edges there are no rows.
    """
    ready(edges.sparkSession)
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = written(edges.mapInPandas(_contract, "a long, b long"), "edges")
    # A node may have had several stars; only its smallest centre is its parent so far, the other edges remain.
    parents = written(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).groupBy("node").agg(F.min("root").alias("root")), "parents")
    parents = _rooted(parents)
    e = _redrawn(e, parents)
    while not e.isEmpty():
        both = e.union(e.select("b", "a")).toDF("node", "other")
        hooks = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
        hooks = _rooted(written(hooks, "hooks"))
        moved = written(
            parents.join(hooks.toDF("h", "new"), parents["root"] == F.col("h"), "left").select("node", F.coalesce("new", "root").alias("root")), "parents"
        )
        discard(parents)
        parents = moved
        e = _redrawn(e, hooks)
        discard(hooks)
    discard(e)
    out = parents.withColumnRenamed("root", "component")
    out._scratch = parents._scratch
    return out


def _rooted(parents: DataFrame) -> DataFrame:
    """Pointer jumping until each root is its own parent.  parents: a written table, which goes."""
    while True:
        up = parents.toDF("n2", "r2")
        new = written(parents.join(up, parents["root"] == up["n2"], "left").select("node", F.coalesce("r2", "root").alias("root"), (F.col("r2") != F.col("root")).alias("moved")), "jump")
        discard(parents)
        done = new.where("moved").isEmpty()
        parents = new.select("node", "root")
        parents._scratch = new._scratch
        if done:
            return parents


def _redrawn(e: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges between roots, once each, without loops.  e: a written table, which goes."""
    pa, pb = parents.toDF("na", "ra"), parents.toDF("nb", "rb")
    half = written(e.join(pa, e["a"] == pa["na"], "left").select(F.coalesce("ra", "a").alias("a"), "b"), "half")
    discard(e)
    out = half.join(pb, half["b"] == pb["nb"], "left").select("a", F.coalesce("rb", "b").alias("b"))
    out = out.where("a <> b").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.lit(1).alias("x")).select("a", "b")
    out = written(out, "edges")
    discard(half)
    return out
