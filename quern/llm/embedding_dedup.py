"""Near-duplicate embeddings by E8 lattice hashing.

Each table projects unit vectors on eight random orthonormal directions and decodes the result to the nearest point
of the E8 lattice, which packs eight dimensions best: close vectors fall into one cell more often than with
any grid of the same cell size.  A vector stands in its own cell and in the nearest neighbouring ones.  Vectors
that share a cell of a table are compared by cosine in double precision.

Copies of a vector stand for each other.  Of cells with the same members one is left.  A cell's vectors are compared in
blocks of bounded size, and a pair counts in the smallest remaining cell that both have alone; so links are counted
without a row for each pair, and a cell that holds a large share of all vectors is many tasks.  Only ids and cells are
shuffled to find the cells; vectors then travel to the cells that are left, as they are stored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, ready, written
from quern.llm.components import components, forest

TABLES = 6
PROBES = 2
#: The expected distance of a pair at the threshold, in units of the lattice (whose minimal distance is 1.41).
SPREAD = 0.5
BLOCK = 500  # vectors of a side in one block's task
PAIRS = 4_000_000  # comparisons of cells in memory at a time


def roots() -> np.ndarray:
    """The 240 minimal vectors of E8: two entries of 1 or -1, or eight of one half with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> i & 1 else 0.5 for i in range(8)]))
    return np.array(out)


ROOTS = roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the sum is odd, the worst rounding is turned."""
    y = np.rint(x)
    odd = y.sum(axis=1) % 2 != 0
    off = x - y
    worst = np.abs(off).argmax(axis=1)
    rows = np.nonzero(odd)[0]
    step = np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    y[rows, worst[rows]] += step
    return y


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row."""
    a = _even(x)
    b = _even(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, seed: int = 11) -> np.ndarray:
    """tables x dim x 8; each table's columns are orthonormal (dim >= 8), else a random square-ish frame."""
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    out = []
    for _ in range(tables):
        g = rng.standard_normal((max(dim, 8), 8))
        q, r = np.linalg.qr(g)
        out.append((q * np.sign(np.diag(r)))[:dim])
    return np.array(out)


def _word(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit word of a lattice point and its table."""
    h = np.full(len(points), np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(table), np.uint64)
    for j in range(8):
        h = (h ^ (2 * points[:, j]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E6C63D0876A9A47)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def cells(unit: np.ndarray, cosine: float, tables: int = TABLES, probes: int = PROBES, spread: float = SPREAD) -> np.ndarray:
    """rows x tables x (1 + probes) words: each vector's own cell, then the nearest neighbouring ones."""
    dim = unit.shape[1]
    scale = spread / (math.acos(cosine) * math.sqrt(min(8 / dim, 1.0)))
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t, p in enumerate(projections(dim, tables)):
        x = unit @ p * scale
        home = decode(x)
        out[:, t, 0] = _word(home, t)
        if probes:
            pull = (x - home) @ ROOTS.T  # the nearest other points lie where the rest of x points
            order = np.argsort(-pull, axis=1, kind="stable")[:, :probes]
            for i in range(probes):
                out[:, t, 1 + i] = _word(home + ROOTS[order[:, i]], t)
    return out


def _usable(v) -> np.ndarray | None:
    if v is None:
        return None
    try:
        x = np.asarray(v, float)
    except (TypeError, ValueError):
        return None
    return x if x.ndim == 1 and len(x) and np.isfinite(x).all() and x.any() else None


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths are equal.  Null and zero vectors
    and such with null or non-finite components link with nothing: n_links 0 and a component of their own.  A row
    without a vec_id links with nothing and has a null component; it is kept.  Rows repeated count as other vectors.
    Rows of one vec_id with different vectors are one node with the links of each; ties at the threshold are links.
    An empty table gives no rows; other columns are left out.  Found pairs are verified; pairs at the threshold are
    found with probability above 0.999 by the six tables (tests measure it).
    """
    spark = vectors.sparkSession
    ready(spark)
    vectors = vectors.select("vec_id", "embedding", "label")
    key = [F.xxhash64("embedding").alias("ka"), F.xxhash64(F.lit(1), "embedding").alias("kb")]
    named = vectors.where("vec_id is not null and label is not null and embedding is not null")
    classes = named.select("vec_id", "label", "embedding", *key).groupBy("label", "ka", "kb").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("id", F.xxhash64("label", "ka", "kb")), "vectors")

    def hashed(frames):
        for f in frames:
            got = [(i, lab, u) for i, lab, u in zip(f["id"], f["label"], map(_usable, f["embedding"])) if u is not None]
            for dim in sorted({len(x[2]) for x in got}):
                part = [x for x in got if len(x[2]) == dim]
                c = cells(_units(np.array([x[2] for x in part])), cosine, tables, probes).reshape(len(part), -1)
                yield pd.DataFrame({"id": [x[0] for x in part], "label": [f"{x[1]}/{dim}" for x in part], "cells": list(c)})

    usable = written(classes.select("id", F.col("label").cast("string").alias("label"), "embedding").mapInPandas(hashed, "id long, label string, cells array<long>"), "cells")

    # Cells with one vector need no comparison, and of cells with the same vectors one is enough.
    stands = usable.select("id", "label", F.explode(F.array_distinct("cells")).alias("cell"))
    full = stands.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).where("m > 1")
    full = full.groupBy("label", "m", "x", "y").agg(F.min("cell").alias("c2"))
    full = full.select(F.col("label").alias("l2"), "c2", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    met = written(stands.join(full, (stands["label"] == F.col("l2")) & (stands["cell"] == F.col("c2"))).select("id", "label", "cell", "blocks"), "met")
    own = met.groupBy(F.col("id").alias("i2")).agg(F.sort_array(F.collect_set("cell")).alias("cells"))  # at most tables * (1 + probes) of them
    carried = classes.select("id", "rep", "copies", "embedding").join(own, F.col("id") == F.col("i2")).drop("i2")
    rows = met.withColumnRenamed("id", "i3").join(carried, F.col("i3") == F.col("id"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", "cell"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = rows.select("label", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "id", "rep", "copies", "embedding", "cells")
    rows = rows.repartition("label", "cell", "i", "j").sortWithinPartitions("label", "cell", "i", "j", "id")

    def compare(cell, group):
        side = np.array([g[0] for g in group])
        ids, rep, copies = (np.array([g[k] for g in group]) for k in (1, 2, 3))
        unit = _units(np.array([g[4] for g in group], float))
        a, b = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        if not len(a) or not len(b):
            return None
        hit = unit[a] @ unit[b].T >= cosine
        hit &= (ids[a][:, None] < ids[b][None, :]) if (side == 2).all() else (ids[a][:, None] != ids[b][None, :])
        i, j = np.nonzero(hit)
        if not len(i):
            return None
        i, j = a[i], b[j]
        lone = np.array([len(g[5]) == 1 for g in group])
        sure = lone[i] | lone[j]  # a vector with one cell meets no other elsewhere
        keep = sure.copy()
        rest = np.nonzero(~sure)[0]
        if len(rest):
            width = max(len(g[5]) for g in group)
            held = np.array([[*g[5], *[0] * (width - len(g[5]))] for g in group])
            filled = np.arange(width) < np.array([len(g[5]) for g in group])[:, None]
            step = max(1, PAIRS // width**2)
            for at in range(0, len(rest), step):
                x, y = i[rest[at : at + step]], j[rest[at : at + step]]
                common = ((held[x][:, :, None] == held[y][:, None, :]) & filled[y][:, None, :]).any(axis=2) & filled[x]
                keep[rest[at : at + step]] = np.where(common, held[x], np.iinfo(np.int64).max).min(axis=1) == cell
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        n = np.bincount(i, copies[j], len(group)) + np.bincount(j, copies[i], len(group))
        seen = np.nonzero(n)[0]
        fa, fb = forest(rep[i], rep[j])
        return pd.DataFrame({
            "a": np.concatenate([ids[seen], fa]), "b": pd.array([*[None] * len(seen), *fb.tolist()], "Int64"),
            "n": np.concatenate([n[seen].astype(np.int64), np.zeros(len(fa), np.int64)]),
        })

    def run(frames):
        now, group = None, []
        for f in frames:
            for lab, c, i, j, *row in zip(*(f[x] for x in ("label", "cell", "i", "j", "side", "id", "rep", "copies", "embedding", "cells"))):
                if (lab, c, i, j) != now:
                    if len(group) > 1 and (out := compare(now[1], group)) is not None:
                        yield out
                    now, group = (lab, c, i, j), []
                group.append(row)
        if len(group) > 1 and (out := compare(now[1], group)) is not None:
            yield out

    found = written(rows.mapInPandas(run, "a long, b long, n long"), "links")
    joined = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    told = classes.select("id", "label", "ka", "kb", "rep", "copies").join(usable.select(F.col("id").alias("u")), F.col("id") == F.col("u"))
    told = told.join(counts, F.col("id") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("label").alias("l"), F.col("ka").alias("xa"), F.col("kb").alias("xb"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"), "copies")
    told = written(told, "told")
    discard(classes, usable, met, found, joined)

    every = vectors.select("vec_id", "label", *key)
    match = F.col("vec_id").isNotNull() & (every["label"] == F.col("l")) & (F.col("ka") == F.col("xa")) & (F.col("kb") == F.col("xb"))
    out = every.join(told, match, "left")
    out = out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
