"""Plain Lloyd clustering of integer vectors, exact and the same on any partitioning.

Components become integers once; the rows are written in the shared folder and read again in each round.  A round sends the
centroids to all tasks (clusters x dimensions numbers, whatever the table's size); mapInPandas takes squared differences per
centroid in NumPy, the lowest index wins ties, and each partition gives one integer sum per centroid and component, which
groupBy merges.  Sums are exact at any size: Python's integers in a partition, decimals of 38 digits across them.

Rows are independent of one another but for the sums, so nothing is shuffled by cluster and a cluster with most of the
vectors costs what any other does.  A lost executor's partitions are read and summed again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import masked, ready, written

#: Below this magnitude squared distances of 64 components are sums of int64 that cannot overflow.
SMALL = 2**27
LONGEST = 2**63 - 1


def integers(vector: Column, dimensions: int, scale: int) -> Column:
    """floor(scale * x) of each component, null where the vector is not kept.

    Kept are vectors of just so many components, none null or non-finite.  A component whose integer is beyond 2^62 counts
    as non-finite: it has no place in a long.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * float(scale))
    fine = (F.size(vector) == dimensions) & F.forall(scaled, lambda x: F.coalesce(F.abs(x) < float(2**62), F.lit(False)))
    return F.when(fine, F.transform(scaled, lambda x: F.floor(x).cast("long")))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (the smaller number of equally near ones) and its squared distance.

    Large components are taken as Python's integers, so that no comparison wraps around.
    """
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) >= SMALL:
        v, centroids = v.astype(object), centroids.astype(object)
    best = best_distance = None
    for j, c in enumerate(centroids):
        d = v - c
        distance = (d * d).sum(axis=1)
        if best is None:
            best, best_distance = np.zeros(len(v), np.int32), distance
        else:
            closer = distance < best_distance
            best[closer] = j
            best_distance = np.where(closer, distance, best_distance)
    return best, best_distance


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _sums(shared):
    """(cluster, position, total, n) of a partition; totals as text, since they may be longer than a long."""

    def run(frames):
        centroids = shared.value
        k, dimensions = centroids.shape
        totals, counts = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for f in frames:
            if not len(f):
                continue
            v = _stacked(f["v"])
            cluster, _ = nearest(v, centroids)
            wide = v if np.abs(v).max() < SMALL else v.astype(object)
            for j in np.unique(cluster):
                mine = wide[cluster == j]
                totals[j] += mine.sum(axis=0).astype(object)
                counts[j] += len(mine)
        for j in np.nonzero(counts)[0]:
            yield pd.DataFrame({"cluster": np.int32(j), "position": np.arange(dimensions, dtype=np.int32), "total": [str(x) for x in totals[j]], "n": counts[j]})

    return run


def _assigned(shared):
    def run(frames):
        for f in frames:
            if len(f):
                cluster, distance = nearest(_stacked(f["v"]), shared.value)
                short = np.minimum(distance, LONGEST).astype(np.int64)
                yield pd.DataFrame({"vec_id": masked(f["vec_id"], f["known"]), "cluster": cluster, "distance": short})

    return run


def lloyd(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of (vec_id, embedding).

    The start is the rows with the smallest sha256 of `seed:vec_id`, in that order; each round assigns and then moves every
    centroid that has vectors to the floor of their mean; a last assignment follows.  A centroid without vectors stays.

    Repeated rows and ids are rows of their own, equal hashes are ordered by components, null ids start no centroid before
    all others did; with fewer rows than clusters there are as many clusters as rows; an empty table gives no rows.  Other
    columns are left out.  A distance or inertia that does not fit a long is the largest long.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), dimensions, scale).alias("v")).where("v is not null")
    rows = written(rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"), "v"), "vectors")
    mark = F.when(F.col("known"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    start = rows.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(len(start), dimensions)
    for _ in range(rounds if start else 0):
        shared = spark.sparkContext.broadcast(centroids)
        sums = rows.mapInPandas(_sums(shared), "cluster int, position int, total string, n long")
        merged = sums.groupBy("cluster", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in merged.collect():  # clusters x dimensions rows
            centroids[r["cluster"], r["position"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centroids)
    told = written(rows.mapInPandas(_assigned(shared), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(inertia.values()), LONGEST)
    facts = [(j, min(inertia.get(j, 0), LONGEST), whole, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
