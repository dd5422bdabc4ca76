"""Centroid clustering with bounds that spare distances, exact in whole numbers.

Each vector keeps one upper bound of the distance to its centroid and one lower bound of that to the second nearest.
After centroids move, the upper bound grows by its centroid's drift and the lower one shrinks by the largest drift of any
other. While the upper bound stays below the lower one, or below half the distance of its centroid to the next, the
nearest centroid is still the same and the only one; else the upper bound is made exact, and a vector that is ambiguous
even then gets the whole scan. Bounds are doubles rounded outwards, comparisons strict: ties always come to the scan.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm import vectors as V
from casegraph.llm.common import drop, stash

CLUSTERS, ROUNDS, SCALE, DIMENSIONS = 8, 10, 1024.0, 64
STATE = "vec_id long, x array<long>, cluster int, upper double, lower double, distance long"


@dataclass
class Clustered:
    """centroids[cluster][component], rows (vec_id, cluster, distance), and how many vectors each pass scanned in full."""

    centroids: list[list[int]]
    rows: DataFrame
    scans: list[int]


def above(x):
    """The next doubles above x; two steps, as a root of a rounded number may be off by one."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def below(x):
    return np.maximum(0.0, np.nextafter(np.nextafter(x, -np.inf), -np.inf))


def root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def drifts(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """How far each centroid moved, rounded up."""
    return [float(above(math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))))) for x, y in zip(old, new, strict=True)]


def own_squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of centres, pair by pair, exact."""
    number = V.kind(x.shape[1] * (2 * V.greatest(x, centres)) ** 2) if x.size else np.int64
    return ((x.astype(number) - centres.astype(number)) ** 2).sum(axis=1)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, drift: np.ndarray):
    """New cluster, upper and lower bound of each row, and the number of rows that got the whole scan. A cluster of -1
    is none yet."""
    cluster, known = cluster.copy(), cluster >= 0
    if len(centres) > 1:
        between = V.squares(centres, centres).astype(object)
        half = np.array([below(root(np.array([min(d for j, d in enumerate(row) if j != i)], object))[0] / 2) for i, row in enumerate(between)])
        others = np.array([max(d for j, d in enumerate(drift) if j != i) for i in range(len(drift))])
    else:
        half, others = np.array([np.inf]), np.zeros(1)
    at = np.where(known, cluster, 0)
    upper = np.where(known, above(upper + drift[at]), np.inf)
    lower = np.where(known, below(lower - others[at]), 0.0)
    safe = np.maximum(lower, half[at])
    unsure = np.flatnonzero(~known | ~(upper < safe))
    tight = unsure[known[unsure]]
    if len(tight):
        upper[tight] = above(root(own_squares(x[tight], centres[cluster[tight]])))
    scan = unsure[~known[unsure] | ~(upper[unsure] < safe[unsure])]
    if len(scan):
        squared = V.squares(x[scan], centres)
        best = squared.argmin(axis=1).astype(np.int64)  # the first of equals
        cluster[scan] = best
        upper[scan] = above(root(squared[np.arange(len(scan)), best]))
        if len(centres) > 1:
            squared[np.arange(len(scan)), best] = squared.max(axis=1)
            lower[scan] = below(root(squared.min(axis=1)))
        else:
            lower[scan] = np.inf
    return cluster, upper, lower, len(scan)


def _assign(centroids: list[list[int]], drift: list[float], last: bool):
    centres, drift = np.array(centroids, np.int64), np.array(drift)

    def step(block: pa.Table, sums: V.Sums) -> dict[str, pa.Array]:
        x = V.matrix(block, centres.shape[1])
        before, upper, lower = (np.asarray(block.column(n).combine_chunks()) for n in ("cluster", "upper", "lower"))
        cluster, upper, lower, scanned = reassign(x, before.astype(np.int64), upper, lower, centres, drift)
        sums.add(cluster, x)
        sums.counts[len(centres)] += scanned  # a cell after those of the centroids
        out = {"cluster": pa.array(cluster.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower)}
        if last:
            out["distance"] = pa.array(V.clamped(own_squares(x, centres[cluster]).tolist()), pa.int64())
        return out

    return step


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE, dimensions: int = DIMENSIONS, seed: str = "3",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clustered:
    """Centroids after `rounds` rounds over all vectors, and each vector's nearest of them with the squared distance.

    Rows take part whose vector has exactly `dimensions` components, none null or non-finite; other columns are ignored.
    Components become floor(scale * x), held at a long's ends. Centroids start as the rows with the smallest sha256 of
    `<seed>:<id>` in that order (null ids last; repeated rows and ids count as often as they stand, in the order of their
    components), fewer than `clusters` where there are fewer rows. A centroid without vectors stays. Distances beyond a
    long are held at its end. An empty table gives no centroids and no rows. Rounds end early when no centroid moves.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = rows.where(V.usable(F.col("x")) & (F.size("x") == dimensions)).withColumn("x", V.whole(F.col("x"), scale))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["x"]) for r in rows.orderBy(drawn.asc_nulls_last(), "x").select("x").limit(clusters).collect()]
    zero = F.lit(0.0)
    state = rows.select("vec_id", "x", F.lit(-1).alias("cluster"), zero.alias("upper"), zero.alias("lower"), F.lit(0).cast("long").alias("distance"))
    scans: list[int] = []
    if not centroids:
        return Clustered([], state.select("vec_id", "cluster", "distance"), scans)
    path, drift = None, [0.0] * len(centroids)
    for k in range(rounds + 1):
        last = k == rounds
        now, new = stash(V.one_pass(state, STATE, _assign(centroids, drift, last), len(centroids) + 1, dimensions), "clusters")
        if path:
            drop(now.sparkSession, path)
        state, path = now.where(F.col("cell").isNull()), new
        sums = V.gathered(now)
        scans.append(sums.get((len(centroids), V.COUNT), 0))
        if not last:
            there = V.moved(centroids, sums)
            drift, centroids = drifts(centroids, there), there
    return Clustered(centroids, state.select("vec_id", "cluster", "distance"), scans)


def digest(found: Clustered) -> DataFrame:
    """vec_id, cluster, distance, the distances' sums over the cluster and over all, and the sha256 of the centroid."""
    by = found.rows.groupBy("cluster").agg(V.long_sum("distance").alias("inertia")).collect()  # as many rows as centroids
    sums = {r["cluster"]: r["inertia"] for r in by}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    own = of([sums.get(k, 0) for k in range(len(hashes))], "long")
    total = F.lit(V.clamped([sum(sums.values())])[0]).cast("long")
    return found.rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), total.alias("inertia"), of(hashes, "string").alias("centroid_sha256"))
