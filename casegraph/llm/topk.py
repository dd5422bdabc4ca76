"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (dimension, weight). Queries and candidates are cut into blocks; in a block each dimension
has a posting list. For a tile of queries, every dimension's postings are scattered, times the queries' weights, into a
dense score array; the best k of each query are selected by partitioning, and the blocks' selections are merged.
All queries meet all candidates, block by block: the work is queries times candidates, and each row is sent once for
every block of the other side, so blocks are as large as a task's memory allows (BLOCK_BYTES each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import stash

K = 5
SCALE = 256.0
#: Bytes of the vectors (8 a component) of a block of queries or candidates, and rows of the smallest block of candidates.
BLOCK_BYTES, LEAST_BLOCK = 8 << 20, 1024
#: Cells of a score array, as much as stays in a core's cache, and candidates of its rows.
TILE, ACROSS = 1 << 17, 4096


def _postings(dense: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each dimension, the rows whose weight is not zero, and those weights; None for all rows, if most have one."""
    out: list[tuple[np.ndarray | None, np.ndarray]] = []
    for column in np.ascontiguousarray(dense.T):
        rows = np.flatnonzero(column)
        out.append((None, column) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def scaled(vectors: pa.ListArray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, as whole floats [row, dimension]; rows are filled up with zeros."""
    ends = np.asarray(vectors.offsets)
    sizes = np.diff(ends)
    flat = np.floor(scale * np.asarray(vectors.values, np.float64)[ends[0] : ends[-1]])
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def exact_kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The smallest kind of number that holds every partial sum of the products exactly."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * min(queries.shape[1], candidates.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def scatter(asked: list, posted: list, shape: tuple[int, int], kind: type) -> np.ndarray:
    """Scores [query, candidate] from the postings of both, term at a time."""
    scores = np.zeros(shape, kind)
    product = np.empty_like(scores)
    for (q_rows, q_weights), (c_rows, c_weights) in zip(asked, posted, strict=False):
        if not len(q_weights) or not len(c_weights):
            continue
        if q_rows is None and c_rows is None:
            np.multiply(q_weights[:, None], c_weights[None, :], out=product)
            scores += product
        else:
            at = np.ix_(*(np.arange(n) if rows is None else rows for rows, n in zip((q_rows, c_rows), shape, strict=True)))
            scores[at] += q_weights[:, None] * c_weights[None, :]
    return scores


def whole(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole floats as numbers of a kind."""
    return x.astype(kind) if kind is not object else np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores [query, candidate] of whole numbers."""
    kind = exact_kind(queries, candidates)
    return scatter(_postings(whole(queries, kind)), _postings(whole(candidates, kind)), (len(queries), len(candidates)), kind)


def select(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by score, ties to the smaller id; `scores`, `rows` and `ids` are alike long."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(scores)), key=lambda i: (rows[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, rows))
    first = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - first < k]


def tile_best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best of each row without the candidates of its own id, by partition."""
    twin = own[:, None] == ids[None, :]
    most = int(twin.sum(axis=1).max(initial=0))  # an id's own rows may be among the best
    if scores.dtype != object and scores.shape[1] > k + most:
        least = np.partition(scores, scores.shape[1] - k - most, axis=1)[:, -k - most]
        rows, columns = np.nonzero((scores >= least[:, None]) & ~twin)
    else:
        rows, columns = np.nonzero(~twin)
    best = select(scores[rows, columns], rows, ids[columns], k)
    return rows[best], ids[columns[best]], scores[rows[best], columns[best]]


def _clamp(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def block_best(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Query ids, ids and scores of the k best of a block of candidates for each of a block of queries, tile by tile."""
    kind = exact_kind(queries, candidates)
    across = min(len(c_ids), ACROSS)
    down = max(1, TILE // across)
    asked = [_postings(whole(queries[a : a + down], kind)) for a in range(0, len(q_ids), down)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in range(0, len(c_ids), across):
        ids, posted = c_ids[b : b + across], _postings(whole(candidates[b : b + across], kind))
        for n, a in enumerate(range(0, len(q_ids), down)):
            own = q_ids[a : a + down]
            rows, best, scores = tile_best(scatter(asked[n], posted, (len(own), len(ids)), kind), own, ids, k)
            found.append((rows + a, best, scores))
    rows, best, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    top = select(scores, rows, best, k)
    return q_ids[rows[top]], best[top], [_clamp(s) for s in scores[top].tolist()]


def search(vectors: DataFrame, query_when, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `query_when` (a condition on column vec_id) takes, the k rows
    of another id with the highest inner product of floor(scale * x).

    Rows whose id or vector is null, or whose vector holds null or non-finite components, take no part. Vectors of
    different lengths meet on the dimensions they share. Rows repeated with id and vector count once; the pairs
    of an id with several vectors are ranked together. An empty vector scores 0. Scores beyond a long are held
    at its ends. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(~bad)
    rows, _ = stash(rows.dropDuplicates(), "topk-vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(query_when).alias("q"), F.max(F.size("vector")).alias("dims")).first()
    block = max(1, block_bytes // (8 * max(1, sizes["dims"] or 0)))
    q_blocks = max(1, -(-sizes["q"] // block))
    # smaller blocks of candidates where there are fewer of them than cores
    busy = min(2 * spark.sparkContext.defaultParallelism, -(-sizes["n"] // LEAST_BLOCK))
    c_blocks = max(1, -(-sizes["n"] // block), -(-busy // q_blocks))
    spread = F.xxhash64("vec_id", "vector")
    all_q, all_c = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (q_blocks, c_blocks))
    queries = rows.where(query_when).select("vec_id", "vector", F.lit(True).alias("asks"), F.pmod(spread, F.lit(q_blocks)).alias("qb"), all_c.alias("cb"))
    candidates = rows.select("vec_id", "vector", F.lit(False).alias("asks"), F.pmod(spread, F.lit(c_blocks)).alias("cb"), all_q.alias("qb"))

    def cell(both: pa.Table) -> pa.Table:
        asks = both.column("asks")
        q, c = both.filter(asks), both.filter(pa.compute.invert(asks))
        out = ([], [], [])
        if q.num_rows and c.num_rows:
            ids, weights = zip(*((t.column("vec_id").to_numpy(), scaled(t.column("vector").combine_chunks(), scale)) for t in (q, c)), strict=True)
            out = block_best(ids[0], weights[0], ids[1], weights[1], k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = queries.unionByName(candidates).groupBy("qb", "cb").applyInArrow(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
