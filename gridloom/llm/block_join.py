"""Nearest neighbours by a block matrix join over int8 tiles, exact after refinement.

Queries and candidates form a grid of tiles of bounded size.  In a tile every vector is one int8 vector times a scale,
plus a rest of known length.  One integer matrix product gives all distances of the int8 vectors; the two rest lengths
bound the error (triangle inequality).  Candidates whose lower bound is above the k-th smallest upper bound, or above
the k-th distance found so far in the tile, are out; the others are recomputed in double precision and kept in one heap
per query.  The heaps of the tiles are merged by query.  No true neighbour is lost.

Rows without an id, null, empty or zero vectors and vectors with null or non-finite components take no part.  Vectors
of different dimension are not compared.  Of an id given twice the larger vector stands.  Ties go to the smaller id.
Fewer candidates than ``k`` give fewer rows; empty tables give none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import saved, ship_package, table
from gridloom.llm.vectors import grid, group_of, merged, stacked, tiles, usable

STRIP = 4096  # candidates per matrix product
CHUNK_DIMS = 1024  # 127 * 127 * 1024 < 2**24: products in single precision stay whole numbers


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 matrix, scale and rest length of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / scale[:, None])
    rest = x / scale[:, None] - q
    # The rest, in the vector's own unit, with a margin for rounding.
    return q.astype(np.int8), scale, np.sqrt((rest * rest).sum(axis=1)) * scale * (1 + 1e-9)


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], CHUNK_DIMS):
        out += a[:, at : at + CHUNK_DIMS].astype(np.float32) @ b[:, at : at + CHUNK_DIMS].astype(np.float32).T
    return out


def tile_neighbours(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, distance): the ``k`` nearest of a tile, by (distance, id)."""
    q8, qs, qr = quantised(q)
    q_norm = (q8.astype(np.int64) ** 2).sum(axis=1) * qs ** 2
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    for at in range(0, len(cid), STRIP):
        ids, x = cid[at : at + STRIP], c[at : at + STRIP]
        c8, cs, cr = quantised(x)
        c_norm = (c8.astype(np.int64) ** 2).sum(axis=1) * cs ** 2
        both = q_norm[:, None] + c_norm[None, :]
        square = both - 2 * qs[:, None] * cs[None, :] * int_products(q8, c8)
        rough = np.sqrt(np.maximum(square, 0.0))
        # Cancellation in the square: its rounding error, carried to the root.
        margin = qr[:, None] + cr[None, :] + np.sqrt(both * 1e-14)
        lower, upper = rough - margin, rough + margin
        own = qid[:, None] == ids[None, :]
        upper[own] = np.inf
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(qid), np.inf)
        known = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps])
        keep = (lower <= np.minimum(bound, known)[:, None]) & ~own
        for i in np.flatnonzero(keep.any(axis=1)):
            js = np.flatnonzero(keep[i])
            diff = x[js] - q[i]
            exact = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])  # summed in the order of the components
            heap = heaps[i]
            for d, j in zip(exact.tolist(), ids[js].tolist(), strict=True):
                item = (-d, -j)  # the worst kept one on top: largest distance, then largest id
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
    return [(int(query), -j, -d) for query, heap in zip(qid, heaps, strict=True) for d, j in heap]


def _tile(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(rows):
            left, right = stacked(queries["v"]), stacked(rows["v"])
            qid, cid = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            for dim in left.keys() & right.keys():
                (qi, q), (ci, c) = left[dim], right[dim]
                order = np.argsort(cid[ci])
                out += tile_neighbours(qid[qi], q, cid[ci][order], c[order], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``is_query`` (a condition on ``vec_id``) against all rows."""
    ship_package(rows.sparkSession)
    zero = ~F.exists("v", lambda x: x != 0)
    clean = saved(usable(rows, vec_id, embedding).where(~zero))
    queries = clean.where(is_query)
    slots = 4 * rows.sparkSession.sparkContext.defaultParallelism
    across, down = grid(queries.count(), clean.count(), slots)
    left = tiles(queries, group_of("vec_id", across), down, "gi", "gj").groupBy("gi", "gj")
    right = tiles(clean, group_of("vec_id", down), across, "gj", "gi").groupBy("gi", "gj")
    found = left.cogroup(right).applyInPandas(_tile(k), "query_id long, vec_id long, score double")
    ranked = merged(found, k, [F.col("score"), F.col("vec_id")])
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_block_join(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 100 == 0, 10)
