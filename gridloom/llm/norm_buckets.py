"""Exact top-k inner products over norm buckets.

Vectors are grouped by length.  Each query first meets the longest vectors of all (a fixed number), which gives a
k-th product as its threshold.  Then every bucket is searched on its own: threshold over the query's length and the
bucket's largest length is the least cosine a hit must have.  Above 1 the bucket is skipped; where that cosine is high,
*coordinate* pruning keeps vectors whose largest query coordinates lie in the range that such an angle allows; where it
is low, *length* pruning keeps vectors long enough to reach the threshold at all.  What is left is multiplied exactly,
in whole numbers, and raises the threshold for the next bucket.

Components are ``floor(256 * x)`` with x as double.  Rows without an id, null or empty vectors and vectors with null or
non-finite components take no part; zero vectors do (product 0).  Vectors of different dimension are not compared.  Of
an id given twice the larger vector stands.  Ties go to the smaller id.  Products beyond a long stop at its limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import saved, ship_package, table
from gridloom.llm.vectors import grid, group_of, merged, stacked, tiles, usable

SCALE = 256.0
SEEDS = 512
BUCKET_ROWS, BUCKET_RATIO = 4096, 0.9  # a bucket ends at so many rows, or below this share of its largest length
FOCUS, STEEP = 3, 0.5  # coordinates looked at, and the local cosine from which they are
SLACK = 1e-9


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``p`` with ``q`` (whole numbers held in doubles)."""
    most = np.abs(p).max(initial=0.0) * np.abs(q).max(initial=0.0) * len(q)
    if most < 2.0 ** 52:
        return (p @ q).astype(np.int64)
    if most < 2.0 ** 62:
        return p.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in p]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], dtype=np.int64)


class Best:
    """The ``k`` highest products of one query, ties to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~s falls as s grows, without overflow
        self.ids, self.scores = ids[order], scores[order]

    def threshold(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def buckets(norms: np.ndarray) -> list[slice]:
    """Cut descending lengths into buckets."""
    out, start = [], 0
    while start < len(norms):
        close = np.searchsorted(-norms[start:], -norms[start] * BUCKET_RATIO, side="right")
        end = start + int(min(BUCKET_ROWS, max(close, 1)))
        out.append(slice(start, end))
        start = end
    return out


def candidates(unit: np.ndarray, norms: np.ndarray, q_unit: np.ndarray, q_norm: float, threshold: float) -> np.ndarray | None:
    """Positions in a bucket that may reach ``threshold``; None if none can.  ``unit``: directions, ``norms``: lengths."""
    longest = norms[0]
    reach = q_norm * longest * (1 + SLACK)
    if threshold == -np.inf or reach == 0:
        return np.arange(len(norms)) if threshold <= 0 else None
    local = threshold / reach
    if local > 1 + SLACK:
        return None
    if local >= STEEP:
        beta = np.arccos(min(local, 1.0)) + 1e-7
        keep = np.ones(len(norms), dtype=bool)
        for f in np.argsort(-np.abs(q_unit))[:FOCUS]:
            alpha = np.arccos(np.clip(q_unit[f], -1, 1))
            low, high = np.cos(min(np.pi, alpha + beta)), np.cos(max(0.0, alpha - beta))
            keep &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
        return np.flatnonzero(keep)
    if threshold > 0:
        enough = threshold / q_norm * (1 - SLACK)
        return np.arange(np.searchsorted(-norms, -enough, side="right"))
    return np.arange(len(norms))


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, seeds: tuple[np.ndarray, np.ndarray]) -> list:
    """(query, candidate, product) of the best ``k`` of one tile; ``seeds`` (ids, vectors) only raise the thresholds."""
    norms = np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((cid, -norms))
    cid, c, norms = cid[order], c[order], norms[order]
    unit = c / np.where(norms > 0, norms, 1.0)[:, None]
    cuts = buckets(norms)
    out = []
    for query, v in zip(qid.tolist(), q, strict=True):
        q_norm = float(np.sqrt((v * v).sum()))
        q_unit = v / q_norm if q_norm > 0 else v
        start, best = Best(k), Best(k)
        others = seeds[0] != query
        start.add(seeds[0][others], products(seeds[1][others], v))
        for cut in cuts:
            at = candidates(unit[cut], norms[cut], q_unit, q_norm, max(start.threshold(), best.threshold()))
            if at is None:
                break  # later buckets are shorter still
            ids = cid[cut][at]
            mine = ids != query
            best.add(ids[mine], products(c[cut][at[mine]], v))
        out += [(query, int(i), int(s)) for i, s in zip(best.ids, best.scores, strict=True)]
    return out


def _tile(k: int, seeds: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(queries) and len(rows):
            left, right = stacked(queries["v"]), stacked(rows["v"])
            qid, cid = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            for dim in left.keys() & right.keys():
                (qi, q), (ci, c) = left[dim], right[dim]
                start = seeds.get(dim, (np.empty(0, np.int64), np.empty((0, dim))))
                out += search(qid[qi], q, cid[ci], c, k, start)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_products(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``is_query`` (a condition on ``vec_id``) against all rows."""
    ship_package(rows.sparkSession)
    # From 2**44 on a double times 256 is a whole number already, and may be too large for floor().
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0 ** 44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    clean = saved(usable(rows, vec_id, embedding).withColumn("v", whole).withColumn("norm", length))
    queries = clean.where(is_query).select("vec_id", "v")
    slots = 4 * rows.sparkSession.sparkContext.defaultParallelism
    across, down = grid(queries.count(), clean.count(), slots)
    longest = clean.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toPandas()
    seeds = {d: (longest["vec_id"].to_numpy()[at], m) for d, (at, m) in stacked(longest["v"]).items()}
    # Tiles are dealt by id, whatever the lengths; each tile orders its rows by length into buckets.
    left = tiles(queries, group_of("vec_id", across), down, "gi", "gj").groupBy("gi", "gj")
    right = tiles(clean.drop("norm"), group_of("vec_id", down), across, "gj", "gi").groupBy("gi", "gj")
    found = left.cogroup(right).applyInPandas(_tile(k, seeds), "query_id long, vec_id long, score long")
    ranked = merged(found, k, [F.desc("score"), F.col("vec_id")])
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_norm_buckets(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(rows, F.col("vec_id") % 50 == 0, 5)
