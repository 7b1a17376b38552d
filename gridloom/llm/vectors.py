"""What the vector searches share: clean rows, a grid of tiles, and the final merge."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window

PAIRS_PER_TILE, LEAST_PAIRS = 200_000_000, 250_000
ROWS_PER_TILE = 1 << 18


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): one row per id whose vector has components, all finite (of an id given twice, the larger vector)."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    clean = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return clean.groupBy("vec_id").agg(F.max("v").alias("v"))


def grid(queries: int, rows: int, slots: int = 1) -> tuple[int, int]:
    """Numbers of query groups and candidate groups, so that every tile has a bounded number of rows and pairs.

    Below that bound the work is spread over ``slots`` tiles, unless they would be very small.
    """
    parts = max(1, math.ceil(rows / ROWS_PER_TILE))
    groups = max(1, math.ceil(queries / ROWS_PER_TILE))
    pairs = min(PAIRS_PER_TILE, max(LEAST_PAIRS, queries * rows / slots))
    tiles = max(parts * groups, math.ceil(queries * rows / pairs), 1)
    # Both sides are copied to a row or column of the grid; the square root balances the copies.
    across = min(max(groups, round(math.sqrt(tiles * queries / max(rows, 1)))), tiles)
    return across, max(parts, math.ceil(tiles / across))


def tiles(df: DataFrame, own: Column, others: int, own_name: str, other_name: str) -> DataFrame:
    """``df`` with its own group and one copy for each group of the other side."""
    every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    return df.withColumn(own_name, own.cast("int")).withColumn(other_name, every)


def group_of(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups))


def stacked(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each dimension."""
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(column):
        by_dim.setdefault(len(v), []).append(i)
    return {d: (np.array(at), np.array([column.iloc[i] for i in at], dtype=np.float64)) for d, at in by_dim.items()}


def merged(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The best ``k`` rows of each query, ranked from 1; each task keeps ``k`` before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
