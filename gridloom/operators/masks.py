"""Mask algebra on sparse tables: a row is a set cell, absence is zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid, cell_of, center_lat, center_lon


def apply_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Keep only the rows of set cells."""
    return cells.join(mask.select(*CELL).distinct(), CELL, "left_semi")


def blank_outside(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Keep every row but turn values outside the mask into missing."""
    inside = mask.select(*CELL).distinct().withColumn("__in", F.lit(True))
    return cells.join(inside, CELL, "left").withColumn(
        "value", F.when(F.col("__in"), F.col("value"))
    ).drop("__in")


def tiles_with_cells(mask: DataFrame, grid: Grid) -> DataFrame:
    """Tiles that hold at least one set cell, with how many."""
    n = grid.tile_size
    return mask.groupBy(
        F.floor(F.col("i_lat") / n).cast("int").alias("tile_r"),
        F.floor(F.col("i_lon") / n).cast("int").alias("tile_c"),
    ).agg(F.count(F.lit(1)).alias("cells"))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    a, b = a.select(*CELL).distinct(), b.select(*CELL).distinct()
    if how == "and":
        return a.join(b, CELL, "left_semi")
    if how == "or":
        return a.union(b).distinct()
    raise ValueError(f"unknown mask operation: {how}")


def coverage(mask: DataFrame, grid: Grid) -> DataFrame:
    total = grid.nlat * grid.nlon
    return mask.agg(F.count(F.lit(1)).alias("cells")).withColumn(
        "share", F.col("cells") / F.lit(total)
    )


def dilate(mask: DataFrame, grid: Grid, iterations: int = 1) -> DataFrame:
    """8-neighbour dilation, clipped at the grid edges (no wrap).

    ``iterations`` steps reach exactly the square of that radius, so rows and
    columns are widened once each instead of joining nine offsets per step.
    """
    out = mask.select(*CELL).distinct()
    for axis, size in (("i_lat", grid.nlat), ("i_lon", grid.nlon)):
        c = F.col(axis)
        span = F.sequence(
            F.greatest(c - iterations, F.lit(0)), F.least(c + iterations, F.lit(size - 1))
        )
        other = [x for x in CELL if x != axis]
        out = out.select(*other, F.explode(span).alias(axis)).distinct()
    return out.select(*CELL)


def domain_around(seed: DataFrame, water: DataFrame, data: DataFrame, grid: Grid, iterations: int) -> DataFrame:
    """Seed cells plus their wet surroundings, where data exists."""
    grown = combine(dilate(seed, grid, iterations), water, "and") if iterations > 0 else None
    domain = seed if grown is None else combine(seed, grown, "or")
    return combine(domain, data, "and")


def from_observations(obs: DataFrame, min_days: int) -> DataFrame:
    """Cells with at least ``min_days`` present observations."""
    return obs.groupBy(*CELL).agg(F.count("value").alias("days")).where(F.col("days") >= min_days).select(*CELL)


def presence(cells: DataFrame) -> DataFrame:
    return from_observations(cells, 1)


def coarsen_any(mask: DataFrame, fine: Grid, coarse: Grid) -> DataFrame:
    """Coarse cells that contain any set fine cell."""
    f = integer_ratio(fine, coarse)
    return mask.select(
        F.floor(F.col("i_lat") / f).cast("int").alias("i_lat"),
        F.floor(F.col("i_lon") / f).cast("int").alias("i_lon"),
    ).distinct()


def integer_ratio(fine: Grid, coarse: Grid) -> int:
    f = round(coarse.deg / fine.deg)
    if f < 1 or abs(f * fine.deg - coarse.deg) > 1e-9:
        raise ValueError(f"{fine.deg} does not divide {coarse.deg}")
    return f


def coarse_check(stored: DataFrame, fine_mask: DataFrame, fine: Grid, coarse: Grid) -> DataFrame:
    """Cells where a stored coarse mask differs from one recomputed now."""
    a = stored.select(*CELL).distinct().withColumn("stored", F.lit(True))
    b = coarsen_any(fine_mask, fine, coarse).withColumn("expected", F.lit(True))
    both = a.join(b, CELL, "full_outer")
    return both.where(F.col("stored").isNull() | F.col("expected").isNull()).select(
        *CELL, F.when(F.col("stored").isNull(), "missing").otherwise("extra").alias("problem")
    )


def remap_nearest(mask: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Target cells whose centre falls in a set source cell.

    Each set source cell lists the few target rows and columns whose centres
    it contains, so no full target grid is built.
    """
    ratio = source.deg / target.deg
    c = lambda i: [
        F.greatest(F.floor(F.col(i) * ratio) - 1, F.lit(0)).cast("int"),
        F.ceil((F.col(i) + 1) * ratio).cast("int"),
    ]
    (r0, r1), (c0, c1) = c("i_lat"), c("i_lon")
    cand = mask.select(F.col("i_lat").alias("s_lat"), F.col("i_lon").alias("s_lon"), "id",
                       F.explode(F.sequence(r0, F.least(r1, F.lit(target.nlat - 1)))).alias("t_lat"),
                       c0.alias("c0"), F.least(c1, F.lit(target.nlon - 1)).alias("c1"))
    row = cell_of(center_lat(F.col("t_lat"), target), F.lit(0.0), source)["i_lat"]
    cand = cand.where(row == F.col("s_lat")).withColumn("t_lon", F.explode(F.sequence("c0", "c1")))
    col = cell_of(F.lit(0.0), center_lon(F.col("t_lon"), target), source)["i_lon"]
    return cand.where(col == F.col("s_lon")).select(
        F.col("t_lat").alias("i_lat"), F.col("t_lon").alias("i_lon"), "id"
    )


def classify_points(points: DataFrame, mask: DataFrame, names: DataFrame, grid: Grid,
                    prefix: str, columns=("code", "name")) -> DataFrame:
    """Id and names of the mask cell each point falls in; none means NULL."""
    p = points.withColumns(
        {f"__{k}": v for k, v in cell_of(F.col("lat"), F.col("lon"), grid).items()}
    )
    m = mask.where(F.col("id") > 0).select(
        F.col("i_lat").alias("__i_lat"), F.col("i_lon").alias("__i_lon"), F.col("id").alias(f"{prefix}_id")
    )
    n = names.select(F.col("id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return p.join(m, ["__i_lat", "__i_lon"], "left").join(n, f"{prefix}_id", "left").drop("__i_lat", "__i_lon")


def fine_or_coarse_bbox(points: DataFrame, risk_mask: DataFrame, coarse: Grid, fine: Grid) -> DataFrame:
    """Box of the fine cell where the coarse risk mask is set, of the coarse cell elsewhere."""
    from gridloom.grid import bbox_of

    p = points.withColumns(cell_of(F.col("lat"), F.col("lon"), coarse)).withColumns(
        {f"f_{k}": v for k, v in cell_of(F.col("lat"), F.col("lon"), fine).items()}
    )
    risky = risk_mask.select(*CELL).distinct().withColumn("fine", F.lit(True))
    joined = p.join(risky, CELL, "left").withColumn("fine", F.coalesce("fine", F.lit(False)))
    a, b = bbox_of(coarse), bbox_of(fine, "f_i_lat", "f_i_lon")
    box = [
        F.when(F.col("fine"), b[k]).otherwise(a[k]).alias(f"box_{k}")
        for k in ("lat_min", "lat_max", "lon_min", "lon_max")
    ]
    return joined.select(*points.columns, "fine", *box)
