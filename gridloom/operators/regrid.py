"""Regridding and rasterising as joins, explodes and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid, center_lat, center_lon, wrap_lon


def _target_axis(spark, grid: Grid, axis: str) -> DataFrame:
    n, center = (grid.nlat, center_lat) if axis == "lat" else (grid.nlon, center_lon)
    idx = spark.range(n).select(F.col("id").cast("int").alias("i"))
    return idx.select("i", center(F.col("i"), grid).alias("x"))


def _brackets(source_axis: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring source coordinates of each target coordinate, for each source grid (value of ``by``).

    Both axes of a grid together have at most a few thousand rows (the edge length of a grid), so an ordered window
    over them is small at any table size.
    """
    xs = F.array_sort(F.collect_list("x"))
    ends = source_axis.groupBy(*by).agg(
        F.min("x").alias("first"), F.max("x").alias("last"), F.get(xs, F.lit(1)).alias("second")
    )
    src = source_axis.select(*by, F.lit(None).cast("int").alias("i"), F.col("x"), F.col("x").alias("s"))
    tgt = ends.select(*by).join(F.broadcast(targets)).select(*by, "i", "x", F.lit(None).cast("double").alias("s"))
    # A target sorts before an equal source, so "before" is strictly lower.
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("x", F.col("s").isNotNull())
    below = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = src.union(tgt).withColumns({"lo": below, "hi": above}).where(F.col("i").isNotNull())
    rows = rows.join(ends, by) if by else rows.join(F.broadcast(ends))
    at_first = F.col("x") == F.col("first")
    lo = F.when(at_first, F.col("first")).otherwise(F.col("lo"))
    hi = F.when(at_first, F.col("second")).otherwise(F.col("hi"))
    outside = (F.col("x") < F.col("first")) | (F.col("x") > F.col("last"))
    nearest = (
        F.when(F.col("x") <= F.col("first"), F.col("first"))
        .when(F.col("x") >= F.col("last"), F.col("last"))
        .when(F.col("x") - F.col("lo") <= F.col("hi") - F.col("x"), F.col("lo"))
        .otherwise(F.col("hi"))
    )
    return rows.select(
        *by, "i", outside.alias("outside"), nearest.alias("nearest"),
        F.when(~outside, lo).alias("lo"), F.when(~outside, hi).alias("hi"),
        F.when(~outside, (F.col("x") - lo) / (hi - lo)).alias("w"),
    )


def source_axes(source: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, axis, x): the distinct latitudes and longitudes of each source grid, in one scan; worth storing."""
    both = F.array(F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("x")),
                   F.struct(F.lit("lon").alias("axis"), wrap_lon(F.col("lon")).alias("x")))
    return source.select(*(by or []), F.inline(both)).distinct()


def _weights(br: DataFrame, by: list[str], coord: str, out: str) -> DataFrame:
    """(by, coord, target, way, weight, outside): two weighted neighbours inside the bounds, and the nearest one."""
    pair = lambda way, c, w: F.struct(F.lit(way).alias("way"), c.alias(coord), w.alias("w"))
    nearest = pair("near", F.col("nearest"), F.lit(1.0))
    ways = F.when(F.col("outside"), F.array(nearest)).otherwise(
        F.array(pair("mix", F.col("lo"), 1 - F.col("w")), pair("mix", F.col("hi"), F.col("w")), nearest))
    return br.select(*by, F.col("i").alias(out), F.col("outside").alias(f"{out}_outside"), F.inline(ways))


def _weighed() -> Column:
    """Weighted sum; a missing neighbour makes the result missing."""
    need = F.when(F.col("way") == "mix", 2).otherwise(1)
    return F.when(F.count("value") == need, F.sum(F.col("value") * F.col("w")))


def regrid(source: DataFrame, grid: Grid, method: str = "bilinear", keys: list[str] | None = None,
           grid_keys: list[str] | None = None, axes: DataFrame | None = None) -> DataFrame:
    """(lat, lon, value) on any rectangular axes to the cells of ``grid``.

    Interior gaps stay missing; only targets beyond the source bounds take the
    nearest source value.  Bilinear is separable: rows first, then columns.
    Every value of ``grid_keys`` (of all ``keys``, if not given) is a source
    grid with axes of its own; name only the keys that tell grids apart, as
    the metric, and the time steps of a grid share its axes.  With ``axes``
    (:func:`source_axes` of the grids) the source is read once.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown regrid method: {method}")
    keys = keys or []
    by = keys if grid_keys is None else grid_keys
    src = source.select(*keys, "lat", wrap_lon(F.col("lon")).alias("lon"), "value")
    spark = source.sparkSession
    axes = source_axes(source, by) if axes is None else axes
    axis = lambda name: axes.where(F.col("axis") == name).select(*by, "x")
    rows = _brackets(axis("lat"), _target_axis(spark, grid, "lat"), by)
    cols = _brackets(axis("lon"), _target_axis(spark, grid, "lon"), by)
    if method == "nearest":
        by_lat = rows.select(*by, F.col("i").alias("i_lat"), F.col("nearest").alias("lat"))
        by_lon = cols.select(*by, F.col("i").alias("i_lon"), F.col("nearest").alias("lon"))
        return src.join(by_lat, [*by, "lat"]).join(by_lon, [*by, "lon"]).select(*keys, *CELL, "value")
    # A target is mixed if both its coordinates are inside, else it takes the nearest row and column.
    ends = axis("lon").groupBy(*by).agg(F.min("x").alias("west"), F.max("x").alias("east"))
    lat = _weights(rows, by, "lat", "i_lat")
    src = src.join(ends, by) if by else src.join(F.broadcast(ends))
    # Inner rows need their nearest values only under columns beyond the bounds, so at the outermost longitudes.
    used = (F.col("way") == "mix") | F.col("i_lat_outside") | F.col("lon").isin(F.col("west"), F.col("east"))
    by_row = src.join(lat, [*by, "lat"]).where(used).groupBy(*keys, "lon", "i_lat", "way", "i_lat_outside").agg(
        _weighed().alias("value"))
    lon = _weights(cols, by, "lon", "i_lon")
    hit = by_row.join(lon, [*by, "lon", "way"]).where(
        (F.col("way") == "mix") | F.col("i_lat_outside") | F.col("i_lon_outside"))
    mixed = hit.where(~((F.col("way") == "mix") & (F.col("i_lat_outside") | F.col("i_lon_outside"))))
    return mixed.groupBy(*keys, *CELL, "way").agg(_weighed().alias("value")).drop("way")


def reindex_nearest(source: DataFrame, grid: Grid, tolerance: float = 0.51, keys: list[str] | None = None) -> DataFrame:
    """Snap source coordinates to cell centres within a tolerance in cells."""
    keys = keys or []

    def near(coord: Column, origin: float, sign: int, n: int):
        pos = (coord - F.lit(origin)) * sign / F.lit(grid.deg) - 0.5
        return F.filter(
            F.array(F.floor(pos).cast("int"), F.floor(pos).cast("int") + 1),
            lambda i: (i >= 0) & (i < n) & (F.abs(pos - i) <= tolerance),
        ), pos

    lat_idx, lat_pos = near(F.col("lat"), grid.lat_max, -1, grid.nlat)
    lon_idx, lon_pos = near(wrap_lon(F.col("lon")), grid.lon_min, 1, grid.nlon)
    cand = source.select(
        *keys, "value", "lat", "lon", lat_pos.alias("py"), lon_pos.alias("px"), lon_idx.alias("xs"),
        F.explode(lat_idx).alias("i_lat"),
    ).withColumn("i_lon", F.explode("xs"))
    order = F.struct(
        F.abs(F.col("py") - F.col("i_lat")), "lat", F.abs(F.col("px") - F.col("i_lon")), "lon"
    )
    return cand.groupBy(*keys, *CELL).agg(F.min_by("value", order).alias("value"))


MERCATOR_LIMIT = 85.05112878


def mercator_bounds(grid: Grid, lat_limit: float = MERCATOR_LIMIT) -> tuple[float, float]:
    """Lowest and highest row centre inside the limit, or the limit itself."""
    lats = [grid.lat_max - (i + 0.5) * grid.deg for i in range(grid.nlat)]
    kept = [round(lat, 10) for lat in lats if abs(lat) <= lat_limit]
    return (kept[-1], kept[0]) if kept else (-lat_limit, lat_limit)


def mercator_rows(raster: DataFrame, grid: Grid, lat_limit: float = MERCATOR_LIMIT, keys: list[str] | None = None) -> DataFrame:
    """Rows of each raster resampled to equal Mercator spacing, only between present neighbours.

    Each pair of vertically adjacent present cells fills the target rows that
    fall between them, so gaps are never bridged and nothing is joined.
    """
    import math

    y = lambda lat: math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    lats = [grid.lat_max - (i + 0.5) * grid.deg for i in range(grid.nlat)]
    kept = [i for i, lat in enumerate(lats) if abs(lat) <= lat_limit]
    if len(kept) < 2:
        return raster
    top, bottom, n = y(lats[kept[0]]), y(lats[kept[-1]]), len(kept)
    step = (top - bottom) / (n - 1)
    keys = keys or []
    w = Window.partitionBy(*keys, "i_lon").orderBy("i_lat")
    yc = F.log(F.tan(F.lit(math.pi / 4) + F.radians(center_lat(F.col("i_lat"), grid)) / 2))
    rows = raster.where(F.col("value").isNotNull() & F.col("i_lat").between(kept[0], kept[-1]))
    seg = rows.withColumn("y", yc).withColumns({
        "i1": F.lead("i_lat").over(w), "y1": F.lead("y").over(w), "v1": F.lead("value").over(w),
    }).where(F.col("i1") == F.col("i_lat") + 1)
    first = F.greatest(F.floor((F.lit(top) - F.col("y")) / step).cast("int"), F.lit(0))
    last = F.least(F.ceil((F.lit(top) - F.col("y1")) / step).cast("int"), F.lit(n - 1))
    hits = seg.withColumn("row", F.explode(F.sequence(first, last)))
    yt = F.lit(top) - F.col("row") * F.lit(step)
    eps = 1e-9
    hits = hits.withColumn("yt", yt).where(
        (F.col("yt") <= F.col("y") + eps) & (F.col("yt") >= F.col("y1") - eps)
    )
    part = (F.col("yt") - F.col("y1")) / (F.col("y") - F.col("y1"))
    filled = F.col("v1") + (F.col("value") - F.col("v1")) * F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    return hits.groupBy(*keys, "row", "i_lon").agg(F.min_by(filled, "i_lat").alias("value"))


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of closed rings, paired by an equi-join on position.

    The join key includes the position, so one huge ring spreads evenly.
    """
    nxt = vertices.select(
        "feature_id", "ring", (F.col("seq") - 1).alias("seq"),
        F.col("lon").alias("lon2"), F.col("lat").alias("lat2"),
    )
    return vertices.join(nxt, ["feature_id", "ring", "seq"])


def polygon_to_cells(vertices: DataFrame, ids: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside a polygon (even-odd rule over all rings).

    Every edge is cut at the row centres it spans; the sorted cuts of a
    (feature, row) pair up into runs of columns.  ``ids`` maps feature_id to
    the mask id; the highest feature_order wins a shared cell.
    """
    e = ring_edges(vertices)
    lo, hi = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    first = F.greatest(F.ceil((grid.lat_max - hi) / grid.deg - 0.5).cast("int") - 1, F.lit(0))
    last = F.least(F.floor((grid.lat_max - lo) / grid.deg - 0.5).cast("int") + 1, F.lit(grid.nlat - 1))
    cuts = e.where((F.col("lat") != F.col("lat2")) & (first <= last)).withColumn(
        "i_lat", F.explode(F.sequence(first, last))
    ).withColumn("y", center_lat(F.col("i_lat"), grid))
    # Half-open in latitude, so a vertex on a row centre counts once.
    cuts = cuts.where((F.col("y") >= lo) & (F.col("y") < hi)).withColumn(
        "x", F.col("lon") + (F.col("y") - F.col("lat")) * (F.col("lon2") - F.col("lon")) / (F.col("lat2") - F.col("lat"))
    )
    w = Window.partitionBy("feature_id", "i_lat").orderBy("x")
    runs = cuts.select(
        "feature_id", "feature_order", "i_lat", "x",
        F.row_number().over(w).alias("rn"), F.lead("x").over(w).alias("x2"),
    ).where(F.col("rn") % 2 == 1)
    col = lambda x: F.ceil((x - grid.lon_min) / grid.deg - 0.5).cast("int")
    c0 = F.greatest(col(F.col("x")), F.lit(0))
    c1 = F.least(col(F.col("x2")) - 1, F.lit(grid.nlon - 1))
    cells = runs.where(c0 <= c1).withColumn("i_lon", F.explode(F.sequence(c0, c1)))
    return cells.join(ids.select("feature_id", "id"), "feature_id").groupBy(*CELL).agg(
        F.max_by("id", F.struct("feature_order", "id")).alias("id")
    )


def feature_ids(features: DataFrame) -> DataFrame:
    """Stable positive ids per country code, in order of first appearance.

    A blank or ``-99`` code falls back to the alternative code; features with
    neither are left out.  Codes number a few hundred, so one window is small.
    """
    clean = lambda c: F.when(~F.upper(F.trim(c)).isin("", "-99"), F.upper(F.trim(c)))
    coded = features.select(
        "feature_id", "feature_order", F.coalesce(clean(F.col("code")), clean(F.col("alt_code"))).alias("code")
    ).where(F.col("code").isNotNull())
    codes = coded.groupBy("code").agg(F.min("feature_order").alias("__first"))
    numbered = codes.withColumn(
        "id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__first", "code")).cast("int")
    ).drop("__first")
    return coded.join(numbered, "code").select("feature_id", "code", "id")


def circular_centroids(vertices: DataFrame) -> DataFrame:
    """Per name: vertex mean latitude, circular mean longitude, longest label.

    Features of one name merge weighted by their vertex count; the label seen
    first wins among equally long ones.
    """
    rad = F.radians("lon")
    per_feature = vertices.groupBy("norm_name", "feature_id", "feature_order", "name").agg(
        F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n"),
        F.atan2(F.sum(F.sin(rad)), F.sum(F.cos(rad))).alias("a"),
    )
    n = F.col("n")
    lon = F.degrees(F.atan2(F.sum(F.sin("a") * n), F.sum(F.cos("a") * n)))
    return per_feature.groupBy("norm_name").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("feature_order"))).alias("label"),
        (F.sum(F.col("lat") * n) / F.sum(n)).alias("lat"),
        wrap_lon(lon).alias("lon"),
        F.sum(n).alias("vertices"),
    )
