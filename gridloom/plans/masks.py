"""Mask algebra and point classification over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.operators import masks as M, regions as RG
from gridloom.plans import views as V
from gridloom.plans.registry import query


@query("apply_mask", "SELECT i_lat, i_lon, t, value FROM obs_gappy SEMI JOIN mask_a USING (i_lat, i_lon)")
def _(spark, sf):
    return M.apply_mask(V.obs_gappy(spark, sf), V.mask_a(spark, sf))


@query("blank_outside_mask", """SELECT o.i_lat, o.i_lon, t, CASE WHEN m.i_lat IS NOT NULL THEN value END AS value
  FROM obs_gappy o LEFT JOIN mask_a m ON o.i_lat = m.i_lat AND o.i_lon = m.i_lon""")
def _(spark, sf):
    return M.blank_outside(V.obs_gappy(spark, sf), V.mask_a(spark, sf))


@query("batch_has_valid", """SELECT CAST(i_lat // 16 AS INTEGER) AS tile_r, CAST(i_lon // 16 AS INTEGER) AS tile_c, count(*) AS cells
  FROM mask_a GROUP BY 1, 2""")
def _(spark, sf):
    return M.tiles_with_cells(V.mask_a(spark, sf), V.TOY)


@query("mask_combine_and", "SELECT i_lat, i_lon FROM mask_a SEMI JOIN mask_b USING (i_lat, i_lon)")
def _(spark, sf):
    return M.combine(V.mask_a(spark, sf), V.mask_b(spark, sf), "and")


@query("mask_combine_or", "SELECT i_lat, i_lon FROM mask_a UNION SELECT i_lat, i_lon FROM mask_b")
def _(spark, sf):
    return M.combine(V.mask_a(spark, sf), V.mask_b(spark, sf), "or")


@query("mask_coverage", "SELECT count(*) AS cells, round(count(*) / 64800.0::DOUBLE, 6) AS share FROM mask_a")
def _(spark, sf):
    return M.coverage(V.mask_a(spark, sf), V.TOY).withColumn("share", F.round("share", 6))


_DILATED = """SELECT DISTINCT CAST(i_lat + a AS INTEGER) AS i_lat, CAST(i_lon + b AS INTEGER) AS i_lon FROM mask_a,
  range(-{n}, {n} + 1) r(a), range(-{n}, {n} + 1) s(b)
  WHERE i_lat + a BETWEEN 0 AND 179 AND i_lon + b BETWEEN 0 AND 359"""


@query("mask_dilate", _DILATED.format(n=2))
def _(spark, sf):
    return M.dilate(V.mask_a(spark, sf), V.TOY, iterations=2)


@query("reef_domain", f"""WITH d AS ({_DILATED.format(n=1)}), w AS (SELECT DISTINCT i_lat, i_lon FROM obs_daily),
  g AS (SELECT i_lat, i_lon FROM mask_a UNION SELECT i_lat, i_lon FROM d SEMI JOIN w USING (i_lat, i_lon))
  SELECT i_lat, i_lon FROM g SEMI JOIN w USING (i_lat, i_lon)""")
def _(spark, sf):
    water = V.obs_daily(spark, sf).select(*CELL).distinct()
    return M.domain_around(V.mask_a(spark, sf), water, water, V.TOY, iterations=1)


@query("mask_from_observations", "SELECT i_lat, i_lon FROM obs_gappy GROUP BY 1, 2 HAVING count(value) >= 40")
def _(spark, sf):
    return M.from_observations(V.obs_gappy(spark, sf), 40)


@query("presence_mask", "SELECT i_lat, i_lon FROM raster GROUP BY 1, 2 HAVING count(value) >= 1")
def _(spark, sf):
    return M.presence(V.raster(spark, sf))


@query("coarsen_any", "SELECT DISTINCT CAST(i_lat // 5 AS INTEGER) AS i_lat, CAST(i_lon // 5 AS INTEGER) AS i_lon FROM mask_fine")
def _(spark, sf):
    return M.coarsen_any(V.mask_fine(spark, sf), V.TOY_FINE, V.TOY)


@query("coarse_mask_check", """WITH e AS (SELECT DISTINCT i_lat // 5 AS i_lat, i_lon // 5 AS i_lon FROM ocean_fine)
  SELECT CAST(i_lat AS INTEGER) AS i_lat, CAST(i_lon AS INTEGER) AS i_lon, 'extra' AS problem FROM (SELECT * FROM mask_a EXCEPT SELECT * FROM e)
  UNION ALL SELECT CAST(i_lat AS INTEGER), CAST(i_lon AS INTEGER), 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM mask_a)""")
def _(spark, sf):
    return M.coarse_check(V.mask_a(spark, sf), V.ocean_fine(spark, sf), V.TOY_FINE, V.TOY)


_FRAC = "SELECT CAST(i_lat // 5 AS INTEGER) AS i_lat, CAST(i_lon // 5 AS INTEGER) AS i_lon, id, count(*) / 25.0::DOUBLE AS frac FROM {} GROUP BY 1, 2, 3"
V.SQL_VIEWS["country_frac"] = _FRAC.format("mask_fine")
V.SQL_VIEWS["ocean_frac"] = _FRAC.format("ocean_fine")


def country_frac(spark, sf):
    return RG.fractional_weights(V.mask_fine(spark, sf), V.TOY_FINE, V.TOY)


def ocean_frac(spark, sf):
    return RG.fractional_weights(V.ocean_fine(spark, sf), V.TOY_FINE, V.TOY)


@query("fractional_weights", "SELECT i_lat, i_lon, id, frac FROM country_frac")
def _(spark, sf):
    return country_frac(spark, sf)


@query("mask_remap_nearest", """WITH t AS (SELECT a AS i_lat, b AS i_lon,
     CAST(floor((90 - (90 - (a + 0.5::DOUBLE) * 0.5::DOUBLE)) / 0.2::DOUBLE) AS INTEGER) AS s_lat,
     CAST(floor((-180 + (b + 0.5::DOUBLE) * 0.5::DOUBLE + 180) / 0.2::DOUBLE) AS INTEGER) AS s_lon
   FROM range(360) r(a), range(720) s(b))
  SELECT CAST(t.i_lat AS INTEGER) AS i_lat, CAST(t.i_lon AS INTEGER) AS i_lon, id FROM t JOIN mask_fine m ON m.i_lat = s_lat AND m.i_lon = s_lon""")
def _(spark, sf):
    from gridloom.grid import global_grid

    return M.remap_nearest(V.mask_fine(spark, sf), V.TOY_FINE, global_grid(0.5))


_FINE_CELL = """CAST(greatest(0, least(899, floor((90 - greatest(-90 + 1e-12, least(90 - 1e-12, lat))) / 0.2::DOUBLE))) AS INTEGER) AS f_lat,
  CAST(greatest(0, least(1799, floor(((((lon + 180) - floor((lon + 180) / 360) * 360) - 180) + 180) / 0.2::DOUBLE))) AS INTEGER) AS f_lon"""
V.SQL_VIEWS["place_fine"] = f"SELECT geonameid, lat, lon, {_FINE_CELL} FROM places"


@query("classify_point", """WITH p AS (SELECT geonameid, i_lat * 5 + geonameid % 5 AS f_lat, i_lon * 5 + geonameid % 7 AS f_lon FROM
    (SELECT c_custkey AS geonameid, CAST(((c_custkey % 100) * 7) % 180 AS INTEGER) AS i_lat, CAST(((c_custkey % 100) * 13) % 360 AS INTEGER) AS i_lon FROM customer))
  SELECT geonameid, m.id AS country_id, c.code AS country_code, c.name AS country_name, o.id AS ocean_id, n.name AS ocean_name
  FROM p LEFT JOIN mask_fine m ON m.i_lat = f_lat AND m.i_lon = f_lon LEFT JOIN countries c ON c.id = m.id
  LEFT JOIN ocean_fine o ON o.i_lat = f_lat AND o.i_lon = f_lon LEFT JOIN oceans n ON n.id = o.id""")
def _(spark, sf):
    k = F.col("c_custkey")
    cell_lat = ((k % 100) * 7) % 180 * 5 + k % 5
    cell_lon = ((k % 100) * 13) % 360 * 5 + k % 7
    pts = V.table(spark, sf, "customer").select(
        k.alias("geonameid"),
        (F.lit(90.0) - (cell_lat + 0.5) * 0.2).alias("lat"), (F.lit(-180.0) + (cell_lon + 0.5) * 0.2).alias("lon"),
    )
    with_country = M.classify_points(pts, V.mask_fine(spark, sf), V.countries(spark, sf), V.TOY_FINE, "country")
    both = M.classify_points(with_country, V.ocean_fine(spark, sf), V.oceans(spark, sf), V.TOY_FINE, "ocean", ("name",))
    return both.select("geonameid", "country_id", "country_code", "country_name", "ocean_id", "ocean_name")


@query("fine_or_coarse_bbox", """WITH p AS (SELECT point_id, lat, lon, i_lat, i_lon,
     CAST(greatest(0, least(899, floor((90 - lat) / 0.2::DOUBLE))) AS INTEGER) AS f_lat,
     CAST(greatest(0, least(1799, floor(((((lon + 180) - floor((lon + 180) / 360) * 360) - 180) + 180) / 0.2::DOUBLE))) AS INTEGER) AS f_lon FROM point_cells),
  j AS (SELECT p.*, m.i_lat IS NOT NULL AS fine FROM p LEFT JOIN mask_a m ON m.i_lat = p.i_lat AND m.i_lon = p.i_lon)
  SELECT point_id, fine, round(CASE WHEN fine THEN 90 - (f_lat + 0.5::DOUBLE) * 0.2::DOUBLE - 0.1::DOUBLE ELSE 90 - (i_lat + 0.5::DOUBLE) - 0.5::DOUBLE END, 6) + 0.0::DOUBLE AS box_lat_min,
    round(CASE WHEN fine THEN -180 + (f_lon + 0.5::DOUBLE) * 0.2::DOUBLE - 0.1::DOUBLE ELSE -180 + (i_lon + 0.5::DOUBLE) - 0.5::DOUBLE END, 6) + 0.0::DOUBLE AS box_lon_min FROM j""")
def _(spark, sf):
    out = M.fine_or_coarse_bbox(V.points(spark, sf), V.mask_a(spark, sf), V.TOY, V.TOY_FINE)
    return out.select("point_id", "fine", (F.round("box_lat_min", 6) + 0.0).alias("box_lat_min"),
                      (F.round("box_lon_min", 6) + 0.0).alias("box_lon_min"))
