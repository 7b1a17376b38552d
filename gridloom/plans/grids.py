"""Regridding, rasterising and centroids over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid
from gridloom.operators import regrid as RGD
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded

#: Four-degree target grid, 45 x 90 cells.
TARGET = Grid("toy_4deg", 4.0, 45, 90)

V.SQL_VIEWS["source_grid"] = """SELECT 85 - i_lat * 10.0::DOUBLE AS lat, -175 + i_lon * 10.0::DOUBLE AS lon, value FROM raster"""


def source_grid(spark, sf):
    return V.raster(spark, sf).select(
        (F.lit(85.0) - F.col("i_lat") * 10.0).alias("lat"), (F.lit(-175.0) + F.col("i_lon") * 10.0).alias("lon"), "value"
    )


def _axis_sql(name: str, n: int, expr: str, coord: str) -> str:
    return f"""{name}_t AS (SELECT CAST(i AS INTEGER) AS i, {expr} AS x FROM range({n}) r(i)),
  {name}_s AS (SELECT DISTINCT {coord} AS s FROM source_grid),
  {name}_b AS (SELECT i, x, (SELECT min(s) FROM {name}_s) AS f, (SELECT max(s) FROM {name}_s) AS l,
     (SELECT max(s) FROM {name}_s WHERE s < x) AS lo0, (SELECT min(s) FROM {name}_s WHERE s >= x) AS hi0 FROM {name}_t),
  {name} AS (SELECT i, x, x < f OR x > l AS out_, CASE WHEN x = f THEN f ELSE lo0 END AS lo,
     CASE WHEN x = f THEN (SELECT min(s) FROM {name}_s WHERE s > f) ELSE hi0 END AS hi,
     CASE WHEN x <= f THEN f WHEN x >= l THEN l WHEN x - lo0 <= hi0 - x THEN lo0 ELSE hi0 END AS near FROM {name}_b)"""


_AXES = "WITH " + _axis_sql("rw", 45, "90 - (i + 0.5::DOUBLE) * 4", "lat") + ", " + _axis_sql("cl", 90, "-180 + (i + 0.5::DOUBLE) * 4", "lon")


@query("regrid_bilinear", f"""{_AXES},
  g AS (SELECT rw.i AS i_lat, cl.i AS i_lon, rw.out_ OR cl.out_ AS o, n.value AS nv, a.value AS v00, b.value AS v01, c.value AS v10, d.value AS v11,
      (rw.x - rw.lo) / (rw.hi - rw.lo) AS wy, (cl.x - cl.lo) / (cl.hi - cl.lo) AS wx
    FROM rw CROSS JOIN cl LEFT JOIN source_grid n ON n.lat = rw.near AND n.lon = cl.near
    LEFT JOIN source_grid a ON a.lat = rw.lo AND a.lon = cl.lo LEFT JOIN source_grid b ON b.lat = rw.lo AND b.lon = cl.hi
    LEFT JOIN source_grid c ON c.lat = rw.hi AND c.lon = cl.lo LEFT JOIN source_grid d ON d.lat = rw.hi AND d.lon = cl.hi)
  SELECT * FROM (SELECT i_lat, i_lon, disp(CASE WHEN o THEN nv ELSE (1 - wx) * ((1 - wy) * v00 + wy * v10) + wx * ((1 - wy) * v01 + wy * v11) END, 6) AS value FROM g) WHERE value IS NOT NULL""")
def _(spark, sf):
    return rounded(RGD.regrid(source_grid(spark, sf), TARGET), "value").where("value IS NOT NULL")


@query("regrid_nearest", f"""{_AXES} SELECT rw.i AS i_lat, cl.i AS i_lon, n.value FROM rw CROSS JOIN cl
  JOIN source_grid n ON n.lat = rw.near AND n.lon = cl.near""")
def _(spark, sf):
    return RGD.regrid(source_grid(spark, sf), TARGET, method="nearest")


V.SQL_VIEWS["shifted"] = """SELECT 90 - (i_lat + 0.5::DOUBLE) * 10 + 0.3::DOUBLE AS lat, -180 + (i_lon + 0.5::DOUBLE) * 10 - 0.2::DOUBLE AS lon, value FROM raster
  UNION ALL SELECT 90 - (i_lat + 0.5::DOUBLE) * 10 + 2.5::DOUBLE, -180 + (i_lon + 0.5::DOUBLE) * 10 + 1.25::DOUBLE, -value FROM raster WHERE i_lat % 2 = 0"""


def shifted(spark, sf):
    r = V.raster(spark, sf)
    lat, lon = F.lit(90.0) - (F.col("i_lat") + 0.5) * 10, F.lit(-180.0) + (F.col("i_lon") + 0.5) * 10
    near = r.select((lat + 0.3).alias("lat"), (lon - 0.2).alias("lon"), "value")
    far = r.where("i_lat % 2 = 0").select((lat + 2.5).alias("lat"), (lon + 1.25).alias("lon"), (-F.col("value")).alias("value"))
    return near.union(far)


@query("reindex_nearest", """WITH c AS (SELECT i_lat, i_lon, value, abs((90 - lat) / 10 - 0.5::DOUBLE - i_lat) AS dy, abs((lon + 180) / 10 - 0.5::DOUBLE - i_lon) AS dx, lat, lon
    FROM shifted, (SELECT CAST(a AS INTEGER) AS i_lat FROM range(18) r(a)), (SELECT CAST(b AS INTEGER) AS i_lon FROM range(36) s(b))
    WHERE abs((90 - lat) / 10 - 0.5::DOUBLE - i_lat) <= 0.51::DOUBLE AND abs((lon + 180) / 10 - 0.5::DOUBLE - i_lon) <= 0.51::DOUBLE)
  SELECT i_lat, i_lon, value FROM c QUALIFY row_number() OVER (PARTITION BY i_lat, i_lon ORDER BY dy, lat, dx, lon) = 1""")
def _(spark, sf):
    return RGD.reindex_nearest(shifted(spark, sf), V.RASTER)


_Y = "ln(tan(pi() / 4 + radians(90 - (i + 0.5::DOUBLE) * 10) / 2))"


MERCATOR_SQL = f"""WITH ax AS (SELECT CAST(i AS INTEGER) AS i, {_Y} AS y FROM range(18) r(i)),
  b AS (SELECT max(y) AS top, min(y) AS bot FROM ax),
  t AS (SELECT CAST(k AS INTEGER) AS row, top - k * ((top - bot) / 17) AS yt FROM range(18) r(k), b),
  s AS (SELECT p.i_lon, p.i_lat, p.value AS v, q.value AS v1, u.y AS y, w.y AS y1 FROM raster p JOIN raster q ON q.i_lon = p.i_lon AND q.i_lat = p.i_lat + 1
     JOIN ax u ON u.i = p.i_lat JOIN ax w ON w.i = q.i_lat WHERE p.value IS NOT NULL AND q.value IS NOT NULL)
  SELECT row, i_lon, disp(v1 + (v - v1) * least(greatest((yt - y1) / (y - y1), 0), 1), 6) AS value FROM s JOIN t ON yt <= y + 1e-9 AND yt >= y1 - 1e-9
  QUALIFY row_number() OVER (PARTITION BY row, i_lon ORDER BY i_lat) = 1"""


@query("mercator_rows", MERCATOR_SQL)
def _(spark, sf):
    return rounded(RGD.mercator_rows(V.raster(spark, sf), V.RASTER), "value")


# Each supplier draws a hexagon with a square hole; odd suppliers have no code of their own.
_VERT = """SELECT s_suppkey AS feature_id, s_suppkey AS feature_order, ring, CAST(seq AS INTEGER) AS seq,
    CASE WHEN s_suppkey % 2 = 0 THEN chr(CAST(65 + s_nationkey AS INTEGER)) || 'X' WHEN s_suppkey % 3 = 0 THEN '-99' ELSE ' ' END AS code,
    CASE WHEN s_suppkey % 5 <> 0 THEN chr(CAST(65 + s_nationkey AS INTEGER)) || 'Y' ELSE '-99' END AS alt_code,
    ((s_suppkey * 37) % 140) - 70 + 0.013::DOUBLE + dy AS lat, ((s_suppkey * 89) % 330) - 165 + 0.017::DOUBLE + dx AS lon,
    'Sea ' || (s_suppkey % 40) || CASE WHEN s_suppkey % 3 = 0 THEN ' (outer)' ELSE '' END AS name, 'sea ' || (s_suppkey % 40) AS norm_name
  FROM supplier, shape"""
_SHAPE = [(0, 0, 6.1, 0.0), (0, 1, 3.2, 7.7), (0, 2, -3.4, 7.3), (0, 3, -6.3, 0.4), (0, 4, -3.1, -7.9), (0, 5, 3.3, -7.2), (0, 6, 6.1, 0.0),
          (1, 0, 1.6, 1.7), (1, 1, -1.4, 1.8), (1, 2, -1.5, -1.9), (1, 3, 1.7, -1.6), (1, 4, 1.6, 1.7)]
V.SQL_VIEWS["shape"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({r}, {s}, {dy}::DOUBLE, {dx}::DOUBLE)" for r, s, dy, dx in _SHAPE) + ") v(ring, seq, dy, dx)"
V.SQL_VIEWS["vertices"] = _VERT


def vertices(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    letter = F.char(F.lit(65) + n)
    shape = F.inline(F.array(*[
        F.struct(F.lit(r).alias("ring"), F.lit(s).alias("seq"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
        for r, s, dy, dx in _SHAPE
    ]))
    v = V.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", shape)
    return v.select(
        k.alias("feature_id"), k.alias("feature_order"), "ring", "seq",
        F.when(k % 2 == 0, F.concat(letter, F.lit("X"))).when(k % 3 == 0, "-99").otherwise(" ").alias("code"),
        F.when(k % 5 != 0, F.concat(letter, F.lit("Y"))).otherwise("-99").alias("alt_code"),
        ((k * 37) % 140 - 70 + F.lit(0.013) + F.col("dy")).alias("lat"),
        ((k * 89) % 330 - 165 + F.lit(0.017) + F.col("dx")).alias("lon"),
        F.concat(F.lit("Sea "), (k % 40).cast("string"), F.when(k % 3 == 0, " (outer)").otherwise("")).alias("name"),
        F.concat(F.lit("sea "), (k % 40).cast("string")).alias("norm_name"),
    )


@query("polygon_to_cells", """WITH f AS (SELECT DISTINCT feature_id, feature_order, coalesce(CASE WHEN upper(trim(code)) NOT IN ('', '-99') THEN upper(trim(code)) END,
      CASE WHEN upper(trim(alt_code)) NOT IN ('', '-99') THEN upper(trim(alt_code)) END) AS cc FROM vertices),
  ids AS (SELECT cc, CAST(row_number() OVER (ORDER BY min(feature_order), cc) AS INTEGER) AS id FROM f WHERE cc IS NOT NULL GROUP BY cc),
  e AS (SELECT a.feature_id, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM vertices a JOIN vertices b ON a.feature_id = b.feature_id AND a.ring = b.ring AND b.seq = a.seq + 1),
  rows_ AS (SELECT CAST(i AS INTEGER) AS i_lat, 90 - (i + 0.5::DOUBLE) AS y FROM range(180) r(i)),
  cuts AS (SELECT feature_id, i_lat, x1 + (y - y1) * (x2 - x1) / (y2 - y1) AS x FROM e JOIN rows_ ON y >= least(y1, y2) AND y < greatest(y1, y2)),
  box AS (SELECT feature_id, i_lat, min(x) AS a, max(x) AS b FROM cuts GROUP BY 1, 2),
  cell AS (SELECT feature_id, i_lat, CAST(j AS INTEGER) AS i_lon FROM box, range(360) r(j) WHERE -180 + (j + 0.5::DOUBLE) BETWEEN a AND b),
  inside AS (SELECT c.feature_id, c.i_lat, c.i_lon FROM cell c JOIN cuts u ON u.feature_id = c.feature_id AND u.i_lat = c.i_lat
     GROUP BY ALL HAVING count(*) FILTER (WHERE u.x < -180 + (c.i_lon + 0.5::DOUBLE)) % 2 = 1)
  SELECT i_lat, i_lon, id FROM inside JOIN f USING (feature_id) JOIN ids USING (cc)
  QUALIFY row_number() OVER (PARTITION BY i_lat, i_lon ORDER BY feature_order DESC) = 1""")
def _(spark, sf):
    v = vertices(spark, sf)
    ids = RGD.feature_ids(v.select("feature_id", "feature_order", "code", "alt_code").distinct())
    return RGD.polygon_to_cells(v, ids, V.TOY)


@query("circular_centroid", """WITH p AS (SELECT norm_name, feature_id, feature_order, name, avg(lat) AS lat, count(*) AS n,
    atan2(sum(sin(radians(lon))), sum(cos(radians(lon)))) AS a FROM vertices GROUP BY 1, 2, 3, 4),
  g AS (SELECT norm_name, sum(lat * n) / sum(n) AS lat, degrees(atan2(sum(sin(a) * n), sum(cos(a) * n))) AS lon, CAST(sum(n) AS BIGINT) AS vertices FROM p GROUP BY 1),
  l AS (SELECT norm_name, name AS label FROM p QUALIFY row_number() OVER (PARTITION BY norm_name ORDER BY length(name) DESC, feature_order) = 1)
  SELECT norm_name, label, disp(lat, 5) + 0.0::DOUBLE AS lat, disp(((lon + 180) - floor((lon + 180) / 360) * 360) - 180, 5) + 0.0::DOUBLE AS lon, vertices FROM g JOIN l USING (norm_name)""")
def _(spark, sf):
    return rounded(RGD.circular_centroids(vertices(spark, sf)), "lat", "lon", digits=5)
