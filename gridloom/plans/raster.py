"""Scores, palettes and pixel operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.operators import raster as E, regrid as RGD
from gridloom.plans import views as V
from gridloom.plans.grids import MERCATOR_SQL
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded

_RULES = [({"op": "gte", "threshold": 24}, 1), ({"op": "between", "min": 25, "max": 25.5}, 2),
          ({"op": "gt", "threshold": 26}, 4), ({"op": "lt", "threshold": 23}, 3)]
V.SQL_VIEWS["scored"] = """SELECT i_lat, i_lon, value, CAST(CASE WHEN value IS NULL THEN 0 ELSE greatest(0, CASE WHEN value >= 24 THEN 1 ELSE 0 END,
  CASE WHEN value BETWEEN 25 AND 25.5 THEN 2 ELSE 0 END, CASE WHEN value > 26 THEN 4 ELSE 0 END, CASE WHEN value < 23 THEN 3 ELSE 0 END) END AS INTEGER) AS score FROM raster"""


def scored(spark, sf):
    return V.raster(spark, sf).withColumn("score", E.score(F.col("value"), _RULES))


@query("score_map", "SELECT i_lat, i_lon, score FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(*CELL, "score")


@query("score_counts", """SELECT CAST(s AS INTEGER) AS score, count(scored.score) AS cells FROM range(5) r(s) LEFT JOIN scored ON scored.score = s GROUP BY 1""")
def _(spark, sf):
    return E.score_counts(scored(spark, sf))


V.SQL_VIEWS["scale"] = "SELECT quantile_cont(value, 0.02) AS vmin, quantile_cont(value, 0.98) AS vmax FROM raster"


@query("resolve_scale", "SELECT disp(vmin, 6) AS vmin, disp(vmax, 6) AS vmax FROM scale")
def _(spark, sf):
    return rounded(E.resolve_scale(V.raster(spark, sf)), "vmin", "vmax")


@query("resolve_scale_daily", "SELECT disp(quantile_cont(value, 0.02), 6) AS vmin, 45.0::DOUBLE AS vmax FROM obs_daily")
def _(spark, sf):
    return rounded(E.resolve_scale(V.obs_daily(spark, sf), vmax=45.0), "vmin", "vmax")


@query("legend_ticks", """SELECT CAST(k AS INTEGER) AS tick, round(vmax - k * ((vmax - vmin) / 4), 2) AS value
  FROM (SELECT disp(vmin, 6) AS vmin, disp(vmax, 6) AS vmax FROM scale), range(5) r(k)""")
def _(spark, sf):
    return E.legend_ticks(rounded(E.resolve_scale(V.raster(spark, sf)), "vmin", "vmax"))


_COLORS = ["#0011cc", "#00ddaa", "#ffee00", "#dd1100"]
_LO, _HI = 22.0, 29.0


def _channel(k: int) -> str:
    stops = [E.hex_rgb(c)[k] for c in _COLORS]
    arr = "[" + ", ".join(f"{s}.0::DOUBLE" for s in stops) + "]"
    return f"CAST(CASE WHEN value IS NULL THEN {E.hex_rgb('#102030')[k]} ELSE floor({arr}[i0 + 1] * (1 - (pos - i0)) + {arr}[least(i0 + 1, 3) + 1] * (pos - i0)) END AS INTEGER)"


V.SQL_VIEWS["pixels"] = f"""SELECT i_lat, i_lon, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b,
    CAST(CASE WHEN value IS NULL THEN 0 ELSE 255 END AS INTEGER) AS a
  FROM (SELECT *, CAST(floor(pos) AS INTEGER) AS i0 FROM (SELECT i_lat, i_lon, value, least(greatest((value - {_LO}::DOUBLE) / 7.0::DOUBLE, 0), 1) * 3 AS pos FROM raster))"""


def pixels(spark, sf):
    rgba = E.palette(F.col("value"), F.lit(_LO), F.lit(_HI), _COLORS, "#102030", 0.0)
    return V.raster(spark, sf).select(*CELL, *[c.cast("int").alias(n) for n, c in rgba.items()])


@query("palette_rgb", "SELECT * FROM pixels")
def _(spark, sf):
    return pixels(spark, sf)


@query("stitch_dateline", """WITH e AS (SELECT i_lat, i_lon, value, least(i_lon, 35 - i_lon) AS k FROM raster WHERE i_lon < 8 OR i_lon >= 28),
  p AS (SELECT i_lat, k, avg(value) AS value FROM e GROUP BY 1, 2)
  SELECT i_lat, i_lon, value FROM raster WHERE NOT (i_lon < 8 OR i_lon >= 28)
  UNION ALL SELECT i_lat, CAST(CASE WHEN s = 0 THEN k ELSE 35 - k END AS INTEGER), value FROM p, range(2) r(s)""")
def _(spark, sf):
    return E.stitch_dateline(V.raster(spark, sf), nlon=36)


@query("downsample_max_alpha", """SELECT CAST(i_lat // 2 AS INTEGER) AS i_lat, CAST(i_lon // 2 AS INTEGER) AS i_lon, r, g, b, a FROM pixels
  QUALIFY row_number() OVER (PARTITION BY i_lat // 2, i_lon // 2 ORDER BY a DESC, i_lat, i_lon) = 1""")
def _(spark, sf):
    return E.downsample_max_alpha(pixels(spark, sf))


@query("map_stats", f"""WITH m AS ({MERCATOR_SQL}) SELECT min(value) AS min, max(value) AS max, CAST(648 - count(value) AS BIGINT) AS nan_count FROM m""")
def _(spark, sf):
    projected = rounded(RGD.mercator_rows(V.raster(spark, sf), V.RASTER), "value")
    return E.map_stats(projected, V.RASTER.nlat * V.RASTER.nlon)
