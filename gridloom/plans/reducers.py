"""Temporal reducers and coordinate maths over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import grid as G
from gridloom.contract import CELL
from gridloom.functions import calendar as cal, predicates, units
from gridloom.operators import reducers as R
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded
from gridloom.storage import work_folder


# --- coordinates, predicates, units -------------------------------------------------

@query("normalize_lon", "SELECT point_id, disp(((lon + 180) - floor((lon + 180) / 360) * 360) - 180, 6) AS lon FROM points")
def _(spark, sf):
    return rounded(V.points(spark, sf).select("point_id", G.wrap_lon(F.col("lon")).alias("lon")), "lon")


_WRAP = "(((lon + 180) - floor((lon + 180) / 360) * 360) - 180)"
_ROW = "CAST(greatest(0, least(179, floor(90 - greatest(-90 + 1e-12, least(90 - 1e-12, lat))))) AS INTEGER)"
_COL = f"CAST(greatest(0, least(359, floor({_WRAP} + 180))) AS INTEGER)"
V.SQL_VIEWS["point_cells"] = f"SELECT point_id, {_ROW} AS i_lat, {_COL} AS i_lon, lat, lon FROM points"


def point_cells(spark, sf):
    pts = V.points(spark, sf)
    return pts.withColumns(G.cell_of(F.col("lat"), F.col("lon"), V.TOY))


@query("snap_to_cell", "SELECT point_id, i_lat, i_lon FROM point_cells")
def _(spark, sf):
    return point_cells(spark, sf).select("point_id", *CELL)


@query("cell_to_tile", """SELECT point_id, CAST(i_lat // 16 AS INTEGER) AS tile_r, CAST(i_lon // 16 AS INTEGER) AS tile_c,
  CAST(i_lat % 16 AS INTEGER) AS o_lat, CAST(i_lon % 16 AS INTEGER) AS o_lon FROM point_cells""")
def _(spark, sf):
    return point_cells(spark, sf).withColumns(G.tile_of(V.TOY)).select(
        "point_id", "tile_r", "tile_c", "o_lat", "o_lon"
    )


@query("cell_bbox", """SELECT point_id, 90 - (i_lat + 0.5::DOUBLE) AS lat, -180 + (i_lon + 0.5::DOUBLE) AS lon,
  90 - (i_lat + 0.5::DOUBLE) - 0.5::DOUBLE AS lat_min, 90 - (i_lat + 0.5::DOUBLE) + 0.5::DOUBLE AS lat_max,
  -180 + (i_lon + 0.5::DOUBLE) - 0.5::DOUBLE AS lon_min, -180 + (i_lon + 0.5::DOUBLE) + 0.5::DOUBLE AS lon_max FROM point_cells""")
def _(spark, sf):
    return point_cells(spark, sf).select(
        "point_id", *[c.alias(n) for n, c in G.bbox_of(V.TOY).items()]
    )


@query("snap_round", """SELECT id, round_even(click_lat / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0.0::DOUBLE AS lat,
  round_even(click_lon / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0.0::DOUBLE AS lon FROM clicks""")
def _(spark, sf):
    return V.clicks(spark, sf).select(
        "id",
        (G.snap_round(F.col("click_lat"), 0.25) + 0.0).alias("lat"),
        (G.snap_round(F.col("click_lon"), 0.25) + 0.0).alias("lon"),
    )


@query("postprocess", "SELECT i_lat, i_lon, t, disp((value - 273.15::DOUBLE) * 1000 * 0.1::DOUBLE, 6) AS value FROM obs_daily")
def _(spark, sf):
    steps = ["k_to_c", "m_to_mm", ("scale", 0.1)]
    out = V.obs_daily(spark, sf).withColumn("value", units.postprocess(F.col("value"), steps))
    return rounded(out, "value")


@query("convert_unit", """SELECT i_lat, i_lon, t, disp(value * 9 / 5 + 32, 3) AS absolute,
  disp(value * 9 / 5, 3) AS delta, disp((value - 32) * 5 / 9, 6) AS to_c FROM obs_daily""")
def _(spark, sf):
    v = F.col("value")
    out = V.obs_daily(spark, sf).select(
        *CELL, "t",
        units.display_value(v, F.lit("annual_mean"), "C", "F").alias("absolute"),
        units.display_value(v, F.lit("multi_model_offset"), "C", "F").alias("delta"),
        units.convert_unit(v, "F", "C").alias("to_c"),
    )
    return rounded(out, "to_c")


@query("score_predicate", """SELECT i_lat, i_lon, t, coalesce(value > 25, false) AS gt, coalesce(value >= 25, false) AS gte,
  coalesce(value < 10, false) AS lt, coalesce(value <= 10, false) AS lte, coalesce(value = 20, false) AS eq,
  coalesce(value <> 20, false) AS neq, coalesce(value BETWEEN 10 AND 20, false) AS between_incl,
  coalesce(value > 10 AND value < 20, false) AS between_excl FROM obs_gappy""")
def _(spark, sf):
    v = F.col("value")
    specs = {
        "gt": {"op": "gt", "threshold": 25}, "gte": {"op": "gte", "threshold": 25},
        "lt": {"op": "lt", "threshold": 10}, "lte": {"op": "lte", "threshold": 10},
        "eq": {"op": "eq", "threshold": 20}, "neq": {"op": "neq", "threshold": 20},
        "between_incl": {"op": "between", "min": 10, "max": 20},
        "between_excl": {"op": "between", "min": 10, "max": 20, "inclusive": False},
    }
    return V.obs_gappy(spark, sf).select(
        *CELL, "t", *[predicates.matches(v, s).alias(n) for n, s in specs.items()]
    )


@query("bbox_filter", """SELECT i_lat, i_lon, t, value FROM obs_daily
  WHERE 90 - (i_lat + 0.5) BETWEEN -60 AND 70 AND (-180 + (i_lon + 0.5) >= 100 OR -180 + (i_lon + 0.5) <= -60)""")
def _(spark, sf):
    lat, lon = G.center_lat(F.col("i_lat"), V.TOY), G.center_lon(F.col("i_lon"), V.TOY)
    return V.obs_daily(spark, sf).where(G.in_bbox(lat, lon, west=100, south=-60, east=-60, north=70))


@query("year_month_filter", """SELECT i_lat, i_lon, t, value FROM obs_monthly
  WHERE year(t) BETWEEN 1996 AND 1999 AND month(t) IN (6, 7, 8)""")
def _(spark, sf):
    keep = cal.in_years_months(F.year("t"), F.month("t"), 1996, 1999, [6, 7, 8])
    return V.obs_monthly(spark, sf).where(keep)


@query("window_days", """SELECT i_lat, i_lon, avg(value) AS value, count(*) AS days FROM obs_daily
  WHERE t BETWEEN DATE '1996-06-23' AND DATE '1996-07-05' GROUP BY 1, 2""")
def _(spark, sf):
    inside = cal.in_window(F.col("t"), "1996-06-23", "1996-07-05")
    out = V.obs_daily(spark, sf).where(inside).groupBy(*CELL).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("days")
    )
    return out


@query("climatology_months", """SELECT i_lat, i_lon, t, value FROM obs_monthly
  WHERE month(t) = 6 AND year(t) BETWEEN 1996 AND 2000""")
def _(spark, sf):
    return V.obs_monthly(spark, sf).where(
        cal.in_climatology(F.year("t"), F.month("t"), 6, 1996, 2000)
    )


@query("drop_feb29", "SELECT i_lat, i_lon, t, value FROM obs_daily WHERE NOT (month(t) = 2 AND day(t) = 29)")
def _(spark, sf):
    return V.obs_daily(spark, sf).where(~cal.is_feb29(F.col("t")))


@query("select_years", "SELECT i_lat, i_lon, year, value FROM annual WHERE year IN (1997, 1999)")
def _(spark, sf):
    return R.select_years(V.annual(spark, sf), [1997, 1999])


@query("select_years_no_match", "SELECT i_lat, i_lon, year, value FROM annual")
def _(spark, sf):
    return R.select_years(V.annual(spark, sf), [1850])


@query("widen_narrow_range", """WITH req AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS s,
    CAST(year(o_orderdate) + o_orderkey % 4 AS INTEGER) AS e FROM orders),
  r2 AS (SELECT o_orderkey, s, least(e, 2001) AS e FROM req),
  grown AS (SELECT *, CASE WHEN e - s >= 2 THEN 0
      WHEN e - s = 1 THEN CASE WHEN e < 2001 THEN 0 WHEN s > 1995 THEN 1 ELSE 0 END
      ELSE CASE WHEN e >= 2001 THEN least(2, s - 1995) WHEN s > 1995 THEN 1 ELSE 0 END END AS before FROM r2)
  SELECT o_orderkey, CAST(s - before AS INTEGER) AS start_year,
    CAST(e + least(greatest(0, 2 - (e - s)) - before, 2001 - e) AS INTEGER) AS end_year FROM grown""")
def _(spark, sf):
    y = F.year("o_orderdate")
    req = V.table(spark, sf, "orders").select(
        "o_orderkey", y.alias("s"),
        F.least((y + F.col("o_orderkey") % 4).cast("int"), F.lit(2001)).alias("e"),
    )
    start, end = cal.widen_range(F.col("s"), F.col("e"), F.lit(1995), F.lit(2001))
    return req.select("o_orderkey", start.cast("int").alias("start_year"), end.cast("int").alias("end_year"))


# --- reducers -------------------------------------------------------------------------

@query("identity", "SELECT i_lat, i_lon, t, value FROM obs_gappy")
def _(spark, sf):
    return R.identity(V.obs_gappy(spark, sf))


for _name, _fn, _agg in [
    ("monthly_mean_from_daily", R.monthly_mean, "avg"),
    ("monthly_max_from_daily", R.monthly_max, "max"),
    ("monthly_min_from_daily", R.monthly_min, "min"),
]:
    query(_name, f"""WITH m AS (SELECT i_lat, i_lon, CAST(date_trunc('month', t) AS DATE) AS t, {_agg}(value) AS value
        FROM obs_gappy GROUP BY 1, 2, 3),
      span AS (SELECT i_lat, i_lon, min(t) AS a, max(t) AS b FROM m GROUP BY 1, 2),
      spine AS (SELECT i_lat, i_lon, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS t FROM span)
      SELECT i_lat, i_lon, t, disp(value, 6) AS value FROM spine LEFT JOIN m USING (i_lat, i_lon, t)""")(
        lambda spark, sf, fn=_fn: rounded(fn(V.obs_gappy(spark, sf), fill_gaps=True), "value")
    )


@query("annual_mean_from_monthly", """SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, disp(avg(value), 6) AS value
  FROM obs_monthly GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(R.annual_mean_of_months(V.obs_monthly(spark, sf)), "value")


@query("annual_mean_from_daily", """WITH m AS (SELECT i_lat, i_lon, date_trunc('month', t) AS t, avg(value) AS value
  FROM obs_gappy GROUP BY 1, 2, 3)
  SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, disp(avg(value), 6) AS value FROM m GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(R.annual_mean_from_daily(V.obs_gappy(spark, sf)), "value")


@query("annual_sum_from_daily", "SELECT i_lat, i_lon, year, disp(value, 6) AS value FROM annual")
def _(spark, sf):
    return rounded(R.annual_sum(V.obs_gappy(spark, sf)), "value")


@query("annual_group", """SELECT CAST(year(t) AS INTEGER) AS year, disp(avg(value), 6) AS mean, disp(sum(value), 4) AS sum, max(value) AS max
  FROM obs_gappy GROUP BY 1""")
def _(spark, sf):
    obs = V.obs_gappy(spark, sf)
    how = lambda h: R.annual_group(obs, h, keys=[]).withColumnRenamed("value", h)
    out = how("mean").join(how("sum"), "year").join(how("max"), "year")
    return rounded(rounded(out, "mean"), "sum", digits=4)


V.SQL_VIEWS["daily_range"] = """SELECT i_lat, i_lon, t, value AS v_mean, value - i_lat % 5 AS v_min,
  value + i_lon % 3 AS v_max FROM obs_gappy"""


def daily_range(spark, sf):
    v = F.col("value")
    return V.obs_gappy(spark, sf).select(
        *CELL, "t", v.alias("v_mean"), (v - F.col("i_lat") % 5).alias("v_min"),
        (v + F.col("i_lon") % 3).alias("v_max"),
    )


@query("daily_to_monthly_yearly", """SELECT i_lat, i_lon, 'monthly' AS period, CAST(date_trunc('month', t) AS DATE) AS start,
  disp(avg(v_mean), 6) AS v_mean, disp(avg(v_min), 6) AS v_min, disp(avg(v_max), 6) AS v_max FROM daily_range GROUP BY 1, 2, 3, 4
  UNION ALL SELECT i_lat, i_lon, 'yearly', CAST(date_trunc('year', t) AS DATE),
  disp(avg(v_mean), 6), disp(avg(v_min), 6), disp(avg(v_max), 6) FROM daily_range GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return rounded(R.daily_to_monthly_yearly(daily_range(spark, sf)), "v_mean", "v_min", "v_max")


@query("max_cdd_per_year", """WITH m AS (SELECT *, CAST(year(t) AS INTEGER) AS year, coalesce(value < 25, false) AS dry FROM obs_gappy),
  i AS (SELECT *, row_number() OVER (PARTITION BY i_lat, i_lon, year ORDER BY t)
     - row_number() OVER (PARTITION BY i_lat, i_lon, year, dry ORDER BY t) AS g FROM m),
  r AS (SELECT i_lat, i_lon, year, dry, g, count(*) AS len, count(value) AS n FROM i GROUP BY ALL)
  SELECT i_lat, i_lon, year, CASE WHEN sum(n) > 0 THEN CAST(coalesce(max(len) FILTER (WHERE dry), 0) AS BIGINT) END AS value
  FROM r GROUP BY ALL""")
def _(spark, sf):
    return R.longest_dry_run(V.obs_gappy(spark, sf), threshold=25.0)


@query("climatology_mean", """SELECT i_lat, i_lon, CAST(2000 AS INTEGER) AS year, disp(avg(value), 6) AS value FROM annual
  WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(R.climatology_mean(V.annual(spark, sf), 1996, 2000, strict=False), "value")


@query("hot_days_per_year", """WITH d AS (SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, dayofyear(t) AS doy, value
    FROM obs_gappy WHERE NOT (month(t) = 2 AND day(t) = 29)),
  lim AS (SELECT i_lat, i_lon, doy, round(quantile_cont(value, 0.6), 9) AS p FROM d
    WHERE year <= (SELECT min(year(t)) + 4 FROM obs_gappy) GROUP BY 1, 2, 3)
  SELECT i_lat, i_lon, year, CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value > p) END AS value
  FROM d LEFT JOIN lim USING (i_lat, i_lon, doy) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return R.hot_days(V.obs_gappy(spark, sf), baseline_years=5, percentile=60)


@query("hot_days_appended", """WITH d AS (SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, dayofyear(t) AS doy, value
    FROM obs_gappy WHERE NOT (month(t) = 2 AND day(t) = 29)), b AS (SELECT min(year(t)) + 4 AS last FROM obs_gappy),
  lim AS (SELECT i_lat, i_lon, doy, round(quantile_cont(value, 0.6), 9) AS p FROM d WHERE year <= (SELECT last FROM b) GROUP BY 1, 2, 3)
  SELECT i_lat, i_lon, year, CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value > p) END AS value
  FROM d LEFT JOIN lim USING (i_lat, i_lon, doy) WHERE year > (SELECT last FROM b) GROUP BY 1, 2, 3""")
def _(spark, sf):
    obs = V.obs_gappy(spark, sf)
    last = obs.agg(F.min(F.year("t")) + 4).first()[0]
    path = f"{work_folder(spark, 'limits')}/limits"
    R.day_limits(obs.where(F.year("t") <= last), 60).write.parquet(path)
    # From here on only the stored limits and the new years are read.
    return R.hot_days_against(obs.where(F.year("t") > last), spark.read.parquet(path))


@query("multi_model_offset", """WITH e AS (SELECT i_lat, i_lon, year, avg(value) AS value FROM models GROUP BY 1, 2, 3)
  SELECT i_lat, i_lon, CAST(2000 AS INTEGER) AS year, disp(avg(value) FILTER (WHERE year BETWEEN 1998 AND 2000)
    - avg(value) FILTER (WHERE year BETWEEN 1995 AND 1996), 6) + 0.0::DOUBLE AS value FROM e GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(R.multi_model_offset(V.models(spark, sf), (1995, 1996), (1998, 2000)), "value")


_DHW = "SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, {} AS value FROM dhw_daily GROUP BY 1, 2, 3"
for _name, _expr in [
    ("dhw_no_risk_days", "count(*) FILTER (WHERE value < 4)"),
    ("dhw_moderate_days", "count(*) FILTER (WHERE value >= 4 AND value < 8)"),
    ("dhw_severe_days", "count(*) FILTER (WHERE value >= 8)"),
    ("dhw_risk_score", "CAST(count(*) FILTER (WHERE value >= 4 AND value < 8) + 2 * count(*) FILTER (WHERE value >= 8) AS BIGINT)"),
    ("dhw_max_per_year", "max(value)"),
]:
    query(_name, _DHW.format(_expr))(
        lambda spark, sf, n=_name: R.REDUCERS[n](V.dhw_daily(spark, sf))
    )


@query("partial_period_guard", """WITH d AS (SELECT DISTINCT t, CAST(date_trunc('month', t) AS DATE) AS start FROM obs_daily),
  c AS (SELECT start, count(*) AS days_present FROM d GROUP BY 1)
  SELECT *, CAST(date_diff('day', start, start + INTERVAL 1 MONTH) AS BIGINT) AS days_expected,
    days_present = date_diff('day', start, start + INTERVAL 1 MONTH) AS complete FROM c""")
def _(spark, sf):
    return R.period_completeness(V.obs_daily(spark, sf), "month")


@query("concat_blocks", "SELECT i_lat, i_lon, year, value FROM annual WHERE year BETWEEN 1996 AND 2000")
def _(spark, sf):
    a = V.annual(spark, sf)
    return R.concat_blocks(
        [a.where("year <= 1997"), a.where("year between 1998 and 1999"), a.where("year >= 2000")],
        1996, 2000, strict=False,
    )
