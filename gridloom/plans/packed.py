"""Reducers over packed series of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.operators import packed as P
from gridloom.plans import views as V
from gridloom.plans.quality import annual_series
from gridloom.plans.regions import weights
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded
from gridloom.sources import series as S

_DENSE = """SELECT c.i_lat, c.i_lon, d.t, o.value FROM (SELECT i_lat, i_lon FROM obs_gappy GROUP BY 1, 2 HAVING count(value) > 0) c
  CROSS JOIN (SELECT DISTINCT t FROM obs_gappy) d LEFT JOIN obs_gappy o ON o.i_lat = c.i_lat AND o.i_lon = c.i_lon AND o.t = d.t"""
V.SQL_VIEWS["obs_dense"] = _DENSE


def daily_series(spark, sf):
    obs = V.obs_gappy(spark, sf)
    axis = S.build_axis("daily", obs, "day")
    return S.pack_series(obs, axis, "daily", V.TOY), axis


@query("max_cdd_per_year_packed", """WITH m AS (SELECT *, CAST(year(t) AS INTEGER) AS year, coalesce(value < 25, false) AS dry FROM obs_dense),
  i AS (SELECT *, row_number() OVER (PARTITION BY i_lat, i_lon, year ORDER BY t) - row_number() OVER (PARTITION BY i_lat, i_lon, year, dry ORDER BY t) AS g FROM m),
  r AS (SELECT i_lat, i_lon, year, dry, g, count(*) AS len, count(value) AS n FROM i GROUP BY ALL)
  SELECT i_lat, i_lon, year, CASE WHEN sum(n) > 0 THEN CAST(coalesce(max(len) FILTER (WHERE dry), 0) AS BIGINT) END AS value FROM r GROUP BY ALL""")
def _(spark, sf):
    series, axis = daily_series(spark, sf)
    return P.longest_dry_run(series, axis, threshold=25.0)


@query("region_mean_packed", """SELECT region_key, CAST(year AS VARCHAR) AS axis_label, mean, min, max FROM region_values""")
def _(spark, sf):
    series, axis = annual_series(spark, sf)
    out = P.region_aggregates(series, axis, weights(spark, sf), V.TOY)
    return out.select("region_key", "axis_label", "mean", "min", "max")


@query("annual_sum_packed", "SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, disp(sum(value), 6) AS value FROM obs_dense GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(P.annual_sum(*daily_series(spark, sf)), "value")


@query("annual_mean_packed", """WITH m AS (SELECT i_lat, i_lon, date_trunc('month', t) AS t, avg(value) AS value FROM obs_dense GROUP BY 1, 2, 3)
  SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, disp(avg(value), 6) AS value FROM m GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(P.annual_mean_from_daily(*daily_series(spark, sf)), "value")


@query("daily_to_monthly_yearly_packed", """SELECT i_lat, i_lon, 'monthly' AS period, CAST(date_trunc('month', t) AS DATE) AS start, disp(avg(value), 6) AS value
    FROM obs_dense GROUP BY 1, 2, 3, 4
  UNION ALL SELECT i_lat, i_lon, 'yearly', CAST(date_trunc('year', t) AS DATE), disp(avg(value), 6) FROM obs_dense GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return rounded(P.daily_to_monthly_yearly(*daily_series(spark, sf)), "value")


@query("heat_stress_packed", """SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year,
    CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value < 20) END AS no_risk_days,
    CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value >= 20 AND value < 35) END AS moderate_days,
    CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value >= 35) END AS severe_days,
    CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value >= 20 AND value < 35) + 2 * count(*) FILTER (WHERE value >= 35) END AS risk_score,
    max(value) AS max_value FROM obs_dense GROUP BY 1, 2, 3""")
def _(spark, sf):
    return P.heat_stress_years(*daily_series(spark, sf), moderate=20.0, severe=35.0)


@query("hot_days_packed", """WITH d AS (SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, dayofyear(t) AS doy, value
    FROM obs_dense WHERE NOT (month(t) = 2 AND day(t) = 29)),
  lim AS (SELECT i_lat, i_lon, doy, round(quantile_cont(value, 0.6), 9) AS p FROM d
    WHERE year <= (SELECT min(year) + 4 FROM d) GROUP BY 1, 2, 3)
  SELECT i_lat, i_lon, year, CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value > p) END AS value
  FROM d LEFT JOIN lim USING (i_lat, i_lon, doy) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return P.hot_days(*daily_series(spark, sf), baseline_years=5, percentile=60)
