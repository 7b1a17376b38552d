"""Per-cell map reducers and series transforms over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.functions import calendar as cal
from gridloom.functions.units import display_round
from gridloom.operators import percell as D, reducers as R
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded

_SLOPE = "CASE WHEN count(DISTINCT CASE WHEN value IS NOT NULL THEN year END) >= 2 THEN regr_slope(value, year) END"
_ICPT = _SLOPE.replace("regr_slope", "regr_intercept")


@query("reduce_latest_year", "SELECT i_lat, i_lon, year, value FROM annual WHERE year = (SELECT max(year) FROM annual)")
def _(spark, sf):
    return D.latest_year(V.annual(spark, sf))


@query("reduce_year", "SELECT i_lat, i_lon, year, value FROM annual WHERE year = 1998")
def _(spark, sf):
    return D.at_year(V.annual(spark, sf), 1998, strict=False)


@query("reduce_mean", "SELECT i_lat, i_lon, disp(avg(value), 6) AS value FROM annual WHERE year BETWEEN 1996 AND 1999 GROUP BY 1, 2")
def _(spark, sf):
    return rounded(D.mean_between(V.annual(spark, sf), 1996, 1999, strict=False), "value")


@query("anomaly_vs_mean", """SELECT i_lat, i_lon, disp(max(value) FILTER (WHERE year = 2000)
  - avg(value) FILTER (WHERE year BETWEEN 1995 AND 1998), 6) + 0.0::DOUBLE AS value FROM annual GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(D.anomaly_vs_mean(V.annual(spark, sf), 2000, 1995, 1998), "value")


@query("trend_slope", f"SELECT i_lat, i_lon, disp({_SLOPE}, 6) + 0.0::DOUBLE AS value FROM annual WHERE year >= 1996 GROUP BY 1, 2")
def _(spark, sf):
    return rounded(D.trend_slope(V.annual(spark, sf), start=1996), "value")


@query("trend_slope_per_decade", """WITH x AS (SELECT avg(year) AS x0 FROM (SELECT DISTINCT year FROM annual)),
  m AS (SELECT i_lat, i_lon, avg(value) AS my FROM annual GROUP BY 1, 2),
  s AS (SELECT a.i_lat, a.i_lon, sum((year - x0) * (value - my)) AS num,
     sum(CASE WHEN value IS NOT NULL THEN (year - x0) * (year - x0) END) AS den, count(value) AS n
    FROM annual a JOIN m USING (i_lat, i_lon), x GROUP BY 1, 2)
  SELECT i_lat, i_lon, CASE WHEN n >= 2 AND den > 0 THEN disp(10 * num / den, 6) + 0.0::DOUBLE END AS value FROM s""")
def _(spark, sf):
    return rounded(D.trend_slope_per_decade(V.annual(spark, sf)), "value")


@query("monthly_climatology_anomaly", """SELECT i_lat, i_lon, disp(max(value) FILTER (WHERE year(t) = 2000)
  - avg(value) FILTER (WHERE year(t) BETWEEN 1995 AND 1999), 6) + 0.0::DOUBLE AS value
  FROM obs_monthly WHERE month(t) = 6 GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(D.monthly_climatology_anomaly(V.obs_monthly(spark, sf), 2000, 6, 1995, 1999, strict=False), "value")


@query("mean_over_indices", """SELECT i_lat, i_lon, disp(avg(value), 6) AS value FROM obs_gappy
  WHERE day(t) IN (1, 15) AND year(t) >= 1997 GROUP BY 1, 2""")
def _(spark, sf):
    obs = V.obs_gappy(spark, sf)
    axis = obs.select("t").distinct()
    keep = F.dayofmonth("t").isin(1, 15) & (F.year("t") >= 1997)
    return rounded(D.mean_over_positions(obs, axis, keep, strict=False), "value")


_ON_MONTHLY_GRID = """SELECT CAST(i_lat % 6 AS INTEGER) AS i_lat, CAST(i_lon % 10 AS INTEGER) AS i_lon, t, value FROM obs_gappy"""
V.SQL_VIEWS["daily_small"] = _ON_MONTHLY_GRID


def daily_small(spark, sf):
    """Daily observations folded onto the cells of the monthly view."""
    return V.obs_gappy(spark, sf).select(
        (F.col("i_lat") % 6).cast("int").alias("i_lat"), (F.col("i_lon") % 10).cast("int").alias("i_lon"), "t", "value"
    )


@query("daily_window_anomaly", """WITH a AS (SELECT i_lat, i_lon, avg(value) AS v FROM daily_small
    WHERE t BETWEEN DATE '2000-06-01' AND DATE '2000-06-30' GROUP BY 1, 2),
  b AS (SELECT i_lat, i_lon, avg(value) AS v FROM obs_monthly WHERE month(t) = 6 AND year(t) BETWEEN 1996 AND 1999 GROUP BY 1, 2)
  SELECT i_lat, i_lon, disp(a.v - b.v, 6) + 0.0::DOUBLE AS value FROM a JOIN b USING (i_lat, i_lon)""")
def _(spark, sf):
    out = D.daily_window_anomaly(
        daily_small(spark, sf), V.obs_monthly(spark, sf),
        cal.in_window(F.col("t"), "2000-06-01", "2000-06-30"),
        cal.in_climatology(F.year("t"), F.month("t"), 6, 1996, 1999), strict=False,
    )
    return rounded(out, "value")


@query("blended_preindustrial_anomaly", """WITH e AS (SELECT i_lat, i_lon, year, avg(value) AS value FROM models GROUP BY 1, 2, 3),
  o AS (SELECT i_lat, i_lon, avg(value) FILTER (WHERE year BETWEEN 1998 AND 2000) - avg(value) FILTER (WHERE year BETWEEN 1995 AND 1996) AS b
    FROM e GROUP BY 1, 2),
  c AS (SELECT i_lat, i_lon, avg(value) FILTER (WHERE year BETWEEN 1999 AND 2001) - avg(value) FILTER (WHERE year BETWEEN 1995 AND 1997) AS a
    FROM annual GROUP BY 1, 2)
  SELECT i_lat, i_lon, disp(a + b, 6) + 0.0::DOUBLE AS value FROM c JOIN o USING (i_lat, i_lon)""")
def _(spark, sf):
    offset = R.multi_model_offset(V.models(spark, sf), (1995, 1996), (1998, 2000))
    out = D.blended_preindustrial_anomaly(V.annual(spark, sf), offset, (1999, 2001), (1995, 1997))
    return rounded(out, "value")


@query("derive_metrics", """WITH a AS (SELECT i_lat, i_lon, disp(avg(value), 6) AS value FROM annual WHERE year BETWEEN 1999 AND 2001 GROUP BY 1, 2),
  b AS (SELECT i_lat, i_lon, disp(avg(value), 6) AS value FROM annual WHERE year BETWEEN 1995 AND 1997 GROUP BY 1, 2)
  SELECT 'recent' AS metric_id, * FROM a UNION ALL SELECT 'early', * FROM b
  UNION ALL SELECT 'change', i_lat, i_lon, disp(a.value - b.value, 6) + 0.0::DOUBLE FROM a JOIN b USING (i_lat, i_lon)""")
def _(spark, sf):
    mean = lambda s, e: lambda a: rounded(D.mean_between(a, s, e, strict=False), "value")
    out, _skipped = D.derive_metrics(
        {"annual": V.annual(spark, sf)},
        {
            "change": (["recent", "early"], D.difference),
            "recent": (["annual"], mean(1999, 2001)),
            "early": (["annual"], mean(1995, 1997)),
            "never": (["absent"], lambda x: x),
        },
    )
    return rounded(out, "value")


V.SQL_VIEWS["monthly_pos"] = """SELECT i_lat, i_lon, t, value,
  CAST(row_number() OVER (PARTITION BY i_lat, i_lon ORDER BY t) AS INTEGER) AS pos FROM obs_monthly"""


def monthly_pos(spark, sf):
    """Monthly series with axis positions (a cell has at most one row per month)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*CELL).orderBy("t")
    return V.obs_monthly(spark, sf).withColumn("pos", F.row_number().over(w))


@query("rolling_mean_centered", """SELECT i_lat, i_lon, pos, CASE WHEN count(*) OVER w = 5 THEN disp(avg(value) OVER w, 6) END AS rolling
  FROM monthly_pos WINDOW w AS (PARTITION BY i_lat, i_lon ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, sf):
    out = D.rolling_mean_centered(monthly_pos(spark, sf), CELL, window=4)
    return rounded(out.select(*CELL, "pos", "rolling"), "rolling")


@query("rolling_mean_min_periods", """WITH g AS (SELECT *, CASE WHEN pos % 4 = 0 THEN value END AS mean FROM monthly_pos)
  SELECT i_lat, i_lon, pos, disp(coalesce(mean, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END), 6) AS rolling
  FROM g WINDOW w AS (PARTITION BY i_lat, i_lon ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, sf):
    s = monthly_pos(spark, sf).withColumn("mean", F.when(F.col("pos") % 4 == 0, F.col("value")))
    out = D.rolling_mean_min_periods(s, CELL, window=5)
    return rounded(out.select(*CELL, "pos", "rolling"), "rolling")


@query("linear_trend_line", f"""WITH f AS (SELECT i_lat, i_lon, {_SLOPE} AS b, {_ICPT} AS a, max(year) AS last FROM annual GROUP BY 1, 2),
  r AS (SELECT i_lat, i_lon, year FROM annual UNION ALL SELECT i_lat, i_lon, 2010 FROM f WHERE last < 2010)
  SELECT i_lat, i_lon, CAST(year AS INTEGER) AS year, disp(a + b * year, 4) + 0.0::DOUBLE AS trend FROM r JOIN f USING (i_lat, i_lon)""")
def _(spark, sf):
    return rounded(D.linear_trend_line(V.annual(spark, sf), CELL, x="year", extend_to=2010), "trend", digits=4)


@query("series_extrema", """SELECT i_lat, i_lon, min(value) AS min_value,
  arg_min(year, value * 10000 + year) AS min_x, max(value) AS max_value, arg_max(year, value * 10000 - year) AS max_x
  FROM annual WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return D.series_extrema(V.annual(spark, sf), CELL)


@query("chart_trend", f"""WITH s AS (SELECT i_lat, i_lon, year, disp(value, 3) AS value FROM annual WHERE value IS NOT NULL),
  f AS (SELECT i_lat, i_lon, {_SLOPE} AS b, {_ICPT} AS a FROM s GROUP BY 1, 2)
  SELECT i_lat, i_lon, year, 'series' AS role, value FROM s
  UNION ALL SELECT i_lat, i_lon, year, 'trend', disp(a + b * year, 3) + 0.0::DOUBLE FROM s JOIN f USING (i_lat, i_lon) WHERE b IS NOT NULL""")
def _(spark, sf):
    s = V.annual(spark, sf).where("value IS NOT NULL").withColumn("value", display_round(F.col("value")))
    return D.chart_trend(s, CELL).withColumn("value", F.col("value") + 0.0)


@query("trend_rate_label", f"""WITH x AS (SELECT i_lat, i_lon, epoch(make_date(year, 12, 31)) AS x, value FROM annual),
  f AS (SELECT i_lat, i_lon, {_SLOPE.replace('year', 'x')} AS b, {_ICPT.replace('year', 'x')} AS a FROM x GROUP BY 1, 2),
  l AS (SELECT i_lat, i_lon, x, a + b * x AS trend FROM x JOIN f USING (i_lat, i_lon) WHERE b IS NOT NULL),
  e AS (SELECT i_lat, i_lon, min(x) AS x0, max(x) AS x1, arg_min(trend, x) AS y0, arg_max(trend, x) AS y1 FROM l GROUP BY 1, 2)
  SELECT i_lat, i_lon, CASE WHEN x1 > x0 THEN disp((y1 - y0) / ((x1 - x0) / (365.2425::DOUBLE * 86400)) * 10, 4) + 0.0::DOUBLE END AS per_decade FROM e""")
def _(spark, sf):
    s = V.annual(spark, sf).select(*CELL, D.label_to_x(F.col("year").cast("string")).alias("x"), "value")
    line = D.linear_trend_line(s, CELL, x="x")
    return rounded(D.trend_rate_label(line, CELL), "per_decade", digits=4)
