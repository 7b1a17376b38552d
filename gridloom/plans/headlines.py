"""Headlines and fact rows over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as TX
from gridloom.operators import headlines as I, points as H, reducers as R, regions as RG
from gridloom.plans import views as V
from gridloom.plans.cells import _ICPT, _SLOPE
from gridloom.plans.queries import annual_wide, place_annual, place_monthly, region_values
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded

K = ["geonameid"]
_L = "WITH l AS (SELECT *, max(year) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY geonameid) AS latest FROM place_annual)"
_WIN = """SELECT geonameid, max(latest) AS latest_year, CASE WHEN count(value) FILTER (WHERE year > latest - 5) >= 4 AND count(value) FILTER (WHERE year BETWEEN 1995 AND 1997) >= 2
  THEN avg(value) FILTER (WHERE year > latest - 5) - avg(value) FILTER (WHERE year BETWEEN 1995 AND 1997) END AS value FROM l GROUP BY 1"""
_GATES = {"start": 1995, "end": 1997, "need_recent": 4, "need_base": 2}


@query("recent_vs_window", f"{_L} SELECT geonameid, latest_year, disp(value, 6) + 0.0::DOUBLE AS value FROM ({_WIN})")
def _(spark, sf):
    return rounded(I.recent_vs_window(place_annual(spark, sf), K, **_GATES), "value")


V.SQL_VIEWS["place_offset"] = """SELECT geonameid, year, CASE WHEN (geonameid + year) % 3 <> 0 THEN value / 8 END AS value FROM place_annual"""


def place_offset(spark, sf):
    keep = (F.col("geonameid") + F.col("year")) % 3 != 0
    return place_annual(spark, sf).select("geonameid", "year", F.when(keep, F.col("value") / 8).alias("value"))


@query("recent_vs_preindustrial", f"""{_L}, w AS ({_WIN}), o AS (SELECT geonameid, arg_max(value, year) AS off FROM place_offset WHERE value IS NOT NULL GROUP BY 1)
  SELECT geonameid, latest_year, disp(value + off, 6) + 0.0::DOUBLE AS value FROM w LEFT JOIN o USING (geonameid)""")
def _(spark, sf):
    return rounded(I.recent_vs_preindustrial(place_annual(spark, sf), place_offset(spark, sf), K, **_GATES), "value")


@query("recent_vs_year", f"""{_L} SELECT geonameid, max(latest) AS latest_year, disp(CASE WHEN count(value) FILTER (WHERE year > latest - 5) >= 4
  THEN avg(value) FILTER (WHERE year > latest - 5) - max(value) FILTER (WHERE year = 1996) END, 6) + 0.0::DOUBLE AS value FROM l GROUP BY 1""")
def _(spark, sf):
    return rounded(I.recent_vs_year(place_annual(spark, sf), K, 1996), "value")


@query("trend_at_last", f"""WITH f AS (SELECT geonameid, {_SLOPE} AS b, {_ICPT} AS a, max(year) AS last_year, bool_or(year = 1997) AS on_axis FROM place_annual GROUP BY 1)
  SELECT geonameid, last_year, disp(a + b * last_year, 1) + 0.0::DOUBLE AS value,
    CASE WHEN b IS NOT NULL AND on_axis THEN disp(a + b * 1997, 1) + 0.0::DOUBLE END AS baseline_value FROM f""")
def _(spark, sf):
    out = I.trend_at_last(place_annual(spark, sf), K, 1997)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("value", "baseline_value")})


V.SQL_VIEWS["stress"] = """SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value >= 8) END AS s,
  CASE WHEN count(value) > 0 THEN count(*) FILTER (WHERE value >= 4 AND value < 8) END AS m FROM (SELECT * REPLACE (value / 4 AS value) FROM obs_gappy) GROUP BY 1, 2, 3"""


@query("worst_stress_year", """SELECT i_lat, i_lon, count(s) > 0 AS has_data, CASE WHEN count(s) > 0 THEN arg_max(year, (coalesce(s, 0) + coalesce(m, 0)) * 10000 - year) FILTER (WHERE s IS NOT NULL OR m IS NOT NULL) END AS worst_year,
  CASE WHEN count(s) > 0 THEN CAST(max(coalesce(s, 0) + coalesce(m, 0)) AS DOUBLE) END AS worst_days FROM stress GROUP BY 1, 2""")
def _(spark, sf):
    obs = V.obs_gappy(spark, sf).withColumn("value", F.col("value") / 4)
    y = R.heat_stress_years(obs)
    pick = lambda c: y.select("i_lat", "i_lon", "year", F.col(c).alias("value"))
    return I.worst_stress_year(pick("severe_days"), pick("moderate_days"), ["i_lat", "i_lon"])


V.SQL_VIEWS["globe_series"] = "SELECT region_key, year, mean AS value FROM region_values WHERE region_key = 'globe'"


def globe_series(spark, sf):
    from gridloom.operators.regions import globe_aggregates

    return globe_aggregates(V.annual(spark, sf), V.TOY).select("region_key", "year", F.col("mean").alias("value"))


@query("global_recent_delta", """SELECT region_key, max(year) AS latest_year, disp(avg(value) FILTER (WHERE year > (SELECT max(year) FROM globe_series) - 5)
  - max(value) FILTER (WHERE year = 1995), 2) + 0.0::DOUBLE AS value FROM globe_series GROUP BY 1""")
def _(spark, sf):
    return I.global_recent_delta(globe_series(spark, sf), 1995).withColumn("value", F.col("value") + 0.0)


@query("global_trend", f"""WITH f AS (SELECT region_key, {_SLOPE} AS b, {_ICPT} AS a, max(year) AS last_year FROM globe_series GROUP BY 1)
  SELECT region_key, last_year, disp(a + b * last_year, 1) AS value, disp(a + b * 1996, 1) AS baseline_value FROM f""")
def _(spark, sf):
    return I.trend_at_last(globe_series(spark, sf), ["region_key"], 1996)


@query("global_preindustrial", "SELECT region_key, year AS period, disp(value, 2) AS value FROM globe_series WHERE year = (SELECT max(year) FROM globe_series)")
def _(spark, sf):
    return I.global_last_value(globe_series(spark, sf))


_ENDS = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY geonameid ORDER BY year) AS p, row_number() OVER (PARTITION BY geonameid ORDER BY year DESC) AS b FROM place_annual),
  e AS (SELECT geonameid, avg(value) FILTER (WHERE p <= {n}) AS first_mean, avg(value) FILTER (WHERE b <= {n}) AS last_mean FROM p GROUP BY 1)"""


@query("first_last_window_mean", f"{_ENDS.format(n=3)} SELECT geonameid, disp(first_mean, 6) AS first_mean, disp(last_mean, 6) AS last_mean FROM e")
def _(spark, sf):
    return rounded(I.first_last_mean(place_annual(spark, sf), K, 3), "first_mean", "last_mean")


for _ext, _dir in [("max", "DESC"), ("min", "ASC")]:
    query(f"typical_extreme_month_{_ext}", f"""WITH m AS (SELECT geonameid, month, avg(value) AS v FROM place_monthly WHERE year > (SELECT max(year) FROM place_monthly) - 4 AND value IS NOT NULL GROUP BY 1, 2)
      SELECT geonameid, month, disp(v, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY geonameid ORDER BY v {_dir}, month) = 1""")(
        lambda spark, sf, e=_ext: rounded(I.typical_extreme_month(place_monthly(spark, sf), K, e, recent_years=4), "value")
    )


@query("seasonal_yearly_means", """SELECT geonameid, year, disp(avg(value), 6) AS value FROM place_monthly
  WHERE value IS NOT NULL AND ((lat >= 0 AND month IN (12, 1, 2)) OR (lat < 0 AND month IN (6, 7, 8))) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(I.seasonal_yearly_means(place_monthly(spark, sf), K), "value")


@query("local_vs_global_ratio", f"""WITH l AS (SELECT geonameid, {_SLOPE} * 10 AS per_decade FROM place_annual GROUP BY 1), g AS (SELECT {_SLOPE} * 10 AS global_rate FROM globe_series),
  r AS (SELECT *, CASE WHEN global_rate <> 0 THEN round(per_decade / global_rate, 9) END AS ratio FROM l, g WHERE per_decade IS NOT NULL)
  SELECT geonameid, disp(per_decade, 6) + 0.0::DOUBLE AS per_decade, disp(global_rate, 6) AS global_rate, disp(ratio, 6) + 0.0::DOUBLE AS ratio,
    CASE WHEN ratio >= 1.15 THEN 'faster' WHEN ratio <= 0.85 THEN 'slower' ELSE 'in step' END AS verdict FROM r""")
def _(spark, sf):
    local = I.trend_per_decade(place_annual(spark, sf), K)
    globe = I.trend_per_decade(globe_series(spark, sf), ["region_key"])
    return rounded(I.local_vs_global(local, globe), "per_decade", "global_rate", "ratio")


@query("rainfall_change_pct", f"""{_ENDS.format(n=3)}, c AS (SELECT *, CASE WHEN first_mean <> 0 THEN round((last_mean - first_mean) / first_mean * 100, 9) ELSE 0 END AS change_pct FROM e
    WHERE first_mean IS NOT NULL AND last_mean IS NOT NULL)
  SELECT geonameid, disp(first_mean, 6) AS first_mean, disp(last_mean, 6) AS last_mean, disp(change_pct, 6) + 0.0::DOUBLE AS change_pct,
    CASE WHEN change_pct >= 5 THEN 'increased' WHEN change_pct <= -5 THEN 'decreased' ELSE 'stable' END AS verdict FROM c""")
def _(spark, sf):
    return rounded(I.rainfall_change(place_annual(spark, sf), K, 3), "first_mean", "last_mean", "change_pct")


for _ext, _dir in [("max", "DESC"), ("min", "ASC")]:
    query(f"record_value_{_ext}", f"""SELECT geonameid, value, strftime(t, '%Y-%m') AS label FROM place_monthly WHERE value IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY geonameid ORDER BY value {_dir}, t) = 1""")(
        lambda spark, sf, e=_ext: I.record_value(place_monthly(spark, sf), K, e)
    )


def _both_sql(x: str, nd: int, delta: bool) -> str:
    c = f"disp({x}, {nd})"
    f = f"disp({c} * 9 / 5{'' if delta else ' + 32'}, {nd})"
    return f"'[[' || CAST({c} + 0.0::DOUBLE AS VARCHAR) || '°C|' || CAST({f} + 0.0::DOUBLE AS VARCHAR) || '°F]]'"


@query("fact_text", f"""{_ENDS.format(n=5)}, r AS (SELECT geonameid, label, {_SLOPE} * 10 AS d, min(year) AS since FROM place_annual GROUP BY 1, 2),
  t AS (SELECT geonameid, '**' || label || '** has changed at ' || {_both_sql('d', 2, True)} || ' per decade since ' || since || ', from ' || {_both_sql('first_mean', 1, False)} || ' to ' || {_both_sql('last_mean', 1, False)} || '.' AS fact
    FROM r JOIN e USING (geonameid) WHERE d IS NOT NULL AND first_mean IS NOT NULL AND last_mean IS NOT NULL)
  SELECT geonameid, fact, regexp_replace(fact, '\\[\\[([^|\\]]*)\\|([^\\]]*)\\]\\]', '\\2', 'g') AS fahrenheit FROM t""")
def _(spark, sf):
    facts = I.temperature_fact(place_annual(spark, sf), ["geonameid", "label"], "label")
    return facts.select("geonameid", "fact", TX.pick_unit(F.col("fact"), "F").alias("fahrenheit"))


_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in TX.MONTH_NAMES) + "]"
_N = ["geonameid", "name"]


def _named(rows, spark, sf):
    return rows.join(V.places(spark, sf).select("geonameid", F.col("label").alias("name")), "geonameid")


def _whole_sql(x: str) -> str:
    return f"CAST(CAST(disp({x}, 0) AS BIGINT) AS VARCHAR)"


for _ext, _dir, _word in [("max", "DESC", "hot"), ("min", "ASC", "cold")]:
    query(f"fact_text_{_ext}_month", f"""WITH m AS (SELECT geonameid, month, avg(value) AS v FROM place_monthly WHERE year > (SELECT max(year) FROM place_monthly) - 4 AND value IS NOT NULL GROUP BY 1, 2),
      u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY geonameid ORDER BY v {_dir}, month) = 1),
      r AS (SELECT geonameid, value AS record, t FROM place_monthly WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY geonameid ORDER BY value {_dir}, t) = 1)
      SELECT geonameid, 'In **' || label || '** {_word} months reach ' || {_both_sql('v', 1, False)} || ', mostly in ' || {_MONTH_LIST}[u.month] || '; the record is ' || {_both_sql('record', 1, False)}
        || ' in ' || {_MONTH_LIST}[CAST(month(t) AS INTEGER)] || ' ' || CAST(year(t) AS VARCHAR) || '.' AS fact FROM u JOIN r USING (geonameid) JOIN places USING (geonameid)""")(
        lambda spark, sf, e=_ext: I.extreme_month_fact(_named(place_monthly(spark, sf), spark, sf), _N, "name", e, 4).drop("name")
    )


@query("fact_text_winter", f"""WITH y AS (SELECT geonameid, lat >= 0 AS north, year, avg(value) AS value FROM place_monthly
    WHERE value IS NOT NULL AND ((lat >= 0 AND month IN (12, 1, 2)) OR (lat < 0 AND month IN (6, 7, 8))) GROUP BY 1, 2, 3),
  p AS (SELECT *, row_number() OVER (PARTITION BY geonameid ORDER BY year) AS f, row_number() OVER (PARTITION BY geonameid ORDER BY year DESC) AS b FROM y),
  e AS (SELECT geonameid, any_value(north) AS north, avg(value) FILTER (WHERE f <= 2) AS first_mean, avg(value) FILTER (WHERE b <= 2) AS last_mean,
    {_SLOPE} * 10 AS d, min(year) AS since, count(*) AS n FROM p GROUP BY 1)
  SELECT geonameid, 'Winters (' || CASE WHEN north THEN 'December–February' ELSE 'June–August' END || ') of **' || label || '** have ' || CASE WHEN round(abs(d), 9) < 0.05 THEN 'hardly changed'
    ELSE CASE WHEN d > 0 THEN 'warmed by ' ELSE 'cooled by ' END || {_both_sql('abs(d)', 2, True)} || ' per decade' END || ' since ' || since || ': '
    || {_both_sql('first_mean', 1, False)} || ' then, ' || {_both_sql('last_mean', 1, False)} || ' now.' AS fact FROM e JOIN places USING (geonameid) WHERE n >= 2 AND d IS NOT NULL""")
def _(spark, sf):
    return I.winter_fact(_named(place_monthly(spark, sf), spark, sf), _N, "name", n=2).drop("name")


@query("fact_text_ratio", f"""WITH l AS (SELECT geonameid, label, {_SLOPE} * 10 AS d FROM place_annual GROUP BY 1, 2), g AS (SELECT {_SLOPE} * 10 AS g FROM globe_series),
  r AS (SELECT *, CASE WHEN g <> 0 THEN round(d / g, 9) END AS ratio FROM l, g WHERE d IS NOT NULL AND g IS NOT NULL)
  SELECT geonameid, '**' || label || '** changes by ' || {_both_sql('d', 2, True)} || ' per decade, ' || CASE WHEN ratio >= 1.15 THEN CAST(disp(ratio, 1) + 0.0::DOUBLE AS VARCHAR) || ' times'
    WHEN ratio <= 0.85 THEN 'less than' ELSE 'about' END || ' the global ' || {_both_sql('g', 2, True)} || '.' AS fact FROM r""")
def _(spark, sf):
    local = I.trend_per_decade(place_annual(spark, sf), ["geonameid", "label"])
    globe = I.trend_per_decade(globe_series(spark, sf), ["region_key"])
    return I.ratio_fact(local, globe, ["geonameid", "label"], "label").drop("label")


@query("fact_text_rainfall", f"""{_ENDS.format(n=3)}, m AS (SELECT geonameid, label, avg(value) AS mean FROM place_annual GROUP BY 1, 2),
  c AS (SELECT *, CASE WHEN first_mean <> 0 THEN round((last_mean - first_mean) / first_mean * 100, 9) ELSE 0 END AS pct FROM e JOIN m USING (geonameid)
    WHERE first_mean IS NOT NULL AND last_mean IS NOT NULL)
  SELECT geonameid, '**' || label || '** gets ' || {_whole_sql('mean')} || ' mm a year; totals ' || CASE WHEN pct >= 5 THEN 'grew by ' || {_whole_sql('abs(pct)')} || ' %'
    WHEN pct <= -5 THEN 'shrank by ' || {_whole_sql('abs(pct)')} || ' %' ELSE 'stayed about the same' END || ', from ' || {_whole_sql('first_mean')} || ' to ' || {_whole_sql('last_mean')} || ' mm.' AS fact FROM c""")
def _(spark, sf):
    return I.rainfall_fact(place_annual(spark, sf), ["geonameid", "label"], "label", 3).drop("label")


@query("fact_text_rank", f"""WITH d AS (SELECT point_id, rank, value, greatest(abs(r.lat - p.lat), abs(r.lon - p.lon)) AS d FROM points p JOIN ranked_mean r
    ON r.lat BETWEEN p.lat - 0.35 AND p.lat + 0.35 AND r.lon BETWEEN p.lon - 0.35 AND p.lon + 0.35),
  b AS (SELECT *, (SELECT count(*) FROM ranked_mean) AS total FROM d WHERE d < 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, rank) = 1)
  SELECT point_id, 'Number ' || rank || ' of ' || total || ' cities by warmth at ' || {_both_sql('value', 1, False)} || ', above ' || {_whole_sql('(total - rank) / total * 100')} || ' % of them.' AS fact FROM b""")
def _(spark, sf):
    ranking = RG.city_rankings(V.places(spark, sf), annual_wide(spark, sf), V.RASTER, "mean")
    return I.rank_fact(H.rank_of_points(V.points(spark, sf), ranking), "point_id")
