"""Regional aggregates and rankings over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.operators import percell as D, reducers as R, regions as RG
from gridloom.plans import views as V
from gridloom.plans.masks import country_frac, ocean_frac
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded

_COS = "cos(radians(90 - (i_lat + 0.5::DOUBLE)))"
_SLUG = "replace(replace(lower(strip_accents({})), ' ', '_'), '-', '_')"

V.SQL_VIEWS["weights"] = f"""SELECT 'country:' || code AS region_key, 'country' AS region_type, name AS region_name, i_lat, i_lon, frac
    FROM country_frac JOIN countries USING (id) WHERE code IS NOT NULL
  UNION ALL SELECT 'continent:' || replace(continent, ' ', '_'), 'continent', array_to_string(list_transform(string_split(lower(continent), ' '), lambda w: upper(w[1]) || w[2:]), ' '), i_lat, i_lon, least(sum(frac), 1)
    FROM country_frac JOIN countries USING (id) JOIN continent_country ON country_code = code GROUP BY continent, i_lat, i_lon
  UNION ALL SELECT 'ocean:' || {_SLUG.format("coalesce(name, 'ocean_' || id)")}, 'ocean', coalesce(name, 'ocean_' || id), i_lat, i_lon, frac
    FROM ocean_frac LEFT JOIN oceans USING (id)"""


def weights(spark, sf):
    return RG.region_weights(
        country_frac(spark, sf), V.countries(spark, sf), V.continent_country(spark, sf),
        ocean_frac(spark, sf), V.oceans(spark, sf),
    )


V.SQL_VIEWS["region_values"] = f"""SELECT region_key, year, disp(sum(value * frac * {_COS}) / sum(CASE WHEN value IS NOT NULL THEN frac * {_COS} END), 4) AS mean,
    round(min(value), 4) AS min, round(max(value), 4) AS max
  FROM annual JOIN weights USING (i_lat, i_lon) GROUP BY 1, 2
  UNION ALL SELECT 'globe', year, disp(sum(value * {_COS}) / sum(CASE WHEN value IS NOT NULL THEN {_COS} END), 4),
    round(min(value), 4), round(max(value), 4) FROM annual GROUP BY 2"""


def region_values(spark, sf):
    return RG.region_aggregates(V.annual(spark, sf), weights(spark, sf), V.TOY)


@query("area_weight", f"SELECT i_lat, i_lon, round({_COS}, 9) AS w FROM annual GROUP BY ALL")
def _(spark, sf):
    from gridloom.grid import area_weight

    return V.annual(spark, sf).select(*CELL).distinct().withColumn("w", F.round(area_weight(F.col("i_lat"), V.TOY), 9))


@query("region_weights", "SELECT region_key, region_type, region_name, i_lat, i_lon, disp(frac, 6) AS frac FROM weights")
def _(spark, sf):
    return rounded(weights(spark, sf), "frac")


for _name in ("mean", "min", "max"):
    query(f"region_{_name}", f"SELECT region_key, year, {_name} AS value FROM region_values")(
        lambda spark, sf, n=_name: region_values(spark, sf).select("region_key", "year", F.col(n).alias("value"))
    )


@query("region_cell_count", """SELECT region_key, count(*) AS cell_count FROM weights WHERE frac > 0 GROUP BY 1
  UNION ALL SELECT 'globe', CAST(64800 AS BIGINT)""")
def _(spark, sf):
    return RG.region_cell_counts(weights(spark, sf), V.TOY)


@query("globe_mean_masked", """SELECT region_key, year, mean, (SELECT count(*) FROM (SELECT 1 FROM annual GROUP BY i_lat, i_lon HAVING count(value) > 0)) AS cell_count
  FROM region_values WHERE region_key = 'globe'""")
def _(spark, sf):
    return RG.globe_mean_masked(V.annual(spark, sf), V.TOY)


@query("global_mean_trend", f"""WITH m AS (SELECT i_lat, i_lon, date_trunc('month', t) AS t, avg(value) AS value FROM obs_daily GROUP BY 1, 2, 3),
  a AS (SELECT i_lat, i_lon, year(t) AS year, avg(value) AS value FROM m GROUP BY 1, 2, 3),
  g AS (SELECT year, disp(sum(value * {_COS}) / sum(CASE WHEN value IS NOT NULL THEN {_COS} END), 4) AS v FROM a GROUP BY 1)
  SELECT count(*) AS years, disp(avg(v), 4) AS mean, disp(regr_slope(v, year), 6) + 0.0::DOUBLE AS slope_per_year FROM g""")
def _(spark, sf):
    annual = R.annual_mean_from_daily(V.obs_daily(spark, sf))
    globe = RG.globe_aggregates(annual, V.TOY).withColumnRenamed("mean", "value")
    fit = globe.agg(
        F.count(F.lit(1)).alias("years"), F.avg("value").alias("mean"), D.slope().alias("slope_per_year")
    )
    return rounded(rounded(fit, "mean", digits=4), "slope_per_year")


@query("region_key", f"""SELECT c_custkey, 'country:' || chr(CAST(65 + c_nationkey AS INTEGER)) || 'X' AS country,
  'continent:' || replace(r_name, ' ', '_') AS continent, 'ocean:' || replace(replace(regexp_replace(lower(strip_accents('Mer d’Été ' || c_mktsegment || '-' || n_name)), '[^ -~]', '', 'g'), ' ', '_'), '-', '_') AS ocean
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(spark, sf):
    c = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(V.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    sea = F.concat(F.lit("Mer d’Été "), "c_mktsegment", F.lit("-"), "n_name")
    return c.select(
        "c_custkey", RG.country_key(F.concat(F.char(F.lit(65) + F.col("c_nationkey")), F.lit("X"))).alias("country"),
        RG.continent_key(F.col("r_name")).alias("continent"), RG.ocean_key(sea).alias("ocean"),
    )


@query("bbox_mean", f"""WITH a AS (SELECT i_lat, i_lon, value, {_COS} AS w FROM annual WHERE value IS NOT NULL
    AND 90 - (i_lat + 0.5) BETWEEN -50 AND 60 AND -180 + (i_lon + 0.5) BETWEEN -120 AND 100)
  SELECT disp(sum(value * w) / sum(w), 6) AS mean, max(value) AS peak,
   (SELECT 90 - (i_lat + 0.5::DOUBLE) FROM a ORDER BY value DESC, i_lat, i_lon LIMIT 1) AS peak_lat,
   (SELECT -180 + (i_lon + 0.5::DOUBLE) FROM a ORDER BY value DESC, i_lat, i_lon LIMIT 1) AS peak_lon FROM a""")
def _(spark, sf):
    return rounded(RG.bbox_mean(V.annual(spark, sf), V.TOY, west=-120, south=-50, east=100, north=60), "mean")


@query("dhw_fraction_days", """WITH d AS (SELECT t, count(value) AS valid, count(*) FILTER (WHERE value >= 8) AS sev, count(*) FILTER (WHERE value >= 4) AS mod
    FROM dhw_daily GROUP BY 1), p AS (SELECT *, unnest([10.0::DOUBLE, 25.0::DOUBLE, 50.0::DOUBLE]) AS threshold FROM d),
  c AS (SELECT CAST(year(t) AS INTEGER) AS year, threshold, valid > 0 AND sev / valid >= threshold / 100 AS s, valid > 0 AND mod / valid >= threshold / 100 AS m FROM p),
  k AS (SELECT year, threshold, count(*) FILTER (WHERE NOT s AND NOT m) AS no_risk_days, count(*) FILTER (WHERE NOT s AND m) AS moderate_days,
    count(*) FILTER (WHERE s) AS severe_days FROM c GROUP BY 1, 2)
  SELECT CAST(y AS INTEGER) AS year, s.threshold, no_risk_days, moderate_days, severe_days
  FROM (SELECT y, unnest([10.0::DOUBLE, 25.0::DOUBLE, 50.0::DOUBLE]) AS threshold FROM range(1994, 2003) r(y)) s LEFT JOIN k ON k.year = y AND k.threshold = s.threshold""")
def _(spark, sf):
    return RG.fraction_days(V.dhw_daily(spark, sf), [10, 25, 50], (1994, 2002))


@query("dhw_global_max_days", """WITH d AS (SELECT t, max(value) AS m FROM dhw_daily GROUP BY 1)
  SELECT CAST(year(t) AS INTEGER) AS year, count(*) FILTER (WHERE m < 4) AS no_risk_days,
    count(*) FILTER (WHERE m >= 4 AND m < 8) AS moderate_days, count(*) FILTER (WHERE m >= 8) AS severe_days FROM d GROUP BY 1""")
def _(spark, sf):
    return RG.global_max_days(V.dhw_daily(spark, sf))


V.SQL_VIEWS["city_keys"] = f"""SELECT * FROM places WHERE population >= 1000
  QUALIFY row_number() OVER (PARTITION BY round_even(lat * 4, 0), round_even(lon * 4, 0) ORDER BY population DESC, geonameid) = 1"""
_SLOPE10 = "CASE WHEN count(DISTINCT CASE WHEN value IS NOT NULL THEN year END) >= 2 THEN regr_slope(value, year) * 10 END"
for _agg, _expr in [("mean", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("trend_slope", _SLOPE10)]:
    V.SQL_VIEWS[f"ranked_{_agg}"] = f"""SELECT c.geonameid, c.label AS name, c.country_code AS country, c.lat, c.lon, c.population, c.capital,
        disp(s.score, 4) AS value, row_number() OVER (ORDER BY round(s.score, 9) DESC, c.population DESC, c.geonameid) AS rank
      FROM (SELECT *, CAST(floor((90 - lat) / 10) AS INTEGER) AS i_lat, CAST(floor((lon + 180) / 10) AS INTEGER) AS i_lon FROM city_keys) c
      JOIN (SELECT i_lat, i_lon, {_expr} AS score FROM annual_wide GROUP BY 1, 2) s USING (i_lat, i_lon) WHERE s.score IS NOT NULL"""
    query(f"city_rankings_{_agg}", f"SELECT * FROM ranked_{_agg}")(
        lambda spark, sf, a=_agg: RG.city_rankings(V.places(spark, sf), annual_wide(spark, sf), V.RASTER, a)
    )

V.SQL_VIEWS["annual_wide"] = """SELECT CAST((a.i_lat + k.dy) % 18 AS INTEGER) AS i_lat, CAST((a.i_lon + k.dx) % 36 AS INTEGER) AS i_lon, year, max(value) AS value
  FROM annual a, (SELECT x * 7 AS dy, y * 11 AS dx FROM range(2) r(x), range(3) s(y)) k GROUP BY 1, 2, 3"""


def annual_wide(spark, sf):
    """The yearly series folded onto the ten-degree grid at six offsets, so that places fall on cells."""
    dy = F.explode(F.sequence(F.lit(0), F.lit(7), F.lit(7)))
    dx = F.explode(F.sequence(F.lit(0), F.lit(22), F.lit(11)))
    return V.annual(spark, sf).withColumn("dy", dy).withColumn("dx", dx).groupBy(
        ((F.col("i_lat") + F.col("dy")) % 18).alias("i_lat"), ((F.col("i_lon") + F.col("dx")) % 36).alias("i_lon"), "year"
    ).agg(F.max("value").alias("value"))
