"""Point, extreme, similarity and region queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid, cell_of
from gridloom.operators import points as H, regions as RG
from gridloom.operators.similar import similar_locations
from gridloom.plans import views as V
from gridloom.plans.regions import _SLOPE10, annual_wide, region_values, weights
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded
from gridloom.sources import series as S

#: Thirty-degree grid under the monthly view.
M30 = Grid("toy_30deg", 30.0, 6, 12, tile_size=4)

V.SQL_VIEWS["place_cells"] = """SELECT geonameid, label, lat, lon, population, CAST(floor((90 - lat) / 10) AS INTEGER) AS i_lat, CAST(floor((lon + 180) / 10) AS INTEGER) AS i_lon,
  CAST(floor((90 - lat) / 30) AS INTEGER) AS m_lat, CAST(floor((lon + 180) / 30) AS INTEGER) AS m_lon FROM places"""
V.SQL_VIEWS["wide_full"] = """SELECT c.i_lat, c.i_lon, y.year, a.value FROM (SELECT i_lat, i_lon FROM annual_wide GROUP BY 1, 2 HAVING count(value) > 0) c
  CROSS JOIN (SELECT DISTINCT year FROM annual_wide) y LEFT JOIN annual_wide a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.year = y.year"""
V.SQL_VIEWS["place_annual"] = "SELECT geonameid, lat, label, year, value FROM place_cells JOIN wide_full USING (i_lat, i_lon)"
V.SQL_VIEWS["month_full"] = """SELECT c.i_lat, c.i_lon, y.t, a.value FROM (SELECT DISTINCT i_lat, i_lon FROM obs_monthly) c
  CROSS JOIN (SELECT DISTINCT t FROM obs_monthly) y LEFT JOIN obs_monthly a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.t = y.t"""
V.SQL_VIEWS["place_monthly"] = """SELECT geonameid, lat, m.t, CAST(year(m.t) AS INTEGER) AS year, CAST(month(m.t) AS INTEGER) AS month, m.value
  FROM place_cells p JOIN month_full m ON m.i_lat = p.m_lat AND m.i_lon = p.m_lon"""


def wide_series(spark, sf):
    long = annual_wide(spark, sf).withColumn("t", F.make_date("year", F.lit(1), F.lit(1)))
    axis = S.build_axis("annual", long, "year")
    return S.pack_series(long, axis, "annual", V.RASTER), axis.drop("t")


def monthly_series(spark, sf):
    obs = V.obs_monthly(spark, sf)
    axis = S.build_axis("monthly", obs, "month")
    return S.pack_series(obs, axis, "monthly", M30), axis.drop("t")


def place_annual(spark, sf):
    series, axis = wide_series(spark, sf)
    places = V.places(spark, sf)
    rows = H.point_series(places, series, axis, V.RASTER, key="geonameid")
    return rows.select("geonameid", "year", "pos", "value").join(
        places.select("geonameid", "lat", F.col("label")), "geonameid"
    )


def place_monthly(spark, sf):
    series, axis = monthly_series(spark, sf)
    places = V.places(spark, sf)
    rows = H.point_series(places, series, axis, M30, key="geonameid")
    return rows.select("geonameid", "year", "month", "pos", F.col("label"), "value").join(
        places.select("geonameid", "lat"), "geonameid"
    )


@query("point_series", "SELECT geonameid, year, value FROM place_annual")
def _(spark, sf):
    return place_annual(spark, sf).select("geonameid", "year", "value")


@query("point_series_monthly", "SELECT geonameid, year, month, value FROM place_monthly")
def _(spark, sf):
    return place_monthly(spark, sf).select("geonameid", "year", "month", "value")


@query("series_axis_repair", """WITH v AS (SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey) AS vals, count(*) AS n FROM orders GROUP BY 1),
  a AS (SELECT *, CASE WHEN o_custkey % 4 = 0 THEN ['1999', '2000', '2001'] WHEN o_custkey % 4 = 1 THEN ['2000-01', '2000-02', '2000-03', '2000-04', '2000-05', '2000-06', '2000-07', '2000-08']
     WHEN o_custkey % 4 = 2 THEN ['2000-01'] ELSE CAST([] AS VARCHAR[]) END AS ax FROM v)
  SELECT o_custkey, array_to_string(CASE WHEN len(ax) = n THEN ax
    WHEN o_custkey % 4 = 0 THEN list_transform(generate_series(2001 - n + 1, 2001), lambda y: CAST(y AS VARCHAR))
    WHEN len(ax) > n THEN ax[len(ax) - n + 1:] ELSE list_transform(generate_series(1979, 1979 + n - 1), lambda y: CAST(y AS VARCHAR)) END, ',') AS labels FROM a""")
def _(spark, sf):
    k = F.col("o_custkey")
    months = F.array(*[F.lit(f"2000-0{m}") for m in range(1, 9)])
    ax = (
        F.when(k % 4 == 0, F.array(F.lit("1999"), F.lit("2000"), F.lit("2001")))
        .when(k % 4 == 1, months).when(k % 4 == 2, F.array(F.lit("2000-01")))
        .otherwise(F.array().cast("array<string>"))
    )
    # A customer's orders stand in for a short vector.
    vec = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("v"))
    return vec.select("o_custkey", F.array_join(H.repaired_labels(F.col("v"), ax), ",").alias("labels"))


@query("metric_series_yearly", """SELECT geonameid, year, disp(value, 3) AS value FROM place_annual WHERE year BETWEEN 1999 AND 2001""")
def _(spark, sf):
    out = H.metric_series(place_annual(spark, sf), ["geonameid"], monthly=False, start=2000, end=2000)
    return out.select("geonameid", "year", "value")


@query("metric_series_by_year", """SELECT geonameid, year, disp(avg(disp(value, 3)), 3) AS value FROM place_monthly
  WHERE month IN (12, 1, 2) AND year >= 1996 GROUP BY 1, 2""")
def _(spark, sf):
    return H.metric_series(place_monthly(spark, sf), ["geonameid"], True, start=1996, months=[12, 1, 2], by_year=True)


@query("collapse_long_series", """WITH n AS (SELECT geonameid, max(value) AS max_value, min(value) AS min_value,
     arg_max(pos, value * 1000 - pos) AS max_pos, arg_min(pos, value * 1000 + pos) AS min_pos
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY geonameid ORDER BY t) - 1 AS INTEGER) AS pos FROM place_monthly) GROUP BY 1)
  SELECT geonameid, year, disp(avg(value), 3) AS value, max_value, min_value, max_pos, min_pos FROM place_monthly JOIN n USING (geonameid)
  GROUP BY ALL HAVING count(value) > 0""")
def _(spark, sf):
    out = H.collapse_long(place_monthly(spark, sf), ["geonameid"], limit=60)
    return out.select("geonameid", "year", "value", "max_value", "min_value", "max_pos", "min_pos")


@query("monthly_summary", """WITH w AS (SELECT geonameid, count(*) AS n_records, min(year) AS first_year, max(year) AS last_year, disp(avg(value), 2) AS overall_mean,
    max(value) AS hi, min(value) AS lo, arg_max(t, value * 100000 - (year * 12 + month)) AS hi_t, arg_min(t, value * 100000 + year * 12 + month) AS lo_t FROM place_monthly GROUP BY 1),
  m AS (SELECT geonameid, month, disp(avg(value), 2) AS month_mean FROM place_monthly WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT geonameid, month, month_mean, n_records, first_year, last_year, overall_mean, disp(hi, 2) AS high, CAST(year(hi_t) AS INTEGER) AS high_year, CAST(month(hi_t) AS INTEGER) AS high_month,
    disp(lo, 2) AS low, CAST(year(lo_t) AS INTEGER) AS low_year, CAST(month(lo_t) AS INTEGER) AS low_month FROM w JOIN m USING (geonameid)""")
def _(spark, sf):
    return H.monthly_summary(place_monthly(spark, sf), ["geonameid"])


_KEYED = """SELECT *, row_number() OVER (PARTITION BY round_even(lat * 4, 0), round_even(lon * 4, 0) ORDER BY population DESC, geonameid) AS k FROM places
  WHERE population >= 1000 AND {cond}"""


def _extreme_sql(cond: str, score: str, order: str, limit: int, year: str = "CAST(NULL AS INTEGER)", where: str = "true",
                 value: str = "disp(score, 3)", unit: str = "C") -> str:
    return f"""WITH c AS (SELECT *, CAST(floor((90 - lat) / 10) AS INTEGER) AS i_lat, CAST(floor((lon + 180) / 10) AS INTEGER) AS i_lon FROM ({_KEYED.format(cond=cond)}) WHERE k = 1),
      r AS (SELECT i_lat, i_lon, year, disp(value, 3) AS value FROM annual_wide WHERE {where}),
      s AS (SELECT i_lat, i_lon, round({score}, 9) AS score, {year} AS year FROM r GROUP BY 1, 2)
      SELECT CAST(row_number() OVER (ORDER BY score {order}, population DESC, geonameid) AS INTEGER) AS rank, geonameid, label, alt_names, lat, lon,
        {value} + 0.0::DOUBLE AS value, '{unit}' AS unit, year FROM c JOIN s USING (i_lat, i_lon) WHERE score IS NOT NULL
      ORDER BY score {order}, population DESC, geonameid LIMIT {limit}"""


@query("find_extreme_location", _extreme_sql("true", "max(value)", "DESC", 10, "arg_max(year, value * 10000 - year)", "year BETWEEN 1996 AND 2000"))
def _(spark, sf):
    cities = H.eligible_cities(V.places(spark, sf))
    out = H.extreme_locations(cities, annual_wide(spark, sf), V.RASTER, "max", "max", 10, start=1996, end=2000)
    return out.withColumn("value", F.col("value") + 0.0)


@query("find_extreme_location_trend", _extreme_sql("country_code IN (SELECT country_code FROM continent_country WHERE continent IN ('ASIA', 'EUROPE'))", _SLOPE10, "ASC", 5, value="disp(disp(score, 3) * 9.0 / 5.0, 3)", unit="F"))
def _(spark, sf):
    both = V.continent_country(spark, sf).where("continent IN ('ASIA', 'EUROPE')").withColumn("continent", F.lit("eurasia"))
    cities = H.eligible_cities(V.places(spark, sf), continent="eurasia", continent_country=both)
    out = H.extreme_locations(cities, annual_wide(spark, sf), V.RASTER, "trend_slope", "min", 5, target="F")
    return out.withColumn("value", F.col("value") + 0.0)


@query("find_extreme_location_capitals", _extreme_sql("capital AND country_code NOT IN ('AX', 'CX')", "avg(value)", "DESC", 3, value="disp(disp(score, 3) * 9.0 / 5.0 + 32.0, 3)", unit="F"))
def _(spark, sf):
    cities = H.eligible_cities(V.places(spark, sf), capital_only=True, dependencies=["AX", "CX"])
    out = H.extreme_locations(cities, annual_wide(spark, sf), V.RASTER, "mean", "max", 3, target="F")
    return out.withColumn("value", F.col("value") + 0.0)


@query("find_extreme_location_monthly", f"""WITH c AS (SELECT *, CAST(floor((90 - lat) / 30) AS INTEGER) AS i_lat, CAST(floor((lon + 180) / 30) AS INTEGER) AS i_lon FROM ({_KEYED.format(cond="country_code = 'BX'")}) WHERE k = 1),
  s AS (SELECT i_lat, i_lon, round(avg(disp(value, 3)), 9) AS score FROM obs_monthly GROUP BY 1, 2)
  SELECT geonameid, label, disp(score, 3) AS value FROM c JOIN s USING (i_lat, i_lon) ORDER BY score DESC, population DESC, geonameid LIMIT 5""")
def _(spark, sf):
    cities = H.eligible_cities(V.places(spark, sf), country="BX")
    rows = V.obs_monthly(spark, sf).select(*CELL, F.year("t").alias("year"), F.month("t").alias("month"), "value")
    return H.extreme_locations(cities, rows, M30, "mean", "max", 5, monthly=True).select("geonameid", "label", "value")


@query("find_extreme_location_ranked", """SELECT CAST(row_number() OVER (ORDER BY r.rank DESC) AS INTEGER) AS rank, r.geonameid, r.name, r.lat, r.lon,
  disp(disp(r.value, 3) * 9.0 / 5.0 + 32.0, 3) AS value, 'F' AS unit FROM ranked_mean r JOIN places p USING (geonameid)
  WHERE p.population >= 100000 ORDER BY r.rank DESC LIMIT 5""")
def _(spark, sf):
    ranking = RG.city_rankings(V.places(spark, sf), annual_wide(spark, sf), V.RASTER, "mean")
    eligible = H.eligible_cities(V.places(spark, sf), min_population=100_000)
    return H.extreme_from_ranking(ranking, eligible, "min", 5, target="F")


V.SQL_VIEWS["cell_means"] = "SELECT i_lat, i_lon, avg(disp(value, 3)) AS mean FROM annual_wide GROUP BY 1, 2 HAVING count(value) > 0"


@query("find_similar_locations", """WITH j AS (SELECT geonameid, label, lat, lon, population, mean FROM place_cells JOIN cell_means USING (i_lat, i_lon)),
  ref AS (SELECT * FROM j WHERE population >= 100000),
  d AS (SELECT ref.geonameid AS reference, j.*, ref.mean AS r_mean, round(abs(round(j.mean, 9) - round(ref.mean, 9)), 9) AS d FROM j JOIN ref
    ON NOT (abs(j.lat - ref.lat) < 0.13 AND abs(j.lon - ref.lon) < 0.13) WHERE j.population >= 100000)
  SELECT reference, CAST(row_number() OVER (PARTITION BY reference ORDER BY d, population DESC, geonameid) AS INTEGER) AS rank, geonameid, label,
    disp(disp(mean, 3) * 9.0 / 5.0 + 32.0, 3) AS value, disp(disp(d, 3) * 9.0 / 5.0, 3) AS delta, disp(disp(r_mean, 3) * 9.0 / 5.0 + 32.0, 3) AS reference_mean, 'F' AS unit
  FROM d QUALIFY rank <= 8""")
def _(spark, sf):
    places = V.places(spark, sf)
    asked = places.where("population >= 100000").select(F.col("geonameid").alias("reference"), "lat", "lon")
    return similar_locations(places, asked, annual_wide(spark, sf), V.RASTER, limit=8, target="F")


V.SQL_VIEWS["region_info"] = "SELECT DISTINCT region_key, region_type, region_name FROM weights UNION ALL SELECT 'globe', 'globe', 'Global'"
V.SQL_VIEWS["region_series"] = "SELECT region_key, region_type, region_name, year, mean AS value FROM region_values JOIN region_info USING (region_key)"


def region_info(spark, sf):
    globe = spark.range(1).select(
        F.lit("globe").alias("region_key"), F.lit("globe").alias("region_type"), F.lit("Global").alias("region_name")
    )
    return weights(spark, sf).select("region_key", "region_type", "region_name").distinct().unionByName(globe)


def region_series(spark, sf):
    return region_values(spark, sf).join(region_info(spark, sf), "region_key").select(
        "region_key", "region_type", "region_name", "year", F.col("mean").alias("value")
    )


_MAJOR = ["ocean:ocean_africa_sea", "ocean:ocean_asia_sea"]
for _agg, _ext, _expr in [("mean", "max", "avg(value)"), ("trend_slope", "min", _SLOPE10), ("max", "max", "max(value)")]:
    query(f"find_extreme_region_{_agg}", f"""WITH s AS (SELECT region_key, region_type, region_name, round({_expr}, 9) AS score FROM region_series
        WHERE (region_type <> 'ocean' OR region_key IN ('{_MAJOR[0]}', '{_MAJOR[1]}')) AND year >= 1996 AND value IS NOT NULL GROUP BY ALL)
      SELECT CAST(row_number() OVER (ORDER BY score {'DESC' if _ext == 'max' else 'ASC'}, region_key) AS INTEGER) AS rank, region_key, region_type, region_name,
        disp(score, 3) + 0.0::DOUBLE AS value, 'C' AS unit FROM s WHERE score IS NOT NULL
      ORDER BY score {'DESC' if _ext == 'max' else 'ASC'}, region_key LIMIT 6""")(
        lambda spark, sf, a=_agg, e=_ext: H.extreme_regions(
            region_series(spark, sf), a, e, 6, major_oceans=_MAJOR, start=1996
        ).withColumn("value", F.col("value") + 0.0)
    )


@query("resolve_region", """WITH q AS (SELECT DISTINCT x AS query FROM (SELECT region_name AS x FROM region_info UNION ALL SELECT lower(substr(region_key, position(':' IN region_key) + 1)) FROM region_info
    UNION ALL SELECT ' World ' UNION ALL SELECT region_key FROM region_info UNION ALL SELECT lang FROM documents UNION ALL SELECT 'Nation_7 ')),
  n AS (SELECT query, lower(trim(query)) AS s FROM q),
  o AS (SELECT query, 0 AS p, query AS k FROM n UNION ALL SELECT query, 1, 'globe' FROM n WHERE s IN ('global', 'worldwide', 'world', 'globe')
    UNION ALL SELECT query, 2, 'continent:' || replace(s, ' ', '_') FROM n UNION ALL SELECT query, 3, 'country:' || replace(s, ' ', '_') FROM n
    UNION ALL SELECT query, 4, 'ocean:' || replace(s, ' ', '_') FROM n UNION ALL SELECT query, 5, 'country:' || upper(s) FROM n),
  m AS (SELECT query, p, region_key FROM o JOIN region_info r ON r.region_key = o.k UNION ALL SELECT query, 6, region_key FROM n JOIN region_info ON lower(region_name) = s)
  SELECT query, region_key FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY p, region_key) = 1""")
def _(spark, sf):
    info = region_info(spark, sf)
    asked = (
        info.select(F.col("region_name").alias("query"))
        .union(info.select(F.lower(F.substring_index("region_key", ":", -1))))
        .union(info.select("region_key"))
        .union(V.table(spark, sf, "documents").select("lang"))
        .union(spark.range(1).select(F.lit(" World ")))
        .union(spark.range(1).select(F.lit("Nation_7 ")))
    )
    return H.resolve_regions(asked, info)


@query("region_series_query", """SELECT 'continent:ASIA' AS region_key, CAST(year AS VARCHAR) AS x, disp(value * 9 / 5 + 32, 6) AS value
  FROM region_series WHERE region_key = 'continent:ASIA' AND year BETWEEN 1996 AND 2000""")
def _(spark, sf):
    rs = region_series(spark, sf).withColumn("axis_label", F.col("year").cast("string"))
    out = H.region_series_query(rs, "continent:ASIA", "C", "F", start=1996, end=2000)
    return rounded(out.select("region_key", "x", "value"), "value")


_MGLOBE = "cos(radians(90 - (i_lat + 0.5::DOUBLE) * 30))"
V.SQL_VIEWS["globe_monthly"] = f"""SELECT 'globe' AS region_key, strftime(t, '%Y-%m') AS axis_label,
  disp(sum(value * {_MGLOBE}) / sum(CASE WHEN value IS NOT NULL THEN {_MGLOBE} END), 4) AS value FROM obs_monthly GROUP BY t"""


def globe_monthly(spark, sf):
    g = RG.globe_aggregates(V.obs_monthly(spark, sf), M30, step="t")
    return g.select("region_key", F.date_format("t", "yyyy-MM").alias("axis_label"), F.col("mean").alias("value"))


@query("region_series_query_seasonal", """SELECT region_key, substr(axis_label, 1, 4) AS x, disp(avg(value), 6) AS value FROM globe_monthly
  WHERE CAST(substr(axis_label, 6, 2) AS INTEGER) IN (6, 7, 8) GROUP BY 1, 2""")
def _(spark, sf):
    out = H.region_series_query(globe_monthly(spark, sf), "globe", months=[6, 7, 8], by_year=True)
    return rounded(out.select("region_key", "x", "value"), "value")


@query("region_series_query_collapsed", """SELECT region_key, substr(axis_label, 1, 4) AS x, disp(avg(value), 3) AS value FROM globe_monthly GROUP BY 1, 2""")
def _(spark, sf):
    out = H.region_series_query(globe_monthly(spark, sf), "globe", limit=50)
    return out.select("region_key", "x", "value")


@query("rank_of_point", """WITH d AS (SELECT point_id, rank, value, greatest(abs(r.lat - p.lat), abs(r.lon - p.lon)) AS d FROM points p JOIN ranked_mean r
    ON r.lat BETWEEN p.lat - 0.35 AND p.lat + 0.35 AND r.lon BETWEEN p.lon - 0.35 AND p.lon + 0.35),
  b AS (SELECT * FROM d WHERE d < 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, rank) = 1)
  SELECT point_id, rank, value, (SELECT count(*) FROM ranked_mean) AS total, disp(((SELECT count(*) FROM ranked_mean) - rank) / (SELECT count(*) FROM ranked_mean) * 100, 6) AS share_below FROM b""")
def _(spark, sf):
    ranking = RG.city_rankings(V.places(spark, sf), annual_wide(spark, sf), V.RASTER, "mean")
    return rounded(H.rank_of_points(V.points(spark, sf), ranking), "share_below")


@query("metric_catalogue", """SELECT 'annual' AS metric_id, (SELECT CAST(min(year) AS VARCHAR) FROM annual) AS first_label, (SELECT CAST(max(year) AS VARCHAR) FROM annual) AS last_label
  UNION ALL SELECT 'monthly', (SELECT strftime(min(t), '%Y-%m') FROM obs_monthly), (SELECT strftime(max(t), '%Y-%m') FROM obs_monthly)""")
def _(spark, sf):
    years = V.annual(spark, sf).select(F.make_date("year", F.lit(1), F.lit(1)).alias("t"))
    axis = S.build_axis("annual", years, "year").unionByName(S.build_axis("monthly", V.obs_monthly(spark, sf), "month"))
    metrics = spark.createDataFrame(
        [("annual", False), ("monthly", None), ("draft", True)], "metric_id string, hidden boolean"
    )
    return H.metric_catalogue(axis, metrics)
