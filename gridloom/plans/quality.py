"""Ingest, sinks and quality checks over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid
from gridloom.operators import quality as Q, regions as RG
from gridloom.plans import views as V
from gridloom.plans.queries import region_values, wide_series
from gridloom.plans.regions import annual_wide
from gridloom.plans.registry import query
from gridloom.sources import readers, series as S, sinks, tile_archive as TA
from gridloom.storage import work_folder


@query("scan_grid", """SELECT 'sst' AS metric_id, CAST(floor(90 - ((l_suppkey * 7) % 1790 / 10.0::DOUBLE - 89.45::DOUBLE)) AS INTEGER) AS i_lat, CAST(floor((l_partkey % 3599) / 10.0::DOUBLE + 0.05::DOUBLE) AS INTEGER) AS i_lon,
  CAST(l_shipdate AS DATE) AS t, CASE WHEN l_quantity NOT IN (1, 2) THEN l_quantity END AS value FROM lineitem WHERE l_linenumber <> 7""")
def _(spark, sf):
    q = F.col("l_quantity")
    raw = V.table(spark, sf, "lineitem").select(
        ((F.col("l_suppkey") * 7) % 1790 / 10.0 - 89.45).alias("latitude"),
        ((F.col("l_partkey") % 3599) / 10.0 + 0.05 - 180.0).alias("Longitude"),
        F.col("l_shipdate").alias("time"), F.when(F.col("l_linenumber") == 7, 5).otherwise(0).alias("zlev"),
        F.when(q == 1, float("nan")).when(q == 2, -999.0).otherwise(q).alias("sst"), F.lit(0).alias("time_bnds"),
    )
    return readers.select_grid(raw, V.TOY, preferred="analysed_sst", aliases=["sst"], fill=-999.0, metric_id="sst")


V.SQL_VIEWS["annual_cells"] = "SELECT i_lat, i_lon FROM annual GROUP BY 1, 2 HAVING count(value) > 0"


def annual_series(spark, sf, grid=V.TOY):
    long = V.annual(spark, sf).withColumn("t", F.make_date("year", F.lit(1), F.lit(1)))
    axis = S.build_axis("annual", long, "year")
    return S.pack_series(long, axis, "annual", grid), axis


@query("scan_series", """SELECT c.i_lat, c.i_lon, y.year, a.value::FLOAT::DOUBLE AS value FROM annual_cells c CROSS JOIN (SELECT DISTINCT year FROM annual) y
  LEFT JOIN annual a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.year = y.year WHERE c.i_lat // 16 IN (1, 3, 5)""")
def _(spark, sf):
    series, axis = annual_series(spark, sf)
    path = work_folder(spark) + "/series"
    S.write_series(series, path)
    stored = S.scan_series(spark, path, "annual", tile_rows=[1, 3, 5])
    return S.unpack_series(stored, axis.drop("t")).select(*CELL, "year", "value")


@query("write_series_resume", "SELECT i_lat, i_lon, count(*) AS n FROM annual_cells GROUP BY 1, 2")
def _(spark, sf):
    series, _axis = annual_series(spark, sf)
    path = work_folder(spark) + "/series"
    S.write_series(series.where("i_lon % 2 = 0"), path)
    S.write_series(series, path, resume=True)
    return spark.read.parquet(path).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


@query("write_series_tile", """SELECT c.i_lat, c.i_lon, y.year, (CASE WHEN c.i_lat // 16 = 3 AND c.i_lon // 16 = 5 THEN a.value + 1 ELSE a.value END)::FLOAT::DOUBLE AS value
  FROM annual_cells c CROSS JOIN (SELECT DISTINCT year FROM annual) y LEFT JOIN annual a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.year = y.year""")
def _(spark, sf):
    series, axis = annual_series(spark, sf)
    path = work_folder(spark) + "/series"
    S.write_series(series, path)
    one = series.where("tile_r = 3 AND tile_c = 5").withColumn("values", F.transform("values", lambda v: v + 1))
    S.write_series(one, path)  # a tile written again leaves its row's other tiles in place
    return S.unpack_series(S.scan_series(spark, path, "annual"), axis.drop("t")).select(*CELL, "year", "value")


@query("axis_guard", """WITH a AS (SELECT year AS y, row_number() OVER (ORDER BY year) - 1 AS pos FROM (SELECT DISTINCT year FROM annual)),
  b AS (SELECT year AS y, row_number() OVER (ORDER BY year) - 1 AS pos FROM (SELECT DISTINCT year FROM annual WHERE year <> 1997))
  SELECT CAST(coalesce(a.pos, b.pos) AS INTEGER) AS pos, CAST(a.y AS VARCHAR) AS stored, CAST(b.y AS VARCHAR) AS "new" FROM a FULL JOIN b ON a.pos = b.pos WHERE a.y IS DISTINCT FROM b.y""")
def _(spark, sf):
    dates = V.annual(spark, sf).withColumn("t", F.make_date("year", F.lit(1), F.lit(1)))
    old = S.build_axis("annual", dates, "year")
    new = S.build_axis("annual", dates.where("year <> 1997"), "year")
    return S.axis_mismatches(old, new)


@query("fill_missing_tiles", """SELECT CAST(a AS INTEGER) AS i_lat, CAST(b AS INTEGER) AS i_lon, CAST(4 AS INTEGER) AS steps, CAST(0 AS INTEGER) AS present FROM range(32, 64) r(a), range(360) s(b)
  WHERE (a, b) NOT IN (SELECT (i_lat, i_lon) FROM mask_a)""")
def _(spark, sf):
    out = S.missing_cells(V.mask_a(spark, sf), V.TOY, axis_size=4, tile_rows=(2, 3))
    present = F.size(F.filter("values", lambda v: v.isNotNull()))
    return out.select(*CELL, F.size("values").alias("steps"), present.alias("present"))


@query("tile_archive_ingest", """SELECT i_lat, i_lon, CAST(count(*) AS INTEGER) AS steps, CAST(count(value) AS INTEGER) AS present, sum(value) AS total FROM
  (SELECT c.i_lat, c.i_lon, y.year, a.value FROM annual_cells c CROSS JOIN (SELECT DISTINCT year FROM annual) y LEFT JOIN annual a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.year = y.year) GROUP BY 1, 2""")
def _(spark, sf):
    series, _axis = annual_series(spark, sf)
    back = TA.decode_tiles(TA.encode_tiles(series, V.TOY), V.TOY)
    there = F.filter("values", lambda v: v.isNotNull())
    return back.select(
        *CELL, F.size("values").alias("steps"), F.size(there).alias("present"),
        F.aggregate(there, F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


@query("read_places", """SELECT geonameid, label, city_name, CASE WHEN geonameid % 10 = 0 THEN 'NA' ELSE country_code END AS country_code, CASE WHEN geonameid % 7 = 0 THEN 0 ELSE lat END AS lat,
  population, capital, CASE WHEN geonameid % 3 <> 0 THEN alt_names ELSE '' END AS alt_names FROM places""")
def _(spark, sf):
    k = F.col("geonameid")
    path = work_folder(spark) + "/places"
    p = V.places(spark, sf).select(
        "geonameid", "label", "city_name", "country_name", F.when(k % 10 == 0, "NA").otherwise(F.col("country_code")).alias("country_code"),
        F.when(k % 7 != 0, F.col("lat")).alias("lat"), "lon", F.concat(F.col("population").cast("string"), F.lit(".0")).alias("population"),
        F.when(F.col("capital"), "True").otherwise("false").alias("capital"), "feature_code",
        F.when(k % 3 != 0, F.col("alt_names")).alias("alt_names"),
    )
    p.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_places(spark, path).select(
        "geonameid", "label", "city_name", "country_code", "lat", "population", "capital", "alt_names"
    )


@query("geonames_scan", """SELECT geonameid, city_name AS name, country_code AS cc, lat, population, CAST(2 + geonameid % 2 AS INTEGER) AS alias_count, feature_code FROM places
  WHERE geonameid % 13 <> 0 AND geonameid % 6 <> 0 AND feature_code <> 'PPLA2'""")
def _(spark, sf):
    k = F.col("geonameid")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    alt = F.concat(F.lit("One, "), F.when(k % 2 == 1, "Two,").otherwise(" ,"), F.lit("Three"))
    fields = [
        text(k), "city_name", F.lit("ascii"), alt, text(F.col("lat")), text(F.col("lon")), F.when(k % 6 == 0, "A").otherwise("P"), "feature_code",
        "country_code", F.lit(""), F.lit("11"), F.lit("22"), F.lit(""), F.lit(""), text(F.col("population")), F.lit(""), F.lit("5"), F.lit("Etc/UTC"), F.lit("2024-01-01"),
    ]
    line = F.when(k % 13 == 0, F.lit("too\tshort")).otherwise(F.concat_ws("\t", *fields))
    path = work_folder(spark) + "/gazetteer"
    V.places(spark, sf).select(line.alias("value")).write.text(path)
    return readers.geonames_scan(spark, path, ["PPLA2"]).select("geonameid", "name", "cc", "lat", "population", "alias_count", "feature_code")


@query("units_row_skip", "SELECT i_lat, i_lon, t AS time, value FROM obs_daily")
def _(spark, sf):
    path = work_folder(spark) + "/griddap"
    stamped = V.obs_daily(spark, sf).select(
        F.concat(F.col("t").cast("string"), F.lit("T00:00:00")).alias("time"), *[F.col(c).cast("string") for c in CELL], F.col("value").cast("string")
    )

    def with_units(batches):
        yield pd.DataFrame([["UTC", "count", "count", "degree_C"]], columns=["time", "i_lat", "i_lon", "value"])
        yield from batches

    stamped.mapInPandas(with_units, stamped.schema).write.option("header", True).csv(path)
    columns = {"time": "timestamp_ntz", "i_lat": "int", "i_lon": "int", "value": "double"}
    return readers.read_with_units_row(spark, path, columns).withColumn("time", F.col("time").cast("date"))


@query("write_region_series", "SELECT region_key, year, mean AS value, 'annual' AS metric_id, 'mean' AS aggregation FROM region_values UNION ALL SELECT region_key, year, max, 'annual', 'max' FROM region_values")
def _(spark, sf):
    rv = region_values(spark, sf)
    path = work_folder(spark) + "/aggregates"
    for agg in ("mean", "max"):
        sinks.write_region_series(
            rv.select("region_key", "year", F.col(agg).alias("value"), F.lit("annual").alias("metric_id"), F.lit(agg).alias("aggregation")), path
        )
    return spark.read.parquet(path).select("region_key", "year", "value", "metric_id", "aggregation")


@query("write_ranking", "SELECT name, value, rank, 'annual' AS metric_id, 'max' AS aggregation FROM ranked_max")
def _(spark, sf):
    path = work_folder(spark) + "/rankings"
    ranking = RG.city_rankings(V.places(spark, sf), annual_wide(spark, sf), V.RASTER, "max")
    sinks.write_ranking(ranking.withColumns({"metric_id": F.lit("annual"), "aggregation": F.lit("max")}), path, "json")
    schema = "name string, value double, rank long, metric_id string, aggregation string"
    return spark.read.schema(schema).json(path)


_CELL_HASH = "sha256(string_agg(coalesce(CAST(value AS VARCHAR), '~'), ',' ORDER BY year))"
V.SQL_VIEWS["prints"] = f"""SELECT metric_id, sha256(string_agg(h, ',' ORDER BY tile_r, tile_c)) AS sha256 FROM (SELECT metric_id, tile_r, tile_c, sha256(string_agg(h, ',' ORDER BY i_lat, i_lon)) AS h FROM
  (SELECT metric_id, i_lat // 16 AS tile_r, i_lon // 16 AS tile_c, i_lat, i_lon, {_CELL_HASH} AS h FROM (SELECT 'a' || (c.i_lat % 5) AS metric_id, c.i_lat, c.i_lon, y.year, a.value FROM annual_cells c
    CROSS JOIN (SELECT DISTINCT year FROM annual) y LEFT JOIN annual a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.year = y.year) GROUP BY ALL) GROUP BY ALL) GROUP BY 1"""


def prints(spark, sf):
    series, _axis = annual_series(spark, sf)
    split = series.withColumn("metric_id", F.concat(F.lit("a"), (F.col("i_lat") % 5).cast("string")))
    return split, Q.fingerprints(split)


@query("content_fingerprint", "SELECT metric_id, sha256 FROM prints")
def _(spark, sf):
    return prints(spark, sf)[1]


@query("fingerprint_diff", "SELECT * FROM (VALUES ('a0', 'removed'), ('a1', 'changed'), ('a2', 'same'), ('a3', 'same'), ('a4', 'same'), ('a9', 'new')) v(metric_id, state) WHERE (SELECT count(*) FROM lineitem) > 0")
def _(spark, sf):
    split, old = prints(spark, sf)
    m = F.col("metric_id")
    bumped = F.transform("values", lambda v: v + 1)
    new = split.where(m != "a0").withColumn("values", F.when(m == "a1", bumped).otherwise(F.col("values")))
    extra = split.where(m == "a0").withColumn("metric_id", F.lit("a9"))
    return Q.fingerprint_changes(old, Q.fingerprints(new.unionByName(extra)))


# A cell's hash cut into lanes of 60 bits, which add up over the cells; the second release adds 1 to metric a1 in two
# rows of tiles, drops the northernmost cells of a2 and gives a3's first tile column to a new metric.
_LANES = ", ".join(f"(sum(('0x' || substr(h, {15 * k + 1}, 15))::HUGEINT) % 1152921504606846976)::DECIMAL(20, 0) AS lane{k}" for k in range(4))
_CELLS = """SELECT 'a' || (c.i_lat % 5) AS metric_id, c.i_lat, c.i_lon, y.year, a.value FROM annual_cells c
  CROSS JOIN (SELECT DISTINCT year FROM annual) y LEFT JOIN annual a ON a.i_lat = c.i_lat AND a.i_lon = c.i_lon AND a.year = y.year"""
_TILE_PRINTS = """SELECT metric_id, i_lat // 16 AS tile_r, i_lon // 16 AS tile_c, count(*) AS n, {lanes} FROM (
  SELECT metric_id, i_lat, i_lon, sha256(i_lat || ':' || i_lon || ':' || string_agg(coalesce(CAST(value AS VARCHAR), '~'), ',' ORDER BY year)) AS h
  FROM ({cells}) GROUP BY metric_id, i_lat, i_lon) GROUP BY ALL"""
V.SQL_VIEWS["tiles_before"] = _TILE_PRINTS.format(lanes=_LANES, cells=_CELLS)
V.SQL_VIEWS["tiles_after"] = _TILE_PRINTS.format(lanes=_LANES, cells=f"""SELECT CASE WHEN metric_id = 'a3' AND i_lon < 48 THEN 'a9' ELSE metric_id END AS metric_id, i_lat, i_lon, year,
  CASE WHEN metric_id = 'a1' AND i_lat // 16 IN (3, 4) THEN value + 1 ELSE value END AS value FROM ({_CELLS}) WHERE NOT (metric_id = 'a2' AND i_lat < 40)""")


def releases(spark, sf):
    series, _axis = annual_series(spark, sf)
    old = series.withColumn("metric_id", F.concat(F.lit("a"), (F.col("i_lat") % 5).cast("string")))
    m = F.col("metric_id")
    bumped = F.when((m == "a1") & F.col("tile_r").isin(3, 4), F.transform("values", lambda v: v + 1)).otherwise(F.col("values"))
    renamed = F.when((m == "a3") & (F.col("i_lon") < 48), "a9").otherwise(m)
    new = old.where(~((m == "a2") & (F.col("i_lat") < 40))).withColumn("values", bumped).withColumn("metric_id", renamed)
    return Q.tile_prints(old), Q.tile_prints(new)


@query("tile_fingerprints", "SELECT * FROM tiles_before")
def _(spark, sf):
    return releases(spark, sf)[0]


@query("changed_tiles", """SELECT coalesce(a.metric_id, b.metric_id) AS metric_id, coalesce(a.tile_r, b.tile_r) AS tile_r, coalesce(a.tile_c, b.tile_c) AS tile_c,
    CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS state
  FROM tiles_before a FULL JOIN tiles_after b ON a.metric_id = b.metric_id AND a.tile_r = b.tile_r AND a.tile_c = b.tile_c
  WHERE (a.n, a.lane0, a.lane1, a.lane2, a.lane3) IS DISTINCT FROM (b.n, b.lane0, b.lane1, b.lane2, b.lane3)""")
def _(spark, sf):
    return Q.changed_tiles(*releases(spark, sf))


@query("coverage", """WITH p AS (SELECT * FROM annual_cells), d AS (SELECT i_lat, i_lon FROM mask_a)
  SELECT 'annual' AS metric_id, (SELECT count(*) FROM (SELECT DISTINCT i_lat // 16, i_lon // 16 FROM p)) AS tiles_found, CAST(276 AS BIGINT) AS tiles_expected, (SELECT count(*) FROM p) AS present_cells,
    round(100.0::DOUBLE * (SELECT count(*) FROM p) / (276 * 256), 6) AS container_pct, round(100.0::DOUBLE * (SELECT count(*) FROM p) / 64800, 6) AS real_pct,
    round(100.0::DOUBLE * (SELECT count(*) FROM p SEMI JOIN d USING (i_lat, i_lon)) / (SELECT count(*) FROM d), 6) AS domain_pct""")
def _(spark, sf):
    series, _axis = annual_series(spark, sf)
    out = Q.coverage(series, V.TOY, V.mask_a(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("container_pct", "real_pct", "domain_pct")})


V.SQL_VIEWS["stored_regions"] = """SELECT 'annual' AS metric_id, 'mean' AS aggregation, region_key, CAST(year AS VARCHAR) AS axis_label FROM region_values WHERE year <> 1999 AND NOT (region_key = 'globe' AND year = 1996)"""


@query("aggregate_staleness", """WITH n AS (SELECT count(DISTINCT axis_label) AS k FROM stored_regions), l AS (SELECT region_key, count(*) AS n FROM stored_regions GROUP BY 1)
  SELECT 'annual' AS metric_id, 'max' AS aggregation, 'missing' AS problem, '' AS subject, CAST(0 AS BIGINT) AS n
  UNION ALL SELECT 'annual', 'mean', 'length', region_key, n FROM l WHERE n <> (SELECT k FROM n)
  UNION ALL SELECT 'annual', 'mean', 'stale', min(CAST(year AS VARCHAR)), count(*) FROM (SELECT DISTINCT year FROM annual) WHERE CAST(year AS VARCHAR) NOT IN (SELECT axis_label FROM stored_regions) HAVING count(*) > 0""")
def _(spark, sf):
    rv = region_values(spark, sf).where("year <> 1999 AND NOT (region_key = 'globe' AND year = 1996)")
    stored = rv.select(F.lit("annual").alias("metric_id"), F.lit("mean").alias("aggregation"), "region_key", F.col("year").cast("string").alias("axis_label"))
    declared = spark.createDataFrame([("annual", "mean"), ("annual", "max")], "metric_id string, aggregation string")
    dates = V.annual(spark, sf).withColumn("t", F.make_date("year", F.lit(1), F.lit(1)))
    return Q.aggregate_problems(declared, stored, S.build_axis("annual", dates, "year"))


@query("rankings_present", "SELECT * FROM (VALUES ('annual', 'min'), ('other', 'mean')) v(metric_id, aggregation) WHERE (SELECT count(*) FROM ranked_mean) > 0")
def _(spark, sf):
    ranking = RG.city_rankings(V.places(spark, sf), annual_wide(spark, sf), V.RASTER, "mean")
    stored = ranking.select(F.lit("annual").alias("metric_id"), F.lit("mean").alias("aggregation"))
    declared = spark.createDataFrame([("annual", "mean"), ("annual", "min"), ("other", "mean")], "metric_id string, aggregation string")
    return Q.absent_rankings(declared, stored)


@query("tile_presence", """SELECT CAST(a AS INTEGER) AS tile_r, CAST(b AS INTEGER) AS tile_c FROM range(8, 36) r(a), range(12, 80) s(b)
  WHERE (a, b) NOT IN (SELECT (i_lat // 4, i_lon // 4) FROM annual_cells)""")
def _(spark, sf):
    series, _axis = annual_series(spark, sf, Grid("toy_1deg", 1.0, 180, 360, tile_size=4))
    return Q.missing_tiles(series, "annual", rows=(8, 35), cols=(12, 79))


@query("orphan_artifacts", """SELECT 'series' AS kind, 'm' || (p_partkey % 97) AS artifact_id, p_brand AS version FROM part WHERE ('m' || (p_partkey % 97), p_brand) NOT IN (SELECT ('m' || (l_partkey % 89), p_brand) FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def _(spark, sf):
    name = lambda c, n: F.concat(F.lit("m"), (F.col(c) % n).cast("string")).alias("artifact_id")
    part = V.table(spark, sf, "part")
    stored = part.select(F.lit("series").alias("kind"), name("p_partkey", 97), F.col("p_brand").alias("version"))
    used = V.table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    return Q.orphans(stored, used.select(F.lit("series").alias("kind"), name("l_partkey", 89), F.col("p_brand").alias("version")))
