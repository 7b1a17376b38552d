"""Panels, charts and answers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as TX
from gridloom.functions.units import display_round
from gridloom.operators import panels as P
from gridloom.plans import views as V
from gridloom.plans.cells import _ICPT, _SLOPE
from gridloom.plans.places import _norm
from gridloom.plans.queries import place_annual, region_info, region_series, region_values
from gridloom.plans.raster import scored
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded

# Two metrics over the place series; the second lacks the places whose id is a multiple of four.
V.SQL_VIEWS["chart_rows"] = """SELECT geonameid AS point_id, 'heat' AS metric_id, year AS x, value FROM place_annual
  UNION ALL SELECT geonameid, 'rain', year, value / 4 FROM place_annual WHERE geonameid % 4 <> 0"""


def chart_rows(spark, sf):
    rows = place_annual(spark, sf).select(F.col("geonameid").alias("point_id"), F.col("year").alias("x"), "value")
    heat = rows.select("point_id", F.lit("heat").alias("metric_id"), "x", "value")
    rain = rows.where("point_id % 4 <> 0").select("point_id", F.lit("rain").alias("metric_id"), "x", (F.col("value") / 4).alias("value"))
    return heat.unionByName(rain)


_GRAPHS = {
    "temperature": [
        {"metric": "heat", "unit": "C"},
        {"metric": "heat", "unit": "C", "transform": {"fn": "rolling_mean", "params": {"window": 3}}},
        {"metric": "heat", "unit": "C", "key": "line", "transform": {"fn": "linear_trend_line"}},
        {"metric": "other", "unit": "C", "global_only": True},
    ],
    "water": [{"metric": "rain", "unit": "mm"}, {"metric": "heat", "unit": "C", "key": "heat_again"}],
}


@query("panel_series", f"""WITH f AS (SELECT point_id, {_SLOPE.replace('year', 'x')} AS b, {_ICPT.replace('year', 'x')} AS a FROM chart_rows WHERE metric_id = 'heat' GROUP BY 1),
  d AS (SELECT point_id, 'temperature' AS graph_id, 'heat' AS series_key, x, value * 9 / 5 + 32 AS y, 'F' AS unit FROM chart_rows WHERE metric_id = 'heat'
   UNION ALL SELECT point_id, 'temperature', 'heat_rolling_mean', x, CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w * 9 / 5 + 32 END, 'F' FROM chart_rows WHERE metric_id = 'heat' WINDOW w AS (PARTITION BY point_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
   UNION ALL SELECT point_id, 'temperature', 'line', x, (a + b * x) * 9 / 5 + 32, 'F' FROM chart_rows JOIN f USING (point_id) WHERE metric_id = 'heat'
   UNION ALL SELECT point_id, 'water', 'rain', x, value, 'mm' FROM chart_rows WHERE metric_id = 'rain'
   UNION ALL SELECT point_id, 'water', 'heat_again', x, value * 9 / 5 + 32, 'F' FROM chart_rows WHERE metric_id = 'heat'),
  s AS (SELECT geonameid AS point_id, geonameid IN (SELECT point_id FROM chart_rows WHERE metric_id = 'heat') AS h, geonameid IN (SELECT point_id FROM chart_rows WHERE metric_id = 'rain') AS r FROM places)
  SELECT d.point_id, graph_id, series_key, x, disp(y, 4) + 0.0::DOUBLE AS y, unit, CAST(NULL AS VARCHAR) AS error FROM d JOIN s USING (point_id) WHERE h AND (r OR graph_id = 'temperature')
  UNION ALL SELECT point_id, 'temperature', NULL, NULL, NULL, NULL, 'No chart: a series has no values here.' FROM s WHERE NOT h
  UNION ALL SELECT point_id, 'water', NULL, NULL, NULL, NULL, 'No chart: a series has no values here.' FROM s WHERE NOT (h AND r)""")
def _(spark, sf):
    pts = V.places(spark, sf).select(F.col("geonameid").alias("point_id"))
    return rounded(P.panel_series(pts, chart_rows(spark, sf), _GRAPHS, unit="F"), "y", digits=4)


_PCELL = "SELECT point_id, CAST(greatest(0, least(17, floor((90 - lat) / 10))) AS INTEGER) AS i_lat, CAST(floor((((lon + 180) - floor((lon + 180) / 360) * 360) - 180 + 180) / 10) AS INTEGER) AS i_lon FROM points"
V.SQL_VIEWS["point_scores"] = f"SELECT point_id, CAST(least(greatest(coalesce(score, 0), 0), 4) AS INTEGER) AS score FROM ({_PCELL}) p LEFT JOIN scored USING (i_lat, i_lon)"


def point_scores(spark, sf):
    return P.score_lookup(V.points(spark, sf), scored(spark, sf).select("i_lat", "i_lon", "score"), V.RASTER)


@query("score_lookup", "SELECT point_id, score FROM point_scores")
def _(spark, sf):
    return point_scores(spark, sf)


@query("rank_panels", """WITH s AS (SELECT point_id, 'air' AS panel_id, 0 AS o, score FROM point_scores UNION ALL SELECT point_id, 'sea', 1, CAST(3 AS INTEGER) FROM point_scores
    UNION ALL SELECT point_id, 'rain', 2, CAST((score + 1) % 5 AS INTEGER) FROM point_scores)
  SELECT point_id, panel_id, score, CAST(row_number() OVER (PARTITION BY point_id ORDER BY score DESC, o) AS INTEGER) AS rank, score <= 0 AS stub FROM s""")
def _(spark, sf):
    s = point_scores(spark, sf)
    sea = P.score_lookup(V.points(spark, sf), None, V.RASTER, constant=3)
    tag = lambda df, panel, o, score: df.select("point_id", F.lit(panel).alias("panel_id"), F.lit(o).alias("panel_order"), score.cast("int").alias("score"))
    rows = tag(s, "air", 0, F.col("score")).unionByName(tag(sea, "sea", 1, F.col("score"))).unionByName(
        tag(s, "rain", 2, (F.col("score") + 1) % 5)
    )
    return P.rank_panels(rows)


@query("global_panel_series", f"""WITH g AS (SELECT year, mean, max FROM region_values WHERE region_key = 'globe'), f AS (SELECT regr_slope(mean, year) AS b, regr_intercept(mean, year) AS a FROM g)
  SELECT 'air' AS panel_id, 'annual' AS series_key, year AS x, disp(mean, 4) AS y, 'mm' AS unit FROM g
  UNION ALL SELECT 'air', 'annual_linear_trend_line', year, disp(a + b * year, 4), 'mm' FROM g, f
  UNION ALL SELECT 'extremes', 'top', year, disp(max * 9 / 5 + 32, 4), 'F' FROM g""")
def _(spark, sf):
    rv = region_values(spark, sf)
    parts = [
        rv.select("region_key", F.lit("annual").alias("metric_id"), F.lit(a).alias("aggregation"), F.col("year").alias("x"), F.col(a).alias("value"))
        for a in ("mean", "max")
    ]
    panels = {
        "air": [{"metric": "annual", "unit": "mm"}, {"metric": "annual", "unit": "mm", "transform": {"fn": "linear_trend_line"}}],
        "extremes": [{"metric": "annual", "unit": "C", "key": "top", "aggregation": "max"}],
        "empty": [{"metric": "absent"}],
    }
    return rounded(P.global_panel_series(parts[0].unionByName(parts[1]), panels, unit="F"), "y", digits=4)


@query("caption_facts", """SELECT geonameid, min(year) AS start_year, max(year) AS end_year, max(year) - min(year) AS span_years,
  CASE WHEN count(value) >= 2 THEN arg_max(value, year) FILTER (WHERE value IS NOT NULL) - arg_min(value, year) FILTER (WHERE value IS NOT NULL) END AS total_change,
  CASE WHEN max(lat) >= 0 THEN 'N' ELSE 'S' END AS hemisphere FROM place_annual GROUP BY 1""")
def _(spark, sf):
    return P.caption_facts(place_annual(spark, sf), ["geonameid"])


@query("merge_series_wide", """SELECT point_id, CAST(x AS VARCHAR) AS x, max(value) FILTER (WHERE metric_id = 'heat') AS heat, max(value) FILTER (WHERE metric_id = 'rain') AS rain FROM chart_rows GROUP BY 1, 2""")
def _(spark, sf):
    rows = chart_rows(spark, sf).select("point_id", F.col("metric_id").alias("series_key"), "x", F.col("value").alias("y"))
    return P.merge_series_wide(rows, ["point_id"], ["heat", "rain"])


# Chart results: every order is one result of a question (its customer).
V.SQL_VIEWS["results"] = """SELECT o_orderkey AS result_no, 'c' || (o_custkey % 50) AS chart_id, 'm' || (o_custkey % 7) AS metric_id, 'Place ' || (o_custkey % 23) || ', X' AS location,
  CASE WHEN o_orderkey % 5 = 0 THEN 'trend' ELSE 'raw' END AS role, CASE WHEN o_custkey % 7 < 3 AND o_orderkey % 4 = 0 THEN 'explicit' WHEN o_orderkey % 9 <> 0 THEN 'auto' END AS source,
  o_orderkey % 11 = 0 AS month_filter_ignored, CAST(year(o_orderdate) AS INTEGER) AS year, floor(o_totalprice / 1000) AS value FROM orders"""


def results(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    tag = lambda p, x, s="": F.concat(F.lit(p), x.cast("string"), F.lit(s))
    return V.table(spark, sf, "orders").select(
        o.alias("result_no"), tag("c", c % 50).alias("chart_id"), tag("m", c % 7).alias("metric_id"), tag("Place ", c % 23, ", X").alias("location"),
        F.when(o % 5 == 0, "trend").otherwise("raw").alias("role"),
        F.when((c % 7 < 3) & (o % 4 == 0), "explicit").when(o % 9 != 0, "auto").alias("source"),
        (o % 11 == 0).alias("month_filter_ignored"), F.year("o_orderdate").alias("year"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("value"),
    )


@query("prefer_explicit", """WITH k AS (SELECT * FROM results WHERE NOT month_filter_ignored)
  SELECT result_no, metric_id, source FROM k WHERE source IS DISTINCT FROM 'auto' OR metric_id NOT IN (SELECT metric_id FROM k WHERE source = 'explicit')""")
def _(spark, sf):
    return P.prefer_explicit(results(spark, sf)).select("result_no", "metric_id", "source")


@query("dedupe_latest", "SELECT metric_id, location, role, max(result_no) AS result_no, arg_max(value, result_no) AS value FROM results GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = results(spark, sf).select("metric_id", "location", "role", "result_no", "value")
    return P.dedupe_latest(rows, ["metric_id", "location", "role"])


V.SQL_VIEWS["siblings"] = "SELECT * FROM (VALUES ('risk', 'm0', 1), ('risk', 'm1', 2), ('risk', 'm2', 3), ('solo', 'm4', 1)) v(group_id, metric_id, position)"
V.SQL_VIEWS["asked_results"] = "SELECT * FROM results WHERE metric_id IN ('m0', 'm4') OR (metric_id = 'm1' AND value % 2 = 0)"


@query("chart_group_merge", """WITH r AS (SELECT * FROM asked_results JOIN siblings USING (metric_id)),
  f AS (SELECT group_id, location, metric_id, min(result_no) AS result_no FROM r GROUP BY 1, 2, 3),
  u AS (SELECT r.group_id, r.location, r.metric_id, r.position, r.year, r.value FROM r JOIN f ON f.group_id = r.group_id AND f.location = r.location AND f.metric_id = r.metric_id AND f.result_no = r.result_no),
  l AS (SELECT group_id, location, min(result_no) AS result_no FROM f GROUP BY 1, 2),
  sp AS (SELECT r.group_id, r.location, min(year) AS y0, max(year) AS y1 FROM r JOIN l ON l.group_id = r.group_id AND l.location = r.location AND l.result_no = r.result_no GROUP BY 1, 2),
  a AS (SELECT sp.*, s.metric_id, s.position FROM sp JOIN siblings s USING (group_id) WHERE (sp.group_id, sp.location, s.metric_id) NOT IN (SELECT (group_id, location, metric_id) FROM f)),
  e AS (SELECT * FROM u UNION ALL SELECT a.group_id, a.location, a.metric_id, a.position, x.year, x.value FROM a JOIN (SELECT metric_id, location, year, max(value) AS value FROM results GROUP BY 1, 2, 3) x
    ON x.metric_id = a.metric_id AND x.location = a.location AND x.year BETWEEN y0 AND y1)
  SELECT * FROM e WHERE (group_id, location) IN (SELECT (group_id, location) FROM e GROUP BY group_id, location HAVING count(DISTINCT metric_id) >= 2)""")
def _(spark, sf):
    r = results(spark, sf)
    asked = r.where(F.col("metric_id").isin("m0", "m4") | ((F.col("metric_id") == "m1") & (F.col("value") % 2 == 0)))
    available = r.groupBy("metric_id", "location", "year").agg(F.max("value").alias("value"))
    registry = spark.createDataFrame(
        [("risk", "m0", 1), ("risk", "m1", 2), ("risk", "m2", 3), ("solo", "m4", 1)], "group_id string, metric_id string, position int"
    )
    return P.chart_group_merge(asked.select("result_no", "metric_id", "location", "year", "value"), available, registry)


V.SQL_VIEWS["scalar_results"] = """SELECT 'm' || (s_suppkey // 3) AS metric_id, s_suppkey - CASE WHEN s_suppkey % 9 = 1 THEN 1 ELSE 0 END AS result_no, CASE WHEN (s_suppkey // 3) % 4 <> 2 THEN 'country:' || chr(CAST(65 + s_nationkey AS INTEGER)) || 'X' END AS region_key,
  'S' || s_suppkey AS label, s_acctbal AS value FROM supplier"""


@query("scalar_region_compare", """WITH p AS (SELECT metric_id, result_no, count(*) AS n FROM scalar_results GROUP BY 1, 2), k AS (SELECT metric_id FROM p GROUP BY 1 HAVING max(n) = 1 AND count(*) >= 2)
  SELECT metric_id, label AS x, value AS y FROM scalar_results WHERE metric_id IN (SELECT metric_id FROM k) AND metric_id IN (SELECT metric_id FROM scalar_results WHERE region_key IS NOT NULL)""")
def _(spark, sf):
    k = F.col("s_suppkey")
    r = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("m"), F.floor(k / 3).cast("string")).alias("metric_id"),
        (k - F.when(k % 9 == 1, 1).otherwise(0)).alias("result_no"),
        F.when(F.floor(k / 3) % 4 != 2, F.concat(F.lit("country:"), F.char(F.lit(65) + F.col("s_nationkey")), F.lit("X"))).alias("region_key"),
        F.concat(F.lit("S"), k.cast("string")).alias("label"), F.col("s_acctbal").alias("value"),
    )
    return P.scalar_region_compare(r)


_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


@query("month_span_label", f"""WITH m AS (SELECT o_custkey, o_orderpriority, list_sort(list(DISTINCT CAST(month(o_orderdate) AS INTEGER))) AS ms FROM orders GROUP BY 1, 2),
  s AS (SELECT *, list_filter(ms, lambda x: NOT list_contains(ms, ((x + 10) % 12) + 1)) AS st FROM m)
  SELECT o_custkey, o_orderpriority, CASE WHEN len(ms) = 12 THEN NULL WHEN len(ms) = 1 THEN {_MONTHS}[ms[1]] WHEN len(st) = 1 THEN {_MONTHS}[st[1]] || '–' || {_MONTHS}[((st[1] + len(ms) - 2) % 12) + 1]
    ELSE array_to_string(list_transform(ms, lambda x: {_MONTHS}[x]), ', ') END AS label FROM s""")
def _(spark, sf):
    months = V.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.collect_set(F.month("o_orderdate")).alias("ms")  # at most twelve
    )
    return months.select("o_custkey", "o_orderpriority", TX.month_span_label(F.col("ms")).alias("label"))


_METRICS = {
    "m0": {"title": "Mean", "dataset": "alpha", "provider": "cds"}, "m1": {"title": "Trend", "inputs": ["m0", "m2"]},
    "m2": {"title": "Rain", "dataset": "beta", "provider": "erddap"}, "m3": {"inputs": ["m1"]},
    "m4": {"title": "Loose", "inputs": []}, "m5": {"title": "Loop", "inputs": ["m5"]},
}
V.SQL_VIEWS["sources"] = """SELECT * FROM (VALUES ('m0', 'Mean', 'alpha', 'CDS'), ('m1', 'Trend', 'alpha', 'CDS'), ('m2', 'Rain', 'beta', 'ERDDAP'), ('m3', 'm3', 'alpha', 'CDS'),
  ('m4', 'Loose', NULL, NULL), ('m5', 'Loop', NULL, NULL)) v(metric_id, metric_title, dataset_id, provider)"""


@query("provenance_cards", """WITH p AS (SELECT chart_id, metric_id, location AS place, min(result_no) AS pos FROM results GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY chart_id, metric_id ORDER BY pos, place) AS k, count(*) OVER (PARTITION BY chart_id, metric_id) AS n FROM p),
  t AS (SELECT chart_id, metric_id, max(n) AS n, max(place) FILTER (WHERE k = 1) AS a, max(place) FILTER (WHERE k = 2) AS b FROM k GROUP BY 1, 2)
  SELECT chart_id, metric_id, metric_title, dataset_id, provider, CASE WHEN n > 2 THEN a || ' · ' || b || ' +' || (n - 2) || ' more' WHEN n = 2 THEN a || ' · ' || b ELSE a END AS places FROM t JOIN sources USING (metric_id)""")
def _(spark, sf):
    charts = results(spark, sf).select("chart_id", "metric_id", F.col("result_no").alias("position"), F.col("location").alias("place"))
    return P.provenance_cards(charts, _METRICS)


# Each document is an answer that mentions two or three places in bold; some places are listed with it already.
V.SQL_VIEWS["place_pick"] = "SELECT *, row_number() OVER (ORDER BY geonameid) - 1 AS rn, count(*) OVER () AS total FROM places"
V.SQL_VIEWS["answers"] = """SELECT d.doc_id AS answer_id, '**' || a.city_name || ', ' || a.country_name || '** and **' || b.city_name || '** ' || d.text || ' **lower ' || a.city_name || '** **Alt ' || (doc_id % 211) || '**' AS text
  FROM documents d JOIN place_pick a ON a.rn = (doc_id * 7) % a.total JOIN place_pick b ON b.rn = (doc_id * 13 + 5) % b.total"""
V.SQL_VIEWS["listed"] = "SELECT d.doc_id AS answer_id, a.label, a.alt_names, a.lat, a.lon FROM documents d JOIN place_pick a ON a.rn = (doc_id * 13 + 5 + doc_id % 3) % a.total"


def place_pick(spark, sf):
    """Places by a dense number; customer keys are dense from zero."""
    p = V.places(spark, sf)
    return p.withColumn("rn", F.col("geonameid")).join(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"))))


def answers(spark, sf):
    pick = place_pick(spark, sf)
    d = V.table(spark, sf, "documents").join(F.broadcast(pick.agg(F.max("total").alias("total"))))
    k = F.col("doc_id")
    a = pick.select(F.col("rn").alias("ra"), F.col("city_name").alias("city_a"), F.col("country_name").alias("land_a"))
    b = pick.select(F.col("rn").alias("rb"), F.col("city_name").alias("city_b"))
    j = d.join(a, F.col("ra") == (k * 7) % F.col("total")).join(b, F.col("rb") == (k * 13 + 5) % F.col("total"))
    return j.select(k.alias("answer_id"), F.concat(
        F.lit("**"), "city_a", F.lit(", "), "land_a", F.lit("** and **"), "city_b", F.lit("** "), "text",
        F.lit(" **lower "), "city_a", F.lit("** **Alt "), (k % 211).cast("string"), F.lit("**"),
    ).alias("text"))


def listed(spark, sf):
    pick = place_pick(spark, sf)
    d = V.table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id")
    d = d.join(F.broadcast(pick.agg(F.max("total").alias("t"))))
    j = d.join(pick, F.col("rn") == (k * 13 + 5 + k % 3) % F.col("t"))
    return j.select(k.alias("answer_id"), "label", "alt_names", "lat", "lon")


@query("mentions_to_places", f"""WITH m AS (SELECT answer_id, unnest(regexp_extract_all(text, '\\*\\*([^*,\\n]+?)\\*\\*', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '\\*\\*([^*,\\n]+?)\\*\\*', 1), 1) AS pos FROM answers),
  f AS (SELECT answer_id, pos, trim(split_part(trim(raw), ',', 1)) AS name FROM m),
  t AS (SELECT answer_id, {_norm('g')} AS n FROM (SELECT answer_id, unnest([split_part(label, ',', 1)] || string_split(alt_names, ',')) AS g FROM listed)),
  u AS (SELECT f.*, {_norm('name')} AS n FROM f WHERE regexp_matches(name, '^\\p{{Lu}}')),
  h AS (SELECT u.answer_id, u.pos, p.geonameid FROM u JOIN (SELECT name, geonameid FROM name_rows QUALIFY row_number() OVER (PARTITION BY name ORDER BY population DESC, geonameid) = 1) p ON p.name = u.n
     WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.answer_id = u.answer_id AND t.n = u.n)),
  k AS (SELECT h.*, label, lat, lon, round_even(round(lat * 10, 6), 0) AS ky, round_even(round(lon * 10, 6), 0) AS kx FROM h JOIN places USING (geonameid)),
  z AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.answer_id = k.answer_id AND round_even(round(l.lat * 10, 6), 0) = ky AND round_even(round(l.lon * 10, 6), 0) = kx))
  SELECT answer_id, geonameid, label, lat, lon FROM z QUALIFY row_number() OVER (PARTITION BY answer_id, ky, kx ORDER BY pos, geonameid) = 1""")
def _(spark, sf):
    return P.mentions_to_places(answers(spark, sf), listed(spark, sf), V.places(spark, sf))


V.SQL_VIEWS["shown_regions"] = """SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'continent:africa' WHEN '5-LOW' THEN 'continent:north_america' WHEN '2-HIGH' THEN 'globe' ELSE 'country:AX' END AS region_key FROM orders"""


@query("continent_bbox", """WITH c AS (SELECT o_custkey, replace(split_part(region_key, ':', 2), '_', ' ') AS continent FROM shown_regions WHERE starts_with(region_key, 'continent:')),
  o AS (SELECT o_custkey, min(continent) AS continent FROM c GROUP BY 1 HAVING count(DISTINCT continent) = 1)
  SELECT o_custkey, continent, CASE continent WHEN 'africa' THEN -20.0::DOUBLE ELSE -168.0::DOUBLE END AS west, CASE continent WHEN 'africa' THEN -35.0::DOUBLE ELSE 5.0::DOUBLE END AS south,
    CASE continent WHEN 'africa' THEN 52.0::DOUBLE ELSE -52.0::DOUBLE END AS east, CASE continent WHEN 'africa' THEN 38.0::DOUBLE ELSE 84.0::DOUBLE END AS north FROM o""")
def _(spark, sf):
    p = F.col("o_orderpriority")
    shown = V.table(spark, sf, "orders").select(
        "o_custkey", F.when(p == "1-URGENT", "continent:africa").when(p == "5-LOW", "continent:north_america")
        .when(p == "2-HIGH", "globe").otherwise("country:AX").alias("region_key"),
    )
    return P.continent_bbox(shown, ["o_custkey"])


@query("extremes_to_series", """WITH t AS (SELECT region_key FROM (SELECT region_key, avg(value) AS s FROM region_series WHERE region_type = 'country' GROUP BY 1) ORDER BY round(s, 9) DESC, region_key LIMIT 5)
  SELECT region_key, year, value FROM region_series WHERE region_key IN (SELECT region_key FROM t)""")
def _(spark, sf):
    from pyspark.sql import Window
    from gridloom.operators.points import extreme_regions

    rs = region_series(spark, sf)
    top = extreme_regions(rs, "mean", "max", 8, region_type="country")
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "region_key")))
    return P.extremes_to_series(ranked, rs, "region_key", 5).select("region_key", "year", "value")


@query("extremes_to_series_continents", "SELECT region_key, year, value FROM region_series WHERE region_type = 'continent'")
def _(spark, sf):
    from gridloom.operators.points import extreme_regions

    rs = region_series(spark, sf)
    top = extreme_regions(rs, "mean", "max", 2, region_type="continent").withColumn("rank", F.lit(1))
    every = [f"continent:{n}" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE_EAST")]
    return P.extremes_to_series(top, rs, "region_key", 5, continents=every).select("region_key", "year", "value")


@query("region_display_name", """SELECT region_key, CASE WHEN region_key = 'globe' THEN 'Global' WHEN starts_with(region_key, 'country:') THEN region_name
  ELSE array_to_string(list_transform(string_split(replace(lower(split_part(region_key, ':', 2)), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name FROM region_info""")
def _(spark, sf):
    info = region_info(spark, sf)
    country = V.countries(spark, sf).select(F.concat(F.lit("country:"), "code").alias("region_key"), F.col("name").alias("cn"))
    j = info.join(country, "region_key", "left")
    return j.select("region_key", P.region_display_name(F.col("region_key"), F.col("cn")).alias("name"))


@query("slice_time_range_years", "SELECT i_lat, i_lon, year, value FROM (SELECT *, max(year) OVER (PARTITION BY i_lat, i_lon) AS m FROM annual) WHERE year BETWEEN m - 1 - 3 + 1 AND m - 1")
def _(spark, sf):
    return P.slice_time_range(V.annual(spark, sf), ["i_lat", "i_lon"], last=(3, "years"), offset=(1, "years"), x="year")


@query("slice_time_range_points", "SELECT i_lat, i_lon, t, value FROM obs_monthly QUALIFY row_number() OVER (PARTITION BY i_lat, i_lon ORDER BY t DESC) BETWEEN 3 AND 12")
def _(spark, sf):
    return P.slice_time_range(V.obs_monthly(spark, sf), ["i_lat", "i_lon"], last=(10, "points"), offset=(2, "points"), x="t")


@query("slice_time_range_span", "SELECT i_lat, i_lon, t, value FROM (SELECT *, max(t) OVER (PARTITION BY i_lat, i_lon) AS m FROM obs_gappy) WHERE date_diff('day', t, m) - 30 BETWEEN 0 AND 180")
def _(spark, sf):
    return P.slice_time_range(V.obs_gappy(spark, sf), ["i_lat", "i_lon"], last=(6, "months"), offset=(1, "months"), x="t")
