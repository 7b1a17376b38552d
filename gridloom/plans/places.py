"""Place search and resolution over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as TX
from gridloom.operators import masks as M, nearest as N, places as J, regrid as RGD
from gridloom.plans import views as V
from gridloom.plans.grids import vertices
from gridloom.plans.registry import query
from gridloom.plans.rounding import rounded
from gridloom.storage import work_folder


def _norm(x: str) -> str:
    # strip_accents also folds letters without a decomposition (such as an O with a stroke), which stay apart here.
    return f"trim(regexp_replace(lower(strip_accents(regexp_replace(replace({x}, 'ß', 'ss'), '[ØøŁłĐđ]', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g'))"


@query("norm_name", f"SELECT doc_id, md5({_norm('text')}) AS h, length({_norm('text')}) AS n FROM documents")
def _(spark, sf):
    n = TX.norm_name(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.md5(n).alias("h"), F.length(n).cast("long").alias("n"))


V.SQL_VIEWS["normed"] = f"SELECT *, {_norm('label')} AS norm_label, {_norm('city_name')} AS norm_city FROM places"
V.SQL_VIEWS["asked"] = """SELECT DISTINCT substr(city_name, 1 + CAST(geonameid % 4 AS INTEGER), 4 + CAST(geonameid % 5 AS INTEGER)) AS query FROM places
  UNION SELECT lang FROM documents UNION SELECT label FROM places"""


def asked(spark, sf):
    p = V.places(spark, sf)
    part = F.expr("substring(city_name, 1 + cast(geonameid % 4 as int), 4 + cast(geonameid % 5 as int))")
    return (
        p.select(part.alias("query"))
        .union(V.table(spark, sf, "documents").select("lang"))
        .union(p.select("label")).distinct()
    )


_AUTOCOMPLETE_SQL = f"""WITH q AS (SELECT query, {_norm('query')} AS q FROM asked)
  SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY population DESC, label, geonameid) AS INTEGER) AS rank, geonameid, label, population
  FROM q JOIN normed ON contains(norm_label, q) OR contains(norm_city, q) WHERE length(q) >= 3 QUALIFY rank <= 5"""


@query("autocomplete", _AUTOCOMPLETE_SQL)
def _(spark, sf):
    return J.autocomplete(asked(spark, sf), V.places(spark, sf), limit=5)


_STORED: dict = {}


def stored(name, spark, sf, make):
    """A table made from the places once per application and tables, as a deployment would keep it."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def written(spark, df):
    path = work_folder(spark, "index")
    df.write.parquet(path)
    return spark.read.parquet(path)


@query("autocomplete_stored", _AUTOCOMPLETE_SQL)
def _(spark, sf):
    index = stored("trigrams", spark, sf, lambda: written(spark, J.trigram_index(V.places(spark, sf))))
    return J.autocomplete(asked(spark, sf), V.places(spark, sf), limit=5, index=index)


@query("resolve_name_stored", f"""SELECT query, geonameid, label FROM named JOIN name_rows ON name = {_norm('query')}
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY population DESC, geonameid) = 1""")
def _(spark, sf):
    names = stored("names", spark, sf, lambda: written(spark, J.place_names(V.places(spark, sf))))
    return J.resolve_name(named(spark, sf), V.places(spark, sf), names=names)


V.SQL_VIEWS["name_rows"] = f"""SELECT DISTINCT {_norm('raw')} AS name, geonameid, label, country_code, population FROM
  (SELECT geonameid, label, country_code, population, unnest([label, city_name] || string_split(alt_names, ',')) AS raw FROM places) WHERE length({_norm('raw')}) >= 3"""
V.SQL_VIEWS["named"] = """SELECT DISTINCT city_name AS query FROM places UNION SELECT 'ALT  ' || (geonameid % 50) FROM places UNION SELECT ' øld näme' || (geonameid % 9) FROM places"""


def named(spark, sf):
    p, k = V.places(spark, sf), F.col("geonameid")
    return (
        p.select(F.col("city_name").alias("query"))
        .union(p.select(F.concat(F.lit("ALT  "), (k % 50).cast("string"))))
        .union(p.select(F.concat(F.lit(" øld näme"), (k % 9).cast("string")))).distinct()
    )


@query("resolve_name_all", f"""SELECT query, geonameid, label, country_code, population, row_number() OVER (PARTITION BY query ORDER BY population DESC, label, geonameid) AS rank
  FROM named JOIN name_rows ON name = {_norm('query')}""")
def _(spark, sf):
    return J.resolve_name_all(named(spark, sf), V.places(spark, sf))


@query("resolve_name", f"""SELECT query, geonameid, label FROM named JOIN name_rows ON name = {_norm('query')}
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY population DESC, geonameid) = 1""")
def _(spark, sf):
    return J.resolve_name(named(spark, sf), V.places(spark, sf))


V.SQL_VIEWS["place_rows"] = """SELECT geonameid, label, geonameid * 2 AS row_no FROM places
  UNION ALL SELECT geonameid - geonameid % 3, 'copy of ' || label, geonameid * 2 + 1 FROM places WHERE geonameid % 3 = 1"""


def place_rows(spark, sf):
    p, k = V.places(spark, sf), F.col("geonameid")
    copies = p.where(k % 3 == 1).select((k - k % 3).alias("geonameid"), F.concat(F.lit("copy of "), "label").alias("label"), (k * 2 + 1).alias("row_no"))
    return p.select("geonameid", "label", (k * 2).alias("row_no")).unionByName(copies)


@query("resolve_id", "SELECT geonameid, arg_max(label, row_no) AS label FROM place_rows WHERE geonameid IN (SELECT l_partkey FROM lineitem) GROUP BY 1")
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("geonameid"))
    return J.resolve_id(ids, place_rows(spark, sf))


@query("resolve_label", f"""WITH f AS (SELECT {_norm('label')} AS n, arg_min(geonameid, row_no) AS geonameid FROM place_rows GROUP BY 1),
  q AS (SELECT DISTINCT upper(label) AS query FROM places) SELECT query, geonameid FROM q JOIN f ON n = {_norm('query')}""")
def _(spark, sf):
    q = V.places(spark, sf).select(F.upper("label").alias("query"))
    return J.resolve_label(q, place_rows(spark, sf))


V.SQL_VIEWS["located"] = """SELECT query, whole, CASE WHEN contains(whole, ',') THEN trim(split_part(whole, ',', 1)) END AS part,
    CASE WHEN contains(whole, ',') THEN lower(trim(substr(whole, position(',' IN whole) + 1))) END AS qual FROM
  (SELECT query, regexp_replace(trim(query), '^\\*+|\\*+$', '', 'g') AS whole FROM (SELECT DISTINCT query FROM (SELECT '**' || city_name || '**' AS query FROM places
    UNION ALL SELECT city_name || ', ' || country_code FROM places UNION ALL SELECT city_name || ', USA' FROM places
    UNION ALL SELECT substr(city_name, 2, 6) || ', ' || country_name FROM places UNION ALL SELECT 'Nowhere ' || geonameid FROM places)))"""


def located(spark, sf):
    p, k = V.places(spark, sf), F.col("geonameid")
    join = lambda a, b: F.concat(a, F.lit(", "), b).alias("query")
    return (
        p.select(F.concat(F.lit("**"), "city_name", F.lit("**")).alias("query"))
        .union(p.select(join(F.col("city_name"), F.col("country_code"))))
        .union(p.select(F.concat("city_name", F.lit(", USA"))))
        .union(p.select(join(F.substring("city_name", 2, 6), F.col("country_name"))))
        .union(p.select(F.concat(F.lit("Nowhere "), k.cast("string"))))
    )


def _country_names() -> dict[str, str]:
    return {f"nation_{i}": f"{chr(65 + i)}X" for i in range(25)}


def _loc_auto(col: str, tier: int, stage: int) -> str:
    return f"""SELECT query, cc, geonameid, label, country_code, population, {tier} AS tier, {stage} AS stage FROM
      (SELECT l.query, l.cc, n.*, row_number() OVER (PARTITION BY l.query ORDER BY n.population DESC, n.label, n.geonameid) AS k FROM loc l
        JOIN normed n ON contains(norm_label, {col}) OR contains(norm_city, {col}) WHERE length({col}) >= 3) WHERE k <= 10"""


@query("resolve_location", f"""WITH loc AS (SELECT *, {_norm('whole')} AS nw, {_norm('part')} AS np, CASE WHEN qual = 'usa' THEN 'US' WHEN regexp_matches(qual, '^[a-z]{{2}}$') THEN upper(qual)
    WHEN qual LIKE 'nation\\_%' ESCAPE '\\' THEN chr(65 + CAST(substr(qual, 8) AS INTEGER)) || 'X' END AS cc FROM located),
  cand AS (SELECT query, cc, geonameid, label, country_code, population, 0 AS tier, 1 AS stage FROM loc JOIN name_rows ON name = nw
    UNION ALL SELECT query, cc, geonameid, label, country_code, population, 0, 2 FROM loc JOIN name_rows ON name = np
    UNION ALL {_loc_auto('l.nw', 1, 3)} UNION ALL {_loc_auto('l.np', 2, 4)})
  SELECT query, geonameid, label FROM cand QUALIFY row_number() OVER (PARTITION BY query
    ORDER BY tier, NOT coalesce(country_code = cc, false), stage, population DESC, label, geonameid) = 1""")
def _(spark, sf):
    return J.resolve_location(located(spark, sf), V.places(spark, sf), _country_names())


_HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2), 1)))"
_NEAREST_SQL = f"""WITH d AS (SELECT p.lat, p.lon, q.geonameid, round({_HAV}, 6) AS r, {_HAV} AS km FROM (SELECT DISTINCT lat, lon FROM points) p, places q),
  b AS (SELECT lat, lon, min(r) AS r FROM d GROUP BY 1, 2),
  n AS (SELECT d.lat, d.lon, min(d.geonameid) AS geonameid, min(d.km) AS km FROM d JOIN b ON b.lat = d.lat AND b.lon = d.lon AND b.r = d.r GROUP BY 1, 2)
  SELECT point_id, geonameid, disp(km, 4) AS distance_km FROM points JOIN n USING (lat, lon)"""


@query("nearest_place", _NEAREST_SQL)
def _(spark, sf):
    return rounded(N.nearest_place(V.points(spark, sf), V.places(spark, sf)), "distance_km", digits=4)


@query("nearest_place_stored", _NEAREST_SQL)
def _(spark, sf):
    index = stored("nearest", spark, sf, lambda: N.build_index(V.places(spark, sf)))
    return rounded(N.nearest_place(V.points(spark, sf), V.places(spark, sf), index=index), "distance_km", digits=4)


V.SQL_VIEWS["spots"] = """SELECT point_id, p.lat, p.lon, c.code AS country_code, o.id AS ocean_id, n.name AS ocean_name FROM
   (SELECT point_id, lat, lon, CAST(floor((90 - lat) / 10) AS INTEGER) AS r, CAST(floor((lon + 180) / 10) AS INTEGER) AS k FROM
     (SELECT event_id AS point_id, CAST((event_id * 37 + user_id) % 1700 AS DOUBLE) / 10 - 84.95::DOUBLE AS lat, CAST((event_id * 731 + user_id * 3) % 3600 AS DOUBLE) / 10 - 179.95::DOUBLE AS lon FROM events)) p
   LEFT JOIN (SELECT i_lat, i_lon, max(CASE WHEN value > 25.4 THEN 1 + CAST(floor(value * 100) AS BIGINT) % 27 END) AS id FROM raster GROUP BY 1, 2) m ON m.i_lat = r AND m.i_lon = k
   LEFT JOIN (SELECT i_lat, i_lon, max(CASE WHEN value < 25.3 THEN 1 + CAST(floor(value * 100) AS BIGINT) % 5 END) AS id FROM raster GROUP BY 1, 2) o ON o.i_lat = r AND o.i_lon = k
   LEFT JOIN land c ON c.id = m.id LEFT JOIN oceans n ON n.id = o.id"""
V.SQL_VIEWS["land"] = "SELECT id, code, name FROM countries UNION ALL SELECT 26, 'ZZ', 'Emptyland' UNION ALL SELECT 27, 'YY', 'Void'"


def land(spark, sf):
    extra = spark.range(2).select(
        (F.col("id") + 26).cast("int").alias("id"), F.when(F.col("id") == 0, "ZZ").otherwise("YY").alias("code"),
        F.when(F.col("id") == 0, "Emptyland").otherwise("Void").alias("name"),
    )
    return V.countries(spark, sf).unionByName(extra)


def spots(spark, sf):
    """Points with the country and ocean of a coarse label raster."""
    e, u = F.col("event_id"), F.col("user_id")
    pts = V.table(spark, sf, "events").select(
        e.alias("point_id"), (((e * 37 + u) % 1700).cast("double") / 10 - 84.95).alias("lat"),
        (((e * 731 + u * 3) % 3600).cast("double") / 10 - 179.95).alias("lon"),
    )
    v = F.col("value")
    code = F.floor(v * 100)
    r = V.raster(spark, sf)
    ground = r.where(v > 25.4).select("i_lat", "i_lon", (code % 27 + 1).cast("int").alias("id"))
    water = r.where(v < 25.3).select("i_lat", "i_lon", (code % 5 + 1).cast("int").alias("id"))
    p = M.classify_points(pts, ground, land(spark, sf), V.RASTER, "country", ("code",))
    return M.classify_points(p, water, V.oceans(spark, sf), V.RASTER, "ocean", ("name",)).drop("country_id")


@query("resolve_place", f"""WITH loc AS (SELECT DISTINCT lat, lon, country_code FROM spots),
  d AS (SELECT p.lat, p.lon, p.country_code, q.geonameid, q.country_code AS qc, round({_HAV}, 6) AS r, {_HAV} AS km FROM loc p, places q),
  own AS (SELECT lat, lon, country_code, geonameid, km FROM d WHERE qc = country_code AND r <= 100 QUALIFY row_number() OVER (PARTITION BY lat, lon, country_code ORDER BY r, geonameid) = 1),
  anyw AS (SELECT lat, lon, geonameid, km FROM d QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY r, geonameid) = 1),
  j AS (SELECT s.*, coalesce(own.geonameid, anyw.geonameid) AS gid, coalesce(own.km, anyw.km) AS km FROM spots s
    LEFT JOIN own ON own.lat = s.lat AND own.lon = s.lon AND own.country_code = s.country_code JOIN anyw ON anyw.lat = s.lat AND anyw.lon = s.lon),
  k AS (SELECT j.*, q.label AS city, q.country_code AS pcc, q.population AS pop, (SELECT name FROM land WHERE code = j.country_code) AS cname,
      j.country_code IN (SELECT country_code FROM places) AS inhabited, j.country_code IS NULL AND ocean_id IS NOT NULL AS wet FROM j JOIN places q ON q.geonameid = gid)
  SELECT point_id, gid AS geonameid, CASE WHEN wet AND km <= 2 THEN city WHEN wet AND km <= 80 THEN coalesce(ocean_name, 'Open Ocean') || ' off ' || city
      WHEN wet THEN coalesce(ocean_name, 'Open Ocean') WHEN country_code IS NOT NULL AND NOT inhabited THEN coalesce(cname, city) ELSE city END AS label,
    disp(km, 4) AS distance_km, pcc AS country_code, CASE WHEN NOT wet AND pop > 0 THEN pop END AS population FROM k""")
def _(spark, sf):
    names = land(spark, sf).select("code", "name")
    return rounded(N.resolve_place(spots(spark, sf), V.places(spark, sf), names), "distance_km", digits=4)


# Places with copies at the same position under other ids and populations.
V.SQL_VIEWS["raw_places"] = """SELECT geonameid, label, city_name, country_code, lat, lon, population, feature_code, geonameid % 6 AS alias_count FROM places
  UNION ALL SELECT geonameid + 10000000, upper(label), upper(city_name), country_code, lat, lon, population - population % 2, CASE WHEN geonameid % 2 = 0 THEN 'PPLC' ELSE 'PPLX' END, geonameid % 4 FROM places WHERE geonameid % 3 <> 1
  UNION ALL SELECT geonameid + 20000000, label, city_name, country_code, lat + 0.5::DOUBLE, lon, population, 'PPL', geonameid % 9 FROM places WHERE geonameid % 4 = 0"""


def raw_places(spark, sf):
    p, k = V.places(spark, sf), F.col("geonameid")
    cols = ["geonameid", "label", "city_name", "country_code", "lat", "lon", "population", "feature_code", "alias_count"]
    a = p.withColumn("alias_count", k % 6).select(*cols)
    b = p.where(k % 3 != 1).withColumns({
        "alias_count": k % 4, "label": F.upper("label"), "city_name": F.upper("city_name"),
        "population": F.col("population") - F.col("population") % 2,
        "feature_code": F.when(k % 2 == 0, "PPLC").otherwise("PPLX"),
    }).withColumn("geonameid", k + 10000000).select(*cols)
    c = p.where(k % 4 == 0).withColumns({
        "alias_count": k % 9, "lat": F.col("lat") + 0.5, "feature_code": F.lit("PPL"),
    }).withColumn("geonameid", k + 20000000).select(*cols)
    return a.unionByName(b).unionByName(c)


_FR = "CASE feature_code WHEN 'PPLC' THEN 0 WHEN 'PPLA' THEN 1 WHEN 'PPLA2' THEN 2 WHEN 'PPLA3' THEN 3 WHEN 'PPLA4' THEN 4 ELSE 9 END"


@query("dedupe_places", f"""SELECT * FROM raw_places QUALIFY row_number() OVER (PARTITION BY {_norm('city_name')}, country_code, round(lat, 5), round(lon, 5)
  ORDER BY population DESC, {_FR}, geonameid) = 1""")
def _(spark, sf):
    return J.dedupe_places(raw_places(spark, sf))


@query("dedupe_label", f"SELECT * FROM raw_places QUALIFY row_number() OVER (PARTITION BY label ORDER BY population DESC, alias_count DESC, {_FR}, geonameid) = 1")
def _(spark, sf):
    return J.dedupe_label(raw_places(spark, sf))


V.SQL_VIEWS["towns"] = """SELECT s_suppkey * 100 + p_partkey % 100 AS geonameid, p_name AS name, CASE CAST(s_nationkey % 3 AS INTEGER) WHEN 0 THEN 'US' WHEN 1 THEN 'FR' ELSE chr(CAST(65 + s_nationkey AS INTEGER)) || 'X' END AS cc,
    CASE WHEN p_size % 5 = 0 THEN '' ELSE 'A' || (p_size % 4) END AS admin1, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'D' || (p_size % 9) END AS admin2
  FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)"""
V.SQL_VIEWS["first_level"] = "SELECT DISTINCT cc || '.' || admin1 AS key, 'Region ' || admin1 AS name FROM towns WHERE admin1 NOT IN ('', 'A3')"
V.SQL_VIEWS["second_level"] = "SELECT DISTINCT cc || '.' || admin1 || '.' || admin2 AS key, 'County ' || admin2 AS name FROM towns WHERE admin1 <> '' AND admin2 NOT IN ('', 'D2')"


def towns(spark, sf):
    s = V.table(spark, sf, "supplier")
    p = V.table(spark, sf, "part").join(F.broadcast(s.agg(F.count(F.lit(1)).alias("n"))))
    j = p.join(s, F.col("s_suppkey") == F.col("p_partkey") % F.col("n"))
    n, size = F.col("s_nationkey"), F.col("p_size")
    return j.select(
        (F.col("s_suppkey") * 100 + F.col("p_partkey") % 100).alias("geonameid"), F.col("p_name").alias("name"),
        F.when(n % 3 == 0, "US").when(n % 3 == 1, "FR").otherwise(F.concat(F.char(F.lit(65) + n), F.lit("X"))).alias("cc"),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("A"), (size % 4).cast("string"))).alias("admin1"),
        F.when(size % 7 == 0, "").otherwise(F.concat(F.lit("D"), (size % 9).cast("string"))).alias("admin2"),
    )


@query("disambiguate_label", f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY cc, CASE WHEN cc = 'US' THEN admin1 ELSE '' END, {_norm('name')}) AS k,
    (SELECT any_value(a.name) FROM first_level a WHERE a.key = cc || '.' || admin1 AND admin1 <> '') AS a1,
    (SELECT any_value(a.name) FROM second_level a WHERE a.key = cc || '.' || admin1 || '.' || admin2 AND admin1 <> '' AND admin2 <> '') AS a2,
    coalesce((SELECT any_value(c.name) FROM countries c WHERE c.code = cc), cc) AS country FROM towns)
  SELECT geonameid, name, cc, admin1, admin2, CASE WHEN cc = 'US' AND admin1 = '' THEN name || ', USA'
    WHEN cc = 'US' AND k > 1 AND a2 IS NOT NULL THEN name || ' (' || a2 || '), ' || admin1 || ', USA' WHEN cc = 'US' THEN name || ' ' || admin1 || ', USA'
    WHEN cc = 'FR' AND k > 1 AND a2 IS NOT NULL THEN name || ', ' || a2 || ', ' || country WHEN cc <> 'FR' AND k > 1 AND a1 IS NOT NULL THEN name || ', ' || a1 || ', ' || country
    ELSE name || ', ' || country END AS label FROM n""")
def _(spark, sf):
    t = towns(spark, sf)
    a1 = t.where(~F.col("admin1").isin("", "A3")).select(
        F.concat_ws(".", "cc", "admin1").alias("key"), F.concat(F.lit("Region "), "admin1").alias("name")).distinct()
    a2 = t.where((F.col("admin1") != "") & ~F.col("admin2").isin("", "D2")).select(
        F.concat_ws(".", "cc", "admin1", "admin2").alias("key"), F.concat(F.lit("County "), "admin2").alias("name")).distinct()
    return J.disambiguate_labels(t, a1, a2, V.countries(spark, sf).select("code", "name"))


V.SQL_VIEWS["index_rows"] = """SELECT CASE WHEN geonameid % 5 = 0 THEN 2000000000 + geonameid % 37 ELSE geonameid END AS geonameid, label, city_name, country_name, country_code, lat, lon, population, feature_code, alt_names FROM places"""


def index_rows(spark, sf):
    k = F.col("geonameid")
    return V.places(spark, sf).withColumn("geonameid", F.when(k % 5 == 0, F.lit(2000000000) + k % 37).otherwise(k)).select(
        "geonameid", "label", "city_name", "country_name", "country_code", "lat", "lon", "population", "feature_code", "alt_names"
    )


@query("append_marine", """WITH m AS (SELECT norm_name, name FROM vertices QUALIFY row_number() OVER (PARTITION BY norm_name ORDER BY length(name) DESC, feature_order) = 1),
  f AS (SELECT i AS id, row_number() OVER (ORDER BY i) AS n FROM range(2000000000, 2000000200) r(i) WHERE i NOT IN (SELECT geonameid FROM index_rows)),
  k AS (SELECT name, row_number() OVER (ORDER BY norm_name) AS n FROM m)
  SELECT geonameid, label, country_code, population, feature_code FROM index_rows UNION ALL SELECT id, name, 'OC', 0, 'MARINE' FROM k JOIN f USING (n)""")
def _(spark, sf):
    marine = RGD.circular_centroids(vertices(spark, sf))
    out = J.append_marine(index_rows(spark, sf), marine)
    return out.select("geonameid", "label", "country_code", "population", "feature_code")


@query("name_case", """SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_transform(regexp_extract_all(upper(source || '-' || lang || ' o''x'), '[A-Z]+|[^A-Z]+'), lambda w: w[1] || lower(w[2:])), '')
  ELSE source || '-' || lang || ' o''x' END AS label FROM documents""")
def _(spark, sf):
    raw = F.concat("source", F.lit("-"), "lang", F.lit(" o'x"))
    given = F.when(F.col("doc_id") % 2 == 0, F.upper(raw)).otherwise(raw)
    return V.table(spark, sf, "documents").select("doc_id", "source", TX.title_if_upper(given).alias("label"))


@query("country_name_overrides", """SELECT id, code, CASE code WHEN 'AX' THEN 'First' WHEN 'CX' THEN 'Third' ELSE name END AS name FROM countries""")
def _(spark, sf):
    o = spark.createDataFrame([("AX", "First"), ("CX", "Third"), ("QQ", "None")], "code string, name string")
    return J.apply_name_overrides(V.countries(spark, sf), o).select("id", "code", "name")


@query("resolve_continent", """WITH q AS (SELECT DISTINCT x AS query FROM (SELECT ' ' || lower(r_name) || ' ' AS x FROM region UNION ALL SELECT 'orient' UNION ALL SELECT lang FROM documents))
  SELECT query, continent, country_code FROM q JOIN continent_country ON lower(continent) = CASE trim(query) WHEN 'orient' THEN 'asia' ELSE lower(trim(query)) END""")
def _(spark, sf):
    q = (
        V.table(spark, sf, "region").select(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" ")).alias("query"))
        .union(spark.range(1).select(F.lit("orient"))).union(V.table(spark, sf, "documents").select("lang"))
    )
    return J.resolve_continents(q, V.continent_country(spark, sf), {"orient": "Asia"})


@query("is_sovereign", "SELECT geonameid, country_code NOT IN ('AX', 'BX', 'QX') AS sovereign FROM places")
def _(spark, sf):
    from gridloom.operators.points import is_sovereign

    return V.places(spark, sf).select("geonameid", is_sovereign(F.col("country_code"), ["AX", "BX", "QX"]).alias("sovereign"))
