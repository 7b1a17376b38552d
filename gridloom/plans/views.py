"""Views of the driver tables in the shape the operators expect.

Each view exists twice, as a DataFrame and as the SQL of a common table
expression, with the same columns.  Observation values are means of
integers or multiples of a quarter, so both engines agree on them exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.grid import Grid

#: One-degree grid used for the observation views, with small tiles.
TOY = Grid("toy_1deg", 1.0, 180, 360, tile_size=16)
#: Mask grid five times finer.
TOY_FINE = Grid("toy_0p2deg", 0.2, 900, 1800, tile_size=64)
#: Ten-degree dense raster grid.
RASTER = Grid("raster_10deg", 10.0, 18, 36, tile_size=8)

SQL_VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _display_rounding(sql: str) -> str:
    """Expand ``disp(expr, digits)``, the SQL form of the display rounding."""
    while (at := re.search(r"\bdisp\(", sql)) is not None:
        depth, comma, i = 1, 0, at.end()
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        expr, digits = sql[at.end():comma], int(sql[comma + 1:i - 1])
        scale = f"{10 ** digits}::DOUBLE"
        sql = sql[:at.start()] + f"(round_even(round(({expr}) * {scale}, 6), 0) / {scale})" + sql[i:]
    return sql


def with_views(body: str) -> str:
    """Prefix ``body`` with the view definitions it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"(?i)(\bfrom|\bjoin|,)\s*{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    body = _display_rounding(body)
    visit(body)
    ctes = [f"{n} AS ({_display_rounding(SQL_VIEWS[n])})" for n in needed]
    body = body.strip()
    if re.match(r"(?i)with\s+recursive\s", body):
        body = re.sub(r"(?i)^with\s+recursive\s", "", body, count=1)
        return "WITH RECURSIVE " + ", ".join(ctes + [body])
    if re.match(r"(?i)with\s", body):
        body = re.sub(r"(?i)^with\s", "", body, count=1)
        return "WITH " + ", ".join(ctes + [body]) if ctes else "WITH " + body
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


def _view(name: str, sql: str):
    SQL_VIEWS[name] = sql

    def keep(fn):
        return fn

    return keep


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session zone."""
    return (
        F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    ).cast("long")


def _supplier_cell(k: Column) -> dict[str, Column]:
    return {
        "i_lat": ((k * 7) % 180).cast("int"),
        "i_lon": ((F.floor(k / 180) * 11 + k * 13) % 360).cast("int"),
    }


_CELL_SQL = (
    "CAST((l_suppkey * 7) % 180 AS INTEGER) AS i_lat, "
    "CAST(((l_suppkey // 180) * 11 + l_suppkey * 13) % 360 AS INTEGER) AS i_lon"
)


@_view("obs_daily", f"""SELECT {_CELL_SQL}, CAST(l_shipdate AS DATE) AS t,
  floor(avg(l_quantity) * 4) / 4 AS value FROM lineitem GROUP BY 1, 2, 3""")
def obs_daily(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(
            *[c.alias(n) for n, c in _supplier_cell(F.col("l_suppkey")).items()],
            F.col("l_shipdate").cast("date").alias("t"),
            F.col("l_quantity").alias("q"),
        )
        .groupBy("i_lat", "i_lon", "t")
        .agg((F.floor(F.avg("q") * 4) / 4.0).alias("value"))
    )


@_view("obs_gappy", """SELECT i_lat, i_lon, t,
  CASE WHEN (i_lat + day(t)) % 5 <> 0 THEN value END AS value FROM obs_daily""")
def obs_gappy(spark, sf) -> DataFrame:
    """Daily observations where some rows are present but missing."""
    gap = (F.col("i_lat") + F.dayofmonth("t")) % 5 == 0
    return obs_daily(spark, sf).withColumn("value", F.when(~gap, F.col("value")))


@_view("obs_monthly", """SELECT CAST(o_custkey % 6 AS INTEGER) AS i_lat,
  CAST((o_custkey // 6) % 10 AS INTEGER) AS i_lon,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS t, avg(floor(o_totalprice / 1000)) AS value
  FROM orders GROUP BY 1, 2, 3""")
def obs_monthly(spark, sf) -> DataFrame:
    k = F.col("o_custkey")
    return (
        table(spark, sf, "orders")
        .select(
            (k % 6).cast("int").alias("i_lat"),
            (F.floor(k / 6) % 10).cast("int").alias("i_lon"),
            F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("t"),
            F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"),
        )
        .groupBy("i_lat", "i_lon", "t")
        .agg(F.avg("v").alias("value"))
    )


@_view("dhw_daily", "SELECT i_lat, i_lon, t, value / 4 AS value FROM obs_daily")
def dhw_daily(spark, sf) -> DataFrame:
    return obs_daily(spark, sf).withColumn("value", F.col("value") / 4)


@_view("annual", """SELECT i_lat, i_lon, CAST(year(t) AS INTEGER) AS year, sum(value) AS value
  FROM obs_gappy GROUP BY 1, 2, 3""")
def annual(spark, sf) -> DataFrame:
    from gridloom.operators import reducers

    return reducers.annual_sum(obs_gappy(spark, sf))


@_view("models", f"""SELECT {_CELL_SQL}, l_linenumber AS model,
  CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4""")
def models(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(
            *[c.alias(n) for n, c in _supplier_cell(F.col("l_suppkey")).items()],
            F.col("l_linenumber").alias("model"),
            F.year("l_shipdate").alias("year"),
            F.col("l_quantity").alias("q"),
        )
        .groupBy("i_lat", "i_lon", "model", "year")
        .agg(F.avg("q").alias("value"))
    )


@_view("raster", """SELECT CAST(l_partkey % 18 AS INTEGER) AS i_lat,
  CAST((l_partkey // 18) % 36 AS INTEGER) AS i_lon,
  CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 7 <> 0 THEN avg(l_quantity) END AS value
  FROM lineitem GROUP BY 1, 2""")
def raster(spark, sf) -> DataFrame:
    """A nearly dense scalar grid with holes."""
    k = F.col("l_partkey")
    return (
        table(spark, sf, "lineitem")
        .select(
            (k % 18).cast("int").alias("i_lat"),
            (F.floor(k / 18) % 36).cast("int").alias("i_lon"),
            F.col("l_quantity").alias("q"),
        )
        .groupBy("i_lat", "i_lon")
        .agg(F.when(F.sum("q").cast("long") % 7 != 0, F.avg("q")).alias("value"))
    )


@_view("mask_fine", """SELECT CAST(((l_suppkey * 7) % 180) * 5 + l_linenumber % 5 AS INTEGER) AS i_lat,
  CAST((((l_suppkey // 180) * 11 + l_suppkey * 13) % 360) * 5 + l_partkey % 5 AS INTEGER) AS i_lon,
  CAST(max(CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 25 ELSE (l_suppkey + 1) % 25 END) + 1 AS INTEGER) AS id
  FROM lineitem GROUP BY 1, 2""")
def mask_fine(spark, sf) -> DataFrame:
    """Country ids (1..25) on the grid five times finer than the observations."""
    cell = _supplier_cell(F.col("l_suppkey"))
    return (
        table(spark, sf, "lineitem")
        .select(
            (cell["i_lat"] * 5 + F.col("l_linenumber") % 5).cast("int").alias("i_lat"),
            (cell["i_lon"] * 5 + F.col("l_partkey") % 5).cast("int").alias("i_lon"),
            F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 25)
            .otherwise((F.col("l_suppkey") + 1) % 25)
            .alias("k"),
        )
        .groupBy("i_lat", "i_lon")
        .agg((F.max("k") + 1).cast("int").alias("id"))
    )


@_view("ocean_fine", """SELECT i_lat, i_lon, CAST(id % 4 + 1 AS INTEGER) AS id FROM mask_fine
  WHERE (i_lat + i_lon) % 3 = 0""")
def ocean_fine(spark, sf) -> DataFrame:
    return mask_fine(spark, sf).where((F.col("i_lat") + F.col("i_lon")) % 3 == 0).select(
        "i_lat", "i_lon", (F.col("id") % 4 + 1).cast("int").alias("id")
    )


@_view("mask_a", "SELECT DISTINCT i_lat // 5 AS i_lat, i_lon // 5 AS i_lon FROM mask_fine WHERE id % 2 = 0")
def mask_a(spark, sf) -> DataFrame:
    return _coarse_where(mask_fine(spark, sf), F.col("id") % 2 == 0)


@_view("mask_b", "SELECT DISTINCT i_lat // 5 AS i_lat, i_lon // 5 AS i_lon FROM mask_fine WHERE id % 3 = 0")
def mask_b(spark, sf) -> DataFrame:
    return _coarse_where(mask_fine(spark, sf), F.col("id") % 3 == 0)


def _coarse_where(mask: DataFrame, cond: Column) -> DataFrame:
    return mask.where(cond).select(
        F.floor(F.col("i_lat") / 5).cast("int").alias("i_lat"),
        F.floor(F.col("i_lon") / 5).cast("int").alias("i_lon"),
    ).distinct()


@_view("countries", """SELECT CAST(n_nationkey + 1 AS INTEGER) AS id,
  CASE WHEN n_nationkey <> 13 THEN chr(CAST(65 + n_nationkey AS INTEGER)) || 'X' END AS code, n_name AS name FROM nation""")
def countries(spark, sf) -> DataFrame:
    """Names of the country ids; one id has no code on purpose."""
    return table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 1).cast("int").alias("id"),
        F.when(F.col("n_nationkey") != 13, F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("X"))).alias("code"),
        F.col("n_name").alias("name"),
    )


@_view("oceans", """SELECT CAST(r_regionkey + 1 AS INTEGER) AS id, CASE WHEN r_regionkey < 3 THEN 'Océan ' || r_name || '-Sea' END AS name
  FROM region""")
def oceans(spark, sf) -> DataFrame:
    return table(spark, sf, "region").select(
        (F.col("r_regionkey") + 1).cast("int").alias("id"),
        F.when(F.col("r_regionkey") < 3, F.concat(F.lit("Océan "), F.col("r_name"), F.lit("-Sea"))).alias("name"),
    )


@_view("continent_country", """SELECT r_name AS continent,
  chr(CAST(65 + n_nationkey AS INTEGER)) || 'X' AS country_code
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def continent_country(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.col("r_name").alias("continent"),
        F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("X")).alias("country_code"),
    )


@_view("places", """SELECT c_custkey AS geonameid,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' É' || (c_custkey % 97) || ', ' || n_name AS label,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' É' || (c_custkey % 97) AS city_name,
  n_name AS country_name, chr(CAST(65 + n_nationkey AS INTEGER)) || 'X' AS country_code,
  CAST(((c_custkey * 37) % 17000) AS DOUBLE) / 100 - 85 AS lat,
  CAST(((c_custkey * 731) % 36000) AS DOUBLE) / 100 - 180 AS lon,
  CAST(greatest(0, floor(c_acctbal * 100)) AS BIGINT) AS population,
  c_custkey % 5 = 0 AS capital,
  CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN 'PPLC' WHEN 1 THEN 'PPLA' WHEN 2 THEN 'PPLA2' ELSE 'PPL' END AS feature_code,
  'Alt ' || (c_custkey % 211) || ', Øld  Näme' || (c_custkey % 13) || ', x' AS alt_names
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def places(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    city = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" É"), (k % 97).cast("string"))
    return table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        k.alias("geonameid"),
        F.concat(city, F.lit(", "), F.col("n_name")).alias("label"),
        city.alias("city_name"),
        F.col("n_name").alias("country_name"),
        F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("X")).alias("country_code"),
        (((k * 37) % 17000).cast("double") / 100 - 85).alias("lat"),
        (((k * 731) % 36000).cast("double") / 100 - 180).alias("lon"),
        F.greatest(F.lit(0), F.floor(F.col("c_acctbal") * 100)).cast("long").alias("population"),
        (k % 5 == 0).alias("capital"),
        F.when(k % 4 == 0, "PPLC").when(k % 4 == 1, "PPLA").when(k % 4 == 2, "PPLA2")
        .otherwise("PPL").alias("feature_code"),
        F.concat(F.lit("Alt "), (k % 211).cast("string"), F.lit(", Øld  Näme"),
                 (k % 13).cast("string"), F.lit(", x")).alias("alt_names"),
    )


@_view("points", """SELECT event_id AS point_id,
  CAST((event_id * 53 + user_id * 7) % 1790 AS DOUBLE) / 10 - 89.5 AS lat,
  CAST((event_id * 91 + user_id * 13) % 3700 AS DOUBLE) / 10 - 185 AS lon FROM events""")
def points(spark, sf) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        e.alias("point_id"),
        (((e * 53 + u * 7) % 1790).cast("double") / 10 - 89.5).alias("lat"),
        (((e * 91 + u * 13) % 3700).cast("double") / 10 - 185).alias("lon"),
    )


@_view("clicks", """SELECT event_id AS id,
  CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS BIGINT) AS ts,
  CAST((user_id * 53) % 150 AS DOUBLE) / 16 - 4 AS click_lat,
  CAST((event_id * 91) % 300 AS DOUBLE) / 16 - 9 AS click_lon,
  '10.0.' || (user_id % 7) || '.' || (user_id % 11) AS ip
  FROM events WHERE event_type = 'click'""")
def clicks(spark, sf) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").where("event_type = 'click'").select(
        e.alias("id"),
        epoch_seconds(F.col("ts")).alias("ts"),
        (((u * 53) % 150).cast("double") / 16 - 4).alias("click_lat"),
        (((e * 91) % 300).cast("double") / 16 - 9).alias("click_lon"),
        F.concat(F.lit("10.0."), (u % 7).cast("string"), F.lit("."), (u % 11).cast("string")).alias("ip"),
    )


@_view("sessions", """SELECT event_id AS id,
  CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS BIGINT) AS ts,
  CASE WHEN user_id % 9 <> 0 THEN chr(CAST(65 + user_id % 25 AS INTEGER)) || 'X' END AS user_country,
  CASE WHEN user_id % 9 <> 0 THEN CAST((user_id * 53) % 150 AS DOUBLE) / 4 - 20 END AS user_lat,
  CASE WHEN user_id % 9 <> 0 THEN CAST((user_id * 91) % 300 AS DOUBLE) / 4 - 30 END AS user_lon
  FROM events WHERE event_type <> 'click'""")
def sessions(spark, sf) -> DataFrame:
    u = F.col("user_id")
    known = u % 9 != 0
    return table(spark, sf, "events").where("event_type <> 'click'").select(
        F.col("event_id").alias("id"),
        epoch_seconds(F.col("ts")).alias("ts"),
        F.when(known, F.concat(F.char(F.lit(65) + u % 25), F.lit("X"))).alias("user_country"),
        F.when(known, ((u * 53) % 150).cast("double") / 4 - 20).alias("user_lat"),
        F.when(known, ((u * 91) % 300).cast("double") / 4 - 30).alias("user_lon"),
    )


@_view("messages", """SELECT 'm' || conv_id || '_' || turn AS message_id, 's' || (conv_id // 3) AS session_id,
  CAST(1700000000 + conv_id * 60 + turn * 7 AS BIGINT) AS ts, text AS question,
  CASE WHEN turn % 5 <> 4 THEN text END AS answer,
  CAST(turn % 4 AS INTEGER) AS step_count,
  '["series","rank' || (turn % 3) || '"]' AS tools_called,
  '[{"step":1,"prompt_tokens":' || length(text) || ',"completion_tokens":' || (turn * 3) || '},{"step":2,"prompt_tokens":5,"completion_tokens":null}]' AS steps_timing,
  CASE CAST((conv_id + turn) % 4 AS INTEGER) WHEN 0 THEN 'canned' WHEN 1 THEN 'templated' WHEN 2 THEN 'large' END AS tier,
  CASE CAST((conv_id * 3 + turn) % 5 AS INTEGER) WHEN 0 THEN 'good' WHEN 1 THEN 'bad' END AS feedback,
  CASE CAST((conv_id * 3 + turn) % 5 AS INTEGER) WHEN 1 THEN 'new' WHEN 2 THEN 'reviewed' END AS feedback_status,
  conv_id % 11 = 0 AS opt_out, CAST(length(text) * 10 AS BIGINT) AS total_ms,
  CASE WHEN turn % 3 = 0 THEN 'q' || (conv_id % 6) END AS question_id,
  CASE WHEN turn % 3 = 0 AND turn > 0 THEN 'q' || ((conv_id + 1) % 6) END AS parent_question_id,
  CASE WHEN conv_id % 4 <> 3 THEN 'v' || (conv_id % 2) END AS question_tree_version
  FROM conversations""")
def messages(spark, sf) -> DataFrame:
    c, n, text = F.col("conv_id"), F.col("turn"), F.col("text")
    s = lambda x: x.cast("string")
    tier = (c + n) % 4
    mood = (c * 3 + n) % 5
    chip = n % 3 == 0
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("m"), s(c), F.lit("_"), s(n)).alias("message_id"),
        F.concat(F.lit("s"), s(F.floor(c / 3))).alias("session_id"),
        (F.lit(1700000000) + c * 60 + n * 7).cast("long").alias("ts"),
        text.alias("question"),
        F.when(n % 5 != 4, text).alias("answer"),
        (n % 4).cast("int").alias("step_count"),
        F.concat(F.lit('["series","rank'), s(n % 3), F.lit('"]')).alias("tools_called"),
        F.concat(
            F.lit('[{"step":1,"prompt_tokens":'), s(F.length(text)), F.lit(',"completion_tokens":'),
            s(n * 3), F.lit('},{"step":2,"prompt_tokens":5,"completion_tokens":null}]'),
        ).alias("steps_timing"),
        F.when(tier == 0, "canned").when(tier == 1, "templated").when(tier == 2, "large").alias("tier"),
        F.when(mood == 0, "good").when(mood == 1, "bad").alias("feedback"),
        F.when(mood == 1, "new").when(mood == 2, "reviewed").alias("feedback_status"),
        (c % 11 == 0).alias("opt_out"),
        (F.length(text) * 10).cast("long").alias("total_ms"),
        F.when(chip, F.concat(F.lit("q"), s(c % 6))).alias("question_id"),
        F.when(chip & (n > 0), F.concat(F.lit("q"), s((c + 1) % 6))).alias("parent_question_id"),
        F.when(c % 4 != 3, F.concat(F.lit("v"), s(c % 2))).alias("question_tree_version"),
    )
