"""Panel and chart tables: long rows in, long or wide rows out.

Panel, graph and series specifications are short Python lists; they become
column expressions or tiny literal tables, never data frames of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.functions.text import norm_name
from gridloom.functions.units import convert_unit
from gridloom.grid import Grid, cell_of
from gridloom.operators.places import resolve_name

MISSING = "No chart: a series has no values here."


def series_key(spec: dict) -> str:
    """Explicit key, else the metric with its transform's name."""
    if spec.get("key"):
        return spec["key"]
    fn = (spec.get("transform") or {}).get("fn")
    return f"{spec['metric']}_{fn}" if fn else spec["metric"]


def _chart_rows(rows: DataFrame, keys: list[str], specs: list[tuple[str, dict]], unit: str, tag: str) -> DataFrame:
    """(keys, tag, series_key, x, y, unit) of all (tag, series) pairs in one pass over ``rows``.

    The series of a (key, metric) is one axis long, so one window over it yields every rolling mean and the fitted line;
    the specs are a literal list that each row unfolds into.
    """
    def transform(spec: dict) -> tuple[str, dict]:
        t = spec.get("transform") or {}
        if t.get("fn") not in (None, "rolling_mean", "linear_trend_line"):
            raise ValueError(f"unknown transform: {t['fn']}")
        return t.get("fn") or "", t.get("params", {})

    whole = Window.partitionBy(*keys, "metric_id")
    made = {"value": F.col("value")}
    listed = []
    for name, spec in specs:
        fn, params = transform(spec)
        column = "value"
        if fn == "rolling_mean":
            half = int(params.get("window", 5)) // 2
            column = f"__roll{half}"
            w = whole.orderBy("x").rowsBetween(-half, half)
            made[column] = F.when(F.count(F.lit(1)).over(w) == 2 * half + 1, F.avg("value").over(w))
        elif fn == "linear_trend_line":
            column = "__line"
            made["__b"], made["__a"] = F.regr_slope("value", "x").over(whole), F.regr_intercept("value", "x").over(whole)
            made["__last"] = F.max("x").over(whole)
        given = (spec.get("unit") or "").upper()
        listed.append(F.struct(
            F.lit(name).alias("tag"), F.lit(spec["metric"]).alias("metric"), F.lit(spec.get("aggregation", "mean")).alias("aggregation"),
            F.lit(series_key(spec)).alias("series_key"), F.lit(column).alias("column"), F.lit(given).alias("given"),
            F.lit(unit if given in ("C", "F") else spec.get("unit") or unit).alias("unit"),
            F.lit(params.get("extend_to") if fn == "linear_trend_line" else None).cast("double").alias("extend_to"),
        ))
    base = rows.where(F.col("metric_id").isin(*{spec["metric"] for _, spec in specs}))
    base = base.withColumns({c: v for c, v in made.items() if c != "value"}).withColumn("s", F.explode(F.array(*listed)))
    mine = F.col("s.metric") == F.col("metric_id")
    if "aggregation" in keys:
        mine = mine & (F.col("s.aggregation") == F.col("aggregation"))
    y = F.col("value")
    for column in made:
        if column.startswith("__roll"):
            y = F.when(F.col("s.column") == column, F.col(column)).otherwise(y)
    points = F.array(F.struct(F.col("x").alias("x"), y.alias("y")))
    if "__b" in made:
        x_type = rows.schema["x"].dataType
        line = lambda x: F.struct(x.alias("x"), (F.col("__a") + F.col("__b") * x).alias("y"))
        more = (F.col("x") == F.col("__last")) & (F.col("s.extend_to") > F.col("__last"))
        fitted = F.when(more, F.array(line(F.col("x")), line(F.col("s.extend_to").cast(x_type)))).otherwise(F.array(line(F.col("x"))))
        points = F.when(F.col("s.column") == "__line", fitted).otherwise(points)
    out = base.where(mine).select(*keys, "s", F.inline(points))
    shown = F.when(F.col("s.given") == "C", convert_unit(F.col("y"), "C", unit)).when(
        F.col("s.given") == "F", convert_unit(F.col("y"), "F", unit)).otherwise(F.col("y"))
    return out.select(*keys, F.col("s.tag").alias(tag), F.col("s.series_key").alias("series_key"), "x", shown.alias("y"), F.col("s.unit").alias("unit"))


def panel_series(points: DataFrame, rows: DataFrame, graphs: dict[str, list[dict]], unit: str = "C") -> DataFrame:
    """Chart rows of every point and graph.

    ``rows`` are (point_id, metric_id, x, value).  A graph with any missing
    series is replaced by one row that carries the error.
    """
    wanted = {g: [s for s in specs if not s.get("global_only")] for g, specs in graphs.items()}
    data = _chart_rows(rows, ["point_id"], [(g, s) for g, specs in wanted.items() for s in specs], unit, "graph_id")
    # Whether a series exists depends on its metric only, so a small presence
    # table decides it before any chart row is touched.
    have = rows.select("point_id", "metric_id").distinct().groupBy("point_id").agg(
        F.collect_set("metric_id").alias("metrics")  # no more than the registered metrics
    )
    need = F.array(*[
        F.struct(F.lit(g).alias("graph_id"), F.array(*[F.lit(s["metric"]) for s in specs]).alias("need"))
        for g, specs in wanted.items()
    ])
    status = points.select("point_id").join(have, "point_id", "left").select(
        "point_id", "metrics", F.inline(need)
    ).withColumn(
        "ok", F.forall("need", lambda m: F.coalesce(F.array_contains("metrics", m), F.lit(False)))
    )
    good = status.where("ok").select("point_id", "graph_id")
    shown = data.join(good, ["point_id", "graph_id"], "left_semi").withColumn("error", F.lit(None).cast("string"))
    failed = status.where(~F.col("ok")).select("point_id", "graph_id", F.lit(MISSING).alias("error"))
    return shown.unionByName(failed, allowMissingColumns=True)


def score_lookup(points: DataFrame, scores: DataFrame | None, grid: Grid, constant: int | None = None) -> DataFrame:
    """Score 0..4 of the cell under each point, or of a constant map."""
    clamp = lambda s: F.least(F.greatest(s, F.lit(0)), F.lit(4)).cast("int")
    if constant is not None:
        return points.select("point_id", clamp(F.lit(constant)).alias("score"))
    at = points.select("point_id", *[c.alias(n) for n, c in cell_of(F.col("lat"), F.col("lon"), grid).items()])
    return at.join(scores, CELL, "left").select("point_id", clamp(F.coalesce("score", F.lit(0))).alias("score"))


def rank_panels(scores: DataFrame) -> DataFrame:
    """Panels of a point by score, registry order on ties; score 0 is a stub.

    ``scores`` are (point_id, panel_id, panel_order, score), a few per point.
    """
    w = Window.partitionBy("point_id").orderBy(F.desc("score"), "panel_order")
    return scores.select(
        "point_id", "panel_id", "score", F.row_number().over(w).alias("rank"), (F.col("score") <= 0).alias("stub")
    )


def global_panel_series(region_series: DataFrame, panels: dict[str, list[dict]], unit: str = "C") -> DataFrame:
    """Globe rows (metric_id, aggregation, x, value) per panel; panels without series vanish."""
    globe = region_series.where(F.col("region_key") == "globe")
    specs = [(panel, s) for panel, listed in panels.items() for s in listed]
    return _chart_rows(globe, ["aggregation"], specs, unit, "panel_id").drop("aggregation")


def caption_facts(rows: DataFrame, keys: list[str], lat: str = "lat") -> DataFrame:
    """First and last year, span, last minus first present value, hemisphere."""
    v, year = F.col("value"), F.col("year")
    present = F.when(v.isNotNull(), year)
    change = F.max_by("value", present) - F.min_by("value", present)
    return rows.groupBy(*keys).agg(
        F.min("year").alias("start_year"), F.max("year").alias("end_year"),
        (F.max("year") - F.min("year")).alias("span_years"),
        F.when(F.count("value") >= 2, change).alias("total_change"),
        F.when(F.max(lat) >= 0, "N").otherwise("S").alias("hemisphere"),
    )


def merge_series_wide(rows: DataFrame, group: list[str], series_keys: list[str], order: str | None = None) -> DataFrame:
    """One row per x with a column per series; sort by x as text.

    Of several values the one with the greatest ``order`` counts, else the greatest value.
    """
    chosen = F.max_by("y", order) if order else F.max("y")
    return rows.groupBy(*group, F.col("x").cast("string").alias("x")).pivot("series_key", series_keys).agg(chosen)


def prefer_explicit(results: DataFrame) -> DataFrame:
    """Drop rows that ignored their month filter, and automatic rows of metrics asked for explicitly."""
    kept = results.where(~F.coalesce("month_filter_ignored", F.lit(False)))
    explicit = kept.where(F.col("source") == "explicit").select("metric_id").distinct()
    auto = kept.where(F.col("source") == "auto").join(explicit, "metric_id", "left_anti")
    return kept.where(~F.coalesce(F.col("source") == "auto", F.lit(False))).unionByName(auto)


def dedupe_latest(results: DataFrame, keys: list[str], order: str = "result_no") -> DataFrame:
    """Last result of each key as a mergeable aggregate."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def chart_group_merge(requested: DataFrame, available: DataFrame, registry: DataFrame) -> DataFrame:
    """Sibling metrics of a chart group side by side per location.

    ``requested`` are (result_no, metric_id, location, year, value).  Absent
    siblings come from ``available`` over the years of the first result;
    groups that end with a single metric are left out.
    """
    r = requested.join(registry, "metric_id")
    place = ["group_id", "location"]
    firsts = r.groupBy(*place, "metric_id").agg(F.min("result_no").alias("result_no"))
    unique = r.join(firsts, [*place, "metric_id", "result_no"])
    lead = firsts.groupBy(*place).agg(F.min("result_no").alias("result_no"))
    span = r.join(lead, [*place, "result_no"]).groupBy(*place).agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    absent = span.join(registry, "group_id").join(firsts, [*place, "metric_id"], "left_anti")
    fetched = absent.join(available, ["metric_id", "location"]).where(F.col("year").between(F.col("y0"), F.col("y1")))
    cols = [*place, "metric_id", "position", "year", "value"]
    every = unique.select(*cols).unionByName(fetched.select(*cols))
    enough = every.select(*place, "metric_id").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return every.join(enough, place, "left_semi")


def scalar_region_compare(results: DataFrame) -> DataFrame:
    """Metrics whose region results all have one point, when there are at least two."""
    per = results.groupBy("metric_id", "result_no").agg(F.count(F.lit(1)).alias("n"))
    ok = per.groupBy("metric_id").agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("k")).where("m = 1 AND k >= 2")
    region = results.where(F.col("region_key").isNotNull()).select("metric_id").distinct()
    return results.join(ok, "metric_id", "left_semi").join(region, "metric_id", "left_semi").select(
        "metric_id", F.col("label").alias("x"), F.col("value").alias("y")
    )


def dataset_sources(metrics: dict[str, dict]) -> dict[str, tuple[str | None, str | None]]:
    """(dataset, provider) of every metric of a registry; a derived metric has those of its first input.

    Answers spread from the metrics that name a dataset, and from those that lead nowhere, to the metrics built on
    them.  Where first inputs form a ring, a member leaves it by its next input that has an answer.
    """
    found: dict[str, tuple[str | None, str | None]] = {}
    for name, spec in metrics.items():
        if spec.get("dataset"):
            found[name] = (spec["dataset"], (spec.get("provider") or "").upper() or None)
        elif not [i for i in spec.get("inputs", []) if i != name]:
            found[name] = (None, None)
    for reach in (1, None):
        spreading = True
        while spreading:
            ready = {
                name: answers[0] for name, spec in metrics.items() if name not in found
                and (answers := [found.get(i, (None, None)) for i in [x for x in spec["inputs"] if x != name][:reach]
                                 if i in found or i not in metrics])
            }
            found |= ready
            spreading = bool(ready)
    return {name: found.get(name, (None, None)) for name in metrics}


def provenance_cards(charts: DataFrame, metrics: dict[str, dict]) -> DataFrame:
    """One card per chart and metric: dataset, title and at most two places.

    ``charts`` are (chart_id, metric_id, position, place).  The lineage of the
    registry resolves on the driver; places are ranked by first appearance.
    """
    known = [(m, *source, metrics[m].get("title") or m) for m, source in dataset_sources(metrics).items()]
    lineage = charts.sparkSession.createDataFrame(
        known, "metric_id string, dataset_id string, provider string, metric_title string"
    )
    card = ["chart_id", "metric_id"]
    places = charts.where(F.coalesce(F.col("place") != "", F.lit(False))).groupBy(*card, "place").agg(
        F.min("position").alias("position")
    )
    w = Window.partitionBy(*card).orderBy("position", "place")
    top = places.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 2)
    named = top.groupBy(*card).agg(
        F.max(F.when(F.col("k") == 1, F.col("place"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("place"))).alias("b")
    )
    counts = places.groupBy(*card).agg(F.count(F.lit(1)).alias("n"))
    text = (
        F.when(F.col("n") > 2, F.concat("a", F.lit(" · "), "b", F.lit(" +"), (F.col("n") - 2).cast("string"), F.lit(" more")))
        .otherwise(F.concat_ws(" · ", "a", "b"))
    )
    cards = charts.select(*card).distinct().join(lineage, "metric_id")
    return cards.join(counts, card, "left").join(named, card, "left").select(
        *card, "metric_title", "dataset_id", "provider", F.when(F.col("n") > 0, text).alias("places")
    )


def mentions_to_places(answers: DataFrame, listed: DataFrame, places: DataFrame) -> DataFrame:
    """Places named in bold in an answer that are not listed with it already.

    ``answers`` are (answer_id, text), ``listed`` (answer_id, label,
    alt_names, lat, lon).  One place per tenth of a degree and answer.
    """
    bold = F.regexp_extract_all("text", F.lit(r"\*\*([^*,\n]+?)\*\*"), F.lit(1))
    found = answers.select("answer_id", F.posexplode(bold).alias("at", "raw")).select(
        "answer_id", "at", F.trim(F.substring_index(F.trim("raw"), ",", 1)).alias("name")
    ).where(F.col("name").rlike(r"^\p{Lu}")).withColumn("n", norm_name(F.col("name")))
    given = F.concat(F.array(F.substring_index("label", ",", 1)), F.split(F.coalesce("alt_names", F.lit("")), ","))
    taken = listed.select("answer_id", F.explode(given).alias("g")).select("answer_id", norm_name(F.col("g")).alias("n"))
    fresh = found.join(taken.where("n <> ''").distinct(), ["answer_id", "n"], "left_anti")
    hit = resolve_name(fresh.select("name"), places, "name")
    tenth = [F.rint(F.round(F.col(c) * 10, 6)).cast("int").alias(k) for c, k in (("lat", "ky"), ("lon", "kx"))]
    at = fresh.join(hit, "name").join(places.select("geonameid", "lat", "lon"), "geonameid").select("*", *tenth)
    there = listed.select("answer_id", *tenth).distinct()
    first = at.join(there, ["answer_id", "ky", "kx"], "left_anti").groupBy("answer_id", "ky", "kx").agg(
        F.min_by(F.struct("geonameid", "label", "lat", "lon"), F.struct("at", "geonameid")).alias("p")
    )
    return first.select("answer_id", "p.*")


# Map boxes of the continents as west, south, east, north.
CONTINENT_BOXES = {
    "africa": (-20.0, -35.0, 52.0, 38.0),
    "antarctica": (-180.0, -90.0, 180.0, -60.0),
    "asia": (25.0, -10.0, 180.0, 82.0),
    "europe": (-25.0, 34.0, 45.0, 72.0),
    "north america": (-168.0, 5.0, -52.0, 84.0),
    "oceania": (110.0, -50.0, 180.0, 10.0),
    "south america": (-82.0, -57.0, -33.0, 15.0),
}


def continent_bbox(results: DataFrame, keys: list[str]) -> DataFrame:
    """Box to show when the results name exactly one continent."""
    name = F.replace(F.substring_index("region_key", ":", -1), F.lit("_"), F.lit(" "))
    one = results.where(F.col("region_key").startswith("continent:")).groupBy(*keys).agg(
        F.min(name).alias("continent"), F.max(name).alias("other")
    ).where(F.col("continent") == F.col("other")).drop("other")
    boxes = results.sparkSession.createDataFrame(
        [(k, *v) for k, v in CONTINENT_BOXES.items()], "continent string, west double, south double, east double, north double"
    )
    return one.join(boxes, "continent")


def extremes_to_series(top: DataFrame, series: DataFrame, key: str, limit: int = 5,
                       continents: list[str] | None = None) -> DataFrame:
    """Series of the first results; a result of only continents shows every continent.

    ``top`` has ``key`` and rank and holds at most the asked number of rows.
    """
    first = top.where(F.col("rank") <= limit).select(key)
    if continents is None:
        return series.join(first, key, "left_semi")
    only = first.agg(F.bool_and(F.col(key).startswith("continent:")).alias("__all"))
    marked = series.join(first.withColumn("__hit", F.lit(True)), key, "left").join(F.broadcast(only))
    keep = F.when(F.col("__all"), F.col(key).isin(*continents)).otherwise(F.coalesce("__hit", F.lit(False)))
    return marked.where(keep).select(*series.columns)


def region_display_name(key: Column, country_name: Column) -> Column:
    """Readable form of a region key; ``country_name`` is the joined name or NULL."""
    rest = F.substring_index(key, ":", -1)
    return (
        F.when(key == "globe", "Global").when(F.instr(key, ":") == 0, key)
        .when(key.startswith("country:") & (F.length(rest) <= 3), F.coalesce(country_name, F.upper(rest)))
        .otherwise(F.initcap(F.replace(rest, F.lit("_"), F.lit(" "))))
    )


_DAYS = {"days": 1.0, "months": 30.0, "years": 365.25}


def slice_time_range(rows: DataFrame, keys: list[str], last: tuple[int, str] | None = None,
                     offset: tuple[int, str] | None = None, start=None, end=None, x: str = "x") -> DataFrame:
    """Rows of a time range: between two ends, or the last N points or span, shifted back by an offset.

    ``x`` is a year number or a DATE.  Each key is one series along an axis.
    """
    col = F.col(x)
    numeric = dict(rows.dtypes)[x] != "date"
    if last is None:
        keep = F.lit(True)
        cast = (lambda v: F.lit(v)) if numeric else (lambda v: F.lit(v).cast("date"))
        if start is not None:
            keep = keep & (col >= cast(start))
        if end is not None:
            keep = keep & (col <= cast(end))
        return rows.where(keep)
    n, unit = last
    back, back_unit = offset or (0, unit)
    if unit == "points" or (offset and back_unit == "points"):
        pos = F.row_number().over(Window.partitionBy(*keys).orderBy(col.desc()))
        skip = max(0, back)
        return rows.withColumn("__p", pos).where(F.col("__p").between(skip + 1, skip + max(1, n))).drop("__p")
    latest = F.max(x).over(Window.partitionBy(*keys))
    marked = rows.withColumn("__latest", latest)
    if numeric and unit == "years":
        top = F.col("__latest") - back
        return marked.where(col.between(top - n + 1, top)).drop("__latest")
    age = F.datediff(F.col("__latest"), col) - F.lit(back * _DAYS[back_unit])
    return marked.where(age.between(0, n * _DAYS[unit])).drop("__latest")
