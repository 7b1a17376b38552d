"""Place search, resolution, deduplication and labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.text import norm_name
from gridloom.operators.scan import global_row_number
from gridloom.storage import stable

MIN_QUERY = 3
#: Places of one trigram are spread over so many keys.
SALTS = 16

# Spoken country names and their codes.
COUNTRY_ALIASES = {
    "uk": "GB", "u k": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "scotland": "GB",
    "wales": "GB", "usa": "US", "u s a": "US", "u s": "US", "america": "US", "united states of america": "US",
    "uae": "AE", "south korea": "KR", "north korea": "KP", "russia": "RU", "holland": "NL", "czechia": "CZ",
    "czech republic": "CZ",
}

# Rank of populated-place codes, best first; anything else is 9.
FEATURE_RANK = {"PPLC": 0, "PPLA": 1, "PPLA2": 2, "PPLA3": 3, "PPLA4": 4}


def feature_rank(code: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in FEATURE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, code), F.lit(9))


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: normalising costs far more than moving the rows, and a table of one file is one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_norms(places: DataFrame) -> DataFrame:
    return _spread(places).withColumns({"norm_label": norm_name(F.col("label")), "norm_city": norm_name(F.col("city_name"))})


def _trigrams(s: Column) -> Column:
    return F.when(F.length(s) >= MIN_QUERY, F.transform(
        F.sequence(F.lit(1), F.length(s) - MIN_QUERY + 1), lambda i: F.substring(s, i, F.lit(MIN_QUERY))
    )).otherwise(F.array().cast("array<string>"))


def trigram_index(places: DataFrame) -> DataFrame:
    """(tri, salt, place columns): every place under each distinct trigram of its names; worth storing by ``tri``."""
    both = F.array_distinct(F.concat(_trigrams(F.col("norm_label")), _trigrams(F.col("norm_city"))))
    named = with_norms(places.select("geonameid", "label", "city_name", "population"))
    return named.select(
        F.explode(both).alias("tri"), F.pmod(F.hash("geonameid"), F.lit(SALTS)).alias("salt"),
        "geonameid", "label", "population", "norm_label", "norm_city",
    )


def autocomplete(queries: DataFrame, places: DataFrame, limit: int = 10, query: str = "query",
                 index: DataFrame | None = None) -> DataFrame:
    """Best places whose label or city contains the normalised query.

    A query looks up the places of its rarest trigram only, then checks the whole string.  The places of a trigram are
    spread over a few keys, and each task keeps the best of a query before the last shuffle.  ``index`` is a stored
    :func:`trigram_index` of ``places``.
    """
    index = trigram_index(places) if index is None else index
    asked = _asked(queries, query).withColumnRenamed("__n", "__q").where(F.length("__q") >= MIN_QUERY)
    parts = asked.select("__q").distinct().select("__q", F.explode(F.array_distinct(_trigrams(F.col("__q")))).alias("tri"))
    counts = index.groupBy("tri").agg(F.count(F.lit(1)).alias("n"))
    # A query with a trigram that no place has finds nothing.
    rarest = parts.join(counts, "tri", "left").groupBy("__q").agg(
        F.min_by("tri", F.struct("n", "tri")).alias("tri"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    ).where("n > 0").drop("n")
    keyed = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = index.join(keyed, ["tri", "salt"]).where(
        F.contains("norm_label", "__q") | F.contains("norm_city", "__q")
    )
    best = Window.partitionBy("__q").orderBy(F.desc("population"), "label", "geonameid")
    top = hits.select("__q", "geonameid", "label", "population").withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= limit
    )
    return asked.join(top, "__q").select(query, "rank", "geonameid", "label", "population")


def _names(places: DataFrame) -> DataFrame:
    """:func:`place_names`, where a place may have a name several times."""
    raw = F.concat(F.array("label", "city_name"), F.split(F.coalesce("alt_names", F.lit("")), ","))
    named = _spread(places.select("geonameid", "label", "city_name", "alt_names", "country_code", "population"))
    return named.select("geonameid", "label", "country_code", "population", F.explode(F.array_distinct(raw)).alias("raw")).select(
        norm_name(F.col("raw")).alias("name"), "geonameid", "label", "country_code", "population"
    ).where(F.length("name") >= MIN_QUERY)


def place_names(places: DataFrame) -> DataFrame:
    """(name, place) for every label, city and alternative name of three or more letters; worth storing by name."""
    return _names(places).distinct()


def _asked(queries: DataFrame, query: str) -> DataFrame:
    """Each query once, with its search key ``__n``."""
    return _spread(queries.select(query).distinct()).withColumn("__n", norm_name(F.col(query)))


def _exact(queries: DataFrame, places: DataFrame, query: str, names: DataFrame | None = None) -> DataFrame:
    """Places by equal name; ``names`` is a stored :func:`place_names` of ``places``."""
    names = place_names(places) if names is None else names
    return _asked(queries, query).join(names.withColumnRenamed("name", "__n"), "__n").drop("__n")


def resolve_name_all(queries: DataFrame, places: DataFrame, query: str = "query", names: DataFrame | None = None) -> DataFrame:
    """Every place with exactly that name, most populous first."""
    order = [F.desc("population"), F.asc("label"), F.asc("geonameid")]
    return global_row_number(_exact(queries, places, query, names), [query], order)


def resolve_name(queries: DataFrame, places: DataFrame, query: str = "query", names: DataFrame | None = None) -> DataFrame:
    """The most populous place with exactly that name; the first id on ties."""
    asked = _asked(queries, query)
    names = (_names(places) if names is None else names).withColumnRenamed("name", "__n")
    best = F.max_by(F.struct("geonameid", "label"), F.struct("population", -F.col("geonameid")))
    # The best place of a name is found once, before queries of that name multiply its places.
    known = names.join(asked.select("__n").distinct(), "__n", "left_semi").groupBy("__n").agg(best.alias("p"))
    return asked.join(known, "__n").select(query, "p.*")


def resolve_id(ids: DataFrame, places: DataFrame, row: str = "row_no") -> DataFrame:
    """Place per id; the last row of an id counts."""
    last = places.groupBy("geonameid").agg(F.max_by("label", row).alias("label"))
    return ids.select("geonameid").distinct().join(last, "geonameid")


def resolve_label(labels: DataFrame, places: DataFrame, query: str = "query", row: str = "row_no") -> DataFrame:
    """Place per normalised label; the first row of a label counts."""
    asked = _asked(labels, query).withColumnRenamed("__n", "n").where(F.col("n") != "")
    first = _spread(places.select("label", "geonameid", row)).withColumn("n", norm_name(F.col("label"))).groupBy("n").agg(F.min_by("geonameid", row).alias("geonameid"))
    return asked.join(first, "n").select(query, "geonameid")


def country_code_of(qualifier: Column, names: dict[str, str] | None = None) -> Column:
    """Code of a trailing qualifier: alias, then two letters, then a country name."""
    q = F.trim(F.regexp_replace(F.lower(qualifier), r"\s+", " "))
    table = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), q)
    code = F.coalesce(table(COUNTRY_ALIASES), F.when(q.rlike(r"^\p{L}{2}$"), F.upper(q)))
    return F.coalesce(code, table(names)) if names else code


def resolve_location(queries: DataFrame, places: DataFrame, country_names: dict[str, str] | None = None,
                     query: str = "query") -> DataFrame:
    """One place per free-text location, e.g. "Springfield, US".

    Candidates come from the whole string, then its part before the comma,
    then, only without any exact match, from substring search over the whole
    and the part.  Among the candidates of that stage the first in the named
    country is taken, else the first.
    """
    name = F.regexp_replace(F.trim(F.col(query)), r"^\*+|\*+$", "")
    has_part = F.instr(name, ",") > 0
    part = F.trim(F.substring_index(name, ",", 1))
    asked = queries.select(query).distinct().select(
        query, name.alias("whole"), F.when(has_part, part).alias("part"),
        F.when(has_part, country_code_of(F.regexp_replace(name, r"^[^,]*,", ""), country_names)).alias("cc"),
    )
    cols = [query, "cc", "geonameid", "label", "country_code", "population", "tier", "stage"]
    forms = asked.select(query, "cc", F.inline(F.array(
        F.struct(F.lit(0).alias("stage"), F.col("whole").alias("text")),
        F.struct(F.lit(1).alias("stage"), F.col("part").alias("text")),
    ))).where(F.col("text").isNotNull())
    # Only the best place of a name, and its best in the named country, can be taken: at most two rows a form.
    order = F.struct(-F.col("population"), "label", "geonameid")
    best = F.min_by(F.struct("geonameid", "label", "country_code", "population"), order).alias("p")
    keyed = forms.join(_asked(forms, "text"), "text")
    lands = stable(_names(places).groupBy("name", "country_code").agg(best).select("name", "p.*"))
    first = lands.groupBy("name").agg(best).select("name", "p.*")
    same = (F.col("__n") == F.col("name")) & (F.col("cc") == F.col("country_code"))
    hits = keyed.join(first, F.col("__n") == F.col("name")).unionByName(keyed.join(lands, same))
    # Checkpointed because it is read twice: as candidates and to see what is left.
    exact = stable(hits.withColumn("tier", F.lit(0)).select(*cols))
    # Substring search runs only for what has no exact match.
    rest = forms.join(exact.select(query).distinct(), query, "left_anti")
    found = autocomplete(rest, places, 10, "text").join(places.select("geonameid", "country_code"), "geonameid")
    near = rest.join(found, "text").withColumn("tier", F.col("stage") + 1).select(*cols)
    cand = exact.unionByName(near)
    elsewhere = ~F.coalesce(F.col("country_code") == F.col("cc"), F.lit(False))
    order = F.struct("tier", elsewhere, "stage", -F.col("population"), "label", "geonameid")
    return cand.groupBy(query).agg(F.min_by(F.struct("geonameid", "label"), order).alias("p")).select(query, "p.*")


def _best_row(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """One whole row per key: a mergeable aggregate, so hot keys shrink early."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("__r")).select("__r.*")


def dedupe_places(places: DataFrame, name: str = "city_name") -> DataFrame:
    """One row per (name, country, five-decimal position)."""
    keys = [
        norm_name(F.col(name)).alias("k0"), F.col("country_code").alias("k1"),
        F.format_number(F.col("lat"), 5).alias("k2"), F.format_number(F.col("lon"), 5).alias("k3"),
    ]
    order = F.struct("population", -feature_rank(F.col("feature_code")), -F.col("geonameid"))
    return _best_row(places, keys, order)


def dedupe_label(places: DataFrame) -> DataFrame:
    """One row per display label."""
    order = F.struct("population", "alias_count", -feature_rank(F.col("feature_code")), -F.col("geonameid"))
    return _best_row(places, [F.col("label").alias("k0")], order)


def disambiguate_labels(places: DataFrame, admin1: DataFrame, admin2: DataFrame,
                        countries: DataFrame) -> DataFrame:
    """Display labels that tell homonyms apart.

    Names repeated within a US state show the county, repeated French names
    the department, other repeated names the first-level region.
    """
    norm = norm_name(F.col("name"))
    us, fr = F.col("cc") == "US", F.col("cc") == "FR"
    p = places.withColumns({"__n": norm, "__a": F.when(us, F.coalesce("admin1", F.lit(""))).otherwise(F.lit(""))})
    repeated = p.groupBy("cc", "__a", "__n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(
        "cc", "__a", "__n", F.lit(True).alias("__rep")
    )
    key = lambda *parts: F.when(
        F.array_min(F.array(*[F.coalesce(F.col(c) != "", F.lit(False)) for c in parts])),
        F.concat_ws(".", *parts),
    )
    j = (
        p.join(repeated, ["cc", "__a", "__n"], "left")
        .withColumns({"__k1": key("cc", "admin1"), "__k2": key("cc", "admin1", "admin2")})
        .join(admin1.select(F.col("key").alias("__k1"), F.col("name").alias("__a1")), "__k1", "left")
        .join(admin2.select(F.col("key").alias("__k2"), F.col("name").alias("__a2")), "__k2", "left")
        .join(countries.select(F.col("code").alias("cc"), F.col("name").alias("__c")), "cc", "left")
    )
    country = F.coalesce("__c", "cc")
    plain = F.concat("name", F.lit(", "), country)
    within = lambda region: F.when(
        F.col("__rep") & F.col(region).isNotNull(), F.concat("name", F.lit(", "), region, F.lit(", "), country)
    ).otherwise(plain)
    state = F.concat("name", F.lit(" "), "admin1", F.lit(", USA"))
    label = (
        F.when(us & (F.coalesce("admin1", F.lit("")) == ""), F.concat("name", F.lit(", USA")))
        .when(us & F.col("__rep") & F.col("__a2").isNotNull(),
              F.concat("name", F.lit(" ("), "__a2", F.lit("), "), "admin1", F.lit(", USA")))
        .when(us, state).when(fr, within("__a2")).otherwise(within("__a1"))
    )
    return j.select(*places.columns, label.alias("label"))


MARINE_FIRST_ID = 2_000_000_000


def append_marine(index: DataFrame, marine: DataFrame, first_id: int = MARINE_FIRST_ID) -> DataFrame:
    """Place index plus named seas under synthetic ids.

    Seas take ids upward in name order and skip those in use: the n-th free
    id lies beyond every used id that has at most n - 1 free ids below it.
    """
    ranked = global_row_number(marine, [], [F.asc("norm_name")], "n")
    used = index.where(F.col("geonameid") >= first_id).select("geonameid").distinct()
    numbered = global_row_number(used, [], [F.asc("geonameid")], "k")
    marks = numbered.select((F.col("geonameid") - first_id - (F.col("k") - 1)).alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("n"))
    asks = ranked.select((F.col("n") - 1).alias("at"), F.lit(1).alias("ask"), F.col("n").cast("long").alias("n"))
    # In this order the n-th ask stands behind n - 1 asks and all the used ids that it has to skip.
    order = [F.asc("at"), F.asc("ask"), F.asc("n")]
    placed = global_row_number(marks.unionByName(asks), [], order, "stand").where("ask = 1")
    shifts = placed.select("n", (F.col("stand") - F.col("n")).alias("shift"))
    rows = ranked.join(shifts, "n").select(
        (F.lit(first_id) + F.col("n") - 1 + F.col("shift")).cast("long").alias("geonameid"),
        "label", F.col("label").alias("city_name"), F.lit("Ocean").alias("country_name"),
        F.lit("OC").alias("country_code"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"),
        F.lit(0).cast("long").alias("population"), F.lit("MARINE").alias("feature_code"), F.lit("").alias("alt_names"),
    )
    return index.select(*rows.columns).unionByName(rows)


def apply_name_overrides(countries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Country names with preferred wordings where one is given."""
    o = overrides.select("code", F.col("name").alias("__o"))
    return countries.join(o, "code", "left").withColumn("name", F.coalesce("__o", "name")).drop("__o")


def resolve_continents(names: DataFrame, continent_country: DataFrame, aliases: dict[str, str] | None = None,
                       query: str = "query") -> DataFrame:
    """Continent of a name, by alias or by its own name, with its member countries."""
    key = F.lower(F.trim(F.col(query)))
    alias = {k.lower(): v.lower() for k, v in (aliases or {}).items()}
    if alias:
        key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), key), key)
    asked = names.select(query).distinct().withColumn("__k", key)
    members = continent_country.withColumn("__k", F.lower("continent"))
    return asked.join(members, "__k").select(query, "continent", "country_code")
