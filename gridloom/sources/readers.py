"""Declared-schema readers of grids, places and third-party text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.contract import finite
from gridloom.grid import Grid, cell_of

# Names under which sources store their coordinates.
LAT = ["lat", "latitude", "y"]
LON = ["lon", "longitude", "x"]
TIME = ["time", "valid_time", "date", "t"]


def _pick(columns: list[str], names: list[str], what: str) -> str:
    by_lower = {c.lower(): c for c in columns}
    for n in names:
        if n in by_lower:
            return by_lower[n]
    raise ValueError(f"no {what} column among {columns}")


def data_variable(columns: list[str], preferred: str | None = None, aliases: list[str] | None = None) -> str:
    """Preferred name, then an alias, then the only column that is no coordinate or bound."""
    for name in [preferred, *(aliases or [])]:
        if name in columns:
            return name
    coords = set(LAT + LON + TIME + ["zlev"])
    rest = [c for c in columns if c.lower() not in coords and not c.lower().endswith(("_bnds", "_bounds"))]
    if len(rest) != 1:
        raise ValueError(f"cannot choose a data column among {rest}")
    return rest[0]


def select_grid(df: DataFrame, grid: Grid, preferred: str | None = None, aliases: list[str] | None = None,
                fill: float | None = None, metric_id: str = "obs") -> DataFrame:
    """Gridded rows with any coordinate names as observations (surface level only)."""
    lat, lon, t = (_pick(df.columns, n, w) for n, w in ((LAT, "latitude"), (LON, "longitude"), (TIME, "time")))
    var = data_variable(df.columns, preferred, aliases)
    rows = df.where(F.col("zlev") == 0) if "zlev" in df.columns else df
    return rows.select(
        F.lit(metric_id).alias("metric_id"),
        *[c.alias(n) for n, c in cell_of(F.col(lat), F.col(lon), grid).items()],
        F.col(t).cast("date").alias("t"), finite(F.col(var), fill).alias("value"),
    )


def scan_grid(spark: SparkSession, path: str, grid: Grid, **options) -> DataFrame:
    """Observations of a Parquet table; only coordinates and one variable are read."""
    return select_grid(spark.read.parquet(path), grid, **options)


_PLACES_CSV = (
    "geonameid string, label string, city_name string, country_name string, country_code string, lat string, "
    "lon string, population string, capital string, feature_code string, alt_names string"
)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Place index CSV.  Only empty fields are missing, so the code "NA" stays text."""
    raw = spark.read.schema(_PLACES_CSV).option("header", True).option("nullValue", "").option("escape", '"').csv(path)
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return raw.select(
        F.coalesce(F.col("geonameid").try_cast("long"), F.lit(0)).alias("geonameid"), text("label"), text("city_name"),
        text("country_name"), text("country_code"), number("lat").alias("lat"), number("lon").alias("lon"),
        number("population").cast("long").alias("population"),
        (F.lower(F.coalesce(F.trim("capital"), F.lit(""))) == "true").alias("capital"), text("feature_code"), text("alt_names"),
    )


GEONAMES_FIELDS = 19


def geonames_scan(spark: SparkSession, path: str, excluded: list[str]) -> DataFrame:
    """Populated places of a tab-separated gazetteer with at least nineteen fields."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    lines = spark.read.text(path).where(F.size(f) >= GEONAMES_FIELDS)
    rows = lines.where((at(6) == "P") & ~at(7).isin(*excluded))
    alias = F.filter(F.split(at(3), ","), lambda a: F.trim(a) != "")
    return rows.select(
        at(0).try_cast("long").alias("geonameid"), at(1).alias("name"), at(8).alias("cc"), at(10).alias("admin1"),
        at(11).alias("admin2"), at(4).try_cast("double").alias("lat"), at(5).try_cast("double").alias("lon"),
        at(17).alias("timezone"),
        F.coalesce(at(14).try_cast("double"), F.lit(0.0)).cast("long").alias("population"),
        F.size(alias).alias("alias_count"), at(7).alias("feature_code"), at(3).alias("alt_names"),
    )


def read_with_units_row(spark: SparkSession, path: str, columns: dict[str, str], time: str = "time",
                        time_units: tuple[str, ...] = ("UTC",)) -> DataFrame:
    """CSV files whose line after the header names units.

    A units row names one of ``time_units`` as its time and has no value that parses in another typed column.  Every
    other row is kept, in any split of any file; a time or value that does not parse is missing there.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    is_units = F.trim(F.col(f"`{time}`")).isin(*time_units)
    for c, t in columns.items():
        if c != time and t != "string":
            is_units = is_units & F.col(f"`{c}`").try_cast(t).isNull()
    kept = raw.where(~F.coalesce(is_units, F.lit(False)))
    return kept.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()])
