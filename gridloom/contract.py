"""Table schemas and the missing-value contract.

Missing is NULL everywhere.  Sources that encode it as NaN, an infinity or a
sentinel number go through :func:`missing_to_null` once, at ingest; every
operator after that relies on Spark aggregates skipping NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

CELL = ["i_lat", "i_lon"]

OBS = T.StructType([
    T.StructField("metric_id", T.StringType()),
    T.StructField("i_lat", T.IntegerType()),
    T.StructField("i_lon", T.IntegerType()),
    T.StructField("t", T.DateType()),
    T.StructField("value", T.DoubleType()),
])

SERIES = T.StructType([
    T.StructField("metric_id", T.StringType()),
    T.StructField("grid_id", T.StringType()),
    T.StructField("tile_r", T.IntegerType()),
    T.StructField("tile_c", T.IntegerType()),
    T.StructField("i_lat", T.IntegerType()),
    T.StructField("i_lon", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.FloatType())),  # at rest; computed in double
])

AXIS = T.StructType([
    T.StructField("metric_id", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

PLACES = T.StructType([
    T.StructField("geonameid", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("country_name", T.StringType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("population", T.LongType()),
    T.StructField("capital", T.BooleanType()),
    T.StructField("feature_code", T.StringType()),
    T.StructField("alt_names", T.StringType()),
])


def finite(value: Column, fill: float | None = None) -> Column:
    """``value`` as DOUBLE with NaN, infinities and ``fill`` turned into NULL."""
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if fill is not None:
        bad = bad | (v == F.lit(float(fill)))
    return F.when(~bad, v)


def missing_to_null(df: DataFrame, columns=("value",), fill: float | None = None) -> DataFrame:
    return df.withColumns({c: finite(F.col(c), fill) for c in columns})
