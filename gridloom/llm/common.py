"""Small helpers of the corpus operators: tables, stored intermediate results, match spans."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.storage import work_folder


def in_tasks(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInPandas(fn, schema)``, where the workers can import this package on any cluster.

    Texts are long: with Spark's default of 10,000 rows a batch, a task would hold tens of MB several times over.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    return df.mapInPandas(fn, schema)


def arrow_in_tasks(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow(fn, schema)``, as :func:`in_tasks`: texts stay in Arrow's buffers, no Python string is made."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    return df.mapInArrow(fn, schema)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application, hand this package's code to the executors (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = pathlib.Path(__file__).resolve().parents[2]
        to = pathlib.Path(tempfile.mkdtemp(prefix="gridloom-code-"))
        sc.addPyFile(shutil.make_archive(str(to / "gridloom_code"), "zip", root, "gridloom"))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str = "llm") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Later stages all see the same rows, also after executors are lost, and the lineage ends here.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_added(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name gives way (its value is still what ``added`` sees)."""
    taken = {name.lower() for name in added}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in added.items()])


BITS = 1 << 24


def marked(df: DataFrame, key: str, among: DataFrame, among_key: str) -> DataFrame:
    """``df`` plus ``__marked``: false only where ``key`` is certainly not among ``among_key``; no shuffle of ``df``.

    The keys of ``among`` set bits of one map of ``BITS`` bits (2 MB, whatever the data), which is broadcast.  More keys
    than bits only make the mark less telling.  A null key is marked.
    """
    def spot(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c)), F.lit(BITS))

    page = 4096 * 8  # bits in one row of the map
    bits = among.select(spot(among_key).alias("at")).groupBy(F.expr(f"at div {page}").alias("__page")).agg(
        F.bitmap_construct_agg(F.col("at") % page).alias("__bits"))
    seen = df.withColumn("__spot", spot(key)).withColumn("__on", F.expr(f"__spot div {page}"))
    seen = seen.join(F.broadcast(bits), F.col("__on") == F.col("__page"), "left")
    at = F.col("__spot") % page
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.expr(f"cast((__spot % {page}) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1, F.lit(False))
    return seen.withColumn("__marked", on | F.col(key).isNull()).drop("__spot", "__on", "__page", "__bits")


def match_spans(text: Column, pattern: Column, group: int | None = None) -> Column:
    """All non-overlapping matches of ``pattern``: array of (start, end, part), in code points, end exclusive.

    ``part`` is the length of capture ``group`` (of the whole match without one).  The pieces between the matches and
    the matches themselves alternate, so running sums of their lengths are the positions.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if group is None else F.regexp_extract_all(text, pattern, F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))
    none = "array<struct<start:int,end:int,part:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        found = F.struct(start.alias("start"), end.alias("end"), F.length(x["part"]).alias("part"))
        return F.when(x["whole"].isNull(), acc).otherwise(
            F.struct(end.alias("pos"), F.array_append(acc["out"], found).alias("out"))
        )

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(none).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,part:int>>")
