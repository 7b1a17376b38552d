"""Ordered scans that do not depend on any key being small.

A window partitioned by a hot key lands in one task.  :func:`ordered_chunks`
range-partitions rows by their *whole* sort key instead, so a key holding a
third of the rows is spread over a third of the partitions; a scan then needs
only one carried value per (key, chunk).  The chunked table is checkpointed so
that the chunk summaries and the rows always come from the same boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.storage import stable

CHUNK = "__chunk"


def ordered_chunks(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` plus a chunk number; chunks are consecutive in ``order``.

    Without a partition count Spark sizes the chunks by the data.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return stable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def global_row_number(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "rank",
    with_count: str | None = None,
) -> DataFrame:
    """1-based position inside ``keys`` under ``order``, for keys of any size.

    ``order`` must be total.  Chunk counts are at most (keys in a chunk) per
    chunk; only they pass through the window that sums offsets.
    """
    chunked = ordered_chunks(df, [F.col(k) for k in keys] + order)
    counts = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    cols = {"__offset": F.coalesce(F.sum("__n").over(before), F.lit(0))}
    if with_count:
        cols[with_count] = F.sum("__n").over(Window.partitionBy(*keys))
    offsets = counts.withColumns(cols).drop("__n")
    local = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    numbered = chunked.withColumn("__local", local)
    joined = _join_on(numbered, offsets, [*keys, CHUNK])
    return joined.withColumn(name, F.col("__offset") + F.col("__local")).drop(
        "__offset", "__local", CHUNK
    )


def running_count(df: DataFrame, order: list[Column], counted: Column, name: str) -> DataFrame:
    """How many rows up to and including each one, in ``order``, fulfil ``counted``."""
    chunked = ordered_chunks(df.withColumn("__is", counted.cast("long")), order)
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    offsets = chunked.groupBy(CHUNK).agg(F.sum("__is").alias("__n")).select(
        CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = _join_on(chunked.withColumn("__local", F.sum("__is").over(inside)), offsets, [CHUNK])
    return counts.withColumn(name, F.col("__offset") + F.col("__local")).drop("__offset", "__local", "__is", CHUNK)


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row of its key, in ascending ``order``."""
    cols = [F.col(c) for c in order]
    chunked = ordered_chunks(df, [F.col(k) for k in keys] + cols)
    earlier = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunked.withColumn("__prev", F.last(value, ignorenulls=True).over(earlier))
    # What a chunk hands on: its last value, carried over chunks without any.
    tails = chunked.groupBy(*keys, CHUNK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*cols))).alias("__tail")
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("__carry", F.last("__tail", ignorenulls=True).over(before)).drop("__tail")
    out = _join_on(rows, carried, [*keys, CHUNK])
    return out.withColumn(name, F.coalesce("__prev", "__carry")).drop("__prev", "__carry", CHUNK)


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join that keeps the left columns."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict) -> DataFrame:
    """Exact order statistics: rows of (keys, name, n, value), any group size.

    ``ranks`` maps a name to a function from the count column to a 0-based
    rank.  Duplicates collapse to counts, the distinct values are chunked in
    order, chunk sums tell which chunk holds a rank, and only that chunk is
    ordered.
    """
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    counts = base.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    chunked = ordered_chunks(counts, [*[F.col(k) for k in keys], F.col("__v")])
    upto = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    sums = chunked.groupBy(*keys, CHUNK).agg(F.sum("__c").alias("__s")).withColumns({
        "__upto": F.sum("__s").over(upto), "n": F.sum("__s").over(Window.partitionBy(*keys)),
    })
    rank = lambda fn: F.least(F.greatest(fn(F.col("n")).cast("long"), F.lit(0)), F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(fn).alias("__k")) for name, fn in ranks.items()])
    before = F.col("__upto") - F.col("__s")
    targets = sums.select(*keys, CHUNK, "n", before.alias("__before"), "__upto", F.inline(wanted)).where(
        (F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__upto"))
    )
    rows = _join_on(targets, chunked, [*keys, CHUNK])
    run = Window.partitionBy(*keys, "name").orderBy("__v")
    placed = rows.withColumn("__cum", F.col("__before") + F.sum("__c").over(run))
    return placed.where(F.col("__cum") > F.col("__k")).groupBy(*keys, "name").agg(
        F.max("n").alias("n"), F.min("__v").alias("value")
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one column per name in ``qs``."""
    ranks = {}
    for name, q in qs.items():
        ranks[f"{name}:lo"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        ranks[f"{name}:hi"] = lambda n, q=q: F.floor((n - 1) * F.lit(q)) + 1
    stats = order_statistics(df, keys, value, ranks)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    out = {}
    for name, q in qs.items():
        pos = (F.max("n") - 1) * F.lit(q)
        lo, hi = at(f"{name}:lo"), at(f"{name}:hi")
        out[name] = lo + (hi - lo) * (pos - F.floor(pos))
    return stats.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])
