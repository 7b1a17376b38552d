"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each source gets a word target.  Document rates minimise the relative entropy to "every document once" under one word
constraint per source and the box 0 <= rate <= 3; the solution is ``min(3, exp(lambda_source * size / scale))``, and
the duals ``lambda`` come from safeguarded Newton steps on the convex dual.  A step is one aggregate over the
(source, size) histogram, for all sources at once.  Rates then become whole copies by systematic rounding along
(source, size): running sums of the rates are rounded, so the error of a source stays within about one document, and a
few repair rounds move one copy of the best fitting document each.

Null texts have size 0, a null source is a source of its own (last), documents of size 0 take no words.  Rows equal in
id, source and text share their copies as evenly as whole copies allow.  Empty tables give empty results.  Sums run over integers, so reruns
agree.  A hot source only meets partial aggregates, ordered chunks and joins with one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from gridloom.llm.common import saved, table, with_added
from gridloom.operators.scan import CHUNK, global_row_number, ordered_chunks

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3.0
UNIT = 1 << 24


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One light row per document: id, source, size in words, and a hash of the text."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"),
        F.regexp_count(value, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("h"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _by_source(df: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join one row per source to rows; null is a source like the others."""
    right = per_source.withColumnRenamed("source", "__source")
    return df.join(right, _same("source", "__source"), "left").drop("__source")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): shares of all words by weight, none above ``most`` times its source."""
    sums = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    ranked = global_row_number(sums, [], [F.col("source").asc_nulls_last()], name="place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = saved(ranked.withColumn("weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int"))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(most)
    level, before = None, -1
    while True:  # only two sums and a count leave each round
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        fixed, open_weight, n = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count_if(above),
        ).first()
        if n == before or open_weight == 0:
            break
        before, level = n, (total - fixed) / open_weight
    target = F.least(cap, F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _rate(lam: Column, size: Column, scale: Column, most: float) -> Column:
    power = lam * size / scale
    return F.when(power >= F.log(F.lit(most)), F.lit(float(most))).otherwise(F.exp(power))


def balanced(rows: DataFrame, targets: DataFrame, most: float = MOST, rounds: int = 60, near: float = 1e-7) -> DataFrame:
    """``targets`` plus ``lam`` and ``scale`` of each source (null ``lam``: every rate is ``most``)."""
    sizes = saved(rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    scale = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    full = F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")
    ratio = F.col("source_size") / F.col("target")
    state = saved(
        targets.where("source_size > 0").withColumn("scale", scale)
        .withColumns({"full": full, "lam": F.lit(0.0), "lo": F.least(F.lit(0.0), -F.col("scale") * F.log(ratio)) - 1,
                      "hi": F.log(F.lit(most)) * F.col("scale") + 1})
    )
    for _ in range(rounds):
        joined = _by_source(sizes, state.where("not full").select("source", "lam", "scale")).where("lam is not null")
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < F.lit(most), words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = joined.groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        seen = _by_source(state, sums)
        low = F.when(F.col("words") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("words") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        # Newton on log(words): the log of a sum of exponentials is close to linear far from the solution.
        step = F.col("lam") + (F.log("target") - F.log("words")) * F.col("words") / F.col("slope")
        good = (F.col("slope") > 0) & (F.col("words") > 0) & (step > low) & (step < high)
        done = F.col("full") | (F.abs(F.col("words") / F.col("target") - 1) <= near) | (high - low < 1e-9)
        state = saved(seen.withColumns({
            "done": done, "lo": low, "hi": high,
            "lam": F.when(done, F.col("lam")).otherwise(F.when(good, step).otherwise((low + high) / 2)),
        }).drop("words", "slope"))
        if state.where("not coalesce(done, false)").isEmpty():
            break
        state = state.drop("done")
    lam = F.when(~F.col("full"), F.round("lam", 7))
    return targets.join(
        state.select(F.col("source").alias("__source"), lam.alias("lam"), "scale"), _same("source", "__source"), "left"
    ).drop("__source")


def document_copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = int(MOST), repairs: int = 3) -> DataFrame:
    """(id, source, size, h, m, source_size, target, total): one row per distinct (id, source, size, h) of ``rows``.

    ``total`` copies are taken of its ``m`` rows together.
    """
    duals = saved(balanced(rows, source_targets(rows, weights, most), most))
    units = saved(
        rows.groupBy("source", "size", "id", "h").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("place", F.xxhash64("id", "h"))
    )
    order = ["source", "size", "place", "id", "h"]
    rate = F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(
        _rate(F.col("lam"), F.col("size"), F.col("scale"), float(most)))
    tilted = _by_source(units, duals).withColumn("q", F.round(rate * UNIT).cast("long") * F.col("m"))
    # Running sums without a window over a whole source: inside chunks of the sort order, plus offsets per chunk.
    chunked = ordered_chunks(tilted, [F.col(c) for c in order])
    before = Window.partitionBy("source").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy("source", CHUNK).agg(F.sum("q").alias("__q")).select(
        F.col("source").alias("__source"), F.col(CHUNK).alias("__c"),
        F.coalesce(F.sum("__q").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("source", CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.withColumn("__sum", F.sum("q").over(within)).join(
        offsets, _same("source", "__source") & (F.col(CHUNK) == F.col("__c")))
    upto = F.col("__offset") + F.col("__sum") + UNIT // 2
    whole = F.shiftright(upto, 24) - F.shiftright(upto - F.col("q"), 24)
    total = F.least(whole, F.col("m") * most)
    units = saved(summed.select(*order, "m", "source_size", "target", total.alias("total")))
    for _ in range(repairs):
        units = _repaired(units, order, most)
    return units


def _repaired(units: DataFrame, order: list[str], most: int) -> DataFrame:
    """Per source, one copy more or less of the document that brings the words nearest to the target."""
    gaps = saved(units.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("total") * F.col("size"))).alias("gap")))
    words = F.col("size")
    open_ = F.when(F.col("gap") > 0, F.col("total") < F.col("m") * most).otherwise(F.col("total") > 0)
    rest = F.abs(F.abs("gap") - words)
    best = saved(
        _by_source(units, gaps).where((words > 0) & open_ & (rest < F.abs("gap"))).groupBy("source")
        .agg(F.min(F.struct(rest.alias("rest"), "place", "id", "h", "size", "gap")).alias("best"))
    )
    hit = F.col("best").isNotNull()
    for c in ("place", "id", "h", "size"):
        hit = hit & F.col(c).eqNullSafe(F.col("best")[c])
    change = F.when(hit, F.signum(F.col("best.gap")).cast("int")).otherwise(0)
    return saved(_by_source(units, best).withColumn("total", F.col("total") + change).drop("best"))


def with_copies(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Every row of ``rows`` (id, source, size, h and more) with ``source_size``, ``target`` and ``copies``.

    Of the ``m`` rows of a unit the first ``total mod m`` are taken once more than the others.
    """
    keys = ["id", "source", "size", "h"]
    right = units.select(*[F.col(c).alias(f"__{c}") for c in keys], "source_size", "target",
                         F.expr("total div m").cast("int").alias("copies"), (F.col("total") % F.col("m")).alias("__more"))
    on = (F.col("h") == F.col("__h")) & (F.col("size") == F.col("__size")) & _same("id", "__id") & _same("source", "__source")
    joined = rows.join(right, on).drop("__id", "__source", "__size", "__h")
    even = joined.where("__more = 0").drop("__more")
    if units.where("total % m > 0").isEmpty():
        return even
    # Equal rows are told apart by their place in a stored table, so that a unit of very many rows spreads over tasks.
    uneven = saved(joined.where("__more > 0").withColumn("__row", F.monotonically_increasing_id()))
    ranked = global_row_number(uneven, keys, [F.col("__row")], name="__place")
    more = F.when(F.col("__place") <= F.col("__more"), 1).otherwise(0)
    return even.unionByName(ranked.withColumn("copies", F.col("copies") + more).drop("__place", "__more", "__row"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    units = document_copies(saved(document_sizes(docs, doc_id, text, source)), weights)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"),
        F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text}`")).alias("h"),
    )
    taken = with_copies(packed, units.where("total > 0")).where("copies > 0")
    repeated = taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return repeated.select(*[F.col("__doc")[c].alias(c) for c in docs.columns])


def op6_entropy_mix(spark, sf_dir: str) -> DataFrame:
    rows = saved(document_sizes(table(spark, sf_dir, "documents")))
    mixed = with_copies(rows, document_copies(rows))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
