"""Map values: scores, colour scales, palettes and pixel reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.predicates import matches
from gridloom.operators.scan import exact_quantiles


def score(value: Column, rules: list[tuple[dict, int]], default: int = 0) -> Column:
    """Highest score among the matching rules and the default; missing scores 0."""
    best = F.greatest(
        F.lit(default), *[F.when(matches(value, p), F.lit(s)).otherwise(F.lit(default)) for p, s in rules]
    ) if rules else F.lit(default)
    return F.when(value.isNull(), F.lit(0)).otherwise(best).cast("int")


def score_counts(scored: DataFrame, levels: int = 5) -> DataFrame:
    """Cells per score 0..4, with zero for absent scores."""
    counts = scored.agg(*[F.count_if(F.col("score") == s).alias(f"s{s}") for s in range(levels)])
    pairs = F.array(*[F.struct(F.lit(s).alias("score"), F.col(f"s{s}").alias("cells")) for s in range(levels)])
    return counts.select(F.inline(pairs))


def resolve_scale(raster: DataFrame, vmin: float | None = None, vmax: float | None = None,
                  qlo: float = 0.02, qhi: float = 0.98, keys: list[str] | None = None) -> DataFrame:
    """Colour range of each raster (value of ``keys``): given ends or exact quantiles, then min/max, then one unit either way."""
    keys = keys or []
    ends = raster.groupBy(*keys).agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    if vmin is None or vmax is None:
        q = exact_quantiles(raster, keys, "value", {"q0": qlo, "q1": qhi})
    else:
        q = ends.select(*keys, F.lit(None).cast("double").alias("q0"), F.lit(None).cast("double").alias("q1"))
    lo = F.col("q0") if vmin is None else F.lit(float(vmin))
    hi = F.col("q1") if vmax is None else F.lit(float(vmax))
    usable = lo < hi
    flat = F.col("mn") >= F.col("mx")
    a = F.when(usable, lo).when(flat, F.col("mn") - 1.0).otherwise(F.col("mn"))
    b = F.when(usable, hi).when(flat, F.col("mx") + 1.0).otherwise(F.col("mx"))
    empty = F.col("mn").isNull()
    joined = ends.join(q, keys, "left") if keys else ends.join(F.broadcast(q), how="left")
    return joined.select(
        *keys, F.when(empty, F.lit(0.0)).otherwise(a).alias("vmin"),
        F.when(empty, F.lit(1.0)).otherwise(b).alias("vmax"),
    )


def hex_rgb(color: str) -> tuple[int, int, int]:
    h = color.lstrip("#")
    return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)


def palette(value: Column, vmin: Column, vmax: Column, colors: list[str],
            missing_color: str = "#000000", missing_alpha: float | None = None) -> dict[str, Column]:
    """Piecewise-linear colour of a value, channels truncated to whole numbers."""
    stops = [hex_rgb(c) for c in colors]
    segments = len(stops) - 1
    t = F.least(F.greatest((value - vmin) / (vmax - vmin), F.lit(0.0)), F.lit(1.0))
    pos = t * segments
    i0 = F.floor(pos).cast("int")
    i1 = F.least(i0 + 1, F.lit(segments))
    frac = pos - i0
    out = {}
    for k, name in enumerate(("r", "g", "b")):
        table = F.array(*[F.lit(float(s[k])) for s in stops])
        mixed = F.get(table, i0) * (1 - frac) + F.get(table, i1) * frac
        out[name] = F.when(value.isNull(), F.lit(hex_rgb(missing_color)[k])).otherwise(
            F.floor(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0))).cast("int")
        )
    if missing_alpha is not None:
        out["a"] = F.when(value.isNull(), F.lit(int(round(missing_alpha * 255)))).otherwise(F.lit(255))
    return out


def stitch_dateline(raster: DataFrame, nlon: int, band: int = 8, keys: list[str] | None = None) -> DataFrame:
    """Average the ``band`` outer columns of each raster with their mirror; copy one-sided values."""
    keys = keys or []
    width = max(1, min(band, nlon // 2))
    mirror = F.lit(nlon - 1) - F.col("i_lon")
    edge = (F.col("i_lon") < width) | (F.col("i_lon") >= nlon - width)
    # A pair of mirrored cells is a group of two, so one small aggregate replaces a self-join.
    pair = F.least(F.col("i_lon"), mirror)
    edges = raster.where(edge).groupBy(*keys, "i_lat", pair.alias("k")).agg(F.avg("value").alias("value"))
    both = edges.select(
        *keys, "i_lat", F.explode(F.array(F.col("k"), F.lit(nlon - 1) - F.col("k"))).alias("i_lon"), "value"
    ).distinct()
    return raster.where(~edge).select(*keys, "i_lat", "i_lon", "value").unionByName(
        both.select(*keys, "i_lat", F.col("i_lon").cast("int").alias("i_lon"), "value")
    )


def downsample_max_alpha(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per 2x2 block of each raster the most opaque pixel; the first in row order wins ties."""
    keys = keys or []
    first = -((F.col("i_lat") % 2) * 2 + F.col("i_lon") % 2)
    best = F.max_by(F.struct("r", "g", "b", "a"), F.struct(F.col("a"), first))
    return pixels.groupBy(
        *keys,
        F.floor(F.col("i_lat") / 2).cast("int").alias("i_lat"),
        F.floor(F.col("i_lon") / 2).cast("int").alias("i_lon"),
    ).agg(best.alias("p")).select(*keys, "i_lat", "i_lon", "p.*")


def map_stats(projected: DataFrame, source_cells: int, keys: list[str] | None = None) -> DataFrame:
    """Range of the projected values of each raster; missing counts against the *source* size."""
    return projected.groupBy(*(keys or [])).agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.lit(source_cells) - F.count("value")).cast("long").alias("nan_count"),
    )


def legend_ticks(scale: DataFrame, ticks: int = 5) -> DataFrame:
    """Evenly spaced tick values from the top of the range down."""
    step = (F.col("vmax") - F.col("vmin")) / (ticks - 1)
    return scale.where(step > 0).select(F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(ticks - 1)), lambda i: F.round(F.col("vmax") - i * step, 2))
    ).alias("tick", "value"))
