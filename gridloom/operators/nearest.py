"""Exact nearest neighbour on the sphere without comparing all pairs.

Targets are divided into groups of neighbours by a k-d tree over their unit vectors; its cuts come from a bounded sample,
its boxes from all targets.  A location is sent to the groups whose box may hold something nearer than the best of the
nearest box's landmarks (some targets of the sample), usually one or two, and compared there with the targets of the
group.  The answers of the groups merge by partial aggregation, so locations are shuffled once, and a crowded region only
has more groups.  What tasks get as a whole is bounded: at most ``GROUPS`` boxes with ``LANDMARKS`` targets each.

A location inside a scope (such as its country) only sees targets of the same scope; scopes are told apart by a hash
of 53 bits, which is one more dimension of the tree.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.grid import EARTH_RADIUS_KM, wrap_lon
from gridloom.storage import ship_package, stable, work_folder

SAMPLE = 20_000  # targets that the cuts and the landmarks come from
GROUP, GROUPS = 512, 1024  # targets of a group on average, unless that made too many groups
LANDMARKS = 16
BLOCK = 100_000  # locations of a group compared by one task
PAIRS = 1_000_000  # location and target pairs looked at together
TIE = 1e-9  # chords this close may be equal to a millimetre


class Index(NamedTuple):
    """Stored targets (scope, t_lat, t_lon, id, s, x, y, z, group) and what routes locations to their groups."""

    targets: DataFrame
    cuts: list
    low: np.ndarray
    high: np.ndarray
    landmarks: np.ndarray


def _vector(lat: Column, lon: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [(F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z")]


def _scope(scope: list[str]) -> Column:
    """Scopes as numbers, mostly far more than any chord apart; without a scope all targets have the same one."""
    return (F.xxhash64(*scope) if scope else F.lit(0)).cast("double").alias("s")


def _cuts(points: np.ndarray, most: float) -> tuple[list, np.ndarray]:
    """(tree, group of each point): cuts (dimension, threshold, left, right) or [group], down to ``most`` points."""
    tree, group = [], np.zeros(len(points), np.int64)
    todo, n = [(np.arange(len(points)), None, 0)], 0
    while todo:
        some, parent, side = todo.pop()
        if parent is not None:
            tree[parent][side] = len(tree)
        here = points[some]
        wide = np.argmax(here.max(axis=0) - here.min(axis=0)) if len(some) else 0
        at = float(np.median(here[:, wide])) if len(some) else 0.0
        left = here[:, wide] <= at
        if len(some) <= most or left.all():
            group[some] = n
            tree.append([n])
            n += 1
            continue
        todo += [(some[left], len(tree), 2), (some[~left], len(tree), 3)]
        tree.append([int(wide), at, 0, 0])
    return tree, group


def _groups_of(points: np.ndarray, tree: list) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, some = todo.pop()
        if len(tree[node]) == 1:
            out[some] = tree[node][0]
            continue
        dim, at, left, right = tree[node]
        low = points[some, dim] <= at
        todo += [(left, some[low]), (right, some[~low])]
    return out


DIMS = ["s", "x", "y", "z"]


def build_index(places: DataFrame, scope: list[str] | None = None, place_id: str = "geonameid") -> Index:
    """The targets by group, stored, with the groups' boxes and landmarks."""
    scope = scope or []
    # Equal coordinates are one target, under the lowest id.
    targets = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(
        *scope, F.col("lat").alias("t_lat"), wrap_lon(F.col("lon")).alias("t_lon")
    ).agg(F.min(place_id).alias("id"))
    targets = stable(targets.select(*scope, "t_lat", "t_lon", "id", _scope(scope), *_vector(F.col("t_lat"), F.col("t_lon"))))
    total = targets.count()
    sample = np.array([tuple(r) for r in targets.select(*DIMS).orderBy(F.xxhash64("t_lat", "t_lon", "s")).limit(SAMPLE).collect()]).reshape(-1, 4)
    most = len(sample) * max(GROUP / max(total, 1), 1 / GROUPS)
    cuts, group = _cuts(sample, max(most, 8))
    n = group.max(initial=0) + 1
    landmarks = np.full((n, LANDMARKS, 4), np.inf)
    for g in range(n):
        some = sample[group == g][:LANDMARKS]
        landmarks[g, : len(some)] = some

    def assign(batches):
        for batch in batches:
            yield batch.assign(group=_groups_of(batch[DIMS].to_numpy(np.float64), cuts))

    spark = places.sparkSession
    ship_package(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema)
    path = work_folder(spark, "nearest")
    targets.mapInPandas(assign, f"{schema}, `group` long").write.parquet(path)
    targets = spark.read.parquet(path)
    low, high = np.full((n, 4), np.inf), np.full((n, 4), -np.inf)
    bounds = [F.struct(*[f(c).alias(c) for c in DIMS]).alias(f.__name__) for f in (F.min, F.max)]
    for r in targets.groupBy("group").agg(*bounds).collect():  # one row per group
        low[r.group], high[r.group] = tuple(r["min"]), tuple(r["max"])
    return Index(targets, cuts, low, high, landmarks)


def _routes(points: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(number of the location, group) for all groups that can hold its nearest target."""
    low, high, landmarks = index
    out = []
    step = max(1, 2 * PAIRS // len(low))
    for i in range(0, len(points), step):
        p = points[i : i + step]
        least = np.zeros((len(p), len(low)))
        for d in range(4):
            gap = np.maximum(np.maximum(low[None, :, d] - p[:, None, d], p[:, None, d] - high[None, :, d]), 0)
            # Another scope is no distance but no answer at all.
            least += gap * gap if d else np.where(gap > 0, np.inf, 0.0)
        at = least.argmin(axis=1)
        diff = landmarks[at] - p[:, None, :]
        known = np.where(diff[:, :, 0] == 0, (diff[:, :, 1:] ** 2).sum(axis=2), np.inf).min(axis=1)
        a, b = np.nonzero((least <= (np.sqrt(known) + TIE)[:, None] ** 2) & (least < np.inf))
        out.append((a + i, b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def _km(lat: np.ndarray, lon: np.ndarray, t_lat: np.ndarray, t_lon: np.ndarray) -> np.ndarray:
    half = lambda x: np.sin(np.radians(x) / 2) ** 2
    a = half(t_lat - lat) + np.cos(np.radians(lat)) * np.cos(np.radians(t_lat)) * half(t_lon - lon)
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _compare(points: pd.DataFrame, targets: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the locations, ids, distances) of the best target of a group for each location."""
    p, t = points[DIMS].to_numpy(np.float64), targets[DIMS].to_numpy(np.float64)
    lat, lon = points["lat"].to_numpy(np.float64), points["o"].to_numpy(np.float64)
    t_lat, t_lon, ids = targets["t_lat"].to_numpy(np.float64), targets["t_lon"].to_numpy(np.float64), targets["id"].to_numpy()
    best, away = np.full(len(p), -1, np.int64), np.full(len(p), np.inf)
    step = max(1, PAIRS // max(len(t), 1))
    for i in range(0, len(p) if len(t) else 0, step):
        here = p[i : i + step]
        square = sum((here[:, None, d] - t[None, :, d]) ** 2 for d in (1, 2, 3))
        square[here[:, None, 0] != t[None, :, 0]] = np.inf
        least = square.min(axis=1)
        a, b = np.nonzero((square <= (np.sqrt(least) + TIE)[:, None] ** 2) & np.isfinite(square))
        a = a + i
        d = _km(lat[a], lon[a], t_lat[b], t_lon[b])
        order = np.lexsort((ids[b], np.round(d, 6), a))
        first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(a) else order
        best[a[first]], away[a[first]] = b[first], d[first]
    some = np.flatnonzero(best >= 0)
    return some, ids[best[some]] if len(some) else ids[:0], away[some]


def nearest(points: DataFrame, places: DataFrame, scope: list[str] | None = None,
            place_id: str = "geonameid", index: Index | None = None) -> DataFrame:
    """(lat, lon, scope..., place id, distance_km) per distinct location of ``points``.

    ``scope`` columns must agree between a location and its place.  Distances
    equal to a millimetre go to the lower id.  ``index`` reuses the stored
    result of ``build_index``.
    """
    scope = scope or []
    index = build_index(places, scope, place_id) if index is None else index
    # Equal locations are searched once.
    spots = points.select(*scope, "lat", "lon").distinct().where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    spots = spots.withColumn("o", wrap_lon(F.col("lon"))).select("*", _scope(scope), *_vector(F.col("lat"), F.col("o")))
    boxes = index[2:]

    def route(batches):
        for batch in batches:
            number, group = _routes(batch[DIMS].to_numpy(np.float64), boxes)
            yield batch.iloc[number].assign(group=group)

    ship_package(points.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spots.schema)
    routed = stable(spots.mapInPandas(route, f"{schema}, `group` long"))
    # A group that very many locations ask is compared in several blocks.
    blocks = routed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    of = F.pmod(F.xxhash64("lat", "lon"), F.col("blocks")).alias("block")
    asked = routed.join(blocks, "group").select(*routed.columns, of)
    filed = index.targets.join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    kind = index.targets.schema["id"].dataType.simpleString()
    where = [*scope, "lat", "lon"]

    def compare(asked: pd.DataFrame, filed: pd.DataFrame) -> pd.DataFrame:
        at, ids, away = _compare(asked, filed)
        return asked[where].iloc[at].assign(id=ids, d=away)

    types = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in where)
    found = asked.groupBy("group", "block").cogroup(filed.drop("blocks").groupBy("group", "block")).applyInPandas(
        compare, f"{types}, id {kind}, d double")
    return found.groupBy(*where).agg(F.min_by(F.struct("id", "d"), F.struct(F.round("d", 6), F.col("id"))).alias("b")).select(
        *where, F.col("b.id").alias(place_id), F.col("b.d").alias("distance_km"))


def nearest_place(points: DataFrame, places: DataFrame, key: str = "point_id", index: Index | None = None) -> DataFrame:
    """Nearest place of every point by great-circle distance; ``index`` is a stored result of :func:`build_index`."""
    found = nearest(points, places, index=index)
    return points.select(key, "lat", "lon").join(found, ["lat", "lon"]).select(key, "geonameid", "distance_km")


def resolve_place(points: DataFrame, places: DataFrame, country_names: DataFrame,
                  country_km: float = 100.0, city_km: float = 2.0, off_city_km: float = 80.0,
                  index: Index | None = None, country_index: Index | None = None) -> DataFrame:
    """Display place per point.

    ``points`` carry the country_code, ocean_id and ocean_name found for them
    (NULL for none).  The nearest place of the country wins within
    ``country_km``, else the nearest overall; water points are named after
    their ocean unless a city is very near; a country without any place is
    named itself.  ``index`` and ``country_index`` are stored results of :func:`build_index`, the latter of the places
    with a country, by country_code.
    """
    known = places.where(F.col("country_code").isNotNull())
    own = nearest(points.where(F.col("country_code").isNotNull()), known, ["country_code"], index=country_index).where(
        F.col("distance_km") <= country_km
    ).select("country_code", "lat", "lon", F.col("geonameid").alias("own_id"), F.col("distance_km").alias("own_km"))
    anywhere = nearest(points, places, index=index).select(
        "lat", "lon", F.col("geonameid").alias("any_id"), F.col("distance_km").alias("any_km")
    )
    inhabited = known.select("country_code").distinct().withColumn("inhabited", F.lit(True))
    j = (
        points.join(own, ["country_code", "lat", "lon"], "left")
        .join(anywhere, ["lat", "lon"], "left")
        .join(inhabited, "country_code", "left")
        .join(country_names.select(F.col("code").alias("country_code"), F.col("name").alias("own_country")),
              "country_code", "left")
        .withColumn("geonameid", F.coalesce("own_id", "any_id"))
        .withColumn("distance_km", F.coalesce("own_km", "any_km"))
        .withColumnRenamed("country_code", "point_country")
    )
    city = places.select("geonameid", F.col("label").alias("city_label"), F.col("country_code"), "population")
    j = j.join(city, "geonameid", "left")
    label = F.coalesce(F.when(F.trim("city_label") != "", F.trim("city_label")), F.col("geonameid").cast("string"))
    wet = F.col("point_country").isNull() & F.col("ocean_id").isNotNull()
    ocean = F.coalesce("ocean_name", F.lit("Open Ocean"))
    named = (
        F.when(wet & (F.col("distance_km") <= city_km), label)
        .when(wet & (F.col("distance_km") <= off_city_km), F.concat(ocean, F.lit(" off "), label))
        .when(wet, ocean)
        .when(F.col("point_country").isNotNull() & F.col("inhabited").isNull(), F.coalesce("own_country", label))
        .otherwise(label)
    )
    return j.select(
        "point_id", "geonameid", named.alias("label"), "distance_km", "country_code",
        F.when(~wet & (F.col("population") > 0), F.col("population")).alias("population"),
    )
