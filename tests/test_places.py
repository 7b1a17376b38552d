import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as TX
from gridloom.operators import nearest as N, places as J, regrid as RGD

PLACES = ("geonameid long, label string, city_name string, country_code string, lat double, lon double, population long, alt_names string")


@pytest.fixture(scope="module")
def index(frame):
    return frame(PLACES, [
        (1, "Torvéal, Canada", "Torvéal", "CA", 45.5, -73.6, 1_700_000, "Ville-Rose,Torveal"),
        (2, "Torvaco, Torvaco", "Torvaco", "MC", 43.7, 7.4, 39_000, ""),
        (3, "Lumis, France", "Lumis", "FR", 48.9, 2.4, 2_148_000, "Lumigi,Vetèce"),
        (4, "Lumis TX, USA", "Lumis", "US", 33.7, -95.6, 25_000, ""),
        (5, "Grellen Sea", "Grellen Sea", "OC", 75.5, 40.5, 0, ""),
        (6, "Brünn, Germany", "Brünn", "DE", 50.9, 6.96, 1_000_000, "Brunna"),
        (7, "Brunna, Italy", "Brunna", "IT", 45.6, 9.9, 7_000, ""),
    ])


def ask(frame, *names):
    return frame("query string", [(n,) for n in names])


@pytest.mark.parametrize("raw,want", [(" Torvéal!! ", "torveal"), ("Straße 5", "strasse 5"), ("a\\b", "a\\b"), ("ﬁn Ⅷ", "fin viii"),
                                      (None, ""), ("Łódź", "odz"), ("été", "ete"), ("北京 x", "x")])
def test_norm_name(frame, raw, want):
    assert frame("s string", [(raw,)]).select(TX.norm_name(F.col("s"))).first()[0] == want


def test_norm_name_matches_unicode_data(frame):
    import re
    import unicodedata

    chars = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != "\\"]
    texts = [" ".join(f"x{c}y" for c in chars[i : i + 300]) for i in range(0, len(chars), 300)]

    def ref(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s.strip()) if not unicodedata.combining(c)).casefold()
        return re.sub(r"[^a-z0-9]+", " ", s).strip()

    got = frame("i int, s string", list(enumerate(texts))).select("i", TX.norm_name(F.col("s")).alias("n")).collect()
    wrong = [(texts[r.i], r.n, ref(texts[r.i])) for r in got if r.n != ref(texts[r.i])]
    assert wrong == []


def test_search_and_resolution(frame, index):
    got = J.autocomplete(ask(frame, "tor", "LUM", "lu"), index).orderBy("query", "rank").collect()
    assert [(r.query, r.geonameid) for r in got] == [("LUM", 3), ("LUM", 4), ("tor", 1), ("tor", 2)]
    one = {r.query: r.geonameid for r in J.resolve_name(ask(frame, "lumis", "Brunna", "VETECE", "zz"), index).collect()}
    assert one == {"lumis": 3, "Brunna": 6, "VETECE": 3}
    every = J.resolve_name_all(ask(frame, "Lumis", "torveal"), index).orderBy("query", "rank").collect()
    assert [(r.query, r.geonameid, r.rank) for r in every] == [("Lumis", 3, 1), ("Lumis", 4, 2), ("torveal", 1, 1)]


def test_location_with_qualifier(frame, index):
    q = ["Brunna, Italy", "**Lumis**", "Lumis, USA", "Lumis, XX", "Ville, CA", "orvac", "Atlantis"]
    got = {r.query: r.geonameid for r in J.resolve_location(ask(frame, *q), index, {"italy": "IT"}).collect()}
    assert got == {"Brunna, Italy": 7, "**Lumis**": 3, "Lumis, USA": 4, "Lumis, XX": 3, "orvac": 2}


def test_nearest_equals_brute_force(frame):
    rng = np.random.default_rng(11)
    lat = np.concatenate([rng.uniform(-90, 90, 60), 48 + rng.normal(0, 0.01, 300), [89.9, -89.9, 10, 10]])
    lon = np.concatenate([rng.uniform(-180, 180, 60), 2 + rng.normal(0, 0.01, 300), [10, 170, 179.99, -179.99]])
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    plat = np.concatenate([rng.uniform(-90, 90, 150), [90, -90, 10.001, 48.0, 48.0, 0.0]])
    plon = np.concatenate([rng.uniform(-180, 180, 150), [0, 0, 180.0, 2.0, 2.0, 540.0]])
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(plat, plon))]
    out = N.nearest_place(frame("point_id int, lat double, lon double", pts), frame("geonameid int, lat double, lon double", places))
    got = {r.point_id: r for r in out.collect()}
    assert len(got) == len(pts)
    for i, a, b in pts:
        p, q = np.deg2rad(a), np.deg2rad(lat)
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.deg2rad(lon - b) / 2) ** 2
        d = 2 * 6371 * np.arcsin(np.sqrt(h))
        assert got[i].distance_km == pytest.approx(d.min(), abs=1e-6)
        assert d[got[i].geonameid] == pytest.approx(d.min(), abs=1e-6)


@pytest.mark.parametrize("scope", [[], ["zone"]])
def test_nearest_over_many_groups_and_blocks(frame, monkeypatch, scope):
    """Small groups, a crowded spot asked by most locations, far locations, scopes without a place."""
    for name, value in (("GROUP", 10), ("BLOCK", 40), ("LANDMARKS", 3)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(5)
    lat = np.concatenate([rng.uniform(-90, 90, 80), 48 + rng.normal(0, 0.001, 250), [5.0, 5.0]])
    lon = np.concatenate([rng.uniform(-180, 180, 80), 2 + rng.normal(0, 0.001, 250), [7.0, 7.0]])
    zone = rng.choice(["a", "b", "c"], len(lat))
    plat = np.concatenate([rng.uniform(-90, 90, 200), 48 + rng.normal(0, 0.001, 300), [5.0]])
    plon = np.concatenate([rng.uniform(-360, 360, 200), 2 + rng.normal(0, 0.001, 300), [7.0]])
    pzone = rng.choice(["a", "b", "none"], len(plat))
    places = frame("geonameid long, zone string, lat double, lon double", [(i, z, float(a), float(b)) for i, (z, a, b) in enumerate(zip(zone, lat, lon))])
    points = frame("zone string, lat double, lon double", [(z, float(a), float(b)) for z, a, b in zip(pzone, plat, plon)] * 2 + [("a", None, 1.0)])
    index = N.build_index(places, scope)
    assert index.targets.select("group").distinct().count() > 10
    got = {(*[r[c] for c in scope], r.lat, r.lon): r for r in N.nearest(points, places, scope, index=index).collect()}
    want = 0
    for z, a, b in zip(pzone, plat, plon):
        ok = (zone == z) if scope else np.ones(len(lat), bool)
        if not ok.any():
            continue
        want += 1
        p, q = np.deg2rad(a), np.deg2rad(lat)
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.deg2rad(lon - b) / 2) ** 2
        d = np.where(ok, 2 * 6371 * np.arcsin(np.sqrt(h)), np.inf)
        r = got[(z, a, b) if scope else (a, b)]
        assert r.distance_km == pytest.approx(d.min(), abs=1e-6) and r.geonameid == np.flatnonzero(d <= d.min() + 1e-7)[0]
    assert len(got) == want
    assert N.nearest(points, places.limit(0), scope).count() == 0 and N.nearest(points.limit(0), places, scope).count() == 0


def test_resolve_place_labels(frame):
    places = frame(PLACES, [(1, "City A", "City A", "US", 10.0, 20.0, 1000, ""), (2, "", "", None, 11.0, 21.0, 0, "")])
    names = frame("code string, name string", [("US", "United States"), ("NA", "Namibia")])
    P = "point_id int, lat double, lon double, country_code string, ocean_id int, ocean_name string"
    pts = frame(P, [(1, 10.1, 20.0, "US", None, None), (2, 10.0, 20.001, None, 1, "Sea"), (3, 10.3, 20.0, None, 1, "Sea"),
                    (4, 15.0, 20.0, None, 1, None), (5, -22.0, 17.0, "NA", None, None), (6, 11.0, 21.0, None, None, None)])
    got = {r.point_id: (r.label, r.geonameid, r.population) for r in N.resolve_place(pts, places, names).collect()}
    assert got == {1: ("City A", 1, 1000), 2: ("City A", 1, None), 3: ("Sea off City A", 1, None), 4: ("Open Ocean", 2, None),
                   5: ("Namibia", 1, 1000), 6: ("2", 2, None)}


def test_marine_ids_skip_used_ones(frame):
    tri = lambda i, name, norm, x, y: [(i, i, name, norm, x + dx, y + dy) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (0.5, 1.0))]
    v = frame("feature_id int, feature_order int, name string, norm_name string, lon double, lat double",
              tri(1, "North Atlantic Ocean", "north atlantic ocean", -40, 20) + tri(2, "Grellen Sea", "barents sea", 40, 75))
    index = frame("geonameid long, label string, city_name string, country_name string, country_code string, lat double, lon double, "
                  "population long, feature_code string, alt_names string", [(2_000_000_000, "x", "x", "", "US", 0.0, 0.0, 1, "PPL", "")])
    out = {r.label: (r.geonameid, r.country_code) for r in J.append_marine(index, RGD.circular_centroids(v)).collect()}
    assert out["Grellen Sea"] == (2_000_000_001, "OC") and out["North Atlantic Ocean"] == (2_000_000_002, "OC")


def test_centroid_crosses_the_dateline(frame):
    v = frame("feature_id int, feature_order int, name string, norm_name string, lon double, lat double",
              [(1, 1, "S", "s", 179.0, 0.0), (1, 1, "S", "s", -179.0, 2.0)])
    r = RGD.circular_centroids(v).first()
    assert abs(abs(r.lon) - 180) < 1e-9 and r.lat == 1.0


def test_dedupe_and_title(frame):
    rows = [(1, "Aa", "X", 1.0, 1.0, 5, "PPL"), (2, "aa", "X", 1.000001, 1.0, 5, "PPLC"), (3, "AA", "Y", 1.0, 1.0, 1, "PPL")]
    p = frame("geonameid long, city_name string, country_code string, lat double, lon double, population long, feature_code string", rows)
    assert {r.geonameid for r in J.dedupe_places(p).collect()} == {2, 3}
    t = frame("s string", [("NORTH D'URVILLE-SEA",), ("Baltic SEA",), ("",)]).select(TX.title_if_upper(F.col("s")).alias("t"))
    assert [r.t for r in t.collect()] == ["North D'Urville-Sea", "Baltic SEA", ""]


@pytest.mark.parametrize("ms,want", [([12, 1, 2], "December–February"), ([6, 7, 8], "June–August"), ([1, 3], "January, March"), ([5, 5, 40], "May"),
                                     (list(range(1, 13)), None), ([], None)])
def test_month_span(frame, ms, want):
    assert frame("m array<int>", [(ms,)]).select(TX.month_span_label(F.col("m"))).first()[0] == want


def test_unit_pairs(frame):
    df = frame("c double", [(20.04,)]).select(TX.both_units(F.col("c")).alias("t"))
    assert df.first().t == "[[20.0°C|68.0°F]]"
    assert df.select(TX.pick_unit(F.col("t"), "F")).first()[0] == "68.0°F"


@pytest.mark.parametrize("stored", [False, True])
def test_autocomplete_matches_a_scan(frame, stored):
    rng = np.random.default_rng(4)
    words = ["lan", "land", "island", "san", "santa", "ana", "nda"]
    rows = [(i, " ".join(rng.choice(words, 2)), str(rng.choice(words)), "X", 0.0, 0.0, int(p), "") for i, p in enumerate(rng.integers(0, 20, 200))]
    asked = ["land", "AN", "lan", "sla", "a san", "zzz", "and is"]
    got = {}
    places = frame(PLACES, rows)
    index = J.trigram_index(places) if stored else None
    for r in J.autocomplete(ask(frame, *asked), places, limit=4, index=index).collect():
        got.setdefault(r.query, []).append((r["rank"], r.geonameid))
    for q in asked:
        n = q.lower()
        hits = sorted((-p, label, i) for i, label, city, *_x, p, _a in rows if len(n) >= 3 and (n in label or n in city))
        assert [g for _, g in sorted(got.get(q, []))] == [i for *_y, i in hits[:4]]


def test_folding_costs_one_lookup_a_character(frame):
    """No character class of hundreds of members is matched, and only words with a long folding are taken apart."""
    words = ["Straße", "ﬁne", "x", "½", "Ⅷ", "É12", "", "№", "ﷺ"]
    texts = [" ".join(words), "  ß  ", "ß", "a ß\tb c", "plain", "", None]
    df = frame("i int, t string", list(enumerate(texts))).withColumn("n", TX.norm_name(F.col("t")))
    got = {r.i: r.n for r in df.collect()}
    assert got == {0: "strasse fine x 1 2 viii e12 no", 1: "ss", 2: "ss", 3: "a ss b c", 4: "plain", 5: "", 6: ""}
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all(len(p.split("]", 1)[0]) < 100 for p in plan.split(", [")[1:])


def test_a_common_name_is_not_multiplied_by_its_queries(frame, monkeypatch):
    """Only the best place of a name, and its best in the named country, are stored for a query."""
    rows = [(i, f"Santa, C{i % 3}", "Santa", ["AA", "BB", None][i % 3], 0.0, 0.0, None if i == 7 else i % 50, "San,San") for i in range(300)]
    asked = [f"{stars}Santa, {land}" for stars in ("", "*", "**") for land in ("aa", "bb", "cc", "C0", "")]
    kept, stable = [], J.stable
    monkeypatch.setattr(J, "stable", lambda df: (kept.append(stable(df)), kept[-1])[1])
    places = frame(PLACES, rows)
    got = {r.query: r.geonameid for r in J.resolve_location(ask(frame, *asked), places).collect()}
    assert max(df.count() for df in kept) <= 4 * len(asked)
    lowest = lambda r: (r[6] is not None, -(r[6] or 0), r[1], r[0])
    for q in asked:
        land = q.split(",")[1].strip().upper()
        whole = [r for r in rows if r[1].lower() == q.strip("*").lower()]
        hits = [(r[3] != land, stage, lowest(r), r[0]) for stage, found in enumerate((whole, rows)) for r in found]
        assert got[q] == min(hits)[-1], q
    one = J.resolve_name(ask(frame, "san", "SAN", "Santa"), places).collect()
    assert {r.query: r.geonameid for r in one} == {"san": 49, "SAN": 49, "Santa": 49}


def test_names_are_normalised_by_many_tasks(spark, frame):
    """A table that is one file is one task, which normalising must not stay in."""
    places = frame(PLACES, [(i, f"É{i}, Land", f"É{i}", "AA", 0.0, 0.0, i, "x") for i in range(500)]).coalesce(1)
    for named in (J.trigram_index(places), J._names(places)):
        assert named.select(F.spark_partition_id().alias("p")).distinct().count() > 1
