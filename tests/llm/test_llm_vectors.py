"""Vector searches against brute force, with odd rows and forced small tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import block_join, norm_buckets, vectors

NAN, INF = float("nan"), float("inf")


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(int(i), rows[i - 400][1]) for i in range(400, 440)]  # equal vectors under other ids
    rows += [(440, None), (441, []), (442, [0.0] * 8), (443, [NAN] + [1.0] * 7), (444, [INF] * 8), (445, [None] + [1.0] * 7),
             (None, [1.0] * 8), (450, [1.0, 2.0]), (500, [2.0, 1.0]), (600, [3.0]), (0, rows[0][1]), (700, [100.0] * 8)]
    return rows


def clean(rows, zero_ok):
    out = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or (not zero_ok and not any(v)):
            continue
        out[i] = max(out.get(i, v), v)
    return {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in out.items()}


def brute(vecs, mod, k, score, sign):
    out = set()
    for q in (i for i in vecs if i % mod == 0):
        found = sorted((sign * score(vecs[q], vecs[c]), c) for c in vecs if c != q and len(vecs[c]) == len(vecs[q]))
        out |= {(q, n, c, sign * s) for n, (s, c) in enumerate(found[:k], 1)}
    return out


def euclid(a, b):
    d = a - b
    return float(np.sqrt(np.cumsum(d * d)[-1]))


def inner(a, b):
    return int(np.floor(256 * a).astype(np.int64) @ np.floor(256 * b).astype(np.int64))


@pytest.fixture(params=["one tile", "many tiles"])
def tiles(request, monkeypatch):
    if request.param == "many tiles":
        monkeypatch.setattr(vectors, "PAIRS_PER_TILE", 500)
        monkeypatch.setattr(vectors, "ROWS_PER_TILE", 100)


def test_nearest(spark, frame, tiles):
    rows = odd_rows()
    df = frame("vec_id long, embedding array<float>, rank int, score string", [(*r, 1, "x") for r in rows])
    got = {tuple(r) for r in block_join.nearest(df, F.col("vec_id") % 10 == 0, 6).collect()}
    assert got == brute(clean(rows, False), 10, 6, euclid, 1)
    assert block_join.nearest(df.limit(0), F.col("vec_id") % 10 == 0, 6).count() == 0


def test_products(spark, frame, tiles):
    rows = odd_rows()
    df = frame("vec_id long, embedding array<float>, norm int", [(*r, 1) for r in rows])
    got = {tuple(r) for r in norm_buckets.top_products(df, F.col("vec_id") % 10 == 0, 5).collect()}
    assert got == brute(clean(rows, True), 10, 5, inner, -1)
    assert norm_buckets.top_products(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_products_of_varied_lengths_prune_and_stay_exact():
    rng = np.random.default_rng(5)
    c = np.floor(256 * rng.normal(size=(3000, 16)) * rng.exponential(1, size=(3000, 1)))
    ids = rng.permutation(3000)
    looked = 0
    for qi in range(0, 40):
        out = norm_buckets.search(ids[qi : qi + 1], c[qi : qi + 1], ids, c, 5, (ids[:64], c[:64]))
        s = (c @ c[qi]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -s)) if j != qi][:5]
        assert [(o[1], o[2]) for o in out] == [(ids[j], s[j]) for j in order]
    unit = c / np.linalg.norm(c, axis=1)[:, None]
    norms = np.linalg.norm(c, axis=1)
    order = np.argsort(-norms)
    q = c[1]
    for share in (0.3, 0.8, 0.95):
        at = norm_buckets.candidates(unit[order], norms[order], unit[1], norms[1], share * norms[1] * norms[order][0])
        wanted = np.flatnonzero(c[order] @ q >= share * norms[1] * norms[order][0])
        assert at is None or set(wanted) <= set(at.tolist())
        looked += 0 if at is None else len(at)
    assert looked < 3 * 3000
    assert norm_buckets.candidates(unit[order], norms[order], unit[1], norms[1], 1.1 * norms[1] * norms[order][0]) is None


def test_huge_components_stop_at_the_limits_of_a_long():
    p, q = np.array([[2.0 ** 60, 0.0], [-(2.0 ** 60), 1.0]]), np.array([2.0 ** 10, 3.0])
    assert norm_buckets.products(p, q).tolist() == [(1 << 63) - 1, -(1 << 63)]
    assert norm_buckets.products(np.array([[2.0 ** 30, 3.0]]), np.array([2.0 ** 30, 5.0])).tolist() == [2 ** 60 + 15]


def test_error_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 33)) * rng.exponential(5, size=(200, 1))
    q, s, r = block_join.quantised(x)
    assert np.abs(q).max() <= 127
    rest = np.linalg.norm(x - q * s[:, None], axis=1)
    assert (rest <= r + 1e-12).all()


def test_grid_tiles_are_bounded():
    for n in (0, 1, 10 ** 4, 10 ** 7, 10 ** 9):
        across, down = vectors.grid(n // 100, n)
        assert n // 100 / across <= vectors.ROWS_PER_TILE + 1 and n / down <= vectors.ROWS_PER_TILE + 1
        assert (n // 100 / across) * (n / down) <= vectors.PAIRS_PER_TILE * 1.01 + 1


def test_small_grids_spread_over_the_slots():
    assert vectors.grid(103, 10_256, 24) == (1, 5)
    across, down = vectors.grid(513, 51_282, 24)
    assert across * down == 24 and vectors.grid(1, 10, 24) == (1, 1)
