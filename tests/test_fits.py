"""Robust fits, direction families and clear rectangles against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fits


def plain_refined(m, z, scale, shift, inlier, rounds=3):
    for _ in range(rounds):
        near = np.abs((scale * m + shift) * z - 1) <= inlier
        a = np.stack([m[near] * z[near], z[near]], 1)
        s = a.T @ a
        if np.linalg.det(s) <= 1e-9 * s[0, 0] * s[1, 1]:
            break
        new = np.linalg.solve(s, a.sum(0))
        if new[0] <= 0:
            break
        scale, shift = new
    return scale, shift, int((np.abs((scale * m + shift) * z - 1) <= inlier).sum())


def test_robust_fits_equal_plain_ones_for_every_key(spark):
    r, rows = np.random.default_rng(3), []
    for k in range(12):
        n = [400, 60, 30, 3][k % 4]
        z = r.uniform(0.5, 6, n)
        m = (1 / z - 0.1 * k / 12) / (0.5 + k / 10) + r.normal(0, 0.002, n)
        m[r.random(n) < 0.3] = 9.0
        rows += [(k, j, float(a), float(b), "clash") for j, (a, b) in enumerate(zip(m, z, strict=True))]
    rows += [(50, 0, 1.0, 2.0, "one row"), (51, 0, 1.0, 2.0, ""), (51, 1, 1.0, 3.0, "no scale"), (52, 0, None, 1.0, ""), (53, 0, 1.0, -1.0, ""), (None, 0, 1.0, 1.0, "")]
    mix = lambda i, s: (i * (31 + 7 * s) + s * 17) % 1009
    df = spark.createDataFrame(rows, "k long, i long, m double, z double, draw string").repartition(5)
    got = {x["k"]: x for x in fits.robust_fit(df, ["k"], "i", "m", "z", 0.05, draws=8, mix=mix).collect()}
    assert set(got) == {*range(12), 50, 51}
    assert all(got[k]["scale"] is None and got[k]["inliers"] == 0 for k in (50, 51))
    for k in range(12):
        one = [(i, m, z) for g, i, m, z, _ in rows if g == k]
        m, z = np.array([x[1] for x in one]), np.array([x[2] for x in one])
        tried = []
        for d in range(8):
            pick = [min(one, key=lambda x, s=s: ((x[0] * (31 + 7 * s) + s * 17) % 1009, x)) for s in (2 * d, 2 * d + 1)]
            if pick[0][1] != pick[1][1]:
                scale = (1 / pick[0][2] - 1 / pick[1][2]) / (pick[0][1] - pick[1][1])
                shift = 1 / pick[0][2] - scale * pick[0][1]
                if scale > 0:
                    tried.append((round(float(np.minimum(((scale * m + shift) * z - 1) ** 2, 0.0025).sum()), 9), d, scale, shift))
        if not tried:
            assert got[k]["scale"] is None
            continue
        scale, shift, inliers = plain_refined(m, z, *min(tried)[2:], 0.05)
        assert got[k]["n"] == len(one) and got[k]["inliers"] == inliers
        assert got[k]["scale"] == pytest.approx(scale, rel=1e-6) and got[k]["shift"] == pytest.approx(shift, rel=1e-5, abs=1e-7)
    assert fits.robust_fit(df.limit(0), ["k"], "i", "m", "z", 0.05, draws=2).collect() == []


@pytest.mark.parametrize("tolerance", [15.0, 60.0])
def test_families_are_those_of_a_fold_in_input_order(spark, tolerance):
    r = random.Random(7)
    rows = [(r.choice([1, 2, None]), k, r.choice([r.uniform(0, 180), 0.0, 179.9, 15.0, -3.0, 540.0]), "x") for k in range(300)] + [(1, 900, None, "x"), (1, None, 5.0, "x")]
    want, leaders = {}, {}
    for g, k, h, _ in sorted((x for x in rows if x[1] is not None), key=lambda x: x[1]):
        if h is None:
            want[k] = (None, None)
            continue
        known = leaders.setdefault(g, [])
        delta = [min(abs(h - q) % 180, 180 - abs(h - q) % 180) for _, q in known]
        f = next((j for j, d in enumerate(delta) if d <= tolerance), None)
        if f is None:
            f = len(known)
            known.append((k, h))
        want[k] = (known[f][0], f)
    df = spark.createDataFrame(rows, "g long, k long, h double, leader string")
    out = fits.direction_families(df, ["g"], "k", "h", tolerance)
    assert out.columns == ["g", "k", "h", "leader", "family"] and out.count() == len(rows)
    assert {x["k"]: (x["leader"], x["family"]) for x in out.where("k IS NOT NULL").collect()} == want
    assert fits.direction_families(df.limit(0), ["g"], "k", "h", tolerance).collect() == []


def test_clear_rectangles_equal_brute_force(spark):
    r, rows, want = random.Random(1), [], {}
    for g in range(40):
        h, w, share = r.randint(1, 7), r.randint(1, 8), r.choice([0.0, 0.4, 0.75, 1.0])
        grid = [[r.random() < share for _ in range(w)] for _ in range(h)]
        rows += [(g, a - 3, b + 5, grid[a][b]) for a in range(h) for b in range(w)]
        want[g] = max(
            ((z - a) * (y - b) for a in range(h) for z in range(a + 1, h + 1) for b in range(w) for y in range(b + 1, w + 1) if all(grid[i][j] for i in range(a, z) for j in range(b, y))), default=0
        )
    rows += [(100, 0, 0, True), (100, 0, 0, False), (101, 0, 0, None), (None, 0, 0, True), (None, 0, 2, True), *rows[:9]]
    want |= {100: 0, 101: 0, None: 1}
    df = spark.createDataFrame(rows, "g long, r long, c long, free boolean").withColumn("h", F.lit("clash")).withColumn("start", F.lit(1))
    got = {x["g"]: x["cells"] for x in fits.largest_clear_rectangles(df, ["g"], "r", "c", "free").collect()}
    assert got == want
    assert fits.largest_clear_rectangles(df.limit(0), ["g"], "r", "c", "free").collect() == []
