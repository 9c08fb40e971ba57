"""Pieces of points against a plain version."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import pieces


def plain_object(points, cell, substantial, linking):
    """points: (point, x, y, z, depth, sheet) of one frame."""
    at = {n: tuple(math.floor(v / cell) for v in (x, y, z)) for n, (_, x, y, z, _, _) in enumerate(points)}
    count, solid = Counter(at.values()), Counter(at[n] for n, p in enumerate(points) if not p[5])
    links = {c for c in count if solid[c] >= linking}
    around = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if x or y or z]
    near = lambda c: [t for d in around if (t := (c[0] + d[0], c[1] + d[1], c[2] + d[2])) in links]
    root = {}
    for first in sorted(links):
        edge = [first] if first not in root else []
        root.setdefault(first, first)
        while edge:
            for t in near(edge.pop()):
                if t not in root:
                    root[t] = root[first]
                    edge.append(t)
    for c in set(count) - links:
        root[c] = root[near(c)[0]] if near(c) else c
    depths = defaultdict(list)
    for n, p in enumerate(points):
        depths[root[at[n]]].append(p[4])
    if not depths:
        return []
    most = max(map(len, depths.values()))
    chosen = min((sorted(d)[len(d) // 2], r) for r, d in depths.items() if len(d) >= substantial * most)[1]
    footprint = {(c[0] + x, c[2] + z) for c in count if root[c] == chosen for x in (-1, 0, 1) for z in (-1, 0, 1)}
    over = Counter(root[c] for c in at.values() if (c[0], c[2]) in footprint)
    return sorted(p[0] for n, p in enumerate(points) if root[at[n]] == chosen or 2 * over[root[at[n]]] >= len(depths[root[at[n]]]))


@pytest.mark.parametrize("linking", [1, 2])
def test_objects_equal_a_plain_version_across_seams(spark, linking):
    r, rows = random.Random(linking), []
    for k in range(6):
        for n in range([400, 900, 60, 3, 1, 250][k]):
            blob = r.choice([(-12, 0, 3), (14, 2, -9), (40, 1, 40)])
            x, y, z = (b + r.gauss(0, 3) for b in blob) if r.random() < 0.7 else (r.uniform(-30, 50), r.uniform(-3, 9), r.uniform(-20, 50))
            rows.append((f"f{k}", n, x, y, z, round(x * x + z, 1), r.choice([True, False, False, None]), "clash"))
    rows += [("snake", n, n * 0.5, 0.0, 0.0, 1.0, False, "") for n in range(400)]  # one piece over many tiles
    odd = [(None, 1, 0.0, 0.0, 0.0, 1.0, False, ""), ("f0", None, 0.0, 0.0, 0.0, 1.0, False, ""), ("f0", 9000, None, 0.0, 0.0, 1.0, False, ""), ("f0", 9001, float("nan"), 0.0, 0.0, 1.0, False, ""), ("f0", 9002, float("inf"), 0.0, 0.0, 1.0, False, ""), ("f0", 9003, 0.0, 0.0, 0.0, None, False, "")]
    df = spark.createDataFrame(rows + odd, "k string, n int, x double, y double, z double, depth double, sheet boolean, root string").repartition(5)
    got = defaultdict(list)
    for k, n in pieces.connected_object(df, ["k"], "n", ("x", "y", "z"), "depth", "sheet", 1.0, 0.5, linking).collect():
        got[k].append(n)
    want = {k: plain_object([(n, x, y, z, d, s) for f, n, x, y, z, d, s, _ in rows if f == k], 1.0, 0.5, linking) for k in {x[0] for x in rows}}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want["snake"]) == 400


def test_no_points_have_no_object(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 1.0, False)], "k string, n int, x double, y double, z double, depth double, sheet boolean")
    assert pieces.connected_object(df.limit(0), ["k"], "n", ("x", "y", "z"), "depth", "sheet", 1.0).collect() == []
    assert [tuple(x) for x in pieces.connected_object(df, ["k"], "n", ("x", "y", "z"), "depth", "sheet", 1.0).collect()] == [("a", 1)]
    twice = df.unionByName(df).withColumn("sheet", F.lit(True))
    assert pieces.connected_object(twice, ["k"], "n", ("x", "y", "z"), "depth", "sheet", 1.0).count() == 2


def test_loose_cells_are_sent_once_and_nothing_is_broadcast(spark, monkeypatch):
    seen, plain = [], pieces.written
    monkeypatch.setattr(pieces, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    df = spark.createDataFrame([("a", n, float(n % 9), float(n % 5), float(n % 7), 1.0, False) for n in range(200)], "k string, n int, x double, y double, z double, depth double, sheet boolean")
    assert pieces.connected_object(df, ["k"], "n", ("x", "y", "z"), "depth", "sheet", 1.0).count() > 0
    assert any("SortMergeJoin" in p for p in seen) and [p for p in seen if "BroadcastExchange" in p or "turn, 25" in p] == []


def test_cells_too_far_apart_for_one_number(spark):
    r, far = random.Random(5), 3.0e6
    rows = [(n, s * far + r.uniform(0, 6), -s * far + r.uniform(0, 3), s * far + r.uniform(0, 6), r.random(), n % 6 == 0) for n in range(240) for s in [r.choice([-1, 1])]]
    df = spark.createDataFrame([("a", *x) for x in rows], "k string, n int, x double, y double, z double, depth double, sheet boolean")
    got = pieces.connected_object(df, ["k"], "n", ("x", "y", "z"), "depth", "sheet", 1.0)
    assert sorted(x[1] for x in got.collect()) == plain_object(rows, 1.0, 0.5, 2)
