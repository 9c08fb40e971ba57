"""Operators on edges: empty input, one row, exact thresholds, ties, all rows rejected, nulls and NaN,
repeated and late events."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.extension import Tools, classify_once
from tessera.operators import aggregates, gates, joins, selection, sequences, summaries, validation
from tessera.sources import documents
from tessera.streaming import stateful


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_weighted_score_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 3.0, 5.0), ("a", 3, float("nan"), 5.0), ("b", 1, 2.0, None)], "k string, i int, x double, y double")
    got = rows(sequences.weighted_score(df, ["k"], {"x": 0.6, "y": 0.4}), "k", "i", "score")
    assert got == [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 1.0)]


def test_scoring_set_falls_back(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False)], "k string, i int, ok boolean")
    assert rows(sequences.scoring_set(df, ["k"], F.col("ok")), "k", "i", "is_fallback") == [("a", 1, False), ("b", 1, True)]


def test_centred_score(spark):
    got = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 5), (1, 5)], "p int, n int").select(sequences.centred_score(F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 0, 1, 1, 0.5]


def test_weighted_quantile_takes_the_first_that_reaches(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 2.0, 1), ("a", 9.0, 1), ("b", 1.0, 0)], "k string, v double, w int")
    assert rows(aggregates.weighted_quantile(df, ["k"], "v", "w", 0.75), "k", "quantile") == [("a", 2.0), ("b", None)]
    assert aggregates.weighted_quantile(df.where("false"), ["k"], "v", "w", 0.5).count() == 0


def test_similarity_of_nothing_is_zero(spark):
    a = spark.createDataFrame([(1, 1, 0.0)], "g int, c int, n double")
    assert rows(aggregates.soft_similarity(a, a, ["g"], ["c"], "n"), "g", "soft_iou", "containment") == [(1, 0.0, 0.0)]


def test_ordinals(spark):
    df = spark.createDataFrame([(k, "chair", None) for k in range(23)] + [(50, "lamp", "red"), (60, "sofa", "red"), (61, "sofa", "blue"), (62, "sofa", "blue")], "id int, label string, colour string").withColumn("s", F.lit(1))
    got = dict(rows(sequences.spoken_names(df, ["s"], "label", "colour", "id"), "id", "name"))
    assert got[0] == "first chair" and got[9] == "tenth chair" and got[10] == "11th chair" and got[20] == "21st chair" and got[22] == "23rd chair"
    assert got[50] == "lamp" and got[60] == "red sofa" and got[61] == "first sofa" and got[62] == "second sofa"


def test_gate_measures_from_the_last_kept(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 4.0, 8.0, 12.0, 2.0])] + [("b", 0, 5.0)], "k string, i int, v double")
    assert rows(sequences.gate(df, ["k"], ["i"], "v", 8.0), "k", "i") == [("a", 0), ("a", 2), ("b", 0)]


def test_admission_charges_once_and_by_day(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([(1, "u", "x", t(1, 1)), (2, "u", "x", t(1, 2)), (3, "u", "y", t(1, 3)), (4, "u", "y", t(2, 1)), (5, "u", "z", t(1, 23)), (6, "u", "w", t(2, 0))], "i int, u string, b string, ts timestamp_ntz")
    got = rows(sequences.daily_admission(df, "u", "ts", ["ts", "i"], "b", 2), "i", "charged", "admitted")
    assert got == [(1, True, True), (2, False, True), (3, True, True), (4, False, True), (5, True, False), (6, True, True)]


def test_first_failure_and_reasons(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "i int, x int")
    p = validation.first_failure([("null", F.col("x").isNotNull(), F.lit("x")), ("large", F.col("x") < 10, F.col("x"))])
    assert [r[1] and tuple(r[1]) for r in df.select("i", p).orderBy("i").collect()] == [("null", "x"), None, ("large", "50")]
    r = df.select("i", validation.all_reasons([("a", F.col("x") > 1), ("b", F.col("x") > 10)]).alias("r")).orderBy("i").collect()
    assert [x["r"] for x in r] == [[], ["a"], ["a", "b"]]


def test_path_grammar(spark):
    paths = ["", "/a", "gs://b/c", "a/../b", "x" * 130, "a/b/c", "frames/1.jpg", "frames/1.exe", "frames/a b.jpg", None]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "i int, p string")
    got = df.select("i", validation.path_problem(F.col("p"), kinds={"frames": ("jpg",)})).orderBy("i").collect()
    assert [r[1] for r in got] == ["empty", "absolute", "store_url", "parent_segment", "too_long", "too_deep", None, "kind", "characters", "empty"]


def test_set_problems(spark):
    df = spark.createDataFrame([("ok", "a", 1), ("ok", "m", 1), ("twice", "m", 1), ("twice", "m", 1), ("none", "a", 1), ("big", "m", 99), ("many", "a", 1), ("many", "b", 1), ("many", "m", 1)], "g string, n string, s int")
    assert dict(rows(validation.set_problems(df, ["g"], "n", "s", "m", 2, 50), "g", "problem")) == {"ok": None, "twice": "repeated", "none": "missing", "big": "too_large", "many": "too_many"}


def test_overlay_last_write_wins(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    entries = spark.createDataFrame([(1, 1, "remove", None), (1, 2, "move", 9.0), (2, 1, "move", 8.0), (2, 2, "remove", None), (7, 1, "move", 0.0)], "k int, n int, op string, v double")
    assert rows(joins.overlay(base, entries, "k", ["n"], "op", "v"), "k", "v", "op") == [(1, 9.0, "move"), (3, 3.0, "keep")]
    assert rows(joins.orphaned(entries, base, "k").where("orphaned"), "k") == [(7,)]


def test_binned_joins_equal_plain_ones(spark):
    r = np.random.default_rng(2)
    p = r.uniform(-20, 20, (120, 2)).round(2)
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "i int, x double, y double")
    got = rows(joins.within(df.toDF("a", "ax", "ay"), df.toDF("b", "bx", "by"), "ax", "ay", "bx", "by", 3.0), "a", "b")
    assert got == sorted((i, j) for i in range(120) for j in range(120) if np.linalg.norm(p[i] - p[j]) <= 3.0)
    size = r.uniform(0, 9, (120, 2)).round(2)
    q = spark.createDataFrame([(k, *map(float, (*a, *(a + s)))) for k, (a, s) in enumerate(zip(p, size, strict=True))], "i int, x0 double, y0 double, x1 double, y1 double")
    want = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if (np.minimum(p[i] + size[i], p[j] + size[j]) - np.maximum(p[i], p[j]) > 0).all())
    assert rows(joins.overlapping(q, "i", 4.0), "a", "b") == want


def test_uncovered_spans(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("b", 0, 5), ("c", 0, 5)], "k string, lo int, hi int")
    cuts = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 8, 20), ("b", -5, 50)], "k string, cut_lo int, cut_hi int")
    assert rows(joins.uncovered(spans, cuts, ["k"], "lo", "hi"), "k", "free_lo", "free_hi") == [("a", 0, 1), ("a", 4, 8), ("c", 0, 5)]


def test_a_long_chain_is_one_component(spark):
    r = random.Random(3)
    ids = r.sample(range(10**6), 300)
    edges = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (-5, -3), (None, 4), (8, 8)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (*ids, -5, -3, 4, 8)], "n long")
    got = {x["n"]: x["component"] for x in joins.components(nodes, "n", edges, "a", "b").collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {-5: -5, -3: -5, 4: 4, 8: 8}


def test_chain_groups(spark):
    r = random.Random(4)
    rows = [(k, r.choice("xy"), float(r.randrange(60))) for k in range(50)] + [(99, None, 1.0), (98, "x", None)]
    got = joins.chain_groups(spark.createDataFrame(rows, "id long, g string, v double"), ["g"], "v", "id", 2.0).where("g is not null").collect()
    want = []
    for g in "xy":
        run = []
        for v, k in sorted((v, k) for k, q, v in rows if q == g and v is not None):
            if run and v - run[-1][0] > 2:
                want.append((g, min(i for _, i in run), len(run)))
                run = []
            run.append((v, k))
        want.append((g, min(i for _, i in run), len(run)))
    assert sorted((x["g"], x["component"], x["members"]) for x in got) == sorted(want)


def test_closure_and_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "c int, p int")
    assert joins.closure(e, "c", "p").count() == 9 * 10 // 2 + 1
    nodes = spark.range(30).select(F.col("id").cast("int").alias("n"))
    got = dict(rows(joins.components(nodes, "n", e, "c", "p"), "n", "component"))
    assert all(got[k] == 0 for k in range(10)) and got[21] == 20 and got[15] == 15


def test_tiers_refuse_what_is_ambiguous(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ask string")
    t0 = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "name string, target int")
    t1 = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "name string, target int")
    assert rows(joins.tiered_lookup(q, "ask", [t0, t1]), "ask", "tier", "hits", "target") == [("a", 0, 1, 1), ("b", 0, 2, None), ("c", 1, 1, 9), ("d", None, 0, None)]


def test_farthest_points_and_cover():
    x = np.array([[0.0, 0, 0], [1, 0, 0], [10, 0, 0], [10, 1, 0], [5, 0, 0]])
    d = selection.pose_distance(x, np.zeros((5, 3)))
    assert selection.farthest_points(d, 9) == [0, 1, 2, 3, 4] and selection.farthest_points(d, 2) == [0, 3]
    assert selection.farthest_points(np.zeros((4, 4)), 2) == [0, 1]
    f = pd.DataFrame({"f": [1, 1, 2, 3], "i": [1, 2, 3, 1], "v": [1.0, 1.0, 2.0, 5.0]})
    assert selection.cover(f, "f", "i", "v", 5) == [3, 2, 1]


def test_poses_by_blocks_equal_the_whole_matrix(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(140, 6))
    x[5, 3:] = 0
    keys = ["hot"] * 100 + [None] * 35 + ["few"] * 5
    df = spark.createDataFrame([(k, i, *map(float, v)) for i, (k, v) in enumerate(zip(keys, x, strict=True))], "k string, i int, x double, y double, z double, u double, v double, w double")
    got = selection.sample_poses(df.repartition(3), ["k"], "i", ["x", "y", "z"], ["u", "v", "w"], 7, block=16)
    want = [at + j for at, n in ((0, 100), (100, 35), (135, 5)) for j in selection.farthest_points(selection.pose_distance(x[at : at + n, :3], x[at : at + n, 3:]), 7)]
    assert got.columns == df.columns and rows(got, "i") == [(j,) for j in want]


def test_diverse_picks_stream(spark):
    r = np.random.default_rng(6)
    data = [(None if i % 9 == 0 else f"k{i % 3}", i, float(r.integers(0, 40)), float(r.uniform(0, 360))) for i in range(400)]
    got = selection.diverse(spark.createDataFrame(data, "k string, i int, s double, a double"), "k", "i", "s", "a", 6, 30.0)
    want = []
    for key in {d[0] for d in data}:
        taken = []
        for d in sorted((d for d in data if d[0] == key), key=lambda d: (-d[2], d[1])):
            if len(taken) < 6 and all(abs((d[3] - t[3] + 180) % 360 - 180) >= 30 for t in taken):
                taken.append(d)
        want += [(d[1],) for d in taken]
    assert rows(got, "i") == sorted(want)
    assert "InPandas" in (plan := got._jdf.queryExecution().toString()) and "FlatMapGroupsInPandas" not in plan


def test_limits_are_errors(spark):
    with pytest.raises(ValueError):
        selection.newest_first(spark.range(3), "id", "id", 101)


def test_permissive_json_never_fails(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "{bad"), (3, None)], "i int, s string")
    assert rows(documents.permissive_json(df, "s", "k long"), "i", "doc.k", "reason") == [(1, 1, None), (2, None, "malformed"), (3, None, "missing")]
    with pytest.raises(Exception):
        documents.strict_json(df, "s", "k long").select("doc.k").collect()


def test_binary_records(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.bin").write_bytes(documents.pack_records([(10 * k + j, j, 0.5, -1.0) for j in range(k)]))
    spark.dataSource.register(documents.BinaryRecords)
    got = rows(spark.read.format("binary_records").option("path", f"file://{tmp_path}").load(), "id", "x")
    assert got == [(10, 0.0), (20, 0.0), (21, 1.0)]


def test_key_values_take_the_last(spark):
    df = spark.createDataFrame([("a: 1\nb:2\n#c: 3\na:  4 ",), ("",)], "s string").select(documents.key_values(F.col("s")).alias("m"))
    assert [r["m"] for r in df.collect()] == [{"b": "2", "a": "4"}, {}]


def test_model_is_called_once_for_each_prompt(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "p string")
    assert sorted(map(str, classify_once(df, "p", lambda ps: [p + "!" for p in ps]).select("answer").collect())) == sorted(map(str, [("Row(answer='x!')")] * 2 + ["Row(answer='y!')", "Row(answer=None)"]))


def streamed(spark, tmp_path, data, schema, work, batches=2):
    for k in range(batches):
        spark.createDataFrame(data[len(data) * k // batches : len(data) * (k + 1) // batches], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return stateful.run_once(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema, work, f"file://{tmp_path}/out")


def test_leases(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    data = [(1, "a", t(0), 1), (1, "b", t(5), 2), (1, "a", t(8), 3), (1, "b", t(18), 4), (2, "b", t(0), 5)]
    got = streamed(spark, tmp_path, data, "r long, h string, ts timestamp, e long", lambda s: stateful.lease_claims(s, "r", "h", "ts", "e", 10.0), batches=1)
    assert dict(rows(got, "e", "outcome")) == {1: "claimed", 2: "already_owned", 3: "renewed", 4: "reclaimed", 5: "claimed"}  # exactly at the TTL the lease is stale


def test_turns_in_order_of_their_checks(spark, tmp_path):
    t = lambda d, m: dt.datetime(2024, 1, d, 23, m)
    data = [(1, 1, t(1, 0)), (1, 1, t(1, 1)), (1, 2, t(1, 2)), (1, 3, t(1, 20)), (1, 4, t(1, 40)), (1, 5, t(2, 0))]
    got = streamed(spark, tmp_path, data, "u long, m long, ts timestamp", lambda s: stateful.turn_acceptance(s, "u", "m", "ts", 2, 600.0), batches=1)
    assert [r["outcome"] for r in got.orderBy("ts").collect()] == ["accepted", "replay", "busy", "accepted", "rested", "accepted"]


def test_state_machine(spark, tmp_path):
    data = [(1, k, dt.datetime(2024, 1, 1, 0, k), s) for k, s in enumerate(["ready", "processing", "ready", "queued"])]
    got = streamed(spark, tmp_path, data, "x long, e long, ts timestamp, target string", lambda s: stateful.fold_states(s, "x", "target", "ts", "e"), batches=1)
    assert rows(got, "e", "before", "allowed") == [(0, "queued", False), (1, "queued", True), (2, "processing", True), (3, "ready", False)]
    final = validation.edge_allowed(F.lit("ready"), F.lit("queued"))
    assert not spark.range(1).select(final).first()[0]


def test_repeated_events_are_taken_once(spark, tmp_path):
    data = [(k % 4, dt.datetime(2024, 1, 1, 0, k)) for k in range(12)]
    got = streamed(spark, tmp_path, data, "k int, ts timestamp", lambda s: stateful.once_each(s, ["k"], "ts", "1 day"))
    assert sorted(r[0] for r in got.select("k").collect()) == [0, 1, 2, 3]


def test_average_rotations(spark):
    r = np.random.default_rng(5)
    rows = [(k % 3, *map(float, q)) for k, q in enumerate(r.normal([0.2, 0.1, 0.3, 0.9], 0.05, (60, 4)))]
    rows += [(0, *[-c for c in rows[0][1:]]), (1, None, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0)]
    got = {x["k"]: np.array(x[1:]) for x in summaries.average_rotation(spark.createDataFrame(rows, "k int, x double, y double, z double, w double"), "k", list("xyzw")).collect()}
    for k in range(3):
        q = np.array([x[1:] for x in rows if x[0] == k and None not in x and any(x[1:])], dtype=float)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        top = np.linalg.eigh(q.T @ q)[1][:, -1]
        assert np.allclose(got[k], top * np.sign(top[3]))


def test_hulls(spark):
    r = random.Random(6)
    rows = [("square", float(x), float(y)) for x in (0, 1, 2) for y in (0, 1, 2)] + [("line", float(k), float(k)) for k in range(5)] + [("point", 1.0, 1.0)] * 3 + [("square", None, 1.0)]
    rows += [("disc", r.random(), r.random()) for _ in range(300)]
    got = {x["k"]: (x["n_corners"], x["area"]) for x in summaries.hull_areas(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert got["square"] == (4, 4.0) and got["line"] == (2, 0.0) and got["point"] == (1, 0.0)
    p = [x[1:] for x in rows if x[0] == "disc"]
    # an edge of the hull has all points on one side
    edges = [(a, b) for a in p for b in p if a != b and all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= 0 for q in p)]
    assert got["disc"] == (len(edges), pytest.approx(sum(a[0] * b[1] - a[1] * b[0] for a, b in edges) / 2))


def test_gates_on_their_edges(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xd8")), (3, bytearray(b"\xff\xd8\xff" + bytes(9))), (4, bytearray(b"\xff\xd8\xfe" + bytes(9))), (5, bytearray(b"\xff\xd8\xff" + bytes(90)))], "k int, b binary")
    got = dict(rows(df.select("k", gates.blob_problem(F.col("b"), b"\xff\xd8\xff", 10, 50).alias("p")), "k", "p"))
    assert got == {1: "missing", 2: "too_small", 3: None, 4: "wrong_type", 5: "too_large"}
    e = spark.createDataFrame([(1, 1, 2, "at"), (2, 2, 1, "over"), (3, 2, 2, "at"), (4, 2, 3, "over"), (5, 3, 2, "at"), (6, 9, 1, "at")], "pos int, a int, b int, how string")
    sizes = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "k int, size int")
    assert rows(gates.settled_edges(e, "a", "b", "how", "pos", sizes, "k", "size"), "pos", "a", "b", "action") == [(1, 2, 1, "turned"), (2, 2, 1, "dropped_second"), (3, 2, 2, "dropped_self"), (4, 2, 3, "dropped_over"), (5, 3, 2, "kept")]


def test_tools_see_only_rows_that_name_them_with_all_arguments(spark):
    tools = Tools(spark)
    tools.add("view", "backwards", ["name"], lambda name: name[::-1])
    tools.add("click", "twice", ["number"], lambda n: 2 * int(n))
    tools.add("now", "no argument", [], lambda: None)
    given = [(1, "view", {"name": "abc"}), (2, "click", {"number": "4"}), (3, "click", {"name": "abc"}), (4, "click", {"number": None}), (5, "click", {"number": "x"}), (6, "gone", {}), (7, None, {}), (8, "view", None), (9, "now", {}), (10, "view", {"name": ""})]
    df = spark.createDataFrame([(*r, "clash") for r in given], "i int, tool string, a map<string,string>, result string").repartition(3)
    want = [(1, "cba", "ok"), (2, "8", "ok"), (3, None, "missing_argument"), (4, None, "missing_argument"), (5, None, "failed"), (6, None, "unknown_tool"), (7, None, "unknown_tool"), (8, None, "missing_argument"), (9, None, "ok"), (10, "", "ok")]
    assert rows(tools.call(df, "tool", "a"), "i", "result", "outcome") == want
    assert rows(tools.call(df.limit(0), "tool", "a"), "i") == [] and {r["outcome"] for r in Tools(spark).call(df, "tool", "a").collect()} == {"unknown_tool"}


def test_gates_keep_columns_of_their_own_names(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0, 7, 8), ("a", 1.0, 0.0, 7, 8), ("b", 1.0, 1.0, 7, 8)], "k string, x double, y double, planes int, _planes int")
    planes = spark.createDataFrame([("a", 1.0, 0.0, 0.0)], "k string, nx double, ny double, d double")
    assert rows(gates.off_planes(points, planes, "k", ["x", "y"], 0.1), *points.columns) == [("a", 1.0, 0.0, 7, 8), ("b", 1.0, 1.0, 7, 8)]
    got = gates.rule_rows(points.withColumn("rule", F.lit(1)).withColumn("_r", F.lit(2)), "k", [("a", "left", 1), ("a", "right", 2)])
    assert got.columns == ["k", "x", "y", "planes", "_planes", "rule", "_r", "side", "depth"] and got.count() == 4
    now, before = (spark.createDataFrame([(1, v, 5.0), (2, None, 1.0)], "i int, v double, _v double") for v in (1.0, 3.0))
    assert rows(gates.moved(now, before, "i", ["v"], 1.0), "i", "moved_by") == [(1, 2.0)] and rows(gates.moved(now, before, "i", ["_v"], 1.0), "i") == []


def test_distance_joins_send_no_side_through_the_driver(spark):
    side = lambda names: spark.range(30).select(F.col("id").alias(names[0]), F.lit(0).alias("room"), (F.col("id") * 1.0).alias(names[1]), F.lit(0.0).alias(names[2]))
    p = joins.within(side(["a", "ax", "ay"]), side(["b", "bx", "by"]), "ax", "ay", "bx", "by", 2.0, ["room"])
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert p.count() == 30 + 2 * 29 + 2 * 28


def test_fenced_writes_hold_many_entities_in_few_buckets(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)
    data = []
    for k, who in enumerate([None, 1, 2**60 + 1, 3, *range(100, 140)]):
        data += [(who, "a", at(0), 10 * k, "processing"), (who, "b", at(1), 10 * k + 1, "working"), (who, "a", at(2), 10 * k + 2, "ready"), (who, "b", at(3), 10 * k + 3, "processing")]
    schema = "n long, h string, ts timestamp, e long, to string"
    want = sorted((d[3], str(d[0]), o) for d, o in zip(data, ["claimed", "fenced", "written", "terminal"] * 44, strict=True))
    for buckets, batches in ((1, 1), (3, 4)):
        got = streamed(spark, tmp_path / str(buckets), sorted(data, key=lambda d: d[2]), schema, lambda s, n=buckets: stateful.fenced_writes(s, "n", "h", "to", "ts", "e", 10.0, buckets=n), batches=batches)
        assert sorted((r["e"], str(r["n"]), r["outcome"]) for r in got.collect()) == want


def test_lease_claims_answer_in_parts(monkeypatch):
    monkeypatch.setattr(stateful, "PART", 2)
    frames = [pd.DataFrame({"ts": pd.to_datetime([3, 1], unit="s"), "e": [3, 1], "h": ["b", None], "other": 0}), pd.DataFrame({"ts": pd.to_datetime([2], unit="s"), "e": [2], "h": ["a"], "other": 0})]
    got = [p.to_dict("list") for p in stateful.parts(stateful.sorted_columns(iter(frames), ["ts", "e"], ["h"]))]
    assert [p["e"] for p in got] == [[1, 2], [3]] and [p["h"] for p in got] == [[None, "a"], ["b"]]


def test_cumulated_weights_of_a_hot_key_over_many_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, "hot").alias("k"), (F.col("id") % 500).alias("v"), F.lit(2).alias("w"))
    out = aggregates.cumulated(df, ["k"], "v", "w")
    got = {(r["k"], r["v"]): (r["_w"], r["_cum"], r["_all"]) for r in out.collect()}
    assert got[("hot", 1)] == (4, 4, 1800) and got[("hot", 499)] == (4, 1800, 1800) and got[(None, 490)] == (4, 200, 200) and len(got) == 500


def test_a_band_counts_before_it_meets_the_quantile(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") % 4).alias("luma"), (F.col("id") % 2).alias("r"), F.lit(1).alias("w"))
    out = aggregates.dominant_band(df, ["k"], "luma", ["r"], "w", 0.5, 0)
    assert [tuple(r) for r in out.collect()] == [("k", 500, 1)]
    assert not any("luma" in line and "Join" in line and "id#" in line for line in out._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_best_match_makes_no_row_of_a_candidate(spark):
    from tessera.plans import relations

    plan = relations.greedy_best_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_orders_and_neighbours_broadcast_nothing(spark, monkeypatch):
    from tessera.operators import graphs, matching
    from tessera.session import written

    seen = []
    for module in (graphs, matching):
        monkeypatch.setattr(module, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 3)], "n long, t long, p long")
    assert graphs.dependency_order(rows, "n", "t", "p").count() == 3
    points = spark.range(20).select(F.col("id").alias("a"), (F.col("id") % 2).alias("room"), F.col("id").cast("double").alias("x"))
    matching.nearest(points, "a", points.withColumnRenamed("a", "b"), "b", ["x"], ["room"]).count()
    assert any("SortMergeJoin" in p for p in seen) and [p for p in seen if "BroadcastExchange" in p] == []


def test_nested_sets_meet_by_blocks(spark):
    r = random.Random(5)
    sets = {k: set(r.sample(range(30), r.randint(1, 12))) for k in range(60)} | {100: set(range(20)), 101: set(range(19)), 102: set(range(20))}
    members = spark.createDataFrame([(k, f"i{i}") for k, s in sets.items() for i in s], "k long, i string")
    edges = {tuple(e) for e in joins.nested_sets(members, "k", "i", 9, 10, block=7).collect()}
    assert {frozenset(joins_ for joins_ in e) for e in edges} >= {frozenset((100, 101)), frozenset((100, 102))}
    linked = lambda a, b: 10 * len(sets[a] & sets[b]) >= 9 * min(len(sets[a]), len(sets[b]))
    assert all(linked(a, b) for a, b in edges)
    want = {(min(a, b), max(a, b)) for a in sets for b in sets if a != b and linked(a, b)}
    component = lambda pairs: sorted((x["node"], x["component"]) for x in joins.connected_components(spark.createDataFrame(list(pairs), "src long, dst long")).collect())
    assert component(edges) == component(want)
    plan = joins.nested_sets(members, "k", "i", 9, 10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


@pytest.mark.parametrize("name", ["merged_tracks", "placement_problems", "suppressing_boxes", "turned_overlap_pairs"])
def test_queries_of_boxes_broadcast_nothing(spark, monkeypatch, name):
    from tessera import catalogue
    from tessera.operators import graphs
    from tessera.session import written

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen = []
    monkeypatch.setattr(graphs, "written", lambda df, name: seen.append(plan(df)) or written(df, name))
    seen.append(plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001")))
    assert any("SortMergeJoin" in p for p in seen) and [p for p in seen if "BroadcastExchange" in p] == []
