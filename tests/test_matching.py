"""Matching, nearest neighbours, orders of dependents and timed streams against plain versions."""

from __future__ import annotations

import math
import pickle
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs, joins, matching
from tessera.streaming import timed


def test_greedy_matching_equals_the_serial_one(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 1500) if r.random() < 0.7 else 7, r.randint(0, 1500), r.randint(0, 40)) for _ in range(10_000)]  # node 7 has a third of them
    edges += edges[:50] + [(None, 1, 0), (1, None, 0), (None, None, 0)]
    used, want = set(), []
    for o, a, b in sorted((o, a, b) for a, b, o in edges if a is not None and b is not None):
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            want.append((a, b, o))
    df = spark.createDataFrame(edges, "left long, right long, o long")
    got = sorted(tuple(x) for x in matching.greedy_matching(df, "left", "right", [F.col("o")]).collect())
    assert got == sorted(want)
    assert matching.greedy_matching(df.limit(0), "left", "right", [F.col("o")]).collect() == []


def test_greedy_matching_that_does_not_settle_is_an_error(spark):
    chain = spark.createDataFrame([(k // 2, (k + 1) // 2, k) for k in range(14)], "a long, b long, o long")
    assert matching.greedy_matching(chain, "a", "b", [F.col("o")]).count() == 7
    with pytest.raises(RuntimeError, match="open"):
        matching.greedy_matching(chain, "a", "b", [F.col("o")], most_rounds=3)


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_nearest_is_exact_with_far_outliers(spark, dims):
    r = random.Random(dims)
    at = [f"x{k}" for k in range(dims)]
    point = lambda far: [float(r.choice([r.gauss(0, 1), r.randint(-3, 3)])) * (10.0 ** r.randint(2, 7) if far else 1) for _ in range(dims)]
    left = [(g, k, *point(r.random() < 0.1)) for g in range(4) for k in range(80)]
    right = [(g, k, *point(r.random() < 0.05)) for g in range(3) for k in range([60, 1, 200][g])]
    left += [(0, 900, *[None] * dims), (None, 901, *[0.0] * dims), (2, 902, *[float("nan")] * dims), (1, 0, *left[0][2:])]
    right += [(0, 900, *[None] * dims), (None, 1, *[0.0] * dims), (0, 901, *right[0][2:])]
    schema = lambda i: f"g long, {i} long, " + ", ".join(f"{c} double" for c in at)
    want = []
    for g, a, *p in left:
        known = g is not None and all(x is not None and math.isfinite(x) for x in p)
        found = [(math.sqrt(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))), b) for h, b, *q in right if known and h == g and None not in q]
        want.append((g, a, min(found)[1] if found else None, min(found)[0] if found else None))
    got = matching.nearest(spark.createDataFrame(left, schema("a")), "a", spark.createDataFrame(right, schema("b")), "b", at, ["g"]).collect()
    key = lambda x: (str(x[0]), x[1], str(x[3]))
    near = lambda x: (x[0], x[1], x[2], None if x[3] is None else round(x[3], 6))
    assert sorted(map(near, got), key=key) == sorted(map(near, want), key=key)


def test_nearest_without_rows_on_either_side(spark):
    one = spark.createDataFrame([(1, 1, 0.5)], "g long, a long, x double")
    other = one.withColumnRenamed("a", "b")
    assert [tuple(r) for r in matching.nearest(one, "a", other.limit(0), "b", ["x"], ["g"]).collect()] == [(1, 1, None, None)]
    assert matching.nearest(one.limit(0), "a", other, "b", ["x"], ["g"]).collect() == []
    assert [tuple(r) for r in matching.nearest(one, "a", other, "b", ["x"], ["g"]).collect()] == [(1, 1, 1, 0.0)]


def test_dependency_order_is_that_of_a_visit(spark):
    r = random.Random(2)
    target = {k: r.choice([None, *range(300)]) if k % 3 else (k - 3 if k else None) for k in range(300)}
    target |= {k: k - 1 for k in range(301, 420)} | {300: None, 500: 501, 501: 502, 502: 500, 503: 502, 504: 504, 505: 9999, 506: 505}
    pos = dict(zip(target, r.sample(range(5000), len(target)), strict=True))
    refusal = {}
    for k in target:
        seen, at = [], k
        while at is not None and at in target and at not in seen:
            seen.append(at)
            at = target[at]
        refusal[k] = None if at is None else "missing" if at not in target else "cycle"
    done = []

    def visit(k):
        if k not in done:
            if target[k] is not None:
                visit(target[k])
            done.append(k)

    good = [k for k in sorted(target, key=pos.get) if refusal[k] is None]
    for k in good:
        visit(k)
    df = spark.createDataFrame([(k, t, pos[k]) for k, t in target.items()], "node long, target long, pos long")
    got = {x["node"]: x for x in graphs.dependency_order(df, "node", "target", "pos").collect()}
    assert {k: x["refusal"] for k, x in got.items()} == refusal
    assert sorted(good, key=lambda k: (got[k]["needed"], got[k]["level"])) == done
    assert graphs.dependency_order(df.limit(0), "node", "target", "pos").collect() == []


def test_closure_refuses_cycles_and_cuts_nothing(spark):
    deep = spark.createDataFrame([(k, k + 1) for k in range(70)], "c int, p int")
    assert joins.closure(deep, "c", "p").agg(F.max("depth"), F.count("*")).first()[:] == (70, 71 * 70 // 2)
    with pytest.raises(ValueError, match="cycle"):
        joins.closure(deep.unionByName(spark.createDataFrame([(70, 3)], "c int, p int")), "c", "p")
    with pytest.raises(ValueError, match="deeper"):
        joins.closure(deep, "c", "p", most_depth=20)
    assert joins.closure(deep.limit(0), "c", "p").collect() == []


def plain_fold(rows, fold):
    """The fold over each key's rows in event time, timers between them, as if all were there at once."""
    out = []
    for key in {r[0] for r in rows}:
        state = {}
        for _, at, event, *fields in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            while state.get("due") is not None and state["due"] <= at:
                out += [(key, *g) for g in fold.ring(state, state["due"])]
            out += [(key, *g) for g in fold.step(state, at, event, tuple(fields))]
        while state.get("due") is not None:
            out += [(key, *g) for g in fold.ring(state, state["due"])]
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 1, 3)])
def test_timed_streams_do_not_depend_on_the_order_of_files(spark, tmp_path, order):
    r, fold = random.Random(1), timed.leases(40.0)
    start = datetime(2024, 1, 1)
    rows = [(r.choice([1, 2, None]), start + timedelta(seconds=5 * k + r.random()), k, r.choice(["a", "b", None]), r.choice(["claim", "claim", "release"])) for k in range(40)]
    rows += [(1, rows[5][1], 100, "b", "claim"), (3, start + timedelta(days=2), 101, "z", "claim")]  # a tie in time; the last row moves the watermark
    df = spark.createDataFrame(rows, "key long, ts timestamp, event long, holder string, action string")
    path = str(tmp_path / "in")
    part = F.when(F.col("event") == 101, 3).otherwise(F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(str(start)))) / 70))
    for k in order:
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    out = timed.run_in_batches(spark, path, df.schema, lambda s: timed.in_event_time(s, ["key"], "ts", "event", "300 seconds", fold), str(tmp_path / "out"), files=1)
    us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = sorted([tuple(x) for x in out.select("key", F.unix_micros("at"), "event", "outcome", "about").where("event IS NULL OR event <> 101").collect()], key=str)
    want = [x for x in plain_fold([(k, us(t), e, *f) for k, t, e, *f in rows if e != 101], fold)]
    assert got == want and {"expired", "renewed", "released", "already_owned"} <= {x[3] for x in got}


def test_folds_forget_what_has_ended():
    state = {}
    lease = timed.leases(1.0)
    lease.step(state, 0, 1, ("a", "claim"))
    assert lease.ring(state, 1_000_000) == [(1_000_000, None, "expired", "a")] and state == {}
    claims = timed.upload_claims(1.0)
    given = [claims.step(state, t, t, f)[0][2] for t, f in enumerate([("a", "request", "p", False), ("b", "request", "p", False), ("a", "minted", None, None), ("a", "request", "p", False), ("a", "request", "p", True), ("a", "request", "q", False)])]
    assert given == ["claimed", "foreign", "stored", "replay", "remint", "remint"]
    assert claims.ring(state, 9)[0][2] == "lapsed" and "due" not in state and claims.step(state, 10, 10, ("a", "minted", None, None))[0][2] == "stale"
    assert claims.step(state, 11, 11, ("a", "request", "p", False))[0][2] == "replay"  # what was stored before stands
    documents = timed.documents(1.0)
    state = {}
    given = [documents.step(state, t, t, f)[0][2:] for t, f in enumerate([("failed", "x"), ("ready", "y"), ("queued", None), ("processing", "z")])]
    assert given == [("updated", "x"), ("refused", "x"), ("updated", "x"), ("updated", "z")] and "due" not in state


def seen(box, label="chair", score=0.9, cut=False, view=(None, None)):
    return (*box, label, score, cut, *view)


def at(x, size=2.0):
    return (x, 0.0, 0.0, x + size, size, size)


def run_frames(fold, frames, end=True):
    """Frames at 0, 1, 2, .. seconds."""
    state, given, event = {}, [], 0
    for t, rows in enumerate(frames):
        us = t * 1_000_000
        while state.get("due") is not None and state["due"] <= us:
            given += fold.ring(state, state["due"])
        for r in rows:
            event += 1
            given += fold.step(state, us, event, r)
    while state.get("due") is not None and (end or "frame" in state):
        given += fold.ring(state, state["due"])
    return [(e, o, a) for _, e, o, a in given], state


def test_tracks_match_one_to_one_start_miss_and_end():
    fold = timed.tracks(100.0)
    given, state = run_frames(fold, [[seen(at(0)), seen(at(10))], [seen(at(0.2)), seen(at(0.1))]])
    # both sightings of the second frame overlap track 1: the nearer one joins it, the other one starts and is merged at once
    assert given == [(1, "started", "1"), (2, "started", "2"), (3, "started", "3"), (4, "joined", "1"), (None, "merged", "3 1"), (None, "ended", "1"), (None, "ended", "2")]
    assert state == {}
    given, _ = run_frames(fold, [[seen(at(0), score=0.2), seen(at(0), cut=True), seen(at(0), score=0.4)], [seen(at(50), score=0.4), seen(at(0.0, 0.5), "lamp", 0.4)]], end=False)
    assert [o for _, o, _ in given] == ["unsure", "cut_off", "started", "started", "joined"]  # the lamp lies in the chair: another label, wholly contained
    given, _ = run_frames(fold, [[seen(at(0))], *[[seen(at(50))]] * 3], end=False)
    assert (None, "pruned", "1") in given  # tentative, missed three times
    given, _ = run_frames(fold, [[seen(at(0))], *[[seen(at(50), view=(40.0, 60.0))]] * 5], end=False)
    assert (None, "pruned", "1") not in given  # out of view
    given, _ = run_frames(fold, [[(*at(0), None, None, None, None, None)], [seen((0.0, 0.0, 0.0, float("nan"), 1.0, 1.0)), seen((1.0, 0.0, 0.0, 0.0, 1.0, 1.0))]])
    assert given == [(1, "empty", None), (2, "empty", None), (3, "empty", None)]


def test_tracks_of_other_labels_merge_only_if_never_seen_together_and_the_cap_holds():
    a, b = seen(at(0)), seen(at(0.1), "lamp", 0.9)
    given, _ = run_frames(timed.tracks(9.0), [[a, b]], end=False)
    assert [o for _, o, _ in given] == ["started", "started"]
    rules = timed.Tracking(other_contained=2.0)
    given, _ = run_frames(timed.tracks(9.0, rules=rules), [[a], [b]], end=False)
    assert given[-1] == (None, "merged", "2 1")
    many = [seen(at(5.0 * k), score=0.6 if k else 0.5) for k in range(70)]
    given, state = run_frames(timed.tracks(9.0), [many, [seen(at(0.0), score=0.5)]], end=False)
    assert [x for x in given if x[1] == "dropped"] == [(None, "dropped", str(k)) for k in range(1, 12)] and len(state["tracks"]) == 60
    assert given[-2][1] == "started" and given[-1] == (None, "dropped", "11")


def test_streamed_tracks_equal_a_plain_fold_over_the_frames(spark):
    from tessera import catalogue
    from tessera.plans.timed import SIGHTINGS
    from tessera.session import table

    sf = "/root/testdata/sf0.001"
    fold = timed.tracks(10 * 86_400)
    rows = table(spark, sf, "events").selectExpr("user_id div 5 AS key", "unix_micros(date_trunc('DAY', CAST(ts AS TIMESTAMP))) AS us", "event_id", *SIGHTINGS).select("key", "us", "event_id", *fold.fields).collect()
    got = sorted([tuple(x) for x in catalogue.queries()["stream_tracks"](spark, sf).select("key", "at_us", "event", "outcome", "about").collect()], key=str)
    want = plain_fold([tuple(r) for r in rows], fold)
    assert got == want and {"started", "joined", "merged", "pruned", "ended", "unsure", "cut_off"} <= {x[3] for x in got}


def test_timed_queries_over_years_lose_no_last_rows_and_take_more_files_a_batch(spark, tmp_path, monkeypatch):
    from tessera.plans import timed as plans

    rows = [(k, datetime(2020, 1, 1) + timedelta(days=3 * k), k % 40, "view", 1.0) for k in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    asked, run = [], timed.run_in_batches
    monkeypatch.setattr(plans.timed, "run_in_batches", lambda *a: asked.append(a[-1]) or run(*a))
    out = plans.stream_pings(spark, str(tmp_path))
    assert sorted(r.event for r in out.where("event is not null").collect()) == list(range(600))
    assert out.where("outcome = 'closed'").count() == 450
    assert asked[0] > 2


@pytest.mark.parametrize("name", ["stream_status_documents", "stream_upload_claims"])
def test_timed_queries_open_no_more_state_stores_than_cores_where_rows_are_few(spark, tmp_path, monkeypatch, name):
    from tessera.plans import timed as plans

    monkeypatch.setattr(plans, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert getattr(plans, name)(spark, "/root/testdata/sf0.001").count() > 1000
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p.name for p in (tmp_path / "timed" / "_checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == spark.sparkContext.defaultParallelism


class HeldState:
    """What a bucket needs of Spark's group state."""

    def __init__(self):
        self.get, self.exists, self.wm, self.due = None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.wm

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, ms):
        assert ms > self.wm
        self.due = ms


def test_a_bucket_takes_its_rows_by_columns_and_folds_each_key_as_a_plain_fold_does():
    r, fold = random.Random(3), timed.upload_claims(0.002)
    big = 2**53  # neighbours that no float tells apart
    rows = [(f"k{r.randrange(5)}", r.randrange(1, 40_000), big + k, r.choice(["a", "b", None]), r.choice(["request", "minted"]), r.choice(["0", "1", None]), r.random() < 0.3) for k in range(400)]
    rows += [(*rows[0][:3], "z", "request", "1", False), (*rows[0][:3], "a", "request", "0", True)]  # one event three times, its fields differ
    want = None
    for _ in range(3):
        r.shuffle(rows)
        state, given, work = HeldState(), [], timed._bucket(fold, "event")
        frames = [pd.DataFrame(rows[k : k + 67], columns=["key_", "us_", "event", *fold.fields]) for k in range(0, len(rows), 67)]
        assert list(work((0,), iter(frames), state)) == [] and len(pickle.loads(state.get[0])) == len(frames)
        for state.wm in (7, 7, 20, 39, 60):
            given += list(work((0,), iter([frames[0].iloc[:0]]), state))
        got = sorted(pd.concat(given).astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None), key=str)
        assert {x[2] for x in got} - {None} == {x[2] for x in rows} and {"lapsed", "stored", "replay"} <= {x[3] for x in got}
        want = want or got
        assert got == want and state.exists and state.get[0] is None
    repeated = next(x[0] for x in rows if x[3] == "z")
    assert [x for x in want if x[0] != repeated] == plain_fold([x for x in rows if x[0] != repeated], fold)


def test_timed_streams_keep_large_ids_and_times_outside_utc(spark, tmp_path):
    big, start = 2**53, datetime(2024, 10, 27, 0, 30)  # an hour that comes twice in Berlin
    rows = [(k % 3, start + timedelta(minutes=15 * k, microseconds=k), big + k, "a", "claim") for k in range(12)] + [(9, start + timedelta(days=9), 0, "z", "claim")]
    df = spark.createDataFrame(rows, "key long, ts timestamp, event long, holder string, action string")
    us = {x.event: x.us for x in df.select("event", F.unix_micros("ts").alias("us")).collect()}
    df.where("event > 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        out = timed.run_in_batches(spark, str(tmp_path / "in"), df.schema, lambda s: timed.in_event_time(s, ["key"], "ts", "event", "1 day", timed.leases(1e6)), str(tmp_path / "out"), 1)
        got = {x.event: x.us for x in out.where("event > 0").select("event", F.unix_micros("at").alias("us")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {e: t for e, t in us.items() if e}
