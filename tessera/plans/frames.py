"""Queries over ordered sequences: frames, runs, quotas, profiles and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import sequences as seq
from ..operators.validation import all_reasons
from ..session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))


def micros(a, b):
    return F.timestamp_diff("MICROSECOND", a, b)


@register("best_frame_per_object", """
WITH e AS (SELECT user_id, event_id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type FROM events),
r AS (SELECT *, (CASE WHEN hour(ts) IN (0, 23) THEN 1 ELSE 0 END) + (CASE WHEN value < 5 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad,
  CASE WHEN CAST(k AS BIGINT) % 5 = 0 THEN NULL ELSE k END AS solidity, CAST(minute(ts) AS DOUBLE) AS centred FROM e),
s AS (SELECT *, max(CASE WHEN bad = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS any_kept FROM r),
t AS (SELECT *, any_kept = 0 AS is_fallback FROM s WHERE bad = 0 OR any_kept = 0),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS st FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id, run) AS n FROM h),
c AS (SELECT *, CASE WHEN n <= 1 THEN 0.0 ELSE 1 - abs(place - (n - 1) / 2.0) / ((n - 1) / 2.0) END AS temporal FROM p),
m AS (SELECT *, min(value) OVER u AS v0, max(value) OVER u AS v1, min(k) OVER u AS k0, max(k) OVER u AS k1, min(solidity) OVER u AS s0, max(solidity) OVER u AS s1,
  min(centred) OVER u AS c0, max(centred) OVER u AS c1, min(temporal) OVER u AS t0, max(temporal) OVER u AS t1 FROM c WINDOW u AS (PARTITION BY user_id)),
z AS (SELECT *, (0.30 * (CASE WHEN v1 = v0 THEN 1.0 ELSE (value - v0) / nullif(v1 - v0, 0) END) + 0.25 * (CASE WHEN k1 = k0 THEN 1.0 ELSE (k - k0) / nullif(k1 - k0, 0) END)
  + (CASE WHEN solidity IS NULL THEN 0.0 ELSE 0.20 * (CASE WHEN s1 = s0 THEN 1.0 ELSE (solidity - s0) / nullif(s1 - s0, 0) END) END)
  + 0.15 * (CASE WHEN c1 = c0 THEN 1.0 ELSE (centred - c0) / nullif(c1 - c0, 0) END) + 0.10 * (CASE WHEN t1 = t0 THEN 1.0 ELSE (temporal - t0) / nullif(t1 - t0, 0) END))
  / (0.80 + CASE WHEN solidity IS NULL THEN 0.0 ELSE 0.20 END) AS score FROM m)
SELECT user_id, event_id, round(score, 6) AS score, is_fallback FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, event_id) = 1
""")
def best_frame_per_object(spark, sf_dir):
    e = events(spark, sf_dir)
    reasons = all_reasons([("border", F.hour("ts").isin(0, 23)), ("too_small", F.col("value") < 5), ("occluded", F.col("event_type") == "error")])
    e = e.select("user_id", "event_id", "ts", "value", "k", reasons.alias("reasons"), F.when(F.col("k").cast("long") % 5 != 0, F.col("k")).alias("solidity"), F.minute("ts").cast("double").alias("centred"))
    chosen = seq.scoring_set(e, ["user_id"], F.size("reasons") == 0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = seq.with_runs(chosen, ["user_id"], ["ts", "event_id"], micros(F.lag("ts").over(w), F.col("ts")) > 21_600_000_000)
    runs = runs.withColumn("temporal", seq.centred_score(F.col("place"), F.col("run_length")))
    scored = seq.weighted_score(runs, ["user_id"], {"value": 0.30, "k": 0.25, "solidity": 0.20, "centred": 0.15, "temporal": 0.10})
    return seq.top_one(scored, ["user_id"], [F.desc(F.round("score", 9)), F.asc("event_id")]).select("user_id", "event_id", F.round("score", 6).alias("score"), "is_fallback")


@register("run_segmentation", """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
SELECT user_id, event_id, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM h
""")
def run_segmentation(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = seq.with_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], micros(F.lag("ts").over(w), F.col("ts")) > 3_600_000_000)
    return runs.select("user_id", "event_id", F.col("run").cast("long").alias("run"), F.col("place").cast("long").alias("place"), "run_length")


@register("spoken_names", """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment AS label, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CASE CAST(floor(abs(c_acctbal)) AS BIGINT) % 9 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' WHEN 3 THEN 'white' WHEN 4 THEN 'black' WHEN 5 THEN 'grey' WHEN 6 THEN 'pink' WHEN 7 THEN 'orange' ELSE 'yellow' END END AS colour FROM customer),
n AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, label) AS nl, CASE WHEN colour IS NOT NULL THEN count(*) OVER (PARTITION BY c_nationkey, label, colour) END AS nc FROM c),
l AS (SELECT *, nl > 1 AND coalesce(nc, 2) > 1 AS lo FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, label, lo ORDER BY c_custkey) AS rn FROM l)
SELECT c_custkey, CASE WHEN nl = 1 THEN label WHEN NOT lo THEN colour || ' ' || label ELSE
  (CASE WHEN rn <= 10 THEN (['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'])[rn]
   ELSE CAST(rn AS VARCHAR) || (CASE WHEN rn % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rn % 10 = 1 THEN 'st' WHEN rn % 10 = 2 THEN 'nd' WHEN rn % 10 = 3 THEN 'rd' ELSE 'th' END) END) || ' ' || label END AS name FROM r
""")
def spoken_names(spark, sf_dir):
    words = F.array(*map(F.lit, ["red", "green", "blue", "white", "black", "grey", "pink", "orange", "yellow"]))
    colour = F.when(F.col("c_custkey") % 4 != 0, F.get(words, (F.floor(F.abs("c_acctbal")) % 9).cast("int")))
    c = table(spark, sf_dir, "customer").withColumn("colour", colour)
    return seq.spoken_names(c, ["c_nationkey"], "c_mktsegment", "colour", "c_custkey").select("c_custkey", "name")


@register("last_n_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(spark, sf_dir):
    return seq.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role")


@register("daily_quota_admission", """
WITH o AS (SELECT o_orderkey, o_custkey % 20 AS owner, o_orderdate, CAST(o_orderdate AS DATE) AS day, o_orderkey % 700 AS bundle FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY owner, bundle ORDER BY o_orderdate, o_orderkey) = 1 AS charged FROM o),
u AS (SELECT *, sum(CASE WHEN charged THEN 1 ELSE 0 END) OVER (PARTITION BY owner, day ORDER BY o_orderdate, o_orderkey) AS used FROM f)
SELECT o_orderkey, owner, charged, max(charged AND used <= 2) OVER (PARTITION BY owner, bundle) AS admitted FROM u
""")
def daily_quota_admission(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("owner"), "o_orderdate", (F.col("o_orderkey") % 700).alias("bundle"))
    return seq.daily_admission(o, "owner", "o_orderdate", ["o_orderdate", "o_orderkey"], "bundle", 2).select("o_orderkey", "owner", "charged", "admitted")


@register("change_point_two_level", """
WITH s AS (SELECT user_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER w AS a, sum(value * value) OVER w AS aa,
  sum(value) OVER (PARTITION BY user_id) AS t, sum(value * value) OVER (PARTITION BY user_id) AS tt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, round(aa - a * a / i + (tt - aa) - (t - a) * (t - a) / (n - i), 4) AS sse FROM s WHERE i < n)
SELECT user_id, CAST(i AS BIGINT) AS split, round(sse, 3) AS sse, round(a / i, 6) AS left_mean, round((t - a) / (n - i), 6) AS right_mean FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sse, i) = 1
""")
def change_point_two_level(spark, sf_dir):
    s = seq.two_level_split(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return s.select("user_id", F.col("split").cast("long").alias("split"), F.round("sse", 3).alias("sse"), F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"))


@register("lag_autocorrelation", """
WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events),
p AS (SELECT user_id, sum(x * x) AS power FROM x GROUP BY user_id)
SELECT a.user_id, b.i - a.i AS lag, round(sum(a.x * b.x) / nullif(any_value(power), 0), 6) AS r FROM x a JOIN x b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 5 JOIN p ON p.user_id = a.user_id GROUP BY 1, 2
""")
def lag_autocorrelation(spark, sf_dir):
    r = seq.autocorrelation(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return r.select("user_id", F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"))


@register("gap_interpolation", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS ta,
  first_value(v IGNORE NULLS) OVER f AS c, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS tc FROM e
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, a + (c - a) * (event_id - ta) / nullif(tc - ta, 0), a, c), 6) AS filled FROM w
""")
def gap_interpolation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return seq.fill_gaps(e, ["user_id"], "event_id", "v").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@register("as_of_interpolation", """
WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT l.user_id, l.event_id, round(r.value, 6) AS prev_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def as_of_interpolation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return seq.as_of(left, right, ["user_id"], "ts", ["value"]).select("user_id", "event_id", F.round("prev_value", 6).alias("prev_value"))


@register("fold_consecutive_roles", """
WITH g AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER w IS NULL OR role <> lag(role) OVER w THEN 1 ELSE 0 END AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(turn) AS first, any_value(role) AS role, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM h GROUP BY conv_id, run
""")
def fold_consecutive_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return seq.fold_runs(c, ["conv_id"], "turn", "role", "text").select("conv_id", F.col("run").cast("long").alias("run"), "first", "role", "n", "text")


@register("sliding_strip_min", """
WITH s AS (SELECT user_id, row_number() OVER w - 1 AS b, min(value) OVER k AS least, count(*) OVER k AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, CAST(b AS BIGINT) AS start_at, round(least, 6) AS least FROM s WHERE n = 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY least DESC, b) = 1
""")
def sliding_strip_min(spark, sf_dir):
    return seq.widest_strip(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 4).select("user_id", F.col("begin").cast("long").alias("start_at"), F.round("least", 6).alias("least"))


@register("latency_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = greatest(1, ceil(n * 50 / 100.0)) THEN value END) AS p50, max(CASE WHEN i = greatest(1, ceil(n * 95 / 100.0)) THEN value END) AS p95 FROM r GROUP BY event_type
""")
def latency_percentiles(spark, sf_dir):
    return seq.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95])


@register("state_durations", """
WITH d AS (SELECT user_id, event_type, coalesce((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 0.0) AS s FROM events)
SELECT user_id, event_type, round(sum(s), 3) AS seconds, count(*) AS n FROM d GROUP BY user_id, event_type
""")
def state_durations(spark, sf_dir):
    return seq.state_durations(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type").select("user_id", "event_type", F.round("seconds", 3).alias("seconds"), "n")


@register("longest_flagged_run", """
WITH f AS (SELECT user_id, ts, event_id, value > 50 AS f FROM events), g AS (SELECT *, CASE WHEN lag(f) OVER w IS NULL OR f <> lag(f) OVER w THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g), c AS (SELECT user_id, run, any_value(f) AS f, count(*) AS n FROM h GROUP BY user_id, run)
SELECT user_id, max(CASE WHEN f THEN n ELSE 0 END) AS longest FROM c GROUP BY user_id
""")
def longest_flagged_run(spark, sf_dir):
    return seq.longest_flagged_run(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@register("keyframe_gate", """
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, event_id, i, value AS last, TRUE AS taken FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN abs(e.value - g.last) >= 25 THEN e.value ELSE g.last END, abs(e.value - g.last) >= 25 FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, event_id FROM g WHERE taken
""")
def keyframe_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return seq.gate(e, ["user_id"], ["ts", "event_id"], "value", 25.0).select("user_id", "event_id")
