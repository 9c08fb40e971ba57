"""Queries of text, geometry, snapshots and generators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..functions import geometry as geo
from ..functions import text as txt
from ..operators import sequences as seq
from ..session import table


@register("rounded_facts", "SELECT p_partkey, floor(p_retailprice / 0.1) * 0.1 AS floored, round(p_retailprice / 5) * 5 AS nearest FROM part")
def rounded_facts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", txt.down_to(F.col("p_retailprice"), 0.1).alias("floored"), txt.to_nearest(F.col("p_retailprice"), 5.0).alias("nearest"))


@register("spoken_lists", """
WITH l AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)
SELECT n_regionkey, CASE WHEN len(l) <= 1 THEN array_to_string(l, '') ELSE array_to_string(l[1:-2], ', ') || ' and ' || l[-1] END AS said FROM l
""")
def spoken_lists(spark, sf_dir):
    l = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return l.select("n_regionkey", txt.spoken_list(F.col("l")).alias("said"))


@register("normalised_text", r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), ' +', ' ', 'g')) AS said FROM conversations
""")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", txt.normalised(F.col("text")).alias("said"))


@register("slugs", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", txt.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@register("last_sentences", r"SELECT conv_id, turn, trim(regexp_extract(text, '([^.!?]*[.!?]?)\s*$', 1)) AS last, ends_with(trim(text), '?') AS asks FROM conversations")
def last_sentences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", txt.last_sentence(F.col("text")).alias("last"), F.trim("text").endswith("?").alias("asks"))


@register("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", txt.estimated_tokens(F.col("text")).alias("tokens"))


@register("ago_phrases", """
WITH a AS (SELECT event_id, CAST(floor(value * value * 10) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || (CASE WHEN s // 60 = 1 THEN '' ELSE 's' END) || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || (CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END) || ' ago'
 ELSE (s // 86400) || ' day' || (CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END) || ' ago' END AS said FROM a
""")
def ago_phrases(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", txt.ago(F.floor(F.col("value") * F.col("value") * 10)).alias("said"))


@register("event_stream_blocks", "SELECT conv_id, turn, role AS event, length(text) AS n FROM conversations WHERE text IS NOT NULL")
def event_stream_blocks(spark, sf_dir):
    """Writes turns as server-sent events and parses them back."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    block = txt.sse_block(F.col("role"), F.regexp_replace("text", "\n", "\ndata: "))
    p = c.select("conv_id", "turn", txt.parse_sse(block).alias("p"))
    return p.select("conv_id", "turn", "p.event", F.length("p.data").cast("long").alias("n"))


@register("suffix_swap", r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\.[^./]*$', '') || '.spz' AS uri FROM pages")
def suffix_swap(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", txt.suffix_swapped(F.col("url"), ".spz").alias("uri"))


@register("wrapped_angles", "SELECT event_id, round(value - 2 * pi() * round_even(value / (2 * pi()), 0), 6) AS angle FROM events")
def wrapped_angles(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(geo.wrapped(F.col("value")), 6).alias("angle"))


@register("colour_space", """
WITH c AS (SELECT c_custkey, c_custkey * 7919 % 256 / 255.0 AS r, c_custkey * 104729 % 256 / 255.0 AS g, c_custkey * 1299709 % 256 / 255.0 AS b FROM customer),
l AS (SELECT c_custkey, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM c),
x AS (SELECT c_custkey, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM l),
f AS (SELECT c_custkey, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116.0 END AS fx, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116.0 END AS fy, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116.0 END AS fz FROM x)
SELECT c_custkey, round(116 * fy - 16, 5) AS l, round(500 * (fx - fy), 5) AS a, round(200 * (fy - fz), 5) AS b FROM f
""")
def colour_space(spark, sf_dir):
    c = [(F.col("c_custkey") * k % 256).cast("double") for k in (7919, 104729, 1299709)]
    lab = geo.srgb_to_lab(*c)
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.round(x, 5).alias(n) for x, n in zip(lab, "lab", strict=True)])


@register("voxel_counts", """
SELECT label, CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.05) AS BIGINT) AS vx, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.05) AS BIGINT) AS vy, count(*) AS n FROM embeddings GROUP BY 1, 2, 3
""")
def voxel_counts(spark, sf_dir):
    v = [geo.voxel(F.get("embedding", F.lit(k)).cast("double"), 0.05) for k in range(2)]
    return table(spark, sf_dir, "embeddings").groupBy("label", v[0].alias("vx"), v[1].alias("vy")).agg(F.count("*").alias("n"))


@register("trimmed_range", """
WITH s AS (SELECT l_returnflag AS k, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY k ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS d, sum(w) OVER (PARTITION BY k) AS t FROM s)
SELECT k AS l_returnflag, min(CASE WHEN u > 0.05 * t THEN v END) AS low, max(CASE WHEN d > 0.05 * t THEN v END) AS high FROM c GROUP BY 1
""")
def trimmed_range(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return geo.trimmed_range(l, ["l_returnflag"], "l_extendedprice", "w", 0.05)


@register("dominant_gap_group", """
WITH g AS (SELECT user_id, value, CASE WHEN lag(value) OVER w IS NULL OR value - lag(value) OVER w > greatest(4.0, 0.1 * lag(value) OVER w) THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)),
h AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS g FROM g), n AS (SELECT user_id, g, count(*) AS n, min(value) AS lo, max(value) AS hi FROM h GROUP BY 1, 2)
SELECT user_id, n, lo, hi FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, g) = 1
""")
def dominant_gap_group(spark, sf_dir):
    return geo.gap_groups(table(spark, sf_dir, "events"), ["user_id"], "value", 4.0, 0.1)


@register("grid_heading", """
SELECT user_id, round((((degrees(atan2(sum(sin(4 * radians(value)) * (event_id % 7 + 1)), sum(cos(4 * radians(value)) * (event_id % 7 + 1)))) / 4) % 90) + 90) % 90, 5) AS heading FROM events GROUP BY 1
""")
def grid_heading(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("length", (F.col("event_id") % 7 + 1).cast("double"))
    return geo.grid_heading(e, ["user_id"], "value", "length").withColumn("heading", F.round("heading", 5))


@register("laplacian_sharpness", """
WITH d AS (SELECT user_id, lag(value) OVER w + lead(value) OVER w - 2 * value AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(var_pop(d), 4) AS variance FROM d GROUP BY 1
""")
def laplacian_sharpness(spark, sf_dir):
    return geo.laplacian_variance(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("variance", F.round("variance", 4))


@register("path_lengths", """
WITH p AS (SELECT user_id, event_id, ts, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events), s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS s FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 5) AS along FROM s
""")
def path_lengths(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"))
    return geo.path_lengths(p, ["user_id"], ["ts", "event_id"], "x", "y").select("user_id", "event_id", F.round("along", 5).alias("along"))


@register("nearest_edge", """
WITH e AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 500.0, 0.0), (1, 500.0, 0.0, 500.0, 24.0), (2, 500.0, 24.0, 0.0, 24.0), (3, 0.0, 24.0, 0.0, 0.0)) t(i, x0, y0, x1, y1)), p AS (SELECT event_id, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events),
d AS (SELECT event_id, i, abs(((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS d FROM p CROSS JOIN e)
SELECT event_id, i AS edge, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(d, 9), i) = 1
""")
def nearest_edge(spark, sf_dir):
    """The edges are four constants, so they are columns of each row and no join."""
    edges = [(0.0, 0.0, 500.0, 0.0), (500.0, 0.0, 500.0, 24.0), (500.0, 24.0, 0.0, 24.0), (0.0, 24.0, 0.0, 0.0)]
    x, y = F.col("value"), F.hour("ts").cast("double")
    d = [F.struct(F.round(F.abs(geo.signed_distance(x, y, *map(F.lit, e))), 9).alias("d"), F.lit(k).alias("edge")) for k, e in enumerate(edges)]
    return table(spark, sf_dir, "events").select("event_id", F.least(*d).alias("m")).select("event_id", "m.edge", F.round("m.d", 6).alias("distance"))


@register("snapshot_diff", """
WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_size > 5), b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size < 45)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_size IS DISTINCT FROM b.p_size OR a.p_partkey IS NULL OR b.p_partkey IS NULL
""")
def snapshot_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    a = p.where("p_size > 5").withColumnRenamed("p_size", "a")
    b = p.where("p_size < 45").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("b"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "p_partkey", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select("p_partkey", change.alias("change")).where("change is not null")


@register("ends_of_history", """
SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 2
""")
def ends_of_history(spark, sf_dir):
    """The first turn and the last two."""
    up, down = Window.partitionBy("conv_id").orderBy("turn", "role", "text"), Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    c = table(spark, sf_dir, "conversations").withColumn("u", F.row_number().over(up)).withColumn("d", F.row_number().over(down))
    return c.where("u = 1 or d <= 2").select("conv_id", "turn")


@register("three_tier_pick", """
WITH q AS (SELECT quantile_cont(l_tax, 0.6) AS q FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, CASE WHEN l_discount <= 0.05 AND l_tax >= q THEN 0 WHEN l_discount <= 0.05 THEN 1 ELSE 2 END AS tier FROM lineitem CROSS JOIN q)
SELECT l_orderkey, l_linenumber, l_partkey, tier FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, l_quantity DESC, l_linenumber, l_partkey) = 1
""")
def three_tier_pick(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    q = l.agg(F.percentile("l_tax", 0.6).alias("q"))
    whole = F.col("l_discount") <= 0.05
    t = l.crossJoin(F.broadcast(q)).withColumn("tier", F.when(whole & (F.col("l_tax") >= F.col("q")), 0).when(whole, 1).otherwise(2))  # q is one row
    return seq.top_one(t, ["l_orderkey"], [F.asc("tier"), F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "tier")


@register("candidate_steps", """
WITH s AS (SELECT s_suppkey, s_suppkey % 5 AS lo, s_suppkey % 5 + s_suppkey % 7 AS hi FROM supplier) SELECT s_suppkey, CAST(x AS BIGINT) AS at, r * 90 AS turn FROM (SELECT s_suppkey, unnest(range(lo, hi + 1)) AS x FROM s) CROSS JOIN (SELECT unnest(range(0, 4)) AS r)
""")
def candidate_steps(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(k % 5, k % 5 + k % 7)).alias("at"))
    return s.select("s_suppkey", "at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: (r * 90).cast("long"))).alias("turn"))


@register("refuted_votes", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') >= 2 AND count(*) FILTER (l_returnflag = 'R') > count(*) FILTER (l_returnflag = 'N') OR count(*) FILTER (l_linestatus = 'O') + count(*) FILTER (l_linestatus = 'F') >= 3 AND count(*) FILTER (l_linestatus = 'F') > count(*) FILTER (l_linestatus = 'O') AS refuted FROM lineitem GROUP BY 1")
def refuted_votes(spark, sf_dir):
    n = lambda c, v: F.count_if(F.col(c) == v)
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n("l_returnflag", "R").alias("t"), n("l_returnflag", "N").alias("s"), n("l_linestatus", "O").alias("i"), n("l_linestatus", "F").alias("o"))
    return l.select("l_orderkey", geo.refuted(F.col("t"), F.col("s"), F.col("i"), F.col("o")).alias("refuted"))


@register("run_comparison", """
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1
""")
def run_comparison(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.sum("o_totalprice"), 2))
    return p.where("F is not null or O is not null").select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"))


@register("first_terminal_status", """
SELECT user_id, arg_min(event_type, (ts, event_id)) AS outcome, min(ts) AS at FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1
""")
def first_terminal_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("outcome"), F.min("ts").alias("at"))


@register("compare_and_set", """
WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 3 AS n FROM orders), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE 'O' END AS expected FROM orders WHERE o_totalprice > 20000)
SELECT t.o_orderkey, CASE WHEN expected = o_orderstatus THEN 'Q' ELSE o_orderstatus END AS status, CASE WHEN expected = o_orderstatus THEN n + 1 ELSE n END AS n FROM t LEFT JOIN r USING (o_orderkey)
""")
def compare_and_set(spark, sf_dir):
    """A request changes a row only while its status is still the one that was read; a change is counted."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 3).alias("n"))
    r = table(spark, sf_dir, "orders").where("o_totalprice > 20000").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise("O").alias("expected"))
    j = t.join(r, "o_orderkey", "left").withColumn("hit", F.coalesce(F.col("expected") == F.col("o_orderstatus"), F.lit(False)))
    return j.select("o_orderkey", F.when(F.col("hit"), "Q").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("hit"), F.col("n") + 1).otherwise(F.col("n")).alias("n"))


@register("deadline_admission", """
WITH c AS (SELECT user_id, event_id, ts, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worst FROM events)
SELECT user_id, event_id, 900 - coalesce(spent, 0) - 50 >= coalesce(worst, 130) AS may_start FROM c
""")
def deadline_admission(spark, sf_dir):
    """A step may start if what is left of the budget, less a reserve, covers the dearest one so far (or the prior)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    left = 900 - F.coalesce(F.sum("value").over(w), F.lit(0.0)) - 50
    return table(spark, sf_dir, "events").select("user_id", "event_id", (left >= F.coalesce(F.max("value").over(w), F.lit(130.0))).alias("may_start"))


@register("grid_average", """
SELECT label, CAST(floor((CAST(embedding[1] AS DOUBLE) + 1) * 8) AS BIGINT) AS gx, CAST(floor((CAST(embedding[2] AS DOUBLE) + 1) * 8) AS BIGINT) AS gy, round(avg(CAST(embedding[3] AS DOUBLE)), 6) AS mean, round(median(CAST(embedding[3] AS DOUBLE)), 6) AS middle, count(*) AS seen FROM embeddings GROUP BY 1, 2, 3
""")
def grid_average(spark, sf_dir):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    g = [F.floor((x + 1) * 8) for x in e[:2]]
    return table(spark, sf_dir, "embeddings").select("label", g[0].alias("gx"), g[1].alias("gy"), e[2].alias("z")).groupBy("label", "gx", "gy").agg(F.round(F.avg("z"), 6).alias("mean"), F.round(F.median("z"), 6).alias("middle"), F.count("*").alias("seen"))


@register("re_drive_merge", """
WITH p AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_size > 15), n AS (SELECT p_partkey, p_retailprice + 1 AS v FROM part WHERE p_size < 35)
SELECT coalesce(n.p_partkey, p.p_partkey) AS p_partkey, round(coalesce(n.v, p.v), 4) AS v, n.p_partkey IS NOT NULL AS redone FROM p FULL JOIN n ON p.p_partkey = n.p_partkey
""")
def re_drive_merge(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("v"))
    new = t.where("p_size < 35").select("p_partkey", (F.col("v") + 1).alias("w"))
    j = t.where("p_size > 15").join(new, "p_partkey", "full")
    return j.select("p_partkey", F.round(F.coalesce("w", "v"), 4).alias("v"), F.col("w").isNotNull().alias("redone"))


@register("shared_endpoints", """
WITH w AS (SELECT s_suppkey, s_suppkey * 31 % 40 AS x, s_suppkey * 17 % 40 AS y FROM supplier) SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM w a JOIN w b ON a.s_suppkey < b.s_suppkey AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2
""")
def shared_endpoints(spark, sf_dir):
    from ..operators.joins import within

    w = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 31 % 40).cast("double").alias("x"), (F.col("s_suppkey") * 17 % 40).cast("double").alias("y"))
    return within(w.toDF("a", "ax", "ay"), w.toDF("b", "bx", "by"), "ax", "ay", "bx", "by", math.sqrt(2) + 1e-9).where("a < b").select("a", "b")
