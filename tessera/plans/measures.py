"""Queries of aggregations, ledgers and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import aggregates as agg
from ..operators import selection as sel
from ..session import table

QUANTILE = """
WITH s AS (SELECT {key}, {value} AS v, sum({weight}) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY {key} ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY {key}) AS total FROM s)
SELECT {key}, min(CASE WHEN cum >= {q} * total AND total > 0 THEN v END) AS quantile FROM c GROUP BY 1
"""


@register("weighted_quantile", QUANTILE.format(key="l_returnflag", value="l_extendedprice", weight="CAST(l_quantity AS BIGINT)", q="0.9"))
def weighted_quantile(spark, sf_dir):
    return agg.weighted_quantile(table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_quantity").cast("long")), ["l_returnflag"], "l_extendedprice", "w", 0.9)


@register("weighted_median_by_key", QUANTILE.format(key="l_partkey", value="l_extendedprice", weight="CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END", q="0.5"))
def weighted_median_by_key(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("w", F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("long")))
    return agg.weighted_quantile(l, ["l_partkey"], "l_extendedprice", "w", 0.5)


@register("dominant_colour_band", """
WITH l AS (SELECT l_returnflag AS g, l_suppkey % 256 AS r, l_partkey % 256 AS gr, l_orderkey % 256 AS b, CAST(l_quantity AS BIGINT) AS w, l_suppkey % 256 + l_partkey % 256 AS luma FROM lineitem),
s AS (SELECT g, luma, sum(w) AS w FROM l GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY luma ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY g) AS t FROM s), ref AS (SELECT g, min(CASE WHEN cum >= 0.6 * t THEN luma END) AS ref FROM c GROUP BY 1),
band AS (SELECT l.* FROM l JOIN ref USING (g) WHERE abs(luma - ref) <= 20), n AS (SELECT g, count(*) AS n FROM band GROUP BY 1),
x AS (SELECT g, 'r' AS ch, r AS v, w FROM band UNION ALL SELECT g, 'g', gr, w FROM band UNION ALL SELECT g, 'b', b, w FROM band), xs AS (SELECT g, ch, v, sum(w) AS w FROM x GROUP BY 1, 2, 3),
xc AS (SELECT *, sum(w) OVER (PARTITION BY g, ch ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY g, ch) AS t FROM xs), m AS (SELECT g, ch, min(CASE WHEN cum >= 0.5 * t THEN v END) AS v FROM xc GROUP BY 1, 2)
SELECT n.g AS grp, n.n, printf('#%02x%02x%02x', max(CASE WHEN ch = 'r' THEN v END), max(CASE WHEN ch = 'g' THEN v END), max(CASE WHEN ch = 'b' THEN v END)) AS hex FROM n JOIN m USING (g) GROUP BY 1, 2
""")
def dominant_colour_band(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"), F.col("l_quantity").cast("long").alias("w"))
    out = agg.dominant_band(l.withColumn("luma", F.col("r") + F.col("g")), ["grp"], "luma", ["r", "g", "b"], "w", 0.6, 20)
    return out.select("grp", "n", F.format_string("#%02x%02x%02x", "r", "g", "b").alias("hex"))


@register("percentile_clipped_extent", """
SELECT label, round(quantile_cont(CAST(embedding[1] AS DOUBLE), 0.05), 6) AS x_low, round(quantile_cont(CAST(embedding[1] AS DOUBLE), 0.95), 6) AS x_high, round(quantile_cont(CAST(embedding[2] AS DOUBLE), 0.05), 6) AS y_low, round(quantile_cont(CAST(embedding[2] AS DOUBLE), 0.95), 6) AS y_high FROM embeddings GROUP BY 1
""")
def percentile_clipped_extent(spark, sf_dir):
    axes = {n: F.get("embedding", F.lit(k)).cast("double") for k, n in enumerate("xy")}
    out = agg.clipped_range(table(spark, sf_dir, "embeddings"), ["label"], axes, 0.05, 0.95)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("x_low", "x_high", "y_low", "y_high")])


@register("robust_cloud_stats", """
WITH v AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c AS (SELECT label, median(x) AS mx, median(y) AS my FROM v GROUP BY 1),
r AS (SELECT v.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r FROM v JOIN c USING (label)), p AS (SELECT label, quantile_cont(r, 0.95) AS lim FROM r GROUP BY 1)
SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(covar_pop(x, y), 6) AS cov FROM r JOIN p USING (label) WHERE r <= lim GROUP BY 1
""")
def robust_cloud_stats(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    c = v.groupBy("label").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    r = v.join(c, "label").withColumn("r", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    lim = r.groupBy("label").agg(F.percentile("r", 0.95).alias("lim"))
    return r.join(lim, "label").where("r <= lim").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.round(F.covar_pop("x", "y"), 6).alias("cov"))


@register("capped_histogram_2d", """
WITH n AS (SELECT l_returnflag AS g, CAST(floor(l_quantity / 5) AS BIGINT) AS bin_x, CAST(floor(l_discount * 50) AS BIGINT) AS bin_y, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT g, quantile_cont(n, 0.9) AS cap FROM n GROUP BY 1)
SELECT g AS grp, bin_x, bin_y, round(least(n, cap), 6) AS density FROM n JOIN c USING (g)
""")
def capped_histogram_2d(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_returnflag"))
    return agg.capped_histogram(l, ["grp"], F.floor(F.col("l_quantity") / 5), F.floor(F.col("l_discount") * 50), 0.9).withColumn("density", F.round("density", 6))


@register("soft_iou", """
WITH k AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, hour(ts) AS h, event_type, count(*) * 1.0 AS n FROM events GROUP BY 1, 2, 3, 4), a AS (SELECT * FROM k WHERE side = 0), b AS (SELECT * FROM k WHERE side = 1),
j AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.n, 0.0) AS l, coalesce(b.n, 0.0) AS r FROM a FULL JOIN b ON a.pair = b.pair AND a.h = b.h AND a.event_type = b.event_type)
SELECT pair, round(coalesce(sum(least(l, r)) / nullif(sum(greatest(l, r)), 0), 0), 6) AS soft_iou, round(coalesce(sum(least(l, r)) / nullif(least(sum(l), sum(r)), 0), 0), 6) AS containment FROM j GROUP BY 1
""")
def soft_iou(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 2).alias("pair"), (F.col("user_id") % 2).alias("side"), F.hour("ts").alias("h"), "event_type")
    k = e.groupBy("pair", "side", "h", "event_type").agg(F.count("*").cast("double").alias("n"))
    out = agg.soft_similarity(k.where("side = 0"), k.where("side = 1"), ["pair"], ["h", "event_type"], "n")
    return out.select("pair", F.round("soft_iou", 6).alias("soft_iou"), F.round("containment", 6).alias("containment"))


@register("instance_map", """
SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(median(value), 6) AS median_area, max(value) AS largest, round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean_score, count(*) FILTER (value <= 10) AS sentinels FROM events GROUP BY 1
""")
def instance_map(spark, sf_dir):
    out = agg.instance_summary(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", "value", 10.0)
    return out.withColumn("median_area", F.round("median_area", 6)).withColumn("mean_score", F.round("mean_score", 6))


@register("lowest_cluster_floor", """
WITH m AS (SELECT l_orderkey, l_extendedprice AS h, l_quantity AS w, min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS low FROM lineitem)
SELECT l_orderkey, count(*) AS members, round(sum(h * w) / nullif(sum(w), 0), 8) AS floor FROM m WHERE h <= low + 5000 GROUP BY 1
""")
def lowest_cluster_floor(spark, sf_dir):
    return agg.lowest_cluster(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_quantity", 5000.0).withColumn("floor", F.round("floor", 8))


@register("ledger_report", "SELECT o_orderpriority, count(*) AS calls, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS billed, round(sum(o_totalprice), 2) AS priced FROM orders GROUP BY 1")
def ledger_report(spark, sf_dir):
    out = agg.ledger_report(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "o_totalprice")
    return out.select("o_orderpriority", "calls", F.round("billed", 2).alias("billed"), F.round("priced", 2).alias("priced"))


@register("spend_by_day", """
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, day, round(spent, 2) AS spent, n, round(sum(spent) OVER (PARTITION BY o_custkey ORDER BY day), 2) AS so_far FROM d
""")
def spend_by_day(spark, sf_dir):
    out = agg.running_spend(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", "day", F.round("spent", 2).alias("spent"), "n", F.round("so_far", 2).alias("so_far"))


@register("two_reading_agreement", """
WITH j AS (SELECT quality AS a, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE toxic END AS b FROM labels)
SELECT CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE 'tie' END AS outcome, count(*) AS n, count(*) FILTER (a <> b) AS splits FROM j GROUP BY 1
""")
def two_reading_agreement(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return agg.two_reading_agreement(l.select("doc_id", F.col("quality").alias("v")), l.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("toxic")).alias("v")), "doc_id", "v")


@register("zbuffer_argmin", """
SELECT user_id % 16 AS cx, hour(ts) AS cy, arg_min(event_type, (value, event_id)) AS front, min(value) AS depth, count(*) AS n FROM events GROUP BY 1, 2
""")
def zbuffer_argmin(spark, sf_dir):
    return agg.nearest_in_cell(table(spark, sf_dir, "events"), [(F.col("user_id") % 16).alias("cx"), F.hour("ts").cast("long").alias("cy")], "value", "event_id", "event_type")


@register("polygon_area", """
WITH p AS (SELECT user_id, event_id, value AS x, value * value / 100 AS y FROM events), n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(abs(sum(x * ny - nx * y)) / 2, 3) AS area, count(*) AS corners FROM n GROUP BY 1
""")
def polygon_area(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"), (F.col("value") * F.col("value") / 100).alias("y"))
    return agg.shoelace(p, ["user_id"], "event_id", "x", "y").withColumn("area", F.round("area", 3))


@register("weighted_ncc", """
WITH l AS (SELECT l_returnflag AS g, l_extendedprice AS a, l_tax * 1000 AS b, l_quantity AS w FROM lineitem), m AS (SELECT g, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM l GROUP BY 1)
SELECT l.g AS grp, round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb))), 6) AS ncc FROM l JOIN m USING (g) GROUP BY 1
""")
def weighted_ncc(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("a"), (F.col("l_tax") * 1000).alias("b"), F.col("l_quantity").alias("w"))
    m = l.groupBy("grp").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("ma"), (F.sum(F.col("w") * F.col("b")) / F.sum("w")).alias("mb"))
    a, b = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    ncc = F.sum(F.col("w") * a * b) / F.sqrt(F.sum(F.col("w") * a * a) * F.sum(F.col("w") * b * b))
    return l.join(m, "grp").groupBy("grp").agg(F.round(ncc, 6).alias("ncc"))


@register("unanimous_challenger", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS rank FROM lineitem), b AS (SELECT l_orderkey, l_quantity AS q0, l_tax AS t0, l_discount AS d0 FROM l WHERE rank = 0),
v AS (SELECT l_orderkey, rank, CASE WHEN rank = 0 THEN 0.0 ELSE l_quantity - q0 END AS gain, (l_quantity - q0 >= 5 AND l_tax < t0 AND coalesce(CASE WHEN l_discount > 0.02 THEN l_discount < d0 END, TRUE)) AS ok FROM l JOIN b USING (l_orderkey))
SELECT l_orderkey, CAST(rank AS BIGINT) AS rank, CAST(gain AS DOUBLE) AS gain FROM v WHERE rank = 0 OR (ok AND gain > 0) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY gain DESC, rank) = 1
""")
def unanimous_challenger(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    l = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w).cast("long") - 1)
    l = l.select("*", first("l_quantity").alias("q0"), first("l_tax").alias("t0"), first("l_discount").alias("d0"))
    gain = F.col("l_quantity") - F.col("q0")
    votes = [gain >= 5, F.col("l_tax") < F.col("t0"), F.when(F.col("l_discount") > 0.02, F.col("l_discount") < F.col("d0"))]
    return agg.unanimous_challenger(l, ["l_orderkey"], "rank", gain, votes).select("l_orderkey", "rank", F.col("_gain").alias("gain"))


@register("newest_first_topk", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first_topk(spark, sf_dir):
    return sel.newest_first(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderdate")


@register("findings_first_per_key", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id % 2 = 0, event_id) = 1")
def findings_first_per_key(spark, sf_dir):
    return sel.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", F.col("event_id") % 2 == 0, "event_id").select("user_id", "event_type", "event_id")


@register("candidate_argmin_or_refusal", """
WITH c AS (SELECT s_nationkey AS n, s_suppkey, round(s_acctbal, 2) AS cost FROM supplier WHERE s_acctbal > 0), b AS (SELECT n, arg_min(s_suppkey, (cost, s_suppkey)) AS s_suppkey, min(cost) AS cost, count(*) AS candidates FROM c GROUP BY 1)
SELECT n_nationkey, s_suppkey, cost, coalesce(candidates, 0) AS candidates, b.n IS NULL AS refused FROM nation LEFT JOIN b ON b.n = n_nationkey
""")
def candidate_argmin_or_refusal(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.round("s_acctbal", 2).alias("cost"), "s_acctbal")
    return sel.cheapest_or_refusal(table(spark, sf_dir, "nation"), c, "n_nationkey", F.col("s_acctbal") > 0, "cost", "s_suppkey")


@register("winner_by_margin", """
WITH b AS (SELECT user_id, event_type, max(value) AS s FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, s - lead(s) OVER w AS gap FROM b WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, event_type))
SELECT user_id, CASE WHEN coalesce(gap >= 10, FALSE) THEN event_type ELSE 'undecided' END AS choice, coalesce(gap >= 10, FALSE) AS decided, round(gap, 6) AS margin FROM r WHERE n = 1
""")
def winner_by_margin(spark, sf_dir):
    return sel.winner_by_margin(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "undecided", 10.0).withColumn("margin", F.round("margin", 6))


@register("round_robin_shares", """
SELECT user_id, event_id, CAST(100 // count(*) OVER (PARTITION BY user_id) + CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 < 100 % count(*) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS BIGINT) AS share FROM events
""")
def round_robin_shares(spark, sf_dir):
    return sel.round_robin(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 100)


@register("farthest_point_sample")
def farthest_point_sample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(6)])
    return sel.sample_poses(e, ["label"], "vec_id", ["e0", "e1", "e2"], ["e3", "e4", "e5"], 12).select("label", "vec_id")


@register("census_set_cover")
def census_set_cover(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("value"))
    return sel.set_cover(e, "event_type", "hour", "day", "value", 12)


@register("diverse_pick")
def diverse_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") * 37 % 360).cast("double").alias("angle"))
    return sel.diverse(e, "user_id", "event_id", "value", "angle", 6, 15.0).select("user_id", "event_id")
