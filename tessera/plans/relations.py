"""Queries of joins, overlays, matching, hierarchies and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import graphs, joins, matching
from ..session import table


def spread(column: str, factor: int, modulus: int, unit: float = 1.0):
    """A made-up coordinate from a key."""
    return (F.col(column) * factor % modulus).cast("double") * unit


@register("overlay_apply", """
WITH e AS (SELECT p_partkey // 2 AS p_partkey, p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'remove' ELSE 'move' END AS op, CASE WHEN p_partkey % 3 = 1 THEN p_retailprice * 2 END AS price FROM part),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY seq DESC) = 1)
SELECT p.p_partkey, round(coalesce(l.price, p.p_retailprice), 4) AS price, coalesce(l.op, 'keep') AS op FROM part p LEFT JOIN l ON l.p_partkey = p.p_partkey WHERE coalesce(l.op <> 'remove', TRUE)
""")
def overlay_apply(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    e = p.select(F.floor(F.col("p_partkey") / 2).alias("p_partkey"), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 3 == 0, "remove").otherwise("move").alias("o"), F.when(F.col("p_partkey") % 3 == 1, F.col("price") * 2).alias("v"))
    return joins.overlay(p, e.withColumnRenamed("v", "price"), "p_partkey", ["seq"], "o", "price").select("p_partkey", F.round("price", 4).alias("price"), "op")


@register("overlay_orphans", "SELECT c_custkey AS entry, c_custkey + 300 AS target, NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = c.c_custkey + 300) AS orphaned FROM customer c")
def overlay_orphans(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    e = c.select(F.col("c_custkey").alias("entry"), (F.col("c_custkey") + 300).alias("target"))
    return joins.orphaned(e, c.select(F.col("c_custkey").alias("target")), "target").select("entry", "target", "orphaned")


@register("missing_declared_paths", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_declared_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("optional_sibling", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l USING (doc_id)")
def optional_sibling(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("_p"))
    return table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", "quality", F.coalesce("_p", F.lit(False)).alias("present"))


@register("greedy_best_match", """
WITH o AS (SELECT event_id, CAST(floor(value) AS BIGINT) % 50 AS slot, value FROM events WHERE event_type = 'view'), b AS (SELECT p_partkey, p_size % 50 AS slot, p_retailprice % 100 AS want FROM part),
c AS (SELECT event_id, p_partkey, 1 - abs(value - want) / 400 AS overlap FROM o JOIN b USING (slot))
SELECT event_id, p_partkey, round(overlap, 6) AS overlap FROM c WHERE overlap >= 0.98 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(overlap, 9) DESC, p_partkey) = 1
""")
def greedy_best_match(spark, sf_dir):
    """Each event's part of its slot with the most overlap, 0.98 or more, that is within 8 units: parts of one place are one
    entry, both sides are binned by that reach, and a bin's places are one list, so that an event's candidates are never rows."""
    o = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", (F.floor("value") % 50).alias("slot"), "value")
    b = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 50).cast("long").alias("slot"), (F.col("p_retailprice") % 100).alias("want"))
    b = b.groupBy("slot", "want").agg(F.min("p_partkey").alias("p_partkey")).withColumn("cell", F.floor(F.col("want") / 8))
    o = o.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("value") / 8) + k)))
    b = b.groupBy("slot", "cell").agg(F.collect_list(F.struct("want", "p_partkey")).alias("near"))
    overlap = lambda p: 1 - F.abs(F.col("value") - p["want"]) / 400
    good = F.filter("near", lambda p: overlap(p) >= 0.98)
    best = F.array_min(F.transform(good, lambda p: F.struct((-F.round(overlap(p), 9)).alias("o"), p["p_partkey"].alias("p_partkey"), overlap(p).alias("overlap"))))
    c = o.join(b, ["slot", "cell"]).select("event_id", best.alias("best")).where("best IS NOT NULL").groupBy("event_id").agg(F.min("best").alias("best"))
    return c.select("event_id", "best.p_partkey", F.round("best.overlap", 6).alias("overlap"))


@register("interval_handoffs", """
WITH i AS (SELECT event_type, user_id, date_trunc('day', ts) AS day, min(epoch_us(ts)) // 1000000 AS a, max(epoch_us(ts)) // 1000000 AS z FROM events GROUP BY 1, 2, 3)
SELECT x.event_type, x.user_id AS a, y.user_id AS b, y.a - x.z AS gap FROM i x JOIN i y ON x.event_type = y.event_type AND x.user_id <> y.user_id AND y.a - x.z > 0 AND y.a - x.z <= 300
""")
def interval_handoffs(spark, sf_dir):
    s = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1_000_000)
    i = table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min(s).alias("first"), F.max(s).alias("last"))
    return joins.hand_overs(i, "event_type", "user_id", "first", "last", 300)


@register("purity_by_dominant", """
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS claimed FROM n)
SELECT user_id, event_type AS dominant, n AS dominant_n, CAST(claimed AS BIGINT) AS claimed, round(n / claimed, 6) AS purity FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1
""")
def purity_by_dominant(spark, sf_dir):
    return joins.purity(table(spark, sf_dir, "events"), ["user_id"], "event_type").withColumn("purity", F.round("purity", 6))


@register("pairwise_distance_facts", """
WITH s AS (SELECT s_suppkey, s_suppkey // 100 AS room, s_suppkey * 7919 % 1000 / 10.0 AS x, s_suppkey * 104729 % 1000 / 10.0 AS y FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 10) / 10 AS distance FROM s a JOIN s b ON a.room = b.room AND a.s_suppkey < b.s_suppkey AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 15
""")
def pairwise_distance_facts(spark, sf_dir):
    """Pieces of one room (a hundred suppliers), no further apart than 15."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / 100).alias("room"), (spread("s_suppkey", 7919, 1000) / 10.0).alias("x"), (spread("s_suppkey", 104729, 1000) / 10.0).alias("y"))
    a, b = s.toDF("a", "room", "ax", "ay"), s.toDF("b", "room", "bx", "by")
    return joins.within(a, b, "ax", "ay", "bx", "by", 15.0, ["room"]).where("a < b").select("a", "b", (F.floor(F.col("distance") * 10) / 10).alias("distance"))


@register("nearest_neighbour", """
WITH s AS (SELECT c_custkey AS k, c_custkey // 100 AS n, c_custkey * 7919 % 1000 / 10.0 AS x, c_custkey * 104729 % 1000 / 10.0 AS y FROM customer),
p AS (SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a LEFT JOIN s b ON a.n = b.n AND b.k % 2 = 1 WHERE a.k % 2 = 0)
SELECT a, b, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1
""")
def nearest_neighbour(spark, sf_dir):
    """Each even piece's nearest odd one in its room (a hundred customers), however far."""
    s = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 100).alias("room"), (spread("c_custkey", 7919, 1000) / 10.0).alias("x"), (spread("c_custkey", 104729, 1000) / 10.0).alias("y"))
    even, odd = s.where("c_custkey % 2 = 0").withColumnRenamed("c_custkey", "a"), s.where("c_custkey % 2 = 1").withColumnRenamed("c_custkey", "b")
    return matching.nearest(even, "a", odd, "b", ["x", "y"], ["room"]).select("a", "b", F.round("distance", 6).alias("distance"))


@register("one_to_one_matches", """
WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), v AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
e AS (SELECT c.user_id, c.event_id AS click, v.event_id AS view, abs(c.us - v.us) // 1000000 AS apart FROM c JOIN v ON c.user_id = v.user_id AND abs(c.us - v.us) <= 86400000000),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY apart, click, view) AS i FROM e),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS click, NULL::BIGINT AS view, NULL::BIGINT AS apart, FALSE AS taken, []::BIGINT[] AS used FROM o WHERE i = 1
 UNION ALL SELECT user_id, i, click, view, apart, free, CASE WHEN free THEN list_concat(used, [click, view]) ELSE used END FROM (SELECT o.*, r.used, NOT list_contains(r.used, o.click) AND NOT list_contains(r.used, o.view) AS free FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT click, view, apart FROM r WHERE taken
""")
def one_to_one_matches(spark, sf_dir):
    """Clicks and views of one user within a day of each other, matched one to one, the nearest in time first."""
    day = 86_400_000_000
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us")).withColumn("day", F.floor(F.col("us") / day))
    c = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("us").alias("a"), F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)).alias("day"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view"), F.col("us").alias("b"), "day")
    near = c.join(v, ["user_id", "day"]).where(F.abs(F.col("a") - F.col("b")) <= day).select("click", "view", F.floor(F.abs(F.col("a") - F.col("b")) / 1_000_000).alias("apart"))
    return matching.greedy_matching(near, "click", "view", [F.col("apart")])


@register("placement_order", """
WITH RECURSIVE s AS (SELECT c_custkey AS piece, c_custkey * 7919 % 100003 AS pos, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 101 = 5 THEN c_custkey + 1000000000 WHEN c_custkey % 103 = 9 THEN c_custkey WHEN c_custkey % 7 = 1 THEN c_custkey - 1 ELSE c_custkey - 1 - c_custkey % 2 * (c_custkey % 7 > 2)::INT END AS target FROM customer),
w AS (SELECT piece AS start, piece AS now, 0 AS level, FALSE AS broken, FALSE AS loops FROM s
 UNION ALL SELECT w.start, s.target, w.level + 1, b.piece IS NULL, s.target = s.piece FROM w JOIN s ON s.piece = w.now LEFT JOIN s b ON b.piece = s.target WHERE s.target IS NOT NULL AND NOT w.loops AND NOT w.broken),
d AS (SELECT start AS piece, max(level) AS level, bool_or(broken) AS broken, bool_or(loops) AS loops FROM w GROUP BY 1),
n AS (SELECT w.now AS piece, min(s.pos) AS needed FROM w JOIN s ON s.piece = w.start GROUP BY 1)
SELECT piece, CASE WHEN NOT broken AND NOT loops THEN level END AS level, CASE WHEN NOT broken AND NOT loops THEN needed END AS needed, CASE WHEN loops THEN 'cycle' WHEN broken THEN 'missing' END AS refusal FROM d JOIN n USING (piece)
""")
def placement_order(spark, sf_dir):
    """Pieces after what they stand on: chains within seven customers; some stand on themselves or on pieces that are not there."""
    k = F.col("c_custkey")
    target = (
        F.when(k % 7 == 0, None).when(k % 101 == 5, k + 1_000_000_000).when(k % 103 == 9, k).when(k % 7 == 1, k - 1).otherwise(k - 1 - k % 2 * (k % 7 > 2).cast("int"))
    )
    pieces = table(spark, sf_dir, "customer").select(k.alias("piece"), (k * 7919 % 100_003).alias("pos"), target.cast("long").alias("target"))
    return graphs.dependency_order(pieces, "piece", "target", "pos")


@register("rectangle_overlap_pairs", """
WITH r AS (SELECT p_partkey AS id, p_partkey // 200 AS room, p_partkey * 7919 % 500 * 1.0 AS x0, p_partkey * 104729 % 500 * 1.0 AS y0, p_partkey * 7919 % 500 + p_size * 0.4 AS x1, p_partkey * 104729 % 500 + p_retailprice / 100 AS y1 FROM part)
SELECT a.id AS a, b.id AS b, round(least(least(a.x1, b.x1) - greatest(a.x0, b.x0), least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS depth FROM r a JOIN r b ON a.room = b.room AND a.id < b.id AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0
""")
def rectangle_overlap_pairs(spark, sf_dir):
    x, y = spread("p_partkey", 7919, 500), spread("p_partkey", 104729, 500)
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 200).alias("room"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") * 0.4).alias("x1"), (y + F.col("p_retailprice") / 100).alias("y1"))
    return joins.overlapping(r, "id", 25.0, ["room"]).select("a", "b", F.round("depth", 6).alias("depth"))


POLYGON = [(-0.2, -0.2), (0.25, -0.1), (0.1, 0.05), (0.2, 0.25), (-0.15, 0.2)]


@register("point_in_polygon", """
WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT * FROM (VALUES (-0.2, -0.2, 0.25, -0.1), (0.25, -0.1, 0.1, 0.05), (0.1, 0.05, 0.2, 0.25), (0.2, 0.25, -0.15, 0.2), (-0.15, 0.2, -0.2, -0.2)) t(x0, y0, x1, y1))
SELECT vec_id, sum(CASE WHEN (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM v CROSS JOIN (SELECT CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM e) GROUP BY vec_id
""")
def point_in_polygon(spark, sf_dir):
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", joins.inside_polygon(x, y, POLYGON).alias("inside"))


@register("spatial_handles_margin", """
WITH c AS (SELECT c_nationkey AS anchor, c_custkey AS candidate, round(abs(c_acctbal), 2) AS d FROM customer),
n AS (SELECT anchor, candidate, d, row_number() OVER (PARTITION BY anchor ORDER BY d, candidate) AS r, lead(d) OVER (PARTITION BY anchor ORDER BY d, candidate) - d AS g FROM c),
f AS (SELECT anchor, candidate, d, row_number() OVER (PARTITION BY anchor ORDER BY d DESC, candidate DESC) AS r, d - lead(d) OVER (PARTITION BY anchor ORDER BY d DESC, candidate DESC) AS g FROM c)
SELECT anchor, candidate, d AS distance, FALSE AS is_far FROM n WHERE r = 1 AND coalesce(g, 20) >= 20 UNION ALL SELECT anchor, candidate, d, TRUE FROM f WHERE r = 1 AND coalesce(g, 20) >= 20
""")
def spatial_handles_margin(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("anchor"), F.col("c_custkey").alias("candidate"), F.round(F.abs("c_acctbal"), 2).alias("distance"))
    return joins.nearest_with_margin(c, "anchor", "candidate", "distance", 20.0)


@register("tiered_lookup_ambiguity", """
WITH q AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 30 AS VARCHAR) WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE upper(substr(c_name, 1, 8)) END AS ask FROM customer),
t AS (SELECT 0 AS tier, CAST(n_nationkey AS VARCHAR) AS name, n_nationkey AS target FROM nation UNION ALL SELECT 1, n_name, n_nationkey FROM nation UNION ALL SELECT DISTINCT 2, c_mktsegment, c_nationkey FROM customer),
h AS (SELECT ask, tier, count(DISTINCT target) AS hits, min(target) AS target FROM q JOIN t ON ask = name GROUP BY 1, 2), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ask ORDER BY tier) = 1)
SELECT q.ask, f.tier, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN target END AS target FROM q LEFT JOIN f USING (ask)
""")
def tiered_lookup_ambiguity(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    ask = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 30).cast("string")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise(F.upper(F.substring("c_name", 1, 8)))
    tiers = [n.select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_nationkey").alias("target")), n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("target")), c.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("target")).distinct()]
    return joins.tiered_lookup(c.select(ask.alias("ask")), "ask", tiers)


@register("exact_or_unique_prefix", """
WITH q AS (SELECT DISTINCT substr(c_name, 1, 12 + CAST(c_custkey % 7 AS INTEGER)) AS ask FROM customer), n AS (SELECT DISTINCT c_name AS name FROM customer)
SELECT ask, coalesce((SELECT name FROM n WHERE name = ask), (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM n WHERE starts_with(name, ask) AND length(ask) >= 10)) AS found FROM q
""")
def exact_or_unique_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return joins.exact_or_unique_prefix(c.select(F.expr("substring(c_name, 1, 12 + cast(c_custkey % 7 as int))").alias("ask")), "ask", c, "c_name", 10)


@register("interval_difference", """
WITH s AS (SELECT user_id, 0 AS lo, 720 AS hi FROM events GROUP BY 1), c AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS a FROM events),
k AS (SELECT user_id, greatest(a, 0) AS a, least(a + 5, 720) AS b FROM c WHERE greatest(a, 0) < least(a + 5, 720) UNION ALL SELECT user_id, 720, 720 FROM s),
w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k)
SELECT user_id, greatest(coalesce(seen, 0), 0) AS free_lo, a AS free_hi FROM w WHERE greatest(coalesce(seen, 0), 0) < a
""")
def interval_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = F.floor(F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 3_600_000_000)
    spans = e.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("lo"), F.lit(720).cast("long").alias("hi"))
    return joins.uncovered(spans, e.select("user_id", a.alias("cut_lo"), (a + 5).alias("cut_hi")), ["user_id"], "lo", "hi")


@register("hierarchy_closure", """
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
p AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT p.node, e.parent, depth + 1 FROM p JOIN e ON p.ancestor = e.child)
SELECT node, ancestor, depth FROM p
""")
def hierarchy_closure(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    e = e.unionByName(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
    e = e.unionByName(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    return joins.closure(e, "child", "parent")


@register("trimmed_nn_rms", """
WITH v AS (SELECT vec_id, vec_id // 40 AS room, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
p AS (SELECT a.room, a.vec_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d FROM v a JOIN v b ON a.room = b.room AND b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY d, vec_id) AS r, count(*) OVER (PARTITION BY room) AS n FROM p)
SELECT room, any_value(n) AS n, round(CASE WHEN any_value(n) >= 3 THEN sqrt(avg(CASE WHEN r <= greatest(3, floor(n * 0.8)) THEN d * d END)) END, 6) AS rms FROM r GROUP BY room
""")
def trimmed_nn_rms(spark, sf_dir):
    """Of each room's even points, the distance to the nearest odd one, however far; the best four fifths."""
    entry = lambda k: F.get("embedding", F.lit(k)).cast("double")
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 40).alias("room"), entry(0).alias("x"), entry(1).alias("y"), entry(2).alias("z"))
    even, odd = v.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "a"), v.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "b")
    near = matching.nearest(even, "a", odd, "b", ["x", "y", "z"], ["room"]).where("distance IS NOT NULL")
    return joins.trimmed_rms(near, ["room"], "a", "distance", 0.8).select("room", "n", F.round("rms", 6).alias("rms"))


@register("nested_groups_components", """
WITH RECURSIVE w AS (SELECT DISTINCT event_id, user_id, date_trunc('day', ts) AS d, event_type AS t FROM events), c AS (SELECT user_id, count(DISTINCT (d, t)) AS n FROM w GROUP BY 1),
k AS (SELECT DISTINCT user_id, d, t FROM w), p AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS i FROM k a JOIN k b ON a.d = b.d AND a.t = b.t AND a.user_id < b.user_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c x ON x.user_id = a JOIN c y ON y.user_id = b WHERE i >= 0.9 * least(x.n, y.n)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT user_id AS n, user_id AS m FROM c UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a)
SELECT n AS user_id, min(m) AS component FROM r GROUP BY n
""")
def nested_groups_components(spark, sf_dir):
    """Keys whose cells are nested to nine tenths are one group, named by its least key."""
    k = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("d"), "event_type").distinct()
    p = joins.nested_sets(k.select("user_id", F.concat_ws(" ", "d", "event_type").alias("cell")), "user_id", "cell", 9, 10)
    return joins.components(k.select("user_id").distinct(), "user_id", p, "a", "b")


@register("plane_merge_components", """
WITH p AS (SELECT p_partkey, p_brand, p_retailprice, coalesce(p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 2, FALSE) AS new FROM part),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT min(p_partkey) AS component, count(*) AS members, round(avg(p_retailprice), 4) AS mean_price FROM g GROUP BY p_brand, g
""")
def plane_merge_components(spark, sf_dir):
    """Parts of one brand whose prices form a chain of steps of at most 2."""
    c = joins.chain_groups(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 2.0)
    return c.select("component", "members", F.round("mean", 4).alias("mean_price"))
