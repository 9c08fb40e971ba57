"""Queries of gates, decision tables and document rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import gates
from ..session import table


@register("blob_content_check", """
SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN strlen(html) < 1024 THEN 'too_small' WHEN strlen(html) > 4096 THEN 'too_large' WHEN NOT starts_with(html, '<!D') THEN 'wrong_type' END AS problem FROM pages
""")
def blob_content_check(spark, sf_dir):
    """Pages as blobs: their bytes and first characters."""
    return table(spark, sf_dir, "pages").select("page_id", gates.blob_problem(F.encode("html", "UTF-8"), b"<!D", 1024, 4096).alias("problem"))


@register("declared_paths_flatten", """
SELECT o_orderkey, 'orders/' || o_orderkey AS path FROM orders UNION ALL
SELECT l_orderkey, 'lines/' || l_linenumber || '.jpg' FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL
SELECT l_orderkey, 'depth/' || l_linenumber || '.bin' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_tax > 0.04
""")
def declared_paths_flatten(spark, sf_dir):
    """Every path that a nested document declares: its own, one for each line, and an optional one for some lines."""
    own = F.struct(F.concat(F.lit("lines/"), F.col("l_linenumber"), F.lit(".jpg")).alias("image"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("depth/"), F.col("l_linenumber"), F.lit(".bin"))).alias("depth"))
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(own).alias("lines"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey").join(nested, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(nested.schema["lines"].dataType)))
    every = F.flatten(F.array(F.array(F.concat(F.lit("orders/"), F.col("o_orderkey"))), F.col("lines.image"), F.col("lines.depth")))
    return docs.select("o_orderkey", F.explode(F.array_compact(every)).alias("path"))


@register("tier_implies_depth", """
WITH l AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_tax > 0 THEN 0 ELSE 1 END) AS bare FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND n IS NULL THEN 'no_frames' WHEN o_orderpriority = '1-URGENT' AND bare > 0 THEN 'depth_missing' END AS code FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def tier_implies_depth(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(~(F.col("l_tax") > 0)).alias("bare"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return o.select("o_orderkey", gates.ordered_code([("no_frames", ~urgent | F.col("n").isNotNull()), ("depth_missing", ~urgent | (F.col("bare") == 0))]).alias("code"))


@register("first_absolute_path", """
SELECT page_id // 10 AS bundle, arg_min(page_id, page_id) AS frame, arg_min(url, page_id) AS path FROM pages WHERE starts_with(url, 'https://') GROUP BY 1
""")
def first_absolute_path(spark, sf_dir):
    """The first declared path of a bundle, in frame order, that names a store instead of a place within the bundle."""
    bad = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://"))
    return bad.groupBy(F.floor(F.col("page_id") / 10).alias("bundle")).agg(F.min("page_id").alias("frame"), F.min_by("url", "page_id").alias("path"))


@register("declared_identity", """
SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'schema_version' WHEN c_custkey IS NULL THEN 'bundle_id' WHEN coalesce(trim(c_name), '') = '' OR c_acctbal < 0 THEN 'device_id' END AS code FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def declared_identity(spark, sf_dir):
    """Version, key of the other document, and a device that is not empty, checked in that order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    checks = [
        ("schema_version", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")), ("bundle_id", F.col("c_custkey").isNotNull()),
        ("device_id", (F.coalesce(F.trim("c_name"), F.lit("")) != "") & ~(F.col("c_acctbal") < 0)),
    ]
    return o.select("o_orderkey", gates.ordered_code(checks).alias("code"))


@register("suppressed_union", """
SELECT label, CAST(i - 1 AS INTEGER) AS cell, bool_or(embedding[i] > 0.2) AS hidden FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2
""")
def suppressed_union(spark, sf_dir):
    """The union of all masks of a label, cell by cell; a mask is where a component is over 0.2."""
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("cell", "v")).groupBy("label", "cell").agg(F.bool_or(F.col("v") > F.lit(0.2)).alias("hidden"))


@register("usable_frames", """
SELECT vec_id, NOT (list_avg(v) < -0.02 OR len(list_filter(v, lambda x: x > 0.1)) / len(v) > 0.25 OR list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v) < 0.01) AS usable
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
""")
def usable_frames(spark, sf_dir):
    """Vetoes of a frame: too dark, too much of it blown out, or too flat."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda t, x: t + x) / n
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x) / n
    blown = F.size(F.filter("v", lambda x: x > 0.1)) / n
    return v.select("vec_id", (~((mean < -0.02) | (blown > 0.25) | (square - mean * mean < 0.01))).alias("usable"))


FAMILIES = "view:BUILDING|FURNITURE;click:MACHINERY;purchase:HOUSEHOLD|AUTOMOBILE|BUILDING"


@register("family_compatible", """
WITH f AS (SELECT * FROM (VALUES ('view', ['BUILDING', 'FURNITURE']), ('click', ['MACHINERY']), ('purchase', ['HOUSEHOLD', 'AUTOMOBILE', 'BUILDING'])) t(category, labels))
SELECT event_id, c_mktsegment AS label, coalesce(list_contains(labels, c_mktsegment), FALSE) AS compatible FROM events JOIN customer ON c_custkey = user_id LEFT JOIN f ON category = event_type
""")
def family_compatible(spark, sf_dir):
    """Whether a label is in the set of a category, the sets being parsed from one line of configuration."""
    sets = F.transform_values(F.str_to_map(F.lit(FAMILIES), F.lit(";"), F.lit(":")), lambda _, v: F.split(v, r"\|"))
    e = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return e.select("event_id", F.col("c_mktsegment").alias("label"), F.coalesce(F.array_contains(F.try_element_at(sets, "event_type"), F.col("c_mktsegment")), F.lit(False)).alias("compatible"))


@register("refinement_gate", """
WITH m AS (SELECT l_orderkey, l_linenumber, CAST(p_size AS DOUBLE) AS original, l_quantity AS refined, least(p_size, l_quantity) AS common, l_discount AS off_signal, l_tax AS outside FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, r IS NULL AS accepted, r AS reason, round(common / (original + refined - common), 6) AS iou FROM (SELECT *, CASE WHEN original <= 0 THEN 'empty_original' WHEN refined <= original THEN 'no_growth' WHEN common / (original + refined - common) < 0.5 THEN 'iou_too_low'
 WHEN common < 0.98 * original THEN 'original_not_contained' WHEN refined > 1.6 * original THEN 'grew_too_much' WHEN off_signal > 0.08 THEN 'off_signal_growth' WHEN outside > 0.07 THEN 'outside_box_growth' END AS r FROM m)
""")
def refinement_gate(spark, sf_dir):
    """Whether a refined area replaces the original one: the first reason against it, and the overlap of both."""
    m = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = m.select("l_orderkey", "l_linenumber", F.col("p_size").cast("double").alias("o"), F.col("l_quantity").alias("r"), F.least(F.col("p_size").cast("double"), "l_quantity").alias("c"), "l_discount", "l_tax")
    o, r, c = F.col("o"), F.col("r"), F.col("c")
    iou = c / (o + r - c)
    checks = [
        ("empty_original", o > 0), ("no_growth", r > o), ("iou_too_low", iou >= 0.5), ("original_not_contained", c >= 0.98 * o), ("grew_too_much", r <= 1.6 * o),
        ("off_signal_growth", F.col("l_discount") <= 0.08), ("outside_box_growth", F.col("l_tax") <= 0.07),
    ]
    return m.withColumn("reason", gates.ordered_code(checks)).select("l_orderkey", "l_linenumber", F.col("reason").isNull().alias("accepted"), "reason", F.round(iou, 6).alias("iou"))


@register("mask_resize", """
SELECT vec_id, CAST(i AS INTEGER) AS i, embedding[CAST(floor((i + 0.5) * len(embedding) / 6) AS INTEGER) + 1] > 0 AS inside FROM (SELECT vec_id, embedding, unnest(range(0, 6)) AS i FROM embeddings)
""")
def mask_resize(spark, sf_dir):
    """A row of cells resampled to six by the nearest one."""
    at = F.floor((F.col("i") + 0.5) * F.size("embedding") / 6).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return e.select("vec_id", "i", (F.get("embedding", at) > 0).alias("inside"))


@register("structural_walls", """
SELECT p_partkey, p_type <> 'ECONOMY' OR p_size % 7 = 0 OR p_size * p_retailprice >= 40000 AS structural, abs(p_size - 24) <= 2 AS on_floor, CAST(least(p_partkey % 180, 180 - p_partkey % 180) AS DOUBLE) AS heading FROM part
""")
def structural_walls(spark, sf_dir):
    """Walls that are classified, have openings or are large; whether they stand on the floor; their heading against the first."""
    near = gates.heading_apart(F.col("p_partkey").cast("double"), F.lit(0.0))
    keep = (F.col("p_type") != "ECONOMY") | (F.col("p_size") % 7 == 0) | (F.col("p_size") * F.col("p_retailprice") >= 40000)
    return table(spark, sf_dir, "part").select("p_partkey", keep.alias("structural"), (F.abs(F.col("p_size") - 24) <= 2).alias("on_floor"), near.alias("heading"))


@register("moved_beyond_tolerance", """
SELECT o_orderkey, abs(o_totalprice - b) AS moved_by FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + o_custkey ELSE o_totalprice + 1 END AS b FROM orders) WHERE abs(o_totalprice - b) > 25
""")
def moved_beyond_tolerance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    before = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + F.col("o_custkey")).otherwise(F.col("o_totalprice") + 1).alias("o_totalprice"))
    return gates.moved(o, before, "o_orderkey", ["o_totalprice"], 25.0)


@register("document_problems", """
WITH d AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'kind' END, CASE WHEN value > 90 THEN 'value' END, CASE WHEN k IS NULL OR k > 80 THEN 'k' END, CASE WHEN event_type = 'view' AND k % 2 = 1 THEN 'parity' END], lambda x: x IS NOT NULL), chr(10)) AS problems FROM d
""")
def document_problems(spark, sf_dir):
    """All problems of a document of closed words and ranges, one a line."""
    d = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    checks = [("kind", F.col("event_type").isin("view", "click", "purchase", "signup")), ("value", ~(F.col("value") > 90)), ("k", F.col("k") <= 80), ("parity", F.coalesce(~((F.col("event_type") == "view") & (F.col("k") % 2 == 1)), F.lit(True)))]
    return d.select("event_id", F.array_join(gates.all_problems(checks), "\n").alias("problems"))


@register("expiry_stamp_needed", "SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice < 100000 AND o_orderpriority <> '1-URGENT' AS stamp FROM orders")
def expiry_stamp_needed(spark, sf_dir):
    """A failed end state without an expiry so far (urgent ones have one)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000) & (F.col("o_orderpriority") != "1-URGENT")).alias("stamp"))


@register("requeue_decision", """
WITH o AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice < 60000 AS leased, o_orderpriority = '1-URGENT' AS force FROM orders)
SELECT o_orderkey, CASE WHEN status = 'O' THEN TRUE WHEN status = 'P' THEN NOT leased OR force ELSE force END AS allowed,
 CASE WHEN status = 'O' THEN 'queued' WHEN status = 'P' AND NOT leased THEN 'lease_expired' WHEN status = 'P' AND force THEN 'forced' WHEN status = 'P' THEN 'held' WHEN force THEN 'forced_terminal' ELSE 'terminal' END AS reason FROM o
""")
def requeue_decision(spark, sf_dir):
    """Status, lease and force decide whether a job may be queued again, and why."""
    o = table(spark, sf_dir, "orders")
    status, leased, force = F.col("o_orderstatus"), F.col("o_totalprice") < 60000, F.col("o_orderpriority") == "1-URGENT"
    reason = F.when(status == "O", "queued").when((status == "P") & ~leased, "lease_expired").when((status == "P") & force, "forced").when(status == "P", "held").when(force, "forced_terminal").otherwise("terminal")
    return o.select("o_orderkey", reason.isin("queued", "lease_expired", "forced", "forced_terminal").alias("allowed"), reason.alias("reason"))


@register("uuid4_check", r"""
WITH u AS (SELECT doc_id, md5(text) AS h FROM documents), s AS (SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || CASE WHEN doc_id % 3 = 0 THEN '4' ELSE substr(h, 13, 1) END || substr(h, 14, 3) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM u)
SELECT doc_id, regexp_matches(id, '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS valid FROM s
""")
def uuid4_check(spark, sf_dir):
    h = F.md5("text")
    third = F.concat(F.when(F.col("doc_id") % 3 == 0, "4").otherwise(F.substring(h, 13, 1)), F.substring(h, 14, 3))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf_dir, "documents").select("doc_id", made.rlike(gates.UUID4).alias("valid"))


@register("finish_gate", """
WITH m AS (SELECT l_orderkey, sum(l_tax) AS before, sum(l_discount) AS after, max(l_discount) AS worst FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN round(before - after, 6) < 0.02 THEN 'no_gain' WHEN worst > 0.06 THEN 'region_too_bad' ELSE 'ok' END AS verdict FROM m
""")
def finish_gate(spark, sf_dir):
    """A change passes if its measures fall by enough in sum, and none of its regions is too bad."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("before"), F.sum("l_discount").alias("after"), F.max("l_discount").alias("worst"))
    return m.select("l_orderkey", F.coalesce(gates.ordered_code([("no_gain", F.round(F.col("before") - F.col("after"), 6) >= 0.02), ("region_too_bad", F.col("worst") <= 0.06)]), F.lit("ok")).alias("verdict"))


@register("alert_rules", """
WITH s AS (SELECT o_orderpriority AS mode, count(*) AS n, avg(o_totalprice) AS mean, max(o_totalprice) AS top, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS failed FROM orders GROUP BY 1)
SELECT mode, 'many' AS alert FROM s WHERE n > 100 UNION ALL SELECT mode, 'dear' FROM s WHERE top > 199000 UNION ALL SELECT mode, 'failing' FROM s WHERE failed > 0.3 UNION ALL SELECT mode, 'cheap' FROM s WHERE mean < 1000
""")
def alert_rules(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("failed"))
    return gates.alerts(s, [("many", F.col("n") > 100), ("dear", F.col("top") > 199000), ("failing", F.col("failed") > 0.3), ("cheap", F.col("mean") < 1000)]).select("mode", "alert")


@register("rekey_through_map", """
SELECT event_id, coalesce(m.k, event_type) AS key FROM events LEFT JOIN (VALUES ('view', 'look'), ('click', 'touch')) m(name, k) ON name = event_type
""")
def rekey_through_map(spark, sf_dir):
    names = F.create_map(F.lit("view"), F.lit("look"), F.lit("click"), F.lit("touch"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(names, "event_type"), "event_type").alias("key"))


@register("rendered_targets", "SELECT DISTINCT o_custkey // 5 AS scene, 'c' || o_custkey AS uri FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000 AND o_orderpriority <> '5-LOW'")
def rendered_targets(spark, sf_dir):
    """The distinct targets of a scene that are placed, have a transform and an address."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice > 50000 and o_orderpriority != '5-LOW'")
    return o.select(F.floor(F.col("o_custkey") / 5).alias("scene"), F.concat(F.lit("c"), F.col("o_custkey")).alias("uri")).distinct()


@register("live_keys", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS keys FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def live_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("keys"))


@register("needs_patch", """
WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ['reach', 'light'] ELSE [c_mktsegment] END AS base, CASE WHEN c_custkey % 4 = 0 THEN 'quiet' END AS add_, CASE WHEN c_custkey % 3 = 0 THEN 'light' END AS drop_ FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(base, [add_]), lambda x: x IS NOT NULL AND (drop_ IS NULL OR x <> drop_)))), ',') AS needs FROM d
""")
def needs_patch(spark, sf_dir):
    """A key's needs, the default ones where it has no document, with one added and one taken away."""
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_acctbal") >= 0, F.array("c_mktsegment"))
    base = F.coalesce(own, F.array(F.lit("reach"), F.lit("light")))
    added = F.when(F.col("c_custkey") % 4 == 0, F.array_append(base, F.lit("quiet"))).otherwise(base)
    kept = F.when(F.col("c_custkey") % 3 == 0, F.array_remove(added, F.lit("light"))).otherwise(added)
    return c.select("c_custkey", F.array_join(F.sort_array(F.array_distinct(kept)), ",").alias("needs"))


ZONES = [("ECONOMY", "front", 0.6), ("ECONOMY", "left", 0.4), ("STANDARD", "front", 0.9), ("PROMO", "left", 0.3), ("PROMO", "right", 0.3), ("LARGE", "back", 1.2)]


@register("need_zones", """
WITH z AS (SELECT * FROM (VALUES ('ECONOMY', 'front', 0.6), ('ECONOMY', 'left', 0.4), ('STANDARD', 'front', 0.9), ('PROMO', 'left', 0.3), ('PROMO', 'right', 0.3), ('LARGE', 'back', 1.2)) t(kind, side, depth))
SELECT p_partkey, side, round(CAST(depth AS DOUBLE) * p_size, 4) AS area FROM part JOIN z ON kind = p_type
""")
def need_zones(spark, sf_dir):
    """One row for each side that a piece of a kind needs free, sized by the rule book."""
    return gates.rule_rows(table(spark, sf_dir, "part"), "p_type", ZONES).select("p_partkey", "side", F.round(F.col("depth") * F.col("p_size"), 4).alias("area"))


@register("off_plane_points", """
WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), p AS (SELECT * FROM (VALUES (1.0, 0.0, 0.05), (0.0, 1.0, -0.05)) t(nx, ny, d))
SELECT vec_id FROM v WHERE label % 2 = 1 OR NOT EXISTS (SELECT 1 FROM p WHERE abs(x * nx + y * ny - d) <= 0.05)
""")
def off_plane_points(spark, sf_dir):
    """Points that lie on no wall of their room; labels of odd number have no walls."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    walls = F.array(*[F.struct(F.lit(a).alias("nx"), F.lit(b).alias("ny"), F.lit(d).alias("d")) for a, b, d in ((1.0, 0.0, 0.05), (0.0, 1.0, -0.05))])
    planes = v.where("label % 2 = 0").select("label").distinct().select("label", F.explode(walls).alias("p")).select("label", "p.*")
    return gates.off_planes(v, planes, "label", ["x", "y"], 0.05).select("vec_id")


@register("ownership_gate", """
SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_nationkey > 20 THEN 'not_found' WHEN c_acctbal < 0 THEN 'forbidden' WHEN o_orderstatus <> 'O' THEN 'not_ready' ELSE 'ok' END AS code FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def ownership_gate(spark, sf_dir):
    """Not there, not the caller's, not ready: asked in that order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", F.coalesce(gates.ordered_code([("not_found", F.col("c_custkey").isNotNull() & (F.col("c_nationkey") <= 20)), ("forbidden", F.col("c_acctbal") >= 0), ("not_ready", F.col("o_orderstatus") == "O")]), F.lit("ok")).alias("code"))


@register("unprompted_change", r"""
WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who FROM conversations)
SELECT conv_id, turn, who = 'user' AND length(text) > 200 AND NOT regexp_matches(lower(asked), '\b(the|and)\b') AS flagged FROM t WHERE role = 'assistant' AND asked IS NOT NULL
""")
def unprompted_change(spark, sf_dir):
    """Long answers to a question that holds none of the words of asking."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(w)).withColumn("who", F.lag("role").over(w)).where("role = 'assistant' and asked is not null")
    return t.select("conv_id", "turn", ((F.col("who") == "user") & (F.length("text") > 200) & ~F.lower("asked").rlike(r"\b(the|and)\b")).alias("flagged"))


@register("settle_bonds", """
WITH e AS (SELECT c_custkey AS pos, c_nationkey AS a, (c_nationkey + c_custkey * 7) % 25 AS b, CASE c_custkey % 3 WHEN 0 THEN 'at' WHEN 1 THEN 'over' ELSE 'beside' END AS how FROM customer),
s AS (SELECT e.*, CASE WHEN a = b THEN 'dropped_self' WHEN how = 'over' AND y.n_regionkey < x.n_regionkey THEN 'dropped_over' END AS gone, how IN ('at', 'beside') AND x.n_regionkey > y.n_regionkey AS swap FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b),
t AS (SELECT pos, CASE WHEN swap AND gone IS NULL THEN b ELSE a END AS a, CASE WHEN swap AND gone IS NULL THEN a ELSE b END AS b, how, gone, swap FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b), gone IS NULL ORDER BY pos) AS n FROM t)
SELECT pos, a, b, how, CASE WHEN gone IS NOT NULL THEN gone WHEN n > 1 THEN 'dropped_second' WHEN swap THEN 'turned' ELSE 'kept' END AS action FROM r
""")
def settle_bonds(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    how = F.when(F.col("c_custkey") % 3 == 0, "at").when(F.col("c_custkey") % 3 == 1, "over").otherwise("beside")
    edges = c.select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("long").alias("a"), ((F.col("c_nationkey") + F.col("c_custkey") * 7) % 25).alias("b"), how.alias("how"))
    sizes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("size"))
    return gates.settled_edges(edges, "a", "b", "how", "pos", sizes, "k", "size")
