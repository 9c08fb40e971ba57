"""Queries of validation, filters, sets and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import register
from ..functions import scalar
from ..operators import validation as val
from ..session import table


@register("first_failure_validation", """
WITH l AS (SELECT l_orderkey, count(*) AS n, bool_and(l_shipdate IS NOT NULL) AS shipped, min(l_discount) AS d0, max(l_discount) AS d1, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no_lines' WHEN o_totalprice <= 1000 THEN 'price' WHEN n > 6 THEN 'too_many' WHEN d1 > 0.09 THEN 'discount' WHEN o_orderstatus = 'F' AND r > 0 THEN 'returned' END AS code,
 CASE WHEN n IS NULL THEN '0' WHEN o_totalprice <= 1000 THEN o_orderpriority WHEN n > 6 THEN CAST(n AS VARCHAR) WHEN d1 > 0.09 THEN 'high' WHEN o_orderstatus = 'F' AND r > 0 THEN CAST(r AS VARCHAR) END AS detail
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def first_failure_validation(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("d1"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    problem = val.first_failure(
        [
            ("no_lines", F.col("n").isNotNull(), F.lit("0")),
            ("price", F.col("o_totalprice") > 1000, F.col("o_orderpriority")),
            ("too_many", F.col("n") <= 6, F.col("n")),
            ("discount", F.col("d1") <= 0.09, F.lit("high")),
            ("returned", ~((F.col("o_orderstatus") == "F") & (F.col("r") > 0)), F.col("r")),
        ]
    )
    return o.withColumn("p", problem).select("o_orderkey", "p.code", "p.detail")


@register("multi_reason_rejects", """
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity < 3 THEN 'too_small' END, CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_tax > 0.07 THEN 'taxed' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem
WHERE l_quantity < 3 OR l_discount > 0.08 OR l_tax > 0.07 OR l_returnflag = 'R'
""")
def multi_reason_rejects(spark, sf_dir):
    reasons = val.all_reasons([("too_small", F.col("l_quantity") < 3), ("discounted", F.col("l_discount") > 0.08), ("taxed", F.col("l_tax") > 0.07), ("returned", F.col("l_returnflag") == "R")])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reasons.alias("r")).where(F.size("r") > 0).select("l_orderkey", "l_linenumber", F.array_join("r", ",").alias("reasons"))


@register("path_grammar_check", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' WHEN starts_with(path, 'gs://') THEN 'store_url' WHEN list_contains(parts, '..') THEN 'parent_segment' WHEN length(path) > 24 THEN 'too_long'
 WHEN len(parts) > 2 THEN 'too_deep' WHEN NOT regexp_matches(parts[-1], '^[A-Za-z0-9._-]+$') THEN 'characters' END AS problem FROM s
""")
def path_grammar_check(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]*/", "").alias("path"))
    return p.select("page_id", val.path_problem(F.col("path"), most_chars=24).alias("problem"))


@register("manifest_set_constraints", """
WITH d AS (SELECT source, CAST(n_chars AS VARCHAR) || '.txt' AS name, n_chars AS size FROM documents), n AS (SELECT source, name, count(*) AS n, sum(size) AS b FROM d GROUP BY 1, 2),
w AS (SELECT source, sum(n) AS n, max(n) AS most, max(CASE WHEN name = '416.txt' THEN 1 ELSE 0 END) AS has, sum(b) AS b FROM n GROUP BY 1)
SELECT source, CAST(n AS BIGINT) AS n, CAST(b AS BIGINT) AS bytes, CASE WHEN n > 60 THEN 'too_many' WHEN most > 2 - 1 THEN 'repeated' WHEN has = 0 THEN 'missing' WHEN b > 90000 THEN 'too_large' END AS problem FROM w
""")
def manifest_set_constraints(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.col("n_chars").cast("string"), F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"))
    return val.set_problems(d, ["source"], "name", "size", "416.txt", 60, 90_000)


@register("keep_first_dedupe_cap", """
WITH f AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v, ts, event_id FROM events WHERE value >= 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) = 1)
SELECT user_id, event_type, v, event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10
""")
def keep_first_dedupe_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value >= 1").select("user_id", "event_type", F.floor("value").alias("v"), "ts", "event_id")
    return val.keep_first(e, ["user_id", "event_type", "v"], [F.asc("ts"), F.asc("event_id")], 10, ["user_id"]).select("user_id", "event_type", "v", "event_id")


@register("deny_list_split", "SELECT event_id, event_type, lower(trim(event_type)) IN ('error', 'signup') AS suppressed FROM events")
def deny_list_split(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", val.label_split(F.col("event_type"), ["error", "signup"]).alias("suppressed"))


@register("two_sided_vocabulary_gap", """
WITH a AS (SELECT DISTINCT n_nationkey AS value FROM nation), b AS (SELECT DISTINCT CAST(c_nationkey + (c_custkey % 3) AS INTEGER) AS value FROM customer WHERE c_acctbal < -500)
SELECT 'left' AS side, value FROM a ANTI JOIN b USING (value) UNION ALL SELECT 'right', value FROM b ANTI JOIN a USING (value)
""")
def two_sided_vocabulary_gap(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"))
    b = table(spark, sf_dir, "customer").where("c_acctbal < -500").select((F.col("c_nationkey") + F.col("c_custkey") % 3).cast("int").alias("v"))
    return val.vocabulary_gaps(a, b, "v")


@register("state_edge_check", """
WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS a, ['queued', 'processing', 'ready', 'failed', 'failed_invalid'][1 + o_orderkey % 5] AS b FROM orders)
SELECT o_orderkey, a AS state, b AS target, CASE a WHEN 'queued' THEN b IN ('processing', 'failed', 'failed_incomplete', 'failed_invalid') WHEN 'processing' THEN b IN ('ready', 'failed') WHEN 'failed' THEN b = 'queued' ELSE FALSE END AS allowed FROM o
""")
def state_edge_check(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    target = F.get(F.array(*map(F.lit, ["queued", "processing", "ready", "failed", "failed_invalid"])), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), target.alias("target")).withColumn("allowed", val.edge_allowed(F.col("state"), F.col("target")))


@register("expiry_for_transition", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 30 DAYS WHEN 'O' THEN NULL ELSE o_orderdate END AS expires FROM orders
""")
def expiry_for_transition(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return table(spark, sf_dir, "orders").select("o_orderkey", val.expiry_after(state, F.col("o_orderdate"), F.col("o_orderdate"), 30).alias("expires"))


@register("relaxed_predicate", """
WITH s AS (SELECT * FROM (VALUES (0, 1.0), (1, 0.8), (2, 0.6), (3, 0.4)) t(step, scale)), q AS (SELECT l_orderkey, min(step) AS step FROM lineitem JOIN s ON l_quantity >= 40 * scale AND l_discount >= 0.08 * scale GROUP BY 1)
SELECT DISTINCT l.l_orderkey, q.step FROM lineitem l LEFT JOIN q ON l.l_orderkey = q.l_orderkey
""")
def relaxed_predicate(spark, sf_dir):
    """The first of four scales at which a line of the order qualifies: one pass, no join with the scales."""
    own = F.coalesce(*[F.when((F.col("l_quantity") >= 40 * s) & (F.col("l_discount") >= 0.08 * s), k) for k, s in enumerate((1.0, 0.8, 0.6, 0.4))])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(own).alias("step"))


@register("near_top_filter", "WITH m AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) SELECT l_orderkey, l_linenumber FROM m WHERE l_extendedprice >= 0.7 * top")
def near_top_filter(spark, sf_dir):
    from pyspark.sql import Window

    top = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").withColumn("top", top).where(F.col("l_extendedprice") >= 0.7 * F.col("top")).select("l_orderkey", "l_linenumber")


@register("unit_norm_check", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, abs(sqrt(list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * x))) - 0.25) <= 0.1 AS near_quarter FROM embeddings
""")
def unit_norm_check(spark, sf_dir):
    v = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    n = scalar.norm(*v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(n, 5).alias("norm"), (F.abs(n - 0.25) <= 0.1).alias("near_quarter"))


@register("upsert_spec", """
WITH w AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, o_orderdate FROM orders)
SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM w WHERE r = 1
""")
def upsert_spec(spark, sf_dir):
    """One entry for each key; the last write wins and moves to the end."""
    from pyspark.sql import Window

    o = val.keep_first(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return o.select("o_custkey", "o_orderpriority", "o_orderkey", place.alias("place"))


@register("foreign_measurements", """
WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[0-9]+')) AS n FROM conversations), u AS (SELECT conv_id, list_distinct(flatten(list(n))) AS known FROM w WHERE role = 'user' GROUP BY 1)
SELECT w.conv_id, w.turn, len(list_filter(n, lambda x: NOT list_contains(coalesce(known, []), x))) AS unknown FROM w LEFT JOIN u USING (conv_id) WHERE role = 'assistant'
""")
def foreign_measurements(spark, sf_dir):
    """Numbers that an assistant's turn states and no user's turn of the conversation has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("n"))
    known = c.where("role = 'user'").select("conv_id", F.explode("n").alias("x")).groupBy("conv_id").agg(F.collect_set("x").alias("known"))
    j = c.where("role = 'assistant'").join(known, "conv_id", "left")
    return j.select("conv_id", "turn", F.size(F.array_except("n", F.coalesce("known", F.array().cast("array<string>")))).cast("long").alias("unknown"))


@register("new_violations", """
WITH b AS (SELECT DISTINCT l_orderkey, l_returnflag AS law FROM lineitem WHERE l_linenumber <= 2 AND l_discount > 0.05), n AS (SELECT DISTINCT l_orderkey, l_returnflag AS law FROM lineitem WHERE l_discount > 0.05)
SELECT * FROM n EXCEPT SELECT * FROM b
""")
def new_violations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select("l_orderkey", F.col("l_returnflag").alias("law"), "l_linenumber")
    return l.select("l_orderkey", "law").distinct().join(l.where("l_linenumber <= 2").select("l_orderkey", "law").distinct(), ["l_orderkey", "law"], "left_anti")


@register("account_erasure_plan", """
WITH u AS (SELECT c_custkey FROM customer WHERE c_acctbal < -900), o AS (SELECT o_orderkey FROM orders SEMI JOIN u ON o_custkey = c_custkey)
SELECT 'customer' AS store, count(*) AS n FROM u UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey
""")
def account_erasure_plan(spark, sf_dir):
    u = table(spark, sf_dir, "customer").where("c_acctbal < -900").select("c_custkey")
    o = table(spark, sf_dir, "orders").join(u, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(s).alias("store"), "n") for s, d in (("customer", u), ("orders", o), ("lineitem", l))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("content_hash_keys", """SELECT o_orderkey, sha256('["' || CAST(o_custkey AS VARCHAR) || '","' || o_orderstatus || '","' || o_orderpriority || '"]') AS key FROM orders""")
def content_hash_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.content_key(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


@register("quaternion_ops", """
WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(e[1]*e[1] + e[2]*e[2] + e[3]*e[3] + e[4]*e[4]) AS na, sqrt(e[5]*e[5] + e[6]*e[6] + e[7]*e[7] + e[8]*e[8]) AS nb FROM v),
q AS (SELECT vec_id, e[1]/na AS ax, e[2]/na AS ay, e[3]/na AS az, e[4]/na AS aw, e[5]/nb AS bx, e[6]/nb AS b_y, e[7]/nb AS bz, e[8]/nb AS bw FROM n)
SELECT vec_id, round(aw*bx + ax*bw + ay*bz - az*b_y, 6) AS px, round(aw*bw - ax*bx - ay*b_y - az*bz, 6) AS pw, round(degrees(2 * acos(least(abs(ax*bx + ay*b_y + az*bz + aw*bw), 1.0))), 4) AS angle FROM q
""")
def quaternion_ops(spark, sf_dir):
    v = [F.get("embedding", F.lit(k)).cast("double") for k in range(8)]
    df = table(spark, sf_dir, "embeddings").select("vec_id", *[x.alias(f"e{k}") for k, x in enumerate(v)]).withColumn("na", scalar.norm(*[F.col(f"e{k}") for k in range(4)])).withColumn("nb", scalar.norm(*[F.col(f"e{k}") for k in range(4, 8)]))
    a, b = [F.col(f"e{k}") / F.col("na") for k in range(4)], [F.col(f"e{k}") / F.col("nb") for k in range(4, 8)]
    p = scalar.quaternion_product(a, b)
    return df.select("vec_id", F.round(p[0], 6).alias("px"), F.round(p[3], 6).alias("pw"), F.round(scalar.quaternion_angle(a, b), 4).alias("angle"))


@register("projection_ops", """
WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT vec_id, CASE WHEN z < 0 THEN round(320 + 500 * x / -z, 4) END AS u, CASE WHEN z < 0 THEN round(240 - 500 * y / -z, 4) END AS v FROM v
""")
def projection_ops(spark, sf_dir):
    x, y, z = (F.get("embedding", F.lit(k)).cast("double") for k in range(3))
    u, v = scalar.project(x, y, z, 500.0, 500.0, 320.0, 240.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@register("colour_words", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no colour' ELSE '#' || substr(md5(c_name), 1, 6) END AS hex FROM customer),
x AS (SELECT c_custkey, ('0x' || substr(hex, 2, 2))::INTEGER / 255 AS r, ('0x' || substr(hex, 4, 2))::INTEGER / 255 AS g, ('0x' || substr(hex, 6, 2))::INTEGER / 255 AS b FROM c WHERE hex <> 'no colour'),
h AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM x),
k AS (SELECT c_custkey, v, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, 60 * CASE WHEN d = 0 THEN 0 WHEN v = r THEN ((g - b) / d + 6) % 6 WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS hue FROM h),
w AS (SELECT *, CASE WHEN v < 0.2 THEN 'black' WHEN s < 0.18 THEN CASE WHEN v >= 0.9 THEN 'white' ELSE 'grey' END WHEN (hue < 50 OR hue >= 345) AND v < 0.45 THEN 'brown' WHEN hue < 15 OR hue >= 345 THEN 'red' WHEN hue < 50 AND s < 0.4 THEN 'beige' WHEN hue < 50 AND v < 0.62 THEN 'brown'
 WHEN hue < 50 THEN 'orange' WHEN hue < 70 AND s >= 0.4 THEN 'yellow' WHEN hue < 70 THEN 'beige' WHEN hue < 165 THEN 'green' WHEN hue < 200 THEN 'teal' WHEN hue < 255 THEN 'blue' WHEN hue < 290 THEN 'purple' ELSE 'pink' END AS word FROM k)
SELECT c.c_custkey, word, CASE WHEN word IN ('grey', 'beige') THEN FALSE WHEN word = 'black' THEN v <= 0.15 WHEN word = 'white' THEN v >= 0.92 ELSE s >= 0.35 END AS nameable FROM c LEFT JOIN w USING (c_custkey)
""")
def colour_words(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 11 == 0, "no colour").otherwise(F.concat(F.lit("#"), F.substring(F.md5("c_name"), 1, 6)))
    c = table(spark, sf_dir, "customer").select("c_custkey", text.alias("hex"))
    return c.withColumn("k", scalar.colour_reading(*scalar.hex_rgb(F.col("hex")))).select("c_custkey", "k.word", "k.nameable")
