"""Queries of scenes, sessions, tasks, trackers and cards: assembly, leases and their ends, streaks, statuses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import joins
from ..session import scratch_path, table
from .shapes import BOXES, boxes, near_pairs


@register("scene_assembly", """
SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN 'spz/' || c_custkey ELSE 'ply/' || o_custkey END AS uri, c_custkey IS NOT NULL AND o_totalprice > 20000 AS renderable FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def scene_assembly(spark, sf_dir):
    """Objects with their addresses, the compressed one first; which of them can be drawn."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    packed = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("spz/"), F.col("c_custkey")))
    return o.select("o_orderkey", F.coalesce(packed, F.concat(F.lit("ply/"), F.col("o_custkey"))).alias("uri"), (F.col("c_custkey").isNotNull() & (F.col("o_totalprice") > 20000)).alias("renderable"))


@register("scene_assets", """
WITH u AS (SELECT DISTINCT o_custkey // 5 AS scene, o_custkey AS uri FROM orders WHERE o_orderstatus = 'O') SELECT scene, string_agg('raw/' || uri, ',' ORDER BY uri) AS raw, string_agg(CASE WHEN c_acctbal > 5000 THEN 'packed/' || uri END, ',' ORDER BY uri) AS packed FROM u LEFT JOIN customer ON c_custkey = uri GROUP BY 1
""")
def scene_assets(spark, sf_dir):
    """The distinct placed addresses of a scene, sorted; the packed ones only where they are indexed."""
    u = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.floor(F.col("o_custkey") / 5).alias("scene"), F.col("o_custkey").alias("uri")).distinct()
    u = u.join(table(spark, sf_dir, "customer"), F.col("uri") == F.col("c_custkey"), "left")
    s = u.groupBy("scene").agg(F.sort_array(F.collect_list("uri")).alias("all"), F.sort_array(F.collect_list(F.when(F.col("c_acctbal") > 5000, F.col("uri")))).alias("some"))
    named = lambda c, p: F.nullif(F.array_join(F.transform(c, lambda x: F.concat(F.lit(p), x)), ","), F.lit(""))
    return s.select("scene", named("all", "raw/").alias("raw"), named("some", "packed/").alias("packed"))


@register("room_geometry_rows", """
SELECT c_custkey, n_name, r_name, TRY_CAST(substr(c_name, 10 + CAST(c_custkey % 12 AS INTEGER)) AS BIGINT) AS number, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS size FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey
""")
def room_geometry_rows(spark, sf_dir):
    """Objects with their names and their shell; what is malformed or not there is null, no row is lost."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    number = F.expr("try_cast(substring(c_name, 10 + cast(c_custkey % 12 as int)) as bigint)")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name", number.alias("number"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("size"))


@register("signed_addresses", "SELECT page_id, 'signed:' || url AS signed, page_id % 3 = 0 AS packed FROM pages")
def signed_addresses(spark, sf_dir):
    """An injected signer over distinct addresses, looked up for each row."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    minted = p.select("url").distinct().withColumn("signed", F.concat(F.lit("signed:"), F.col("url")))
    return p.join(minted, "url").select("page_id", "signed", (F.col("page_id") % 3 == 0).alias("packed"))


@register("material_planes", """
WITH m AS (SELECT s_nationkey AS k, count(*) AS n, max(s_acctbal) AS best FROM supplier GROUP BY 1) SELECT n_nationkey, coalesce(n, 0) AS samples, coalesce(round(best, 2), 0.0) AS confidence, n IS NULL AS unobserved FROM nation LEFT JOIN m ON k = n_nationkey
""")
def material_planes(spark, sf_dir):
    """Planes with their material results; those without any get the defaults and say so."""
    m = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("best"))
    p = table(spark, sf_dir, "nation").join(m, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return p.select("n_nationkey", F.coalesce("n", F.lit(0)).alias("samples"), F.coalesce(F.round("best", 2), F.lit(0.0)).alias("confidence"), F.col("n").isNull().alias("unobserved"))


@register("projected_boxes", f"WITH {BOXES} SELECT id, round(cos(t), 9) AS m00, round(0 - sin(t), 9) AS m01, round(sin(t), 9) AS m10, round(x, 6) AS tx, round(y, 6) AS ty FROM b WHERE id % 100 > 0")
def projected_boxes(spark, sf_dir):
    """A yaw and a centre as a transform."""
    b = boxes(spark, sf_dir).where("id % 100 > 0")
    return b.select("id", F.round(F.cos("t"), 9).alias("m00"), F.round(0 - F.sin("t"), 9).alias("m01"), F.round(F.sin("t"), 9).alias("m10"), F.round("x", 6).alias("tx"), F.round("y", 6).alias("ty"))


@register("run_starts", "SELECT user_id, min(event_id) AS event_id, arg_min(ts, event_id) AS started FROM events WHERE event_type = 'signup' GROUP BY 1")
def run_starts(spark, sf_dir):
    """The first line of the starting type for each run."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("ts", "event_id").alias("started"))


@register("card_statuses", """
WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS now, max(o_orderkey) AS last FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderkey = last THEN 'current' WHEN o_orderstatus = now THEN 'applied' WHEN o_orderstatus = 'F' THEN 'refused' ELSE 'superseded' END AS status FROM orders JOIN l USING (o_custkey)
""")
def card_statuses(spark, sf_dir):
    """The status of each past card as of the current state."""
    o = table(spark, sf_dir, "orders")
    l = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("now"), F.max("o_orderkey").alias("last"))
    status = F.when(F.col("o_orderkey") == F.col("last"), "current").when(F.col("o_orderstatus") == F.col("now"), "applied").when(F.col("o_orderstatus") == "F", "refused").otherwise("superseded")
    return o.join(l, "o_custkey").select("o_orderkey", status.alias("status"))


@register("first_proposals", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), k AS (SELECT * FROM c WHERE r <= 4) SELECT o_custkey, count(*) AS tried, string_agg(CASE WHEN o_totalprice < 100000 THEN o_orderkey END, ',' ORDER BY r) AS grounded FROM k GROUP BY 1
""")
def first_proposals(spark, sf_dir):
    """The first four changes of a turn, each grounded by itself; what survives, in order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 4")
    kept = F.sort_array(F.collect_list(F.when(F.col("o_totalprice") < 100000, F.struct("r", "o_orderkey"))))
    joined = F.nullif(F.array_join(F.transform(kept, lambda x: x["o_orderkey"].cast("string")), ","), F.lit(""))
    return k.groupBy("o_custkey").agg(F.count("*").alias("tried"), joined.alias("grounded"))


@register("mask_containment", """
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS s FROM documents) SELECT a.doc_id, round(len(list_intersect(a.s, b.s)) / len(a.s), 6) AS contained FROM w a JOIN w b ON b.doc_id = a.doc_id + 1
""")
def mask_containment(spark, sf_dir):
    """The share of a set that the next one holds as well."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    b = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return w.join(b, "doc_id").select("doc_id", F.round(F.size(F.array_intersect("s", "t")) / F.size("s"), 6).alias("contained"))


@register("orphaned_checks", "SELECT item_id FROM benchmark EXCEPT SELECT doc_id // 3 FROM documents WHERE lang = 'en'")
def orphaned_checks(spark, sf_dir):
    """Checks that no entry names."""
    return table(spark, sf_dir, "benchmark").select("item_id").exceptAll(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.floor(F.col("doc_id") / 3).alias("item_id")).distinct()).distinct()


@register("static_scores", """
SELECT l_orderkey, l_linenumber, round(least(sqrt(l_quantity / 50), 0.35) / 0.35, 6) AS size, round(1 - sqrt(pow(l_discount * 5 - 0.25, 2) + pow(l_tax * 5 - 0.2, 2)), 6) AS centred, round(ln(1 + l_extendedprice), 6) AS sharp FROM lineitem
""")
def static_scores(spark, sf_dir):
    """The parts of a detection's score: its size, how central it is, how sharp."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.least(F.sqrt(F.col("l_quantity") / 50), F.lit(0.35)) / 0.35, 6).alias("size"),
        F.round(1 - F.hypot(F.col("l_discount") * 5 - 0.25, F.col("l_tax") * 5 - 0.2), 6).alias("centred"), F.round(F.log1p("l_extendedprice"), 6).alias("sharp"),
    )


@register("worst_case_cost", "SELECT o_orderkey, round((o_totalprice / 4 * 3 + least(o_custkey, 64) * 15) / 1000000, 9) AS usd, greatest(-0.1, least(0.1, (o_orderkey % 7 - 3) / 10.0))::DOUBLE AS step FROM orders")
def worst_case_cost(spark, sf_dir):
    """What a call may cost at most, and a calibration's step held within a tenth."""
    usd = (F.col("o_totalprice") / 4 * 3 + F.least("o_custkey", F.lit(64)) * 15) / 1_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(usd, 9).alias("usd"), F.greatest(F.lit(-0.1), F.least(F.lit(0.1), (F.col("o_orderkey") % 7 - 3) / 10.0)).alias("step"))


@register("facts_block", "SELECT n_regionkey, string_agg('- ' || n_name || ': ' || n_nationkey, chr(10) ORDER BY n_name) AS block FROM nation GROUP BY 1")
def facts_block(spark, sf_dir):
    """Ordered facts as one text."""
    fact = F.struct("n_name", F.concat(F.lit("- "), F.col("n_name"), F.lit(": "), F.col("n_nationkey")).alias("line"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(fact))["line"], "\n").alias("block"))


@register("arrangement_block", """
WITH e AS (SELECT c_custkey, count(o_orderkey) AS n, string_agg(o_orderkey || '@' || o_orderstatus, '; ' ORDER BY o_orderkey) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY 1) SELECT c_custkey, CASE WHEN n = 0 THEN '' ELSE 'Moved: ' || s END AS block FROM e
""")
def arrangement_block(spark, sf_dir):
    """A text of a key's entries; empty without any."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'")
    e = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("s"))
    line = F.array_join(F.transform("s", lambda x: F.concat(x["o_orderkey"], F.lit("@"), x["o_orderstatus"])), "; ")
    return table(spark, sf_dir, "customer").select("c_custkey").join(e, "c_custkey", "left").select("c_custkey", F.when(F.col("s").isNull(), "").otherwise(F.concat(F.lit("Moved: "), line)).alias("block"))


@register("overruled_claims", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'measured' WHEN o_orderstatus = 'F' THEN 'stated' WHEN o_orderpriority = '1-URGENT' THEN 'guessed' ELSE 'none' END AS departs_from FROM orders")
def overruled_claims(spark, sf_dir):
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(failed & (F.col("o_totalprice") > 100000), "measured").when(failed, "stated").when(F.col("o_orderpriority") == "1-URGENT", "guessed").otherwise("none").alias("departs_from"))


#: The columns of a customer that a client may see.
CLIENT_COLUMNS = ("c_custkey", "c_name", "c_mktsegment")


@register("client_view", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def client_view(spark, sf_dir):
    """An allow list: columns that are added on the server never leave."""
    return table(spark, sf_dir, "customer").select(*CLIENT_COLUMNS)


@register("enum_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PARTIAL' ELSE 'UNKNOWN' END AS tier FROM orders")
def enum_names(spark, sf_dir):
    names = F.create_map(F.lit("O"), F.lit("OPEN"), F.lit("P"), F.lit("PARTIAL"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, "o_orderstatus"), F.lit("UNKNOWN")).alias("tier"))


@register("markdown_notes", r"""
WITH n AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages), c AS (SELECT title, count(*) AS k FROM n GROUP BY 1) SELECT page_id, n.title, links, k > 1 AS repeated FROM n JOIN c USING (title)
""")
def markdown_notes(spark, sf_dir):
    """Headers and links of a corpus of notes, and the headers that occur twice."""
    n = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))
    c = n.groupBy("title").agg((F.count("*") > 1).alias("repeated"))
    return n.join(c, "title").select("page_id", "title", "links", "repeated")


@register("turn_audit", "SELECT conv_id, turn, role, length(text) AS chars, md5(text) AS digest, CASE WHEN length(text) > 300 THEN 'long' END AS flag FROM conversations")
def turn_audit(spark, sf_dir):
    """One audit row a turn, written as JSON lines and read back."""
    path = scratch_path(spark, "audit")
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), F.when(F.length("text") > 300, "long").alias("flag"))
    a.write.mode("append").json(path)
    return spark.read.schema(a.schema).json(path)


@register("upload_session_rows", """
SELECT page_id // 10 AS bundle, page_id, CASE WHEN length(url) > 60 THEN 'path_too_long' WHEN strlen(html) > 6000 THEN 'too_large' END AS code, CASE WHEN NOT (length(url) > 60 OR strlen(html) > 6000) THEN 'put:' || url END AS uri FROM pages
""")
def upload_session_rows(spark, sf_dir):
    """A request's manifest validated entry by entry, with an address for what is good."""
    code = F.when(F.length("url") > 60, "path_too_long").when(F.octet_length("html") > 6000, "too_large")
    return table(spark, sf_dir, "pages").withColumn("code", code).select(F.floor(F.col("page_id") / 10).alias("bundle"), "page_id", "code", F.when(F.col("code").isNull(), F.concat(F.lit("put:"), F.col("url"))).alias("uri"))


@register("first_writer_clock", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, min(ts) AS started FROM events GROUP BY 1")
def first_writer_clock(spark, sf_dir):
    """The first writer sets a job's clock; later ones find it set."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min("ts").alias("started"))


@register("early_stops", """
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, value < 30 AS small, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT *, i - max(CASE WHEN bad THEN 0 ELSE i END) OVER w AS rejects, i - max(CASE WHEN small AND NOT bad THEN 0 ELSE i END) OVER w AS smalls FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, min(i) AS stopped_after, arg_min(CASE WHEN rejects >= 2 THEN 'rejected' ELSE 'small_gains' END, i) AS reason FROM r WHERE rejects >= 2 OR smalls >= 2 GROUP BY 1
""")
def early_stops(spark, sf_dir):
    """A loop stops at its second reject, or second small gain, in a row."""
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(o).cast("long")).withColumn("bad", F.col("event_type") == "error").withColumn("small", (F.col("value") < 30) & ~F.col("bad"))
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.col("i") - F.max(F.when(F.col(c), F.lit(0)).otherwise(F.col("i"))).over(w)
    r = e.withColumn("rejects", run("bad")).withColumn("smalls", run("small")).where("rejects >= 2 or smalls >= 2")
    return r.groupBy("user_id").agg(F.min("i").alias("stopped_after"), F.min_by(F.when(F.col("rejects") >= 2, "rejected").otherwise("small_gains"), "i").alias("reason"))


@register("retry_outcomes", """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS tries, event_type FROM events) SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN tries >= 3 THEN 'dead_letter' WHEN event_id % 2 = 0 THEN 'retry_environment' ELSE 'retry' END AS outcome FROM e
""")
def retry_outcomes(spark, sf_dir):
    """What becomes of a failed task: retried until its tries are used up, then put aside."""
    tries = F.get_json_object("props", "$.k").cast("long") % 5
    outcome = F.when(F.col("event_type") != "error", "done").when(tries >= 3, "dead_letter").when(F.col("event_id") % 2 == 0, "retry_environment").otherwise("retry")
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"))


@register("task_names", "SELECT event_id, 'scene-' || user_id || '-r' || CAST(epoch_us(ts) // 1000000 AS BIGINT) AS name FROM events")
def task_names(spark, sf_dir):
    """Names with a time, so that a name that was used cannot swallow a retry."""
    s = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1_000_000)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("scene-"), F.col("user_id"), F.lit("-r"), s).alias("name"))


@register("chained_stages", "SELECT user_id, count(*) AS jobs, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS shells FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def chained_stages(spark, sf_dir):
    """A finished stage queues the next one: the first writes a table, the second reads it."""
    path = scratch_path(spark, "stage")
    table(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')").select("user_id", "event_id", "event_type").write.parquet(path)
    done = spark.read.schema("user_id long, event_id long, event_type string").parquet(path)
    return done.groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type") == "purchase").alias("shells"))


@register("neighbourhood_medians", """
WITH p AS (SELECT l_partkey AS k, l_orderkey % 40 AS x, l_linenumber AS y, l_quantity AS v, l_tax AS c FROM lineitem) SELECT a.k, a.x, a.y, round(median(b.v), 6) AS depth FROM (SELECT DISTINCT k, x, y FROM p) a JOIN p b ON b.k = a.k AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 1 AND b.c >= 0.03 GROUP BY 1, 2, 3
""")
def neighbourhood_medians(spark, sf_dir):
    """The median depth around each cell of an image, of what is certain enough."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") % 40).alias("x"), F.col("l_linenumber").alias("y"), F.col("l_quantity").alias("v"), F.col("l_tax").alias("c"))
    shifts = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in range(-2, 3) for j in range(-1, 2)])
    near = p.where("c >= 0.03").select("k", "v", F.explode(shifts).alias("s")).select("k", "v", "s.x", "s.y")
    return p.select("k", "x", "y").distinct().join(near, ["k", "x", "y"]).groupBy("k", "x", "y").agg(F.round(F.median("v"), 6).alias("depth"))


@register("banded_errors", "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS band, count(*) AS n, round(median(abs(l_discount - l_tax)), 6) AS error FROM lineitem GROUP BY 1")
def banded_errors(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("band"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("e"))
    return l.groupBy("band").agg(F.count("*").alias("n"), F.round(F.median("e"), 6).alias("error"))


@register("census_stable", """
WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), c AS (SELECT *, max(CASE WHEN was IS NULL OR was <> event_type THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS changed FROM e)
SELECT event_id, epoch_us(ts) - epoch_us(changed) >= 3600000000 AS stable FROM c
""")
def census_stable(spark, sf_dir):
    """Stable once an hour has passed since the last change."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    was = F.lag("event_type").over(w)
    e = table(spark, sf_dir, "events").withColumn("c", F.when(was.isNull() | (was != F.col("event_type")), F.col("ts")))
    e = e.withColumn("changed", F.max("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("event_id", (F.timestamp_diff("MICROSECOND", F.col("changed"), F.col("ts")) >= 3_600_000_000).alias("stable"))


@register("rebased_messages", "SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS at_us FROM events WHERE event_type <> 'error'")
def rebased_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type != 'error'")
    return e.select("event_id", F.timestamp_diff("MICROSECOND", F.min("ts").over(Window.partitionBy("user_id")), F.col("ts")).alias("at_us"))


@register("polling_cadence", "SELECT event_id, CASE WHEN value < 30 THEN 2 WHEN value < 300 THEN 10 ELSE 30 END AS seconds FROM events")
def polling_cadence(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 30, 2).when(F.col("value") < 300, 10).otherwise(30).alias("seconds"))


@register("merged_session_entries", """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey AS k, 'uri/' || o_custkey AS uri FROM orders WHERE o_totalprice > 40000) SELECT k, coalesce(status, 'new') AS status, uri FROM a FULL JOIN b USING (k)
""")
def merged_session_entries(spark, sf_dir):
    """New addresses laid over the stored statuses, whichever side knows a path."""
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    b = o.where("o_totalprice > 40000").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("uri/"), F.col("o_custkey")).alias("uri"))
    return a.join(b, "k", "full").select("k", F.coalesce("status", F.lit("new")).alias("status"), "uri")


@register("room_history", "SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'new' ELSE 'ready' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events")
def room_history(spark, sf_dir):
    """A user's rooms with their states, the newest first."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "new").otherwise("ready")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"), F.row_number().over(w).cast("long").alias("place"))


@register("retry_after_seconds", """
WITH h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN event_id % 3 = 1 THEN CAST(event_id % 90 AS VARCHAR) ELSE event_type END AS header FROM events)
SELECT event_id, coalesce(TRY_CAST(header AS BIGINT), epoch(try_strptime(header, '%Y-%m-%dT%H:%M:%SZ'))::BIGINT - 1704067200) AS seconds FROM h
""")
def retry_after_seconds(spark, sf_dir):
    """Seconds, or a date less the present; null for anything else."""
    made = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.when(F.col("event_id") % 3 == 0, made).when(F.col("event_id") % 3 == 1, (F.col("event_id") % 90).cast("string")).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", header.alias("header"))
    date = F.unix_timestamp(F.try_to_timestamp("header", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))) - 1_704_067_200
    return e.select("event_id", F.coalesce(F.expr("try_cast(header as bigint)"), date).alias("seconds"))


@register("decoded_detections", """
WITH f AS (SELECT vec_id, unnest(range(0, len(embedding) // 4)) AS row, embedding FROM embeddings), d AS (SELECT vec_id, row, embedding[row * 4 + 1] AS score, CAST(floor(abs(embedding[row * 4 + 2]) * 100) AS INTEGER) AS class, embedding[row * 4 + 3] AS x, embedding[row * 4 + 4] AS y FROM f)
SELECT vec_id, CAST(row AS INTEGER) AS row, class FROM d WHERE isfinite(score) AND score >= 0.05 AND class < 12 AND x > -0.2 AND y > -0.2
""")
def decoded_detections(spark, sf_dir):
    """Rows of four numbers out of a flat array: those with a score, a known class and a box in the frame."""
    at = lambda k: F.get("embedding", F.col("row") * 4 + k)
    f = table(spark, sf_dir, "embeddings").withColumn("row", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1)))
    d = f.select("vec_id", "row", at(0).alias("score"), F.floor(F.abs(at(1)) * 100).cast("int").alias("class"), at(2).alias("x"), at(3).alias("y"))
    lit = lambda v: F.lit(v).cast("float")
    return d.where(~F.isnan("score") & (F.col("score") >= lit(0.05)) & (F.col("class") < 12) & (F.col("x") > lit(-0.2)) & (F.col("y") > lit(-0.2))).select("vec_id", "row", "class")


@register("duplicate_tracks", f"""
WITH {BOXES}, p AS (SELECT a.id AS loser FROM b AS a JOIN b AS w ON a.room = w.room AND a.id <> w.id AND a.kind = w.kind AND sqrt((a.x - w.x) * (a.x - w.x) + (a.y - w.y) * (a.y - w.y)) <= 4 AND (w.w * w.d, w.id) > (a.w * a.d, a.id)) SELECT id FROM b WHERE hi < 4 AND id NOT IN (SELECT loser FROM p)
""")
def duplicate_tracks(spark, sf_dir):
    """Tracks to publish: not shadowed by a better one of the same kind near by (the larger, ties: the higher id)."""
    b = boxes(spark, sf_dir)
    p = near_pairs(b).where("a_kind = b_kind and a_id != b_id").where((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 <= 16.0)
    area = lambda n: F.col(f"{n}_w") * F.col(f"{n}_d")
    beaten = p.where((area("b") > area("a")) | ((area("b") == area("a")) & (F.col("b_id") > F.col("a_id")))).select(F.col("a_id").alias("id")).distinct()
    return b.where("hi < 4").join(beaten, "id", "left_anti").select("id")


@register("owned_cells", """
WITH c AS (SELECT l_orderkey AS mask, l_partkey AS cell, l_orderkey % 500 AS frame, l_quantity AS score FROM lineitem), m AS (SELECT frame, mask, count(DISTINCT cell) AS n, max(score) AS s FROM c GROUP BY 1, 2), d AS (SELECT DISTINCT frame, mask, cell FROM c),
o AS (SELECT d.frame, d.cell, d.mask FROM d JOIN m USING (frame, mask) QUALIFY row_number() OVER (PARTITION BY d.frame, d.cell ORDER BY s DESC, n, d.mask) = 1) SELECT mask, count(*) AS owned FROM o GROUP BY 1
""")
def owned_cells(spark, sf_dir):
    """Each cell of a frame belongs to one mask: the higher score, the smaller one of equals."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mask"), F.col("l_partkey").alias("cell"), (F.col("l_orderkey") % 500).alias("frame"), F.col("l_quantity").alias("score"))
    m = c.groupBy("frame", "mask").agg(F.countDistinct("cell").alias("n"), F.max("score").alias("s"))
    d = c.select("frame", "mask", "cell").distinct().join(m, ["frame", "mask"])
    own = d.groupBy("frame", "cell").agg(F.min_by("mask", F.struct(-F.col("s"), "n", "mask")).alias("mask"))
    return own.groupBy("mask").agg(F.count("*").alias("owned"))


@register("merged_tracks", f"""
WITH RECURSIVE {BOXES}, e AS (SELECT a.id AS a, c.id AS b FROM b AS a JOIN b AS c ON a.room = c.room AND a.id < c.id AND a.kind = c.kind AND abs(a.x - c.x) <= 2 AND abs(a.y - c.y) <= 2), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id AS n, id AS m FROM b UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a)
SELECT n AS id, min(m) AS track FROM r GROUP BY 1
""")
def merged_tracks(spark, sf_dir):
    """Tracks of one kind that lie in one another are one, through others too."""
    b = boxes(spark, sf_dir)
    e = near_pairs(b).where("a_id < b_id and a_kind = b_kind and abs(a_x - b_x) <= 2 and abs(a_y - b_y) <= 2").select("a_id", "b_id")
    return joins.components(b.select("id"), "id", e, "a_id", "b_id").select("id", F.col("component").alias("track"))


@register("room_measures", f"WITH {BOXES} SELECT room, count(*) AS pieces, max(hi) AS height, max(w) AS longest, arg_max(id, (w, -id)) AS longest_id, CAST(sum(CASE WHEN lo = 0 THEN 1 ELSE 0 END) AS BIGINT) AS placed FROM b GROUP BY 1")
def room_measures(spark, sf_dir):
    """Of each room its height, its longest piece (ties: the first) and how many stand on the floor."""
    b = boxes(spark, sf_dir)
    return b.groupBy("room").agg(F.count("*").alias("pieces"), F.max("hi").alias("height"), F.max("w").alias("longest"), F.max_by("id", F.struct(F.col("w"), -F.col("id"))).alias("longest_id"), F.count_if(F.col("lo") == 0).alias("placed"))


@register("card_eligibility", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'not_ready' WHEN o_orderdate <= TIMESTAMP '1996-06-01' THEN 'too_old' WHEN o_totalprice < 30000 THEN 'too_few' END AS refusal FROM orders
""")
def card_eligibility(spark, sf_dir):
    """Why a scene gets no card, in order; strictly after the cut-off instant."""
    late = F.col("o_orderdate") <= F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", "not_ready").when(late, "too_old").when(F.col("o_totalprice") < 30000, "too_few").alias("refusal"))


@register("sentence_splits", r"SELECT conv_id, turn, regexp_extract(text, '^(.*[.!?])\s', 1, 's') AS spoken, length(text) - length(regexp_extract(text, '^(.*[.!?])\s', 1, 's')) AS rest FROM conversations")
def sentence_splits(spark, sf_dir):
    """The longest beginning of a buffer that ends with a sentence, and how much is left."""
    spoken = F.regexp_extract("text", r"(?s)^(.*[.!?])\s", 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spoken.alias("spoken"), (F.length("text") - F.length(spoken)).cast("long").alias("rest"))

