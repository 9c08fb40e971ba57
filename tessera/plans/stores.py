"""Queries of sources, sinks, streams and the extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import register
from ..functions.extension import Problems, Tools, ask_until_valid, classify_once, minted
from ..sources import documents as src
from ..streaming import stateful as live
from ..session import scratch_path, table


@register("strict_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def strict_json(spark, sf_dir):
    return src.strict_json(table(spark, sf_dir, "events"), "props", "k long").select("event_id", "doc.k")


@register("permissive_json", """
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'malformed' END AS reason FROM events
""")
def permissive_json(spark, sf_dir):
    broken = F.when(F.col("event_id") % 13 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return src.permissive_json(table(spark, sf_dir, "events").withColumn("props", broken), "props", "k long").select("event_id", "doc.k", "reason")


@register("key_value_source", "SELECT event_id, CAST(value AS VARCHAR) AS score, event_type AS kind FROM events")
def key_value_source(spark, sf_dir):
    text = F.concat(F.lit("# comment\nkind: other\nkind: "), F.col("event_type"), F.lit("\nscore:  "), F.col("value").cast("string"), F.lit("\n\nnot a pair"))
    return table(spark, sf_dir, "events").select("event_id", src.key_values(text).alias("m")).select("event_id", F.col("m")["score"].alias("score"), F.col("m")["kind"].alias("kind"))


@register("canonical_documents", """SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' AS doc, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS digest FROM part""")
def canonical_documents(spark, sf_dir):
    doc = src.canonical("p_size", "p_partkey", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"), F.sha2(doc, 256).alias("digest"))


@register("nested_documents", """
SELECT r_name, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']' AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1
""")
def nested_documents(spark, sf_dir):
    j = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("nations"))


@register("incremental_materialise", """
WITH now AS (SELECT doc_id, n_chars, doc_id % 5 AS generation FROM documents), old AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id % 5 END AS generation FROM documents WHERE lang <> 'de')
SELECT doc_id, n_chars, generation FROM now ANTI JOIN old USING (doc_id, n_chars, generation)
""")
def incremental_materialise(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 5).alias("generation"))
    old = d.where("lang != 'de'").withColumn("generation", F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("generation")))
    return src.pending(d, old, ["doc_id", "n_chars", "generation"])


@register("ndjson_ledger", "SELECT o_orderpriority AS mode, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def ndjson_ledger(spark, sf_dir):
    """Appends the ledger as lines of JSON, twice in halves, and reports from what was written."""
    path = scratch_path(spark, "ledger")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("usd"), "o_orderkey")
    src.append_ledger(o.where("o_orderkey % 2 = 0"), path)
    src.append_ledger(o.where("o_orderkey % 2 = 1"), path)
    return spark.read.schema("mode string, usd double, o_orderkey long").json(path).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 2).alias("total"))


@register("profile_scan", "SELECT count(*) AS n, min(l_quantity) AS q0, max(l_quantity) AS q1, round(avg(l_extendedprice), 4) AS mean_price, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def profile_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.countDistinct("l_returnflag").alias("flags"))


@register("order_manifest", "SELECT page_id, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id % 7 = 0, url, page_id) AS place FROM pages")
def order_manifest(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col("page_id") / 100)).orderBy(F.col("page_id") % 7 == 0, "url", "page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.row_number().over(w).cast("long").alias("place"))


def _event_files(spark, sf_dir, columns):
    """The events as a file source of several files, in time order, for the streams."""
    path = scratch_path(spark, "events")
    table(spark, sf_dir, "events").selectExpr(*columns).repartitionByRange(4, "ts").write.parquet(path)
    return path, spark.read.parquet(path).schema


@register("stream_dedupe_ingest", "SELECT DISTINCT user_id, event_type, event_id % 100 AS task FROM events")
def stream_dedupe_ingest(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir, ["user_id", "event_type", "event_id % 100 AS task", "CAST(ts AS TIMESTAMP) AS ts"])
    out = live.run_once(spark, path, schema, lambda s: live.once_each(s, ["user_id", "event_type", "task"], "ts", "60 days"), scratch_path(spark, "stream"))
    return out.select("user_id", "event_type", "task")


@register("stream_lease_claims", """
WITH RECURSIVE e AS (SELECT user_id % 10 AS resource, event_type AS holder, ts, event_id AS event, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT resource, holder, event, i, 'claimed' AS outcome, holder AS owner, ts AS since FROM e WHERE i = 1
 UNION ALL SELECT e.resource, e.holder, e.event, e.i, CASE WHEN e.ts - since < INTERVAL 900 SECOND AND owner <> e.holder THEN 'already_owned' WHEN owner = e.holder THEN 'renewed' ELSE 'reclaimed' END,
  CASE WHEN e.ts - since < INTERVAL 900 SECOND AND owner <> e.holder THEN owner ELSE e.holder END, CASE WHEN e.ts - since < INTERVAL 900 SECOND AND owner <> e.holder THEN since ELSE e.ts END FROM r JOIN e ON e.resource = r.resource AND e.i = r.i + 1)
SELECT resource, holder, event, outcome FROM r
""")
def stream_lease_claims(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir, ["user_id % 10 AS resource", "event_type AS holder", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS event"])
    return live.run_once(spark, path, schema, lambda s: live.lease_claims(s, "resource", "holder", "ts", "event", 900.0), scratch_path(spark, "stream")).select("resource", "holder", "event", "outcome")


@register("stream_turn_acceptance", """
WITH RECURSIVE e AS (SELECT user_id, event_id % 40 AS message, ts, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 40) AS i FROM events),
r AS (SELECT user_id, message, ts, i, 'accepted' AS outcome, day, 1 AS n, ts AS lease, [{'m': message, 't': ts}] AS seen FROM e WHERE i = 1
 UNION ALL SELECT user_id, message, ts, i, outcome, CASE WHEN outcome = 'accepted' THEN day ELSE was END, CASE WHEN outcome = 'accepted' THEN used + 1 ELSE n END, CASE WHEN outcome = 'accepted' THEN ts ELSE lease END, CASE WHEN outcome = 'accepted' THEN list_append(seen, {'m': message, 't': ts}) ELSE seen END
 FROM (SELECT *, CASE WHEN len(list_filter(seen, lambda x: x.m = message AND ts - x.t < INTERVAL 7 DAY)) > 0 THEN 'replay' WHEN used >= 3 THEN 'rested' WHEN ts - lease < INTERVAL 600 SECOND THEN 'busy' ELSE 'accepted' END AS outcome
 FROM (SELECT e.user_id, e.message, e.ts, e.i, e.day, r.day AS was, r.n, r.lease, r.seen, CASE WHEN r.day = e.day THEN r.n ELSE 0 END AS used FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id AS user, message, epoch_us(ts) AS at_us, outcome FROM r
""")
def stream_turn_acceptance(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir, ["user_id AS user", "event_id % 40 AS message", "CAST(ts AS TIMESTAMP) AS ts"])
    out = live.run_once(spark, path, schema, lambda s: live.turn_acceptance(s, "user", "message", "ts", 3, 600.0), scratch_path(spark, "stream"))
    return out.select("user", "message", F.unix_micros("ts").alias("at_us"), "outcome")


_EDGES = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in live.STATE_EDGES.items() for b in bs) + ") t(a, b))"


@register("stream_fsm_fold", f"""
WITH RECURSIVE e AS (SELECT user_id AS entity, event_id AS event, (['processing', 'ready', 'failed', 'queued', 'failed_invalid'])[event_id % 5 + 1] AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT entity, event, i, 'queued' AS before, target, target IN (SELECT b FROM {_EDGES} WHERE a = 'queued') AS allowed FROM e WHERE i = 1
 UNION ALL SELECT entity, event, i, now, target, EXISTS (SELECT 1 FROM {_EDGES} WHERE a = now AND b = target) FROM (SELECT e.*, CASE WHEN r.allowed THEN r.target ELSE r.before END AS now FROM r JOIN e ON e.entity = r.entity AND e.i = r.i + 1))
SELECT entity, event, before, target, allowed FROM r
""")
def stream_fsm_fold(spark, sf_dir):
    to = "element_at(array('processing','ready','failed','queued','failed_invalid'), cast(event_id % 5 + 1 as int)) AS target"
    path, schema = _event_files(spark, sf_dir, ["user_id AS entity", "event_id AS event", "CAST(ts AS TIMESTAMP) AS ts", to])
    return live.run_once(spark, path, schema, lambda s: live.fold_states(s, "entity", "target", "ts", "event"), scratch_path(spark, "stream")).select("entity", "event", "before", "target", "allowed")


@register("stream_fenced_writes", """
WITH RECURSIVE e AS (SELECT user_id * 31 + event_id // 200 AS entity, event_type AS holder, event_id AS event, ts, CASE WHEN event_id % 9 = 0 THEN 'ready' WHEN event_id % 2 = 0 THEN 'processing' ELSE 'working' END AS target, row_number() OVER (PARTITION BY user_id * 31 + event_id // 200 ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT entity, 0::BIGINT AS i, NULL::BIGINT AS event, NULL::VARCHAR AS outcome, NULL::VARCHAR AS owner, TIMESTAMP '2000-01-01' AS since, 'queued' AS status FROM e WHERE i = 1
 UNION ALL SELECT entity, i, event, outcome, CASE outcome WHEN 'claimed' THEN holder WHEN 'reclaimed' THEN holder WHEN 'written' THEN CASE WHEN target = 'ready' THEN NULL ELSE owner END ELSE owner END, CASE WHEN outcome IN ('claimed', 'reclaimed', 'written') THEN ts ELSE since END,
  CASE WHEN outcome IN ('claimed', 'reclaimed') THEN 'processing' WHEN outcome = 'written' THEN target ELSE status END FROM (SELECT *, CASE WHEN status = 'ready' THEN 'terminal' WHEN target = 'processing' AND NOT held THEN CASE WHEN owner IS NULL THEN 'claimed' ELSE 'reclaimed' END WHEN held AND owner = holder THEN 'written' ELSE 'fenced' END AS outcome
  FROM (SELECT e.*, s.owner, s.since, s.status, s.owner IS NOT NULL AND e.ts - s.since < INTERVAL 100000 SECOND AS held FROM s JOIN e ON e.entity = s.entity AND e.i = s.i + 1)))
SELECT entity, event, outcome FROM s WHERE i > 0
""")
def stream_fenced_writes(spark, sf_dir):
    to = "CASE WHEN event_id % 9 = 0 THEN 'ready' WHEN event_id % 2 = 0 THEN 'processing' ELSE 'working' END AS target"
    path, schema = _event_files(spark, sf_dir, ["user_id * 31 + event_id div 200 AS entity", "event_type AS holder", "event_id AS event", "CAST(ts AS TIMESTAMP) AS ts", to])
    buckets = max(64, spark.read.parquet(path).count() // 10_000)
    return live.run_once(spark, path, schema, lambda s: live.fenced_writes(s, "entity", "holder", "target", "ts", "event", 100_000.0, buckets=buckets), scratch_path(spark, "stream"))


@register("stream_spend_admission", """
WITH RECURSIVE e AS (SELECT user_id AS user, event_id AS event, value AS cost, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user, event, i, day, 'opening' AS outcome, cost AS spent FROM e WHERE i = 1
 UNION ALL SELECT e.user, e.event, e.i, e.day, CASE WHEN e.day <> r.day THEN 'opening' WHEN r.spent + e.cost <= 120 THEN 'admitted' ELSE 'over_budget' END, CASE WHEN e.day <> r.day THEN e.cost WHEN r.spent + e.cost <= 120 THEN r.spent + e.cost ELSE r.spent END FROM r JOIN e ON e.user = r.user AND e.i = r.i + 1)
SELECT user, event, outcome, round(spent, 6) AS spent FROM r
""")
def stream_spend_admission(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir, ["user_id AS user", "event_id AS event", "value AS cost", "CAST(ts AS TIMESTAMP) AS ts"])
    return live.run_once(spark, path, schema, lambda s: live.spend_admission(s, "user", "cost", "ts", "event", 120.0), scratch_path(spark, "stream")).withColumn("spent", F.round("spent", 6))


@register("stub_classifier_udf", "SELECT event_id, upper(event_type) AS answer FROM events")
def stub_classifier_udf(spark, sf_dir):
    return classify_once(table(spark, sf_dir, "events"), "event_type", lambda prompts: [p.upper() for p in prompts]).select("event_id", "answer")


@register("validate_udtf", """
WITH p AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN ['empty'] ELSE list_filter([CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN regexp_matches(text, '[#*$%]') THEN 'symbols' END, CASE WHEN contains(text, chr(9)) THEN 'tab' END], lambda x: x IS NOT NULL) END AS c FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, c[i] AS code FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM p)
""")
def validate_udtf(spark, sf_dir):
    spark.udtf.register("problems", Problems)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql("SELECT doc_id, p.position, p.code FROM tessera_documents, LATERAL problems(text) p")


@register("validated_answers", """
SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN NULL ELSE upper(event_type) || '!' END AS answer, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 3 ELSE 2 END AS asked, CASE event_type WHEN 'error' THEN 'refused' WHEN 'purchase' THEN 'invalid' ELSE 'ok' END AS outcome FROM events
""")
def validated_answers(spark, sf_dir):
    """A stub model that answers well when told what was wrong, but for one prompt; another prompt is never sent."""

    def model(prompts):
        return [p.split("\n")[0].upper() + ("!" if "\n" in p and not p.startswith("purchase") else "") for p in prompts]

    out = ask_until_valid(table(spark, sf_dir, "events"), "event_type", model, lambda a: None if a.endswith("!") else "say it with a mark", lambda p: p == "error")
    return out.select("event_id", "answer", "asked", "outcome")


@register("tool_dispatch", """
SELECT event_id, CASE event_type WHEN 'view' THEN reverse('user' || user_id) WHEN 'click' THEN CAST(user_id * 2 AS VARCHAR) END AS result, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'signup' THEN 'missing_argument' ELSE 'unknown_tool' END AS outcome FROM events
""")
def tool_dispatch(spark, sf_dir):
    tools = Tools(spark)
    tools.add("view", "a name backwards", ["name"], lambda name: name[::-1])
    tools.add("click", "twice a number", ["number"], lambda n: str(2 * int(n)))
    tools.add("signup", "needs what no row has", ["token"], lambda t: t)
    e = table(spark, sf_dir, "events").withColumn("a", F.create_map(F.lit("name"), F.concat(F.lit("user"), "user_id"), F.lit("number"), F.col("user_id").cast("string")))
    return tools.call(e, "event_type", "a").select("event_id", "result", "outcome")


@register("minted_addresses", "SELECT page_id, url, 'https://signed/0' || length(url) AS minted FROM pages")
def minted_addresses(spark, sf_dir):
    return minted(table(spark, sf_dir, "pages"), "page_id", "url", lambda urls: [f"https://signed/0{len(u)}" for u in urls])


@register("document_store", "SELECT 'region-' || r_regionkey AS name, r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def document_store(spark, sf_dir):
    """Documents written by name, listed by prefix."""
    store = src.DocumentStore(spark, scratch_path(spark, "documents"))
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "r_name", F.coalesce("nations", F.lit(0)).alias("nations"))
    for k in range(5):
        store.write(r.where(F.col("r_regionkey") == k).select("r_name", "nations"), f"region-{k}")
    store.write(r.limit(0).select("r_name", "nations"), "other-9")
    return store.list("region-", "r_name string, nations long")


@register("packed_masks", "SELECT vec_id, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def packed_masks(spark, sf_dir):
    """Masks written packed, read back and counted."""
    path = scratch_path(spark, "masks")
    mask = F.transform("embedding", lambda x: x > 0)
    table(spark, sf_dir, "embeddings").select("vec_id", src.pack_mask(mask).alias("mask")).write.parquet(path)
    back = spark.read.schema("vec_id long, mask string").parquet(path)
    return back.select("vec_id", F.size(F.filter(src.unpack_mask(F.col("mask")), lambda c: c)).cast("long").alias("cells"))


@register("stream_persist_once", "SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def stream_persist_once(spark, sf_dir):
    """A stream drained into a table by batches that a repetition replaces: each batch is written twice here."""
    path, schema = _event_files(spark, sf_dir, ["event_id", "user_id", "event_type", "ts"])
    out = scratch_path(spark, "persisted")

    def write(batch, number):
        for _ in range(2):
            src.persist_once(batch.where("event_type != 'error'").select("event_id", "user_id"), number, out)

    q = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "sink")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id long, user_id long, batch int").parquet(out).select("event_id", "user_id")
