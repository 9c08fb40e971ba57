"""Queries of the event-time state machines: several micro-batches, files out of order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalogue import register
from ..session import scratch_path, table
from ..streaming import timed

#: Ranges of time that the events are cut into, and the order in which they are written.
CUTS, WRITTEN = 6, (1, 0, 3, 2, 5, 4)
#: Rows of the whole table for each bucket of keys.
BUCKET = 10_000
#: Rows of the whole table for each task and its state store, beyond a task for each core.
TASK = 250_000


def _run(spark, sf_dir, key, fields, fold, ts="CAST(ts AS TIMESTAMP)", also=()):
    """The events in files of neighbouring ranges of time that have changed places, then a file with one row long after the last,
    which moves the watermark past all others: later by the delay, which is what two ranges span, and what any fold waits for. A micro-batch
    takes a third of the files, so their number does not grow with the table; the numbers of buckets and tasks do."""
    path = scratch_path(spark, "timed-events")
    rows = table(spark, sf_dir, "events").selectExpr(f"{key} AS key", f"{ts} AS ts", "event_id AS event", *fields)
    lo, hi, n = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")), F.count("*")).first()
    width = ((hi or 0) - (lo or 0)) // CUTS + 1
    for k in WRITTEN:
        at = F.unix_micros("ts") - (lo or 0)
        rows.where((at >= k * width) & (at < (k + 1) * width)).write.mode("append").parquet(path)
    files = max(math.ceil(len(spark.read.schema(rows.schema).parquet(path).inputFiles()) / 3), 1)
    delay = 2 * width // 1_000_000 + 1
    last = rows.limit(1).withColumn("key", F.lit(None).cast(dict(rows.dtypes)["key"])).withColumn("ts", F.timestamp_micros(F.lit((hi or 0) + delay * 1_000_000 + 400 * 86_400_000_000)))
    last.coalesce(1).write.mode("append").parquet(path)
    work = lambda s: timed.in_event_time(s, ["key", *also], "ts", "event", f"{delay} seconds", fold, max(64, n // BUCKET))
    out = timed.run_in_batches(spark, path, rows.schema, work, scratch_path(spark, "timed"), files, max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK)))
    return out.where("key IS NOT NULL").select("key", *also, F.unix_micros("at").alias("at_us"), "event", "outcome", "about")


_ORDERED = "row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events"


@register("stream_leases_expire", f"""
WITH RECURSIVE e AS (SELECT user_id * 3 + event_id % 3 AS key, event_type AS holder, CASE WHEN event_id % 5 = 0 THEN 'release' ELSE 'claim' END AS action, epoch_us(ts) AS us, event_id AS event, {_ORDERED.format(key="user_id * 3 + event_id % 3")}),
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS us, NULL::BIGINT AS event, NULL::VARCHAR AS outcome, NULL::VARCHAR AS about, NULL::VARCHAR AS owner, NULL::BIGINT AS due FROM e WHERE i = 1
 UNION ALL SELECT key, i, us, event, outcome, holder, CASE WHEN outcome = 'released' THEN NULL WHEN outcome IN ('claimed', 'renewed') THEN holder ELSE own END, CASE WHEN outcome = 'released' THEN NULL WHEN outcome IN ('claimed', 'renewed') THEN us + 86400000000 ELSE was END
 FROM (SELECT *, CASE WHEN action = 'release' THEN CASE WHEN own = holder THEN 'released' ELSE 'not_held' END WHEN own IS NULL THEN 'claimed' WHEN own = holder THEN 'renewed' ELSE 'already_owned' END AS outcome
 FROM (SELECT e.*, CASE WHEN r.due > e.us THEN r.owner END AS own, CASE WHEN r.due > e.us THEN r.due END AS was FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)))
SELECT key, us AS at_us, event, outcome, about FROM r WHERE i > 0
UNION ALL SELECT r.key, r.due, NULL, 'expired', r.owner FROM r LEFT JOIN e ON e.key = r.key AND e.i = r.i + 1 WHERE r.due IS NOT NULL AND (e.us IS NULL OR e.us >= r.due)
""")
def stream_leases_expire(spark, sf_dir):
    fields = ["event_type AS holder", "CASE WHEN event_id % 5 = 0 THEN 'release' ELSE 'claim' END AS action"]
    return _run(spark, sf_dir, "user_id * 3 + event_id % 3", fields, timed.leases(86_400))


@register("stream_upload_claims", f"""
WITH RECURSIVE e AS (SELECT user_id * 5 + event_id % 5 AS key, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'owner' END AS who, CASE WHEN event_type IN ('view', 'error') THEN 'minted' ELSE 'request' END AS action, (event_id // 11 % 2)::VARCHAR AS paths, value > 20 AS force, epoch_us(ts) AS us, event_id AS event, {_ORDERED.format(key="user_id * 5 + event_id % 5")}),
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS us, NULL::BIGINT AS event, NULL::VARCHAR AS outcome, NULL::VARCHAR AS about, NULL::VARCHAR AS owner, NULL::VARCHAR AS stored, NULL::VARCHAR AS pending, NULL::BIGINT AS due FROM e WHERE i = 1
 UNION ALL SELECT key, i, us, event, outcome, CASE WHEN outcome = 'stored' THEN own ELSE who END, CASE WHEN outcome = 'claimed' THEN who ELSE own END, CASE WHEN outcome = 'stored' THEN await ELSE had END, CASE WHEN outcome IN ('claimed', 'remint') THEN paths WHEN outcome = 'stored' THEN NULL ELSE await END,
  CASE WHEN outcome IN ('claimed', 'remint') THEN us + 172800000000 WHEN outcome = 'stored' THEN NULL ELSE was END
 FROM (SELECT *, CASE WHEN action = 'minted' THEN CASE WHEN await IS NULL THEN 'stale' ELSE 'stored' END WHEN own <> who THEN 'foreign' WHEN had = paths AND NOT force THEN 'replay' WHEN own IS NULL THEN 'claimed' ELSE 'remint' END AS outcome
 FROM (SELECT e.*, r.owner AS own, r.stored AS had, CASE WHEN r.due > e.us THEN r.pending END AS await, CASE WHEN r.due > e.us THEN r.due END AS was FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)))
SELECT key, us AS at_us, event, outcome, about FROM r WHERE i > 0
UNION ALL SELECT r.key, r.due, NULL, 'lapsed', r.owner FROM r LEFT JOIN e ON e.key = r.key AND e.i = r.i + 1 WHERE r.due IS NOT NULL AND (e.us IS NULL OR e.us >= r.due)
""")
def stream_upload_claims(spark, sf_dir):
    fields = ["CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'owner' END AS user", "CASE WHEN event_type IN ('view', 'error') THEN 'minted' ELSE 'request' END AS action", "CAST(event_id div 11 % 2 AS STRING) AS paths", "value > 20 AS force"]
    return _run(spark, sf_dir, "user_id * 5 + event_id % 5", fields, timed.upload_claims(172_800))


@register("stream_pings", f"""
WITH RECURSIVE e AS (SELECT user_id AS key, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE event_type END AS kind, epoch_us(ts) AS us, event_id AS event, {_ORDERED.format(key="user_id")}),
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS us, NULL::BIGINT AS event, NULL::VARCHAR AS kind, NULL::BIGINT AS until FROM e WHERE i = 1
 UNION ALL SELECT e.key, e.i, e.us, e.event, e.kind, CASE WHEN e.kind <> 'done' THEN CASE WHEN r.until > e.us THEN r.until ELSE e.us + 36000000000 END END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1),
n AS (SELECT r.*, least(until - 1, coalesce(e.us, until)) AS stop, e.us AS following FROM r LEFT JOIN e ON e.key = r.key AND e.i = r.i + 1 WHERE r.until IS NOT NULL)
SELECT key, us AS at_us, event, CASE WHEN kind = 'done' THEN 'done' ELSE 'block' END AS outcome, kind AS about FROM r WHERE i > 0
UNION ALL SELECT key, us + 7200000000 * unnest(range(1, 1 + (stop - us) // 7200000000)), NULL, 'ping', NULL FROM n
UNION ALL SELECT key, until, NULL, 'closed', NULL FROM n WHERE following IS NULL OR following >= until
""")
def stream_pings(spark, sf_dir):
    return _run(spark, sf_dir, "user_id", ["CASE WHEN event_id % 4 = 0 THEN 'done' ELSE event_type END AS kind"], timed.pings(7200, 36_000))


_EDGES = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in timed.STATE_EDGES.items() for b in bs) + ") t(a, b))"


@register("stream_status_documents", f"""
WITH RECURSIVE e AS (SELECT user_id * 7 + event_id % 7 AS key, (['processing', 'ready', 'failed', 'queued', 'failed_invalid'])[event_id % 5 + 1] AS target, CASE WHEN value > 10 THEN event_type END AS patch, epoch_us(ts) AS us, event_id AS event, {_ORDERED.format(key="user_id * 7 + event_id % 7")}),
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS us, NULL::BIGINT AS event, NULL::VARCHAR AS outcome, NULL::VARCHAR AS status, NULL::VARCHAR AS patch, NULL::BIGINT AS due FROM e WHERE i = 1
 UNION ALL SELECT key, i, us, event, CASE WHEN ok THEN 'updated' ELSE 'refused' END, CASE WHEN ok THEN target ELSE now END, CASE WHEN ok THEN coalesce(patch, had) ELSE had END, CASE WHEN NOT ok THEN was WHEN target LIKE 'failed%' THEN us + 172800000000 WHEN target <> 'queued' THEN was END
 FROM (SELECT *, EXISTS (SELECT 1 FROM {_EDGES} WHERE a = coalesce(now, 'queued') AND b = target) AS ok
 FROM (SELECT e.*, CASE WHEN r.due <= e.us THEN NULL ELSE r.status END AS now, CASE WHEN r.due <= e.us THEN NULL ELSE r.patch END AS had, CASE WHEN r.due > e.us THEN r.due END AS was FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)))
SELECT key, us AS at_us, event, outcome, patch AS about FROM r WHERE i > 0
UNION ALL SELECT r.key, r.due, NULL, 'removed', r.patch FROM r LEFT JOIN e ON e.key = r.key AND e.i = r.i + 1 WHERE r.due IS NOT NULL AND (e.us IS NULL OR e.us >= r.due)
""")
def stream_status_documents(spark, sf_dir):
    to = "element_at(array('processing','ready','failed','queued','failed_invalid'), cast(event_id % 5 + 1 as int)) AS target"
    return _run(spark, sf_dir, "user_id * 7 + event_id % 7", [to, "CASE WHEN value > 10 THEN event_type END AS patch"], timed.documents(172_800))


#: Sightings: a capture's events of a day are a frame; boxes stand about 23 places, their labels are now and then another's.
SIGHTINGS = [
    *[f"CAST(event_id * 7919 % 23 {place} AS DOUBLE) * 2.5 + event_id * 31 % {jitter} / 20.0 AS {c}0" for c, place, jitter in (("x", "% 5", 17), ("y", "div 5", 13))],
    "0D AS z0",
    *[f"CAST(event_id * 7919 % 23 {place} AS DOUBLE) * 2.5 + event_id * 31 % {jitter} / 20.0 + 1.5 + event_id % 7 / 5.0 AS {c}1" for c, place, jitter in (("x", "% 5", 17), ("y", "div 5", 13))],
    "1D + event_id % 3 AS z1", "concat('kind-', IF(event_id % 19 = 0, event_id % 3, event_id * 7919 % 23 % 3)) AS label", "event_id * 37 % 100 / 100D AS score", "event_id % 17 = 0 AS cut",
    "CAST(dayofyear(ts) % 3 * 3 AS DOUBLE) AS vx0", "CAST(dayofyear(ts) % 3 * 3 + 8 AS DOUBLE) AS vx1",
]


@register("stream_tracks")
def stream_tracks(spark, sf_dir):
    """Sightings of each capture (five users) matched to tracks, a day's frame at a time; each frame's matches depend on all before."""
    return _run(spark, sf_dir, "user_id div 5", SIGHTINGS, timed.tracks(10 * 86_400), "date_trunc('DAY', CAST(ts AS TIMESTAMP))")


@register("stream_announcements", f"""
WITH e AS (SELECT user_id AS key, event_id % 4 AS piece, event_type AS kind, epoch_us(ts) AS us, event_id AS event, lag(epoch_us(ts)) OVER w AS before, lead(epoch_us(ts)) OVER w AS following, (['sofa', 'bed', 'chair', 'lamp'])[event_id % 4 + 1] AS what, (['low', 'medium', 'high'])[event_id // 4 % 3 + 1] AS sure
 FROM events WINDOW w AS (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id)), n AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v[0].upper()}{v[1:]}')" for k, v in timed.NOUNS.items())}) t(what, noun)),
f AS (SELECT e.*, before IS NULL OR before + 259200000000 <= us AS fresh, coalesce(CASE WHEN sure <> 'low' THEN noun END, 'Something new') AS line FROM e LEFT JOIN n USING (what))
SELECT key, piece, us AS at_us, event, CASE WHEN fresh THEN 'announced' ELSE 'seen' END AS outcome, CASE WHEN fresh THEN line END AS about FROM f
UNION ALL SELECT key, piece, us + 259200000000, NULL, 'forgotten', NULL FROM f WHERE following IS NULL OR following >= us + 259200000000
""")
def stream_announcements(spark, sf_dir):
    """What a guest is told when a piece is first seen in a capture, and not again while it keeps being seen."""
    fields = ["event_id % 4 AS piece", "element_at(array('sofa','bed','chair','lamp'), cast(event_id % 4 + 1 as int)) AS kind", "element_at(array('low','medium','high'), cast(event_id div 4 % 3 + 1 as int)) AS confidence"]
    return _run(spark, sf_dir, "user_id", fields, timed.announcements(259_200), also=["piece"])
