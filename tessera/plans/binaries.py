"""Queries of binary sources: what is written from the tables is read back and stands beside SQL on the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..catalogue import register
from ..session import scratch_path, table
from ..sources import binary

WIDE = 20


@register("point_file_columns", """
SELECT vec_id::INT AS id, embedding[3] AS e2, embedding[18] AS e17 FROM embeddings WHERE embedding[3] > 0 AND vec_id >= 10
""")
def point_file_columns(spark, sf_dir):
    """Two of twenty properties of point files, and the rows that a comparison keeps, read in ranges of records."""
    path = scratch_path(spark, "points")
    entries = [F.get("embedding", F.lit(k)).alias(f"e{k}") for k in range(WIDE)]
    binary.write_points(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), *entries), path)
    return binary.read_points(spark, path, "id int, e2 float, e17 float", split_bytes=1 << 14).where("e2 > 0 AND id >= 10")


#: A user's day: whose it is, its events, and the labels of the day.
DAY = {1: ("user", "int"), 2: ("day", "string"), 3: ("events", [{1: ("event", "int"), 2: ("kind", "string"), 3: ("value", "double"), 4: ("change", "sint"), 6: ("late", "bool")}]), 15: ("codes", ["int"])}


@register("wire_messages", """
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id AS user, strftime(ts, '%Y-%m-%d') AS day, event_id AS event, event_type AS kind, value, 50 - event_id % 100 AS change, event_id % 2 = 0 AS late, n AS codes FROM events JOIN d USING (user_id) WHERE d.day = strftime(ts, '%Y-%m-%d') AND user_id % 10 <> 3
UNION ALL SELECT NULL, NULL, NULL, 'the message is cut off', NULL, NULL, NULL, count(*) FROM d WHERE user_id % 10 = 3
""")
def wire_messages(spark, sf_dir):
    """Days as wire-format messages with nested events; those of every tenth user are cut off, and counted."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), "value", (50 - F.col("event_id") % 100).alias("change"), (F.col("event_id") % 2 == 0).alias("late")).alias("e"))
    days = e.groupBy("user_id", "day").agg(F.collect_list("e").alias("events"))  # a user's events of one day

    @F.pandas_udf("binary")
    def encode(user: pd.Series, day: pd.Series, events: pd.Series) -> pd.Series:
        rows = [{"user": u, "day": d, "events": list(es), "codes": list(range(len(es)))} for u, d, es in zip(user.tolist(), day, events, strict=True)]
        return pd.Series([binary.encode_message(r, DAY)[: -1 if r["user"] % 10 == 3 else None] for r in rows], dtype=object)

    path = scratch_path(spark, "messages")
    days.select(encode("user_id", "day", "events").alias("raw")).write.parquet(path)
    got = binary.decode_messages(spark.read.schema("raw binary").parquet(path), "raw", DAY)
    good = got.where("problem IS NULL").select("message.user", "message.day", F.explode("message.events").alias("e"), F.size("message.codes").cast("long").alias("codes"))
    bad = got.where("problem IS NOT NULL").groupBy(F.col("problem").alias("kind")).agg(F.count("*").alias("codes"))
    return good.select("user", "day", "e.event", "e.kind", "e.value", "e.change", "e.late", "codes").unionByName(bad, allowMissingColumns=True)


@register("mask_run_unions", """
WITH c AS (SELECT label, vec_id, (i - 1) // 8 + vec_id % 3 AS r, (i - 1) % 8 + vec_id * 7 % 40 AS k FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE x > 0),
u AS (SELECT DISTINCT label, r, k FROM c),
b AS (SELECT DISTINCT label, r, k FROM c WHERE vec_id % 2 = 0 INTERSECT SELECT DISTINCT label, r, k FROM c WHERE vec_id % 2 = 1)
SELECT label, 'union' AS part, count(*) AS cells, min(r) AS top, max(r) + 1 AS bottom, min(k) AS lo, max(k) + 1 AS hi, round(avg(r), 6) AS row_mean, round(avg(k), 6) AS column_mean FROM u GROUP BY 1
UNION ALL SELECT label, 'common', count(*), min(r), max(r) + 1, min(k), max(k) + 1, round(avg(r), 6), round(avg(k), 6) FROM b GROUP BY 1
""")
def mask_run_unions(spark, sf_dir):
    """Masks packed to bits, read as runs: the union of a label's masks, and what its even and odd ones have in common."""
    path = scratch_path(spark, "masks")
    v = table(spark, sf_dir, "embeddings")
    v.select("vec_id", "label", binary.packed_bits(F.transform("embedding", lambda x: x > 0)).alias("bits"), F.expr("size(embedding) div 8").alias("h")).write.parquet(path)
    m = spark.read.schema("vec_id long, label int, bits binary, h long").parquet(path)
    m = m.withColumn("runs", binary.bit_runs("bits", "h", F.lit(8)))
    down, right = (F.col("vec_id") % 3).cast("int"), (F.col("vec_id") * 7 % 40).cast("int")
    m = m.withColumn("runs", F.transform("runs", lambda r: F.struct((r["row"] + down).alias("row"), (r["lo"] + right).alias("lo"), (r["hi"] + right).alias("hi"))))
    halves = [binary.union_runs(m.where(f"vec_id % 2 = {k}"), ["label"], "runs") for k in (0, 1)]
    parts = {"union": binary.union_runs(m, ["label"], "runs"), "common": binary.common_runs(*halves, ["label"])}
    named = [binary.measured_runs(p, ["label"]).withColumn("part", F.lit(n)) for n, p in parts.items()]
    return named[0].unionByName(named[1]).withColumns({c: F.round(c, 6) for c in ("row_mean", "column_mean")})
