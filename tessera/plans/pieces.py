"""Queries of pieces of points in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import pieces
from ..session import table

_NEAR = " AND ".join(f"abs(a.{c} - b.{c}) <= 1" for c in ("x", "y", "z"))


@register("connected_depth", f"""
WITH RECURSIVE p AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS i, CAST(floor(l_partkey * 7919 % 240 / 10.0::DOUBLE) AS BIGINT) AS x, CAST(floor(l_orderkey * 104729 % 60 / 10.0::DOUBLE) AS BIGINT) AS y, CAST(floor((l_orderkey * 31 + l_linenumber * 17) % 80 / 10.0::DOUBLE) AS BIGINT) AS z, l_extendedprice AS depth, l_linenumber = 7 AS sheet FROM lineitem),
c AS (SELECT k, x, y, z, {{'x': x, 'y': y, 'z': z}} AS c, count(*) AS n, count(*) FILTER (NOT sheet) AS solid FROM p GROUP BY ALL),
e AS (SELECT a.k, a.c AS a, b.c AS b FROM c AS a JOIN c AS b ON a.k = b.k AND {_NEAR} AND a.solid >= 2 AND b.solid >= 2),
r AS (SELECT k, a AS n, b AS m FROM e UNION SELECT r.k, r.n, e.b FROM r JOIN e ON r.k = e.k AND r.m = e.a),
linked AS (SELECT k, n AS c, min(m) AS root FROM r GROUP BY 1, 2),
loose AS (SELECT a.k, a.c, arg_min(l.root, (b.z - a.z) * 9 + (b.y - a.y) * 3 + (b.x - a.x)) AS root FROM c AS a JOIN c AS b ON a.k = b.k AND {_NEAR} AND a.solid < 2 AND b.solid >= 2 JOIN linked AS l ON l.k = b.k AND l.c = b.c GROUP BY 1, 2),
placed AS (SELECT c.k, c.x, c.z, c.c, c.n, coalesce(linked.root, loose.root, c.c) AS root FROM c LEFT JOIN linked ON c.k = linked.k AND c.c = linked.c LEFT JOIN loose ON c.k = loose.k AND c.c = loose.c),
q AS (SELECT p.k, p.i, placed.root, depth, row_number() OVER (PARTITION BY p.k, placed.root ORDER BY depth) AS turn, count(*) OVER (PARTITION BY p.k, placed.root) AS size FROM p JOIN placed ON p.k = placed.k AND placed.c = {{'x': p.x, 'y': p.y, 'z': p.z}}),
s AS (SELECT k, root, size, depth, max(size) OVER (PARTITION BY k) AS most FROM q WHERE turn = size // 2 + 1),
chosen AS (SELECT k, arg_min(root, {{'d': depth, 'r': root}}) AS root FROM s WHERE size >= 0.5 * most GROUP BY 1),
f AS (SELECT DISTINCT placed.k, x + dx AS x, z + dz AS z FROM placed JOIN chosen ON placed.k = chosen.k AND placed.root = chosen.root, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz)),
o AS (SELECT placed.k, placed.root, sum(n) AS n FROM placed JOIN f ON f.k = placed.k AND f.x = placed.x AND f.z = placed.z GROUP BY 1, 2),
kept AS (SELECT k, root FROM chosen UNION SELECT o.k, o.root FROM o JOIN s ON o.k = s.k AND o.root = s.root WHERE o.n * 2 >= s.size)
SELECT q.k, q.i FROM q JOIN kept ON q.k = kept.k AND q.root = kept.root
""")
def connected_depth(spark, sf_dir):
    """The object in each supplier's cloud of points."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), (o * 10 + n).alias("i"), (F.col("l_partkey") * 7919 % 240 / 10.0).alias("x"), (o * 104729 % 60 / 10.0).alias("y"), ((o * 31 + n * 17) % 80 / 10.0).alias("z"),
        F.col("l_extendedprice").alias("depth"), (n == 7).alias("sheet"),
    )
    return pieces.connected_object(p, ["k"], "i", ("x", "y", "z"), "depth", "sheet", 1.0)
