"""Queries of fits, direction families and clear rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import fits
from ..session import table

DRAWS = 16


def _robust_sql() -> str:
    error = "abs((scale * m + shift) * z - 1)"
    draw = lambda s: f"arg_min({{'m': m, 'z': z}}, {{'h': (i * {7919 + 2 * s} + {s * 104_729}) % 1000003, 'i': i, 'm': m, 'z': z}})"
    pairs = " UNION ALL ".join(f"SELECT k, {s // 2} AS draw, d{s}.m AS m0, d{s}.z AS z0, d{s + 1}.m AS m1, d{s + 1}.z AS z1 FROM drawn" for s in range(0, 2 * DRAWS, 2))
    out = f"""
WITH pts AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS i, 1 + l_quantity / 10 AS z, CASE WHEN l_linenumber = 3 THEN l_partkey % 100 / 100.0::DOUBLE ELSE (1 / (1 + l_quantity / 10) - 0.05) / 0.8 + (l_partkey * 7919 % 1000 - 500) * 0.00002 END AS m FROM lineitem),
drawn AS (SELECT k, count(*) AS n, {", ".join(f"{draw(s)} AS d{s}" for s in range(2 * DRAWS))} FROM pts GROUP BY k),
pairs AS ({pairs}),
scaled AS (SELECT *, (1 / z0 - 1 / z1) / (m0 - m1) AS scale FROM pairs WHERE m0 <> m1),
tried AS (SELECT k, draw, scale, 1 / z0 - scale * m0 AS shift FROM scaled WHERE scale > 0),
costs AS (SELECT k, draw, scale, shift, round(sum(least({error} * {error}, 0.0025)), 9) AS cost FROM pts JOIN tried USING (k) GROUP BY ALL),
model0 AS (SELECT k, scale, shift FROM costs QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, draw) = 1)"""
    for r in range(3):
        out += f""",
sums{r} AS (SELECT k, sum(m * z * m * z) AS aa, sum(m * z * z) AS ab, sum(z * z) AS bb, sum(m * z) AS a1, sum(z) AS b1 FROM pts JOIN model{r} USING (k) WHERE {error} <= 0.05 GROUP BY k),
new{r} AS (SELECT k, (a1 * bb - b1 * ab) / (aa * bb - ab * ab) AS s, (aa * b1 - ab * a1) / (aa * bb - ab * ab) AS t FROM sums{r} WHERE aa * bb - ab * ab > 1e-9 * aa * bb AND (a1 * bb - b1 * ab) / (aa * bb - ab * ab) > 0),
model{r + 1} AS (SELECT k, coalesce(s, scale) AS scale, coalesce(t, shift) AS shift FROM model{r} LEFT JOIN new{r} USING (k))"""
    return out + f"""
SELECT k, n, round(scale, 6) AS scale, round(shift, 6) AS shift, count(*) FILTER ({error} <= 0.05) AS inliers FROM drawn JOIN pts USING (k) LEFT JOIN model3 USING (k) GROUP BY ALL"""


@register("robust_depth_fit", _robust_sql())
def robust_depth_fit(spark, sf_dir):
    """Scale and shift of each supplier's values against depths, one line in seven being astray."""
    z = 1 + F.col("l_quantity") / 10
    m = F.when(F.col("l_linenumber") == 3, F.col("l_partkey") % 100 / 100.0).otherwise((1 / z - 0.05) / 0.8 + (F.col("l_partkey") * 7919 % 1000 - 500) * 0.00002)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), m.alias("m"), z.alias("z"))
    mix = lambda i, s: (i * (7919 + 2 * s) + s * 104_729) % 1_000_003
    out = fits.robust_fit(rows, ["k"], "i", "m", "z", 0.05, DRAWS, mix=mix)
    return out.select("k", "n", F.round("scale", 6).alias("scale"), F.round("shift", 6).alias("shift"), "inliers")


@register("direction_families", """
WITH RECURSIVE w AS (SELECT vec_id, vec_id // 50 AS room, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y, degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)) AS d FROM embeddings),
h AS (SELECT *, CASE WHEN d < 0 THEN d + 180 ELSE d END AS heading, row_number() OVER (PARTITION BY room ORDER BY vec_id) AS i FROM w),
r AS (SELECT room, i, vec_id, [{'p': vec_id, 'h': heading}] AS leaders, 1 AS f FROM h WHERE i = 1
 UNION ALL SELECT room, i, vec_id, CASE WHEN found IS NULL THEN list_append(leaders, {'p': vec_id, 'h': heading}) ELSE leaders END, coalesce(found, len(leaders) + 1) FROM (SELECT h.*, r.leaders, list_position(list_transform(r.leaders, lambda l: least(abs(h.heading - l.h) % 180, 180 - abs(h.heading - l.h) % 180) <= 15), TRUE) AS found FROM r JOIN h ON h.room = r.room AND h.i = r.i + 1)),
m AS (SELECT r.room, r.vec_id, leaders[f].p AS leader, f - 1 AS family, a.x * m.x + a.y * m.y AS off FROM r JOIN h m ON m.vec_id = r.vec_id JOIN h a ON a.vec_id = leaders[f].p)
SELECT room, family, leader, count(*) AS members, arg_min(vec_id, {'o': off, 'v': vec_id}) AS lowest, arg_max(vec_id, {'o': off, 'v': -vec_id}) AS highest FROM m GROUP BY 1, 2, 3
""")
def direction_families(spark, sf_dir):
    """Walls of a room by direction, and each family's outermost members along its first one."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    d = F.degrees(F.atan2(e(1), e(0)))
    walls = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("room"), e(2).alias("x"), e(3).alias("y"), F.when(d < 0, d + 180).otherwise(d).alias("heading"))
    member = fits.direction_families(walls, ["room"], "vec_id", "heading", 15.0)
    axis = walls.select(F.col("vec_id").alias("leader"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    m = member.join(axis, "leader").withColumn("off", F.col("ax") * F.col("x") + F.col("ay") * F.col("y"))
    low, high = F.min(F.struct("off", "vec_id")), F.max(F.struct("off", (-F.col("vec_id")).alias("v")))
    g = m.groupBy("room", "family", "leader").agg(F.count("*").alias("members"), low.alias("low"), high.alias("high"))
    return g.select("room", F.col("family").cast("long").alias("family"), "leader", "members", F.col("low.vec_id").alias("lowest"), (-F.col("high.v")).alias("highest"))


@register("largest_clear_rectangle", """
WITH c AS (SELECT p_partkey // 100 AS room, p_partkey % 100 // 10 AS r, p_partkey % 10 AS k, p_size % 4 > 0 AS free FROM part),
h AS (SELECT room, r, k, count(*) OVER (PARTITION BY room, k, s ORDER BY r) AS h FROM (SELECT *, r - row_number() OVER (PARTITION BY room, k ORDER BY r) AS s FROM c WHERE free)),
p AS (SELECT a.room, a.r, a.k, b.k AS z, min(m.h) AS h, count(*) AS n FROM h a JOIN h b ON a.room = b.room AND a.r = b.r AND a.k <= b.k JOIN h m ON m.room = a.room AND m.r = a.r AND m.k BETWEEN a.k AND b.k GROUP BY 1, 2, 3, 4)
SELECT g.room, coalesce(max((z - k + 1) * h) FILTER (n = z - k + 1), 0) AS cells FROM (SELECT DISTINCT room FROM c) g LEFT JOIN p ON p.room = g.room GROUP BY 1
""")
def largest_clear_rectangle(spark, sf_dir):
    """The largest clear rectangle of each room's floor of ten by ten cells."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.floor(k / 100).alias("room"), F.floor(k % 100 / 10).alias("r"), (k % 10).alias("c"), (F.col("p_size") % 4 > 0).alias("free"))
    return fits.largest_clear_rectangles(cells, ["room"], "r", "c", "free")
