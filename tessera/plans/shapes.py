"""Queries of shapes: turned boxes, zones, relations between pieces, rays, rotations, screens."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..functions import shapes
from ..operators import joins
from ..session import table
from .relations import POLYGON

#: Parts as turned boxes, a hundred to a room: centre, sides, yaw and height.
BOXES = """b AS (SELECT p_partkey AS id, p_partkey // 100 AS room, p_partkey * 7919 % 300 / 10.0::DOUBLE AS x, p_partkey * 104729 % 300 / 10.0::DOUBLE AS y, 1.0::DOUBLE + p_size % 5 AS w, 1.0::DOUBLE + p_size % 3 AS d,
 radians(p_partkey * 37 % 180) AS t, (p_partkey % 3)::DOUBLE AS lo, (p_partkey % 3 + 1.5)::DOUBLE AS hi, p_type AS kind FROM part)"""


def boxes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.floor(k / 100).alias("room"), (k * 7919 % 300 / 10.0).alias("x"), (k * 104729 % 300 / 10.0).alias("y"), (1.0 + F.col("p_size") % 5).alias("w"), (1.0 + F.col("p_size") % 3).alias("d"),
        F.radians(k * 37 % 180).alias("t"), (k % 3).cast("double").alias("lo"), (k % 3 + 1.5).cast("double").alias("hi"), F.col("p_type").alias("kind"),
    )


#: No two boxes whose centres are further apart can touch: a diagonal, rounded up.
REACH = 6.0


def near_pairs(b):
    """Pairs of boxes of one room near enough to touch, with the columns of both as a_.. and b_.."""
    left, right = b.toDF(*[c if c == "room" else f"a_{c}" for c in b.columns]), b.toDF(*[c if c == "room" else f"b_{c}" for c in b.columns])
    return joins.within(left, right, "a_x", "a_y", "b_x", "b_y", REACH, ["room"]).drop("distance")


def penetration(p: str = "a", q: str = "b"):
    of = lambda n: [F.col(f"{n}_{c}") for c in ("x", "y", "w", "d", "t")]
    return shapes.turned_penetration(of(p), of(q))


SAT = "greatest(0, " + "least(" + ", ".join(
    f"(a.w * abs(cos(a.t - ({t}))) + a.d * abs(sin(a.t - ({t}))) + b.w * abs(cos(b.t - ({t}))) + b.d * abs(sin(b.t - ({t})))) / 2 - abs((b.x - a.x) * cos({t}) + (b.y - a.y) * sin({t}))" for t in ("a.t", "a.t + pi() / 2", "b.t", "b.t + pi() / 2")
) + "))"


@register("turned_overlap_pairs", f"""
WITH {BOXES}, p AS (SELECT a.id AS a, b.id AS b, {SAT} AS depth, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS upright FROM b AS a JOIN b ON a.room = b.room AND a.id < b.id)
SELECT a, b, round(depth, 6) AS depth, upright FROM p WHERE depth > 0.000001 AND upright > 0
""")
def turned_overlap_pairs(spark, sf_dir):
    """Boxes that lie in one another: how deep on the floor, and by how much of their heights."""
    p = near_pairs(boxes(spark, sf_dir)).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), penetration().alias("depth"), shapes.interval_overlap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")).alias("upright"))
    return p.where("depth > 0.000001 and upright > 0").withColumn("depth", F.round("depth", 6))


@register("box_corners", f"""
WITH {BOXES} SELECT id, CAST(i AS INTEGER) AS corner, round(x + w * sx * cos(t) - d * sy * sin(t), 6) AS x, round(y + w * sx * sin(t) + d * sy * cos(t), 6) AS y FROM b, (VALUES (0, 0.5, 0.5), (1, -0.5, 0.5), (2, -0.5, -0.5), (3, 0.5, -0.5)) c(i, sx, sy)
""")
def box_corners(spark, sf_dir):
    b = boxes(spark, sf_dir).select("id", F.posexplode(shapes.corners(*[F.col(c) for c in ("x", "y", "w", "d", "t")])).alias("corner", "c"))
    return b.select("id", "corner", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


_EDGES = ", ".join(f"({30 * (x0 + 0.5)}::DOUBLE, {30 * (y0 + 0.5)}::DOUBLE, {30 * (x1 + 0.5)}::DOUBLE, {30 * (y1 + 0.5)}::DOUBLE)" for (x0, y0), (x1, y1) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))


@register("boxes_inside_polygon", f"""
WITH {BOXES}, c AS (SELECT id, x + w * sx * cos(t) - d * sy * sin(t) AS x, y + w * sx * sin(t) + d * sy * cos(t) AS y FROM b, (VALUES (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5)) c(sx, sy)),
e AS (SELECT * FROM (VALUES {_EDGES}) t(x0, y0, x1, y1)), i AS (SELECT id, x, y, sum(CASE WHEN (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM c, e GROUP BY 1, 2, 3)
SELECT id, bool_and(inside) AS inside FROM i GROUP BY 1
""")
def boxes_inside_polygon(spark, sf_dir):
    """A box is inside where all four corners are."""
    floor = [(30 * (x + 0.5), 30 * (y + 0.5)) for x, y in POLYGON]
    at = shapes.corners(*[F.col(c) for c in ("x", "y", "w", "d", "t")])
    return boxes(spark, sf_dir).select("id", F.forall(at, lambda c: joins.inside_polygon(c["x"], c["y"], floor)).alias("inside"))


@register("placement_problems", f"""
WITH {BOXES}, p AS (SELECT a.id, b.id AS other, {SAT} AS depth FROM b AS a JOIN b ON a.room = b.room AND a.id <> b.id AND NOT (a.kind = b.kind AND abs(a.id - b.id) = 1) AND least(a.hi, b.hi) > greatest(a.lo, b.lo))
SELECT id, other AS worst, round(depth, 6) AS depth FROM p WHERE depth > 0.05 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(depth, 9) DESC, other) = 1
""")
def placement_problems(spark, sf_dir):
    """Each box's worst overlap but with declared relations: neighbours by number of one kind."""
    p = near_pairs(boxes(spark, sf_dir)).where("a_id != b_id and not (a_kind = b_kind and abs(a_id - b_id) = 1) and least(a_hi, b_hi) > greatest(a_lo, b_lo)")
    p = p.select(F.col("a_id").alias("id"), F.col("b_id").alias("worst"), penetration().alias("depth")).where("depth > 0.05")
    return joins.greedy_claims(p, ["id"], [F.desc(F.round("depth", 9)), F.asc("worst")]).withColumn("depth", F.round("depth", 6))


@register("zone_intruders", f"""
WITH {BOXES}, z AS (SELECT id, room, x + cos(t) * (w / 2 + 0.5) AS x, y + sin(t) * (w / 2 + 0.5) AS y, 1.0::DOUBLE AS w, d, t, kind FROM b WHERE kind = 'ECONOMY')
SELECT a.id AS piece, b.id AS intruder FROM z AS a JOIN b ON a.room = b.room AND a.id <> b.id AND b.kind <> 'PROMO' AND {SAT} > 0.000001
""")
def zone_intruders(spark, sf_dir):
    """What stands in the zone before an ECONOMY piece, PROMO ones being exempt."""
    b = boxes(spark, sf_dir)
    ahead = F.col("w") / 2 + 0.5
    z = b.where("kind = 'ECONOMY'").withColumns({"x": F.col("x") + F.cos("t") * ahead, "y": F.col("y") + F.sin("t") * ahead, "w": F.lit(1.0)})
    left, right = z.toDF(*[c if c == "room" else f"a_{c}" for c in z.columns]), b.where("kind != 'PROMO'").toDF(*[c if c == "room" else f"b_{c}" for c in b.columns])
    p = joins.within(left, right, "a_x", "a_y", "b_x", "b_y", REACH, ["room"]).where("a_id != b_id")
    return p.where(penetration() > 0.000001).select(F.col("a_id").alias("piece"), F.col("b_id").alias("intruder"))


@register("bond_shortfalls", f"""
WITH {BOXES}, e AS (SELECT id AS f, id - 1 AS a, CASE id % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'facing' ELSE 'over' END AS how FROM b WHERE id % 100 > 0)
SELECT f AS follower, a AS anchor, how FROM e JOIN b p ON p.id = f JOIN b q ON q.id = a WHERE NOT CASE how WHEN 'near' THEN sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 10 WHEN 'over' THEN p.lo >= q.hi
 ELSE (cos(p.t) * (q.x - p.x) + sin(p.t) * (q.y - p.y)) >= cos(radians(35)) * sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) END
""")
def bond_shortfalls(spark, sf_dir):
    """Relations between a follower and its anchor that do not hold: near, over, facing within 35 degrees."""
    b = boxes(spark, sf_dir)
    how = F.when(F.col("follower") % 3 == 0, "near").when(F.col("follower") % 3 == 1, "facing").otherwise("over")
    e = b.where("id % 100 > 0").select(F.col("id").alias("follower"), (F.col("id") - 1).alias("anchor")).withColumn("how", how)
    p, q = b.toDF(*["follower" if c == "id" else f"p_{c}" for c in b.columns]), b.toDF(*["anchor" if c == "id" else f"q_{c}" for c in b.columns])
    dx, dy = F.col("q_x") - F.col("p_x"), F.col("q_y") - F.col("p_y")
    apart = F.sqrt(dx * dx + dy * dy)
    facing = F.cos("p_t") * dx + F.sin("p_t") * dy >= math.cos(math.radians(35)) * apart
    holds = F.when(F.col("how") == "near", apart <= 10).when(F.col("how") == "over", F.col("p_lo") >= F.col("q_hi")).otherwise(facing)
    return e.join(p, "follower").join(q, "anchor").where(~holds).select("follower", "anchor", "how")


@register("suppressing_boxes", f"""
WITH {BOXES}, o AS (SELECT id, room, x + 0.4 AS x, y, kind FROM b) SELECT o.id, min(b.id) AS suppressed_by FROM o LEFT JOIN b ON o.room = b.room AND o.id <> b.id AND b.kind = o.kind
 AND abs((o.x - b.x) * cos(b.t) + (o.y - b.y) * sin(b.t)) <= b.w / 2 + 0.1 AND abs((o.y - b.y) * cos(b.t) - (o.x - b.x) * sin(b.t)) <= b.d / 2 + 0.1 GROUP BY 1
""")
def suppressing_boxes(spark, sf_dir):
    """The lowest box of the same kind that holds a placed point, within a margin; null without one."""
    b = boxes(spark, sf_dir)
    o = b.select("id", "room", (F.col("x") + 0.4).alias("x"), "y", "kind")
    p = joins.within(o.toDF("id", "room", "px", "py", "kind"), b.toDF(*[c if c in ("room", "kind") else f"b_{c}" for c in b.columns]), "px", "py", "b_x", "b_y", REACH, ["room", "kind"])
    dx, dy = F.col("px") - F.col("b_x"), F.col("py") - F.col("b_y")
    inside = (F.abs(dx * F.cos("b_t") + dy * F.sin("b_t")) <= F.col("b_w") / 2 + 0.1) & (F.abs(dy * F.cos("b_t") - dx * F.sin("b_t")) <= F.col("b_d") / 2 + 0.1)
    hit = p.where(inside & (F.col("id") != F.col("b_id"))).groupBy("id").agg(F.min("b_id").alias("suppressed_by"))
    return o.select("id").join(hit.hint("merge"), "id", "left")


@register("wall_seams", """
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS room, radians(n_nationkey * 47 % 180) AS t, n_nationkey * 13 % 10 / 10.0::DOUBLE AS gap FROM nation)
SELECT a.k AS a, b.k AS b, round(degrees(acos(least(1.0, abs(cos(a.t - b.t))))), 6) AS angle FROM n a JOIN n b ON a.room = b.room AND a.k < b.k AND degrees(acos(least(1.0, abs(cos(a.t - b.t))))) >= 20 AND abs(a.gap - b.gap) <= 0.4
""")
def wall_seams(spark, sf_dir):
    """Pairs of walls of one room that meet at an angle of 20 degrees or more, with a small gap."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("room"), F.radians(F.col("n_nationkey") * 47 % 180).alias("t"), (F.col("n_nationkey") * 13 % 10 / 10.0).alias("gap"))
    p = n.toDF("a", "room", "at", "ag").join(n.toDF("b", "room", "bt", "bg"), "room").where("a < b")
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.cos(F.col("at") - F.col("bt"))))))
    return p.where((angle >= 20) & (F.abs(F.col("ag") - F.col("bg")) <= 0.4)).select("a", "b", F.round(angle, 6).alias("angle"))


@register("rays_and_planes", """
WITH e AS (SELECT event_id, value AS u, event_id % 120 AS v FROM events), r AS (SELECT event_id, (u - 64) / 100 AS x, -(v - 60) / 100.0::DOUBLE AS y FROM e), d AS (SELECT event_id, x / sqrt(x * x + y * y + 1) AS dx, y / sqrt(x * x + y * y + 1) AS dy, -1 / sqrt(x * x + y * y + 1) AS dz FROM r),
a AS (SELECT *, 0.6 * dx + 0.8 * dz AS along FROM d)
SELECT event_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(CASE WHEN abs(along) > 1e-9 AND (-2 - 0.6) / along >= 0 THEN (-2 - 0.6) / along END, 6) AS t FROM a
""")
def rays_and_planes(spark, sf_dir):
    """The ray through a pixel, and how far along it from (1, 0, 0) a slanted plane lies."""
    r = shapes.ray_through_pixel(F.col("value"), F.col("event_id") % 120, 100.0, 100.0, 64.0, 60.0)
    lit = lambda *v: [F.lit(x) for x in v]
    t = shapes.ray_plane(lit(1.0, 0.0, 0.0), r, lit(0.6, 0.0, 0.8), F.lit(-2.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(r[0], 6).alias("dx"), F.round(r[1], 6).alias("dy"), F.round(t, 6).alias("t"))


@register("vertical_seams", """
WITH n AS (SELECT n_nationkey AS k, radians(n_nationkey * 47 % 180) AS t, n_regionkey::DOUBLE AS d FROM nation), p AS (SELECT a.k, cos(a.t) AS nx, sin(a.t) AS ny, a.d, cos(b.t) AS mx, sin(b.t) AS my, b.d AS e FROM n a JOIN n b ON b.k = a.k + 1)
SELECT k, round(CASE WHEN abs(nx * my - ny * mx) >= 0.2 THEN (d * my - e * ny) / (nx * my - ny * mx) END, 6) AS x, round(CASE WHEN abs(nx * my - ny * mx) >= 0.2 THEN (nx * e - mx * d) / (nx * my - ny * mx) END, 6) AS y FROM p
""")
def vertical_seams(spark, sf_dir):
    """Where a wall meets the next one; null where they are nearly parallel."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.radians(F.col("n_nationkey") * 47 % 180).alias("t"), F.col("n_regionkey").cast("double").alias("d"))
    p = n.join(n.select((F.col("k") - 1).alias("k"), F.col("t").alias("s"), F.col("d").alias("e")), "k")
    at = shapes.line_crossing(F.cos("t"), F.sin("t"), F.col("d"), F.cos("s"), F.sin("s"), F.col("e"), 0.2)
    return p.withColumn("at", at).select("k", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"))


@register("axis_rotations", """
WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), u AS (SELECT vec_id, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z, radians(vec_id % 80 + 3.5) AS t FROM v),
q AS (SELECT *, sqrt(y * y + x * x + (1 + z) * (1 + z)) AS n FROM u)
SELECT vec_id, round((1 - cos(t)) * x * x + cos(t), 6) AS m00, round((1 - cos(t)) * x * y - sin(t) * z, 6) AS m01, round((1 - cos(t)) * y * z + sin(t) * x, 6) AS m21, round(-y / n, 6) AS qx, round(x / n, 6) AS qy, round((1 + z) / n, 6) AS qw,
 round(cos(t) * cos(1) , 6) AS e00, round(cos(1) * sin(0.5), 6) AS e21 FROM q
""")
def axis_rotations(spark, sf_dir):
    """Rotations about an axis, the shortest one from the z axis to it, and one by three angles."""
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    n = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    v = table(spark, sf_dir, "embeddings").select("vec_id", *[(c / n).alias(k) for c, k in zip(e, "xyz", strict=True)], F.radians(F.col("vec_id") % 80 + 3.5).alias("t"))
    axis = [F.col(k) for k in "xyz"]
    m = shapes.rotation_about_axis(axis, F.col("t"))
    q = shapes.shortest_rotation([F.lit(0.0), F.lit(0.0), F.lit(1.0)], axis)
    r = shapes.euler_matrix(F.lit(0.5), F.lit(1.0), F.col("t"))
    got = {"m00": m[0], "m01": m[1], "m21": m[7], "qx": q[0], "qy": q[1], "qw": q[3], "e00": r[0], "e21": r[7]}
    return v.select("vec_id", *[F.round(c, 6).alias(k) for k, c in got.items()])


@register("carried_poses", f"""
WITH {BOXES} SELECT p.id, round(q.x + 2 + (p.x - q.x) * cos(0.5) - (p.y - q.y) * sin(0.5), 6) AS x, round(q.y - 1 + (p.x - q.x) * sin(0.5) + (p.y - q.y) * cos(0.5), 6) AS y, round(p.t + 0.5, 6) AS t FROM b p JOIN b q ON q.id = p.id - 1
""")
def carried_poses(spark, sf_dir):
    """Pieces that stand on the one before them go along when it is moved and turned."""
    b = boxes(spark, sf_dir).select("id", "x", "y", "t")
    q = b.select((F.col("id") + 1).alias("id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("t").alias("ot"))
    x, y, t = shapes.carried(F.col("x"), F.col("y"), F.col("t"), [F.col("ox"), F.col("oy"), F.col("ot")], [F.col("ox") + 2, F.col("oy") - 1, F.col("ot") + 0.5])
    return b.join(q, "id").select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(t, 6).alias("t"))


@register("hidden_pieces", f"""
WITH {BOXES}, s AS (SELECT id, room, x - w / 2 AS x0, lo AS y0, x + w / 2 AS x1, hi AS y1, y AS depth FROM b),
c AS (SELECT a.id, max(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))) AS share FROM s a JOIN s b ON a.room = b.room AND a.id <> b.id AND b.depth < a.depth AND b.y1 >= a.y1 GROUP BY 1)
SELECT id, round(share, 6) AS share FROM c WHERE share > 0.4
""")
def hidden_pieces(spark, sf_dir):
    """Pieces of which a nearer one that is no shorter covers over two fifths on the screen."""
    s = boxes(spark, sf_dir).select("id", "room", (F.col("x") - F.col("w") / 2).alias("x0"), F.col("lo").alias("y0"), (F.col("x") + F.col("w") / 2).alias("x1"), F.col("hi").alias("y1"), F.col("y").alias("depth"))
    cell = F.explode(F.sequence(F.floor(F.col("x0") / 5), F.floor(F.col("x1") / 5)))
    a, b = s.toDF(*[c if c == "room" else f"a_{c}" for c in s.columns]).withColumn("cell", F.explode(F.sequence(F.floor(F.col("a_x0") / 5), F.floor(F.col("a_x1") / 5)))), s.withColumn("cell", cell).toDF(*[c if c == "room" else f"b_{c}" for c in s.columns], "cell")
    share = shapes.covered_share(*[[F.col(f"{n}_{c}") for c in ("x0", "y0", "x1", "y1")] for n in "ab"])
    p = a.join(b, ["room", "cell"]).where("a_id != b_id and b_depth < a_depth and b_y1 >= a_y1").groupBy(F.col("a_id").alias("id")).agg(F.max(share).alias("share"))
    return p.where("share > 0.4").select("id", F.round("share", 6).alias("share"))


@register("plan_views", f"""
WITH {BOXES}, c AS (SELECT room, i AS corner, sum(CASE WHEN (x > 15) = (i % 2 = 1) AND (y > 15) = (i // 2 = 1) THEN w * d / 10 + 1 ELSE 0 END) - 3 * sum(CASE WHEN (x > 15) <> (i % 2 = 1) AND w * d > 12 THEN 1 ELSE 0 END) AS score FROM b, range(0, 6) r(i) GROUP BY 1, 2)
SELECT room, CAST(corner AS INTEGER) AS corner, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY room ORDER BY round(score, 9) DESC, corner) <= 4
""")
def plan_views(spark, sf_dir):
    """Of each room the four corners of the best score: what is seen from there, less three for each piece that hides others."""
    b = boxes(spark, sf_dir).withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(5))))
    right, far = (F.col("x") > 15) == (F.col("corner") % 2 == 1), (F.col("y") > 15) == (F.floor(F.col("corner") / 2) == 1)
    area = F.col("w") * F.col("d")
    c = b.groupBy("room", "corner").agg((F.sum(F.when(right & far, area / 10 + 1).otherwise(0.0)) - 3 * F.count_if(~right & (area > 12))).alias("score"))
    w = Window.partitionBy("room").orderBy(F.desc(F.round("score", 9)), "corner")
    return c.withColumn("n", F.row_number().over(w)).where("n <= 4").select("room", "corner", F.round("score", 6).alias("score"))


@register("cutaway_pairs", f"""
WITH {BOXES}, w AS (SELECT id, room, w * d AS area, CASE kind WHEN 'ECONOMY' THEN 6.0 WHEN 'PROMO' THEN 1.5 ELSE 1.0 END::DOUBLE AS openings FROM b), p AS (SELECT a.room, a.id AS a, b.id AS b, (a.area + b.area) / 10 + a.openings + b.openings AS score FROM w a JOIN w b ON a.room = b.room AND b.id = a.id + 1)
SELECT room, a, b, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY room ORDER BY round(score, 9) DESC, a) = 1
""")
def cutaway_pairs(spark, sf_dir):
    """Of each room the two neighbouring walls that are cut away: the highest score by area and openings, the first of equals."""
    opening = F.when(F.col("kind") == "ECONOMY", 6.0).when(F.col("kind") == "PROMO", 1.5).otherwise(1.0)
    w = boxes(spark, sf_dir).select("id", "room", (F.col("w") * F.col("d")).alias("area"), opening.alias("o"))
    b = w.select((F.col("id") - 1).alias("id"), "room", F.col("id").alias("b"), F.col("area").alias("barea"), F.col("o").alias("bo"))
    p = w.join(b, ["id", "room"]).select("room", F.col("id").alias("a"), "b", ((F.col("area") + F.col("barea")) / 10 + F.col("o") + F.col("bo")).alias("score"))
    return joins.greedy_claims(p, ["room"], [F.desc(F.round("score", 9)), F.asc("a")]).withColumn("score", F.round("score", 6))


@register("sweep_order", f"WITH {BOXES} SELECT id, row_number() OVER (PARTITION BY room ORDER BY round(fmod(fmod(atan2(y - 15, x - 15) - 1, 2 * pi()) + 2 * pi(), 2 * pi()), 9), id) AS place FROM b")
def sweep_order(spark, sf_dir):
    """The pieces of a room by their direction from its middle, from a starting angle on."""
    angle = F.round(F.pmod(F.atan2(F.col("y") - 15, F.col("x") - 15) - 1, F.lit(2 * math.pi)), 9)
    w = Window.partitionBy("room").orderBy(angle, "id")
    return boxes(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("place"))


@register("newell_normals", """
WITH c AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_totalprice / 1000 AS x, (o_orderkey % 97)::DOUBLE AS y, (o_orderkey % 31)::DOUBLE AS z FROM orders),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, coalesce(lead(z) OVER w, first_value(z) OVER w) AS z2 FROM c WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT k, round(sum((y - y2) * (z + z2)), 2) AS nx, round(sum((z - z2) * (x + x2)), 2) AS ny, round(sum((x - x2) * (y + y2)), 2) AS nz FROM n GROUP BY 1
""")
def newell_normals(spark, sf_dir):
    """The normal of a polygon by sums over its edges, the last one closing it."""
    w = Window.partitionBy("k").orderBy("i")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"), (F.col("o_orderkey") % 31).cast("double").alias("z"))
    first = c.groupBy("k").agg(F.min_by(F.struct("x", "y", "z"), "i").alias("f"))
    n = c.select("*", *[F.lead(a).over(w).alias(f"_{a}") for a in "xyz"]).join(first, "k")
    x, y, z = (F.col(a) for a in "xyz")
    x2, y2, z2 = (F.coalesce(f"_{a}", f"f.{a}") for a in "xyz")
    return n.groupBy("k").agg(F.round(F.sum((y - y2) * (z + z2)), 2).alias("nx"), F.round(F.sum((z - z2) * (x + x2)), 2).alias("ny"), F.round(F.sum((x - x2) * (y + y2)), 2).alias("nz"))


@register("clipped_openings", """
SELECT l_orderkey, l_linenumber, greatest(0, least(4, l_quantity / 10 - 0.5)) AS lo, greatest(0, least(4, l_quantity / 10 + l_tax * 10)) AS hi FROM lineitem WHERE greatest(0, least(4, l_quantity / 10 - 0.5)) < greatest(0, least(4, l_quantity / 10 + l_tax * 10))
""")
def clipped_openings(spark, sf_dir):
    """Openings in the frame of another wall, cut to its length; what lies outside is gone."""
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(4.0), c))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cut(F.col("l_quantity") / 10 - 0.5).alias("lo"), cut(F.col("l_quantity") / 10 + F.col("l_tax") * 10).alias("hi"))
    return l.where("lo < hi")


@register("window_cover", f"""
WITH {BOXES}, g AS (SELECT room, i * 1.5 + 0.75 AS gx, j * 1.5 + 0.75 AS gy FROM (SELECT DISTINCT room FROM b), range(0, 20) a(i), range(0, 20) c(j)), h AS (SELECT g.room, gx, gy, count(b.id) AS n FROM g LEFT JOIN b ON b.room = g.room
 AND abs((gx - b.x) * cos(b.t) + (gy - b.y) * sin(b.t)) <= b.w / 2 AND abs((gy - b.y) * cos(b.t) - (gx - b.x) * sin(b.t)) <= b.d / 2 GROUP BY 1, 2, 3)
SELECT room, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM h GROUP BY 1
""")
def window_cover(spark, sf_dir):
    """The share of a grid of samples over a room that any box covers."""
    b = boxes(spark, sf_dir)
    g = b.select("room").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(19))))
    g = g.select("room", (F.col("i") * 1.5 + 0.75).alias("gx"), (F.col("j") * 1.5 + 0.75).alias("gy"))
    p = joins.within(g, b.toDF(*[c if c == "room" else f"b_{c}" for c in b.columns]), "gx", "gy", "b_x", "b_y", REACH, ["room"])
    dx, dy = F.col("gx") - F.col("b_x"), F.col("gy") - F.col("b_y")
    hit = p.where((F.abs(dx * F.cos("b_t") + dy * F.sin("b_t")) <= F.col("b_w") / 2) & (F.abs(dy * F.cos("b_t") - dx * F.sin("b_t")) <= F.col("b_d") / 2)).select("room", "gx", "gy").distinct().withColumn("hit", F.lit(1.0))
    return g.join(hit, ["room", "gx", "gy"], "left").groupBy("room").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("share"))


@register("box_visibility", f"""
WITH {BOXES}, f AS (SELECT s_suppkey AS frame, s_suppkey // 5 AS room, s_suppkey * 31 % 300 / 10.0::DOUBLE AS fx, s_suppkey * 57 % 300 / 10.0::DOUBLE AS fy FROM supplier), v AS (SELECT frame, id, w * d / (1 + (x - fx) * (x - fx) + (y - fy) * (y - fy)) AS value, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS apart FROM f JOIN b USING (room))
SELECT frame, id, round(value, 9) AS value, value >= 0.05 AS good FROM v WHERE apart <= 10
""")
def box_visibility(spark, sf_dir):
    """How much of each box a frame of its room sees, within its range, and whether that is enough."""
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), F.floor(F.col("s_suppkey") / 5).alias("room"), (F.col("s_suppkey") * 31 % 300 / 10.0).alias("fx"), (F.col("s_suppkey") * 57 % 300 / 10.0).alias("fy"))
    v = joins.within(f, boxes(spark, sf_dir).select("id", "room", "x", "y", "w", "d"), "fx", "fy", "x", "y", 10.0, ["room"])
    value = F.col("w") * F.col("d") / (1 + (F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2)
    return v.select("frame", "id", F.round(value, 9).alias("value"), (value >= 0.05).alias("good"))
