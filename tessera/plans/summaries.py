"""Queries of aggregates over captures, runs and indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import register
from ..operators import summaries as agg
from ..session import table
from .shapes import BOXES, boxes


@register("run_summary", """
SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS asked, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(CASE WHEN role = 'assistant' THEN length(text) END), 6) AS mean_answer,
 string_agg(DISTINCT CASE WHEN length(text) > 300 THEN 'long' WHEN text LIKE '%,%' THEN 'listed' END, ',' ORDER BY CASE WHEN length(text) > 300 THEN 'long' WHEN text LIKE '%,%' THEN 'listed' END) AS flags FROM conversations GROUP BY 1
""")
def run_summary(spark, sf_dir):
    """Counts, sums, means and the distinct flags of each conversation."""
    flag = F.when(F.length("text") > 300, "long").when(F.col("text").contains(","), "listed")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"),
        F.round(F.avg(F.when(F.col("role") == "assistant", F.length("text"))), 6).alias("mean_answer"), F.array_join(F.sort_array(F.collect_set(flag)), ",").alias("flags"),
    )
    return c.withColumn("flags", F.nullif("flags", F.lit("")))


@register("payload_waste", """
SELECT l_returnflag AS splat, count(*) AS n, sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END)::BIGINT AS clipped, sum(CASE WHEN l_discount <= 0.08 AND l_tax < 0.01 THEN 1 ELSE 0 END)::BIGINT AS faint,
 round(sum(l_extendedprice) * sum(CASE WHEN l_discount > 0.08 OR l_tax < 0.01 THEN 1 ELSE 0 END) / count(*), 2) AS wasted FROM lineitem GROUP BY 1
""")
def payload_waste(spark, sf_dir):
    """Points outside the clip, faint ones, and the bytes that both take."""
    out, faint = F.count_if(F.col("l_discount") > 0.08), F.count_if((F.col("l_discount") <= 0.08) & (F.col("l_tax") < 0.01))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("splat")).agg(F.count("*").alias("n"), out.alias("clipped"), faint.alias("faint"), F.round(F.sum("l_extendedprice") * (out + faint) / F.count("*"), 2).alias("wasted"))


@register("mask_bounds", "SELECT user_id, min(event_id) AS x0, max(event_id) AS x1, min(value) AS y0, max(value) AS y1 FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def mask_bounds(spark, sf_dir):
    """The bounding box of a mask's true cells; a mask without any has none."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(F.min("event_id").alias("x0"), F.max("event_id").alias("x1"), F.min("value").alias("y0"), F.max("value").alias("y1"))


def components(n: int, names: str):
    return [F.get("embedding", F.lit(k + n)).cast("double").alias(c) for k, c in enumerate(names)]


@register("average_rotations")
def average_rotations(spark, sf_dir):
    """The mean rotation of each label."""
    v = table(spark, sf_dir, "embeddings").select("label", *components(0, "xyzw"))
    return agg.average_rotation(v, "label", ["x", "y", "z", "w"])


@register("ray_triangulation", """
WITH v AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS ox, CAST(embedding[2] AS DOUBLE) AS oy, CAST(embedding[3] AS DOUBLE) AS oz, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings),
u AS (SELECT label, ox, oy, oz, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM v),
s AS (SELECT label, count(*) AS n, sum(1 - x * x) AS a, sum(-x * y) AS b, sum(-x * z) AS c, sum(1 - y * y) AS d, sum(-y * z) AS e, sum(1 - z * z) AS f, sum((1 - x * x) * ox - x * y * oy - x * z * oz) AS p, sum(-x * y * ox + (1 - y * y) * oy - y * z * oz) AS q, sum(-x * z * ox - y * z * oy + (1 - z * z) * oz) AS r FROM u GROUP BY 1),
t AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s)
SELECT label, n, round((p * (d * f - e * e) - b * (q * f - r * e) + c * (q * e - r * d)) / det, 5) AS x, round((a * (q * f - r * e) - p * (b * f - c * e) + c * (b * r - c * q)) / det, 5) AS y, round((a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / det, 5) AS z FROM t
""")
def ray_triangulation(spark, sf_dir):
    """The point nearest to all rays of a label."""
    v = table(spark, sf_dir, "embeddings").select("label", *components(0, ["ox", "oy", "oz"]), *components(3, ["dx", "dy", "dz"]))
    got = agg.nearest_to_rays(v, "label", ["ox", "oy", "oz"], ["dx", "dy", "dz"])
    return got.select("label", "n", *[F.round(c, 5).alias(c) for c in "xyz"])


@register("row_profiles", """
WITH e AS (SELECT user_id, hour(ts) AS h, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) SELECT user_id, h AS row, CASE WHEN avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1 END) >= 0.15 THEN round(median(v), 6) END AS profile FROM e GROUP BY 1, 2
""")
def row_profiles(spark, sf_dir):
    """The median of each row of a raster; null where less than 15 % of it is seen."""
    v = F.when(F.col("event_type") != "error", F.col("value"))
    e = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("row"), v.alias("v"))
    return e.groupBy("user_id", "row").agg(F.when(F.avg(F.col("v").isNotNull().cast("double")) >= 0.15, F.round(F.median("v"), 6)).alias("profile"))


@register("mean_shift_modes", """
WITH l AS (SELECT l_orderkey % 500 AS k, l_quantity AS v FROM lineitem), m0 AS (SELECT k, median(v) AS m FROM l GROUP BY 1), """ + ", ".join(f"m{i} AS (SELECT l.k, median(v) AS m FROM l JOIN m{i - 1} USING (k) WHERE abs(v - m) <= 6 GROUP BY 1)" for i in range(1, 9)) + " SELECT k, m AS mode FROM m8")  # fmt: skip
def mean_shift_modes(spark, sf_dir):
    """The quantity around which most lines of a key gather: eight rounds of the median within a radius."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("k"), F.col("l_quantity").alias("v"))
    return agg.mode_within(l, "k", "v", 6.0)


@register("lit_colours", """
WITH c AS (SELECT l_suppkey, median(l_quantity) AS centre FROM lineitem GROUP BY 1) SELECT l_suppkey, centre, round(greatest(centre, coalesce(quantile_cont(CASE WHEN abs(l_quantity - centre) <= 8 THEN l_quantity END, 0.9), centre)), 6) AS lit FROM lineitem JOIN c USING (l_suppkey) GROUP BY 1, 2
""")
def lit_colours(spark, sf_dir):
    """The ninth decile of the samples that agree with a key's centre, not below the centre."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    c = l.groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.5), F.col("n")).alias("centre"))
    near = l.join(c, "l_suppkey").where(F.abs(F.col("l_quantity") - F.col("centre")) <= 8)
    top = near.groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.9), F.col("n")).alias("top"))
    return c.join(top, "l_suppkey", "left").select("l_suppkey", "centre", F.round(F.greatest("centre", F.coalesce("top", "centre")), 6).alias("lit"))


@register("room_balance", f"WITH {BOXES} SELECT room, round(sqrt(pow(sum(x * w * d) / sum(w * d) - 15, 2) + pow(sum(y * w * d) / sum(w * d) - 15, 2)) / sqrt(450), 6) AS balance FROM b GROUP BY 1")
def room_balance(spark, sf_dir):
    """How far the weighted middle of a room's pieces lies from the room's, in half diagonals."""
    b, weight = boxes(spark, sf_dir), F.col("w") * F.col("d")
    off = lambda c: F.sum(F.col(c) * weight) / F.sum(weight) - 15
    return b.groupBy("room").agg(F.round(F.sqrt(off("x") ** 2 + off("y") ** 2) / F.sqrt(F.lit(450.0)), 6).alias("balance"))


@register("drawn_density", """
WITH g AS (SELECT l_orderkey, min(l_quantity) AS ground FROM lineitem GROUP BY 1) SELECT l_suppkey, round(avg(CASE WHEN l_quantity > ground THEN 1.0 ELSE 0 END), 6) AS density FROM lineitem JOIN g USING (l_orderkey) GROUP BY 1
""")
def drawn_density(spark, sf_dir):
    """The share of cells drawn against the ground of their own row."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    g = l.groupBy("l_orderkey").agg(F.min("l_quantity").alias("ground"))
    return l.join(g, "l_orderkey").groupBy("l_suppkey").agg(F.round(F.avg((F.col("l_quantity") > F.col("ground")).cast("double")), 6).alias("density"))


@register("index_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def index_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@register("coverage_map", """
SELECT user_id, string_agg(event_id, ',' ORDER BY value DESC, event_id) AS frames FROM (SELECT user_id, event_id, value FROM events WHERE value >= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 8) GROUP BY 1
""")
def coverage_map(spark, sf_dir):
    """Each box's frames, the best first, eight at most."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = table(spark, sf_dir, "events").where("value >= 20").withColumn("r", F.row_number().over(w)).where("r <= 8")
    ordered = F.sort_array(F.collect_list(F.struct("r", "event_id")))
    return e.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_id"].cast("string")), ",").alias("frames"))


@register("hull_areas")
def hull_areas(spark, sf_dir):
    """The convex hull of each label's first two components."""
    return agg.hull_areas(table(spark, sf_dir, "embeddings").select("label", *components(0, "xy")), "label", "x", "y")


@register("either_side", """
WITH s AS (SELECT l_orderkey, l_returnflag AS side, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS breaks, max(l_tax) >= 0.07 AS short, max(l_quantity) AS depth FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, side, n FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY breaks, short, depth DESC, side) = 1
""")
def either_side(spark, sf_dir):
    """Of the sides that a need allows, the one with the fewest breaks, no shortfall, the most depth."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("side")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("breaks"), (F.max("l_tax") >= 0.07).alias("short"), F.max("l_quantity").alias("depth"))
    return agg.better_side(s, ["l_orderkey"], "side", [F.asc("breaks"), F.asc("short"), F.desc("depth")]).select("l_orderkey", "side", "n")


@register("preference_values", """
WITH r AS (SELECT * FROM (VALUES ('ECONOMY', 'light', 1.0), ('STANDARD', 'wall', 0.6), ('PROMO', 'view', 0.3)) t(kind, rule, weight)) SELECT p_brand, rule, round(sum(weight * CASE WHEN p_size > 30 THEN 1 WHEN p_size > 10 THEN 0.6 ELSE 0.3 END)::DOUBLE, 4) AS value FROM part JOIN r ON kind = p_type GROUP BY 1, 2
""")
def preference_values(spark, sf_dir):
    book = spark.createDataFrame([("ECONOMY", "light", 1.0), ("STANDARD", "wall", 0.6), ("PROMO", "view", 0.3)], "p_type string, rule string, weight double")
    grade = F.when(F.col("p_size") > 30, 1.0).when(F.col("p_size") > 10, 0.6).otherwise(0.3)
    p = table(spark, sf_dir, "part").join(F.broadcast(book), "p_type")  # a fixed book of three rules
    return p.groupBy("p_brand", "rule").agg(F.round(F.sum(F.col("weight") * grade), 4).alias("value"))


@register("unclaimed_bands", """
WITH p AS (SELECT label, CAST(floor((embedding[1] + 0.5) * 5) AS INTEGER) AS band, embedding[2] > 0.1 AS other, embedding[3] > 0.1 AS own FROM embeddings WHERE abs(embedding[4]) > 0.02)
SELECT label, band, count(*) AS n, round(avg(CASE WHEN other OR own THEN 0.0 ELSE 1 END), 6) AS unclaimed, round(avg(CASE WHEN own THEN 1.0 ELSE 0 END), 6) AS mine FROM p GROUP BY 1, 2 HAVING count(*) >= 3
""")
def unclaimed_bands(spark, sf_dir):
    """Of the points off the room's plane, by height band: how many no mask holds, and how many the own one; null rows below three are left out."""
    g = lambda k: F.get("embedding", F.lit(k))
    p = table(spark, sf_dir, "embeddings").where(F.abs(g(3)) > F.lit(0.02)).select("label", F.floor((g(0) + F.lit(0.5).cast("float")) * 5).cast("int").alias("band"), (g(1) > F.lit(0.1)).alias("other"), (g(2) > F.lit(0.1)).alias("own"))
    return p.groupBy("label", "band").agg(F.count("*").alias("n"), F.round(F.avg((~(F.col("other") | F.col("own"))).cast("double")), 6).alias("unclaimed"), F.round(F.avg(F.col("own").cast("double")), 6).alias("mine")).where("n >= 3")


@register("texel_medians", """
WITH t AS (SELECT l_partkey % 40 AS i, l_suppkey % 10 AS j, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS v FROM lineitem) SELECT i, j, round(median(v), 4) AS colour, count(v) AS seen FROM t GROUP BY 1, 2
""")
def texel_medians(spark, sf_dir):
    """Each texel's median over the cameras that see it (null where none does), and their number."""
    v = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 10).alias("j"), v.alias("v"))
    return t.groupBy("i", "j").agg(F.round(F.median("v"), 4).alias("colour"), F.count("v").alias("seen"))


@register("plane_observations", """
WITH t AS (SELECT l_partkey AS plane, l_linenumber AS texel, sum(l_tax) AS weight, sum(l_tax * l_quantity) AS v, count(*) AS frames FROM lineitem GROUP BY 1, 2)
SELECT plane, count(*) AS texels, CAST(sum(frames) AS BIGINT) AS frames, round(avg(CASE WHEN weight > 0 THEN 1.0 ELSE 0 END), 6) AS coverage, round(sum(v) / nullif(sum(weight), 0), 6) AS mean FROM t GROUP BY 1
""")
def plane_observations(spark, sf_dir):
    """What all frames see of a plane, texel by texel: the share of texels seen and the weighted mean."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("plane"), F.col("l_linenumber").alias("texel")).agg(F.sum("l_tax").alias("weight"), F.sum(F.col("l_tax") * F.col("l_quantity")).alias("v"), F.count("*").alias("frames"))
    return t.groupBy("plane").agg(F.count("*").alias("texels"), F.sum("frames").alias("frames"), F.round(F.avg((F.col("weight") > 0).cast("double")), 6).alias("coverage"), F.round(F.sum("v") / F.nullif(F.sum("weight"), F.lit(0.0)), 6).alias("mean"))


@register("calibration_medians", """
WITH f AS (SELECT l_suppkey AS region, l_linenumber AS frame, avg(l_quantity) AS render, median(CASE WHEN abs(l_quantity - 25) <= 15 THEN l_quantity END) AS photo FROM lineitem GROUP BY 1, 2) SELECT region, round(median(photo - render), 6) AS delta, count(photo) AS frames FROM f GROUP BY 1
""")
def calibration_medians(spark, sf_dir):
    """For each region the median over its frames of the photo's near colour less the rendered mean."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("frame")).agg(F.avg("l_quantity").alias("render"), F.median(F.when(F.abs(F.col("l_quantity") - 25) <= 15, F.col("l_quantity"))).alias("photo"))
    return f.groupBy("region").agg(F.round(F.median(F.col("photo") - F.col("render")), 6).alias("delta"), F.count("photo").alias("frames"))


@register("image_differences", """
WITH a AS (SELECT l_orderkey AS name, l_linenumber AS px, l_quantity AS v FROM lineitem), b AS (SELECT l_orderkey AS name, l_linenumber AS px, CASE WHEN l_returnflag = 'R' THEN l_quantity + 10 * l_tax * 10 ELSE l_quantity END AS v FROM lineitem),
d AS (SELECT name, abs(a.v - b.v) AS d FROM a JOIN b USING (name, px)) SELECT name, max(d) = 0 AS identical, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.99), 6) AS p99, round(avg(CASE WHEN d > 2 THEN 1.0 ELSE 0 END), 6) AS over FROM d GROUP BY 1
""")
def image_differences(spark, sf_dir):
    """Images of one name in two folders: whether they are identical, how far apart, and how much of them is."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("px"), F.col("l_quantity").alias("v"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 10 * F.col("l_tax") * 10).otherwise(F.col("l_quantity")).alias("w"))
    d = l.select("name", "px", "v").join(l.select("name", "px", "w"), ["name", "px"]).select("name", F.abs(F.col("v") - F.col("w")).alias("d"))
    return d.groupBy("name").agg((F.max("d") == 0).alias("identical"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", 0.99), 6).alias("p99"), F.round(F.avg((F.col("d") > 2).cast("double")), 6).alias("over"))


@register("answer_key_findings", """
SELECT d.doc_id, bool_and(contains(d.text, k.w)) AS all_found, count(CASE WHEN contains(d.text, k.w) THEN 1 END) AS found FROM documents d, (VALUES ('the'), ('and'), ('of')) k(w) GROUP BY 1
""")
def answer_key_findings(spark, sf_dir):
    """Which words of the answer key a report names, and whether it names all."""
    found = F.array(*[F.col("text").contains(w) for w in ("the", "and", "of")])
    return table(spark, sf_dir, "documents").select("doc_id", F.forall(found, lambda x: x).alias("all_found"), F.size(F.filter(found, lambda x: x)).cast("long").alias("found"))


@register("finish_groups", """
WITH m AS (SELECT l_suppkey AS wall, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey AS wall, l_returnflag AS colour, count(*) AS k FROM lineitem GROUP BY 1, 2), w AS (SELECT wall, colour, k FROM c QUALIFY row_number() OVER (PARTITION BY wall ORDER BY k DESC, colour) = 1)
SELECT wall, colour, round(k / n, 6) AS agreement, min(wall) OVER (PARTITION BY colour) AS paint FROM w JOIN m USING (wall)
""")
def finish_groups(spark, sf_dir):
    """Each wall's mode colour, the share of samples that agree, and the first wall of the same paint."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("wall"), F.col("l_returnflag").alias("colour")).agg(F.count("*").alias("k"))
    n = c.groupBy("wall").agg(F.sum("k").alias("n"), F.min_by("colour", F.struct(-F.col("k"), "colour")).alias("colour"), F.max("k").alias("k"))
    paint = n.groupBy("colour").agg(F.min("wall").alias("paint"))
    return n.join(paint, "colour").select("wall", "colour", F.round(F.col("k") / F.col("n"), 6).alias("agreement"), "paint")
