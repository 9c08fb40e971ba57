"""Queries of room documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import register
from ..session import table
from ..sources.rooms import room_tables


@register("room_document_pieces", """
WITH p AS (SELECT p_partkey AS id, p_partkey // 100 AS room FROM part WHERE p_partkey // 100 % 7 <> 3 AND p_partkey // 100 % 11 <> 5)
SELECT room, 'p' || id AS piece, CASE WHEN id % 5 = 0 THEN 'p' || id ELSE 'Piece ' || id END AS name, (['floor', 'object', 'floor', 'wall'])[id % 4 + 1] AS support, CASE id % 3 WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' END AS wall,
 1.0::DOUBLE - (id % 7) / 2.0::DOUBLE AS y, CASE id % 4 WHEN 0 THEN 0.02::DOUBLE WHEN 1 THEN 0.04::DOUBLE ELSE 0.06::DOUBLE END AS margin, CASE WHEN id % 100 = 50 THEN 'p' || id END AS opening FROM p
""")
def room_document_pieces(spark, sf_dir):
    """Parts as documents of rooms of a hundred, some of another schema or cut short, read back as tables."""
    k = F.col("p_partkey")
    arr = lambda *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % len(vs) + 1).cast("int"))
    name = F.concat(F.lit("p"), k)
    piece = F.struct(
        name.alias("id"), F.when(k % 5 != 0, F.concat(F.lit("Piece "), k)).alias("name"), arr("floor", "on_object", "odd", "wall").alias("support"), F.when(k % 3 == 0, "w1").alias("wall"),
        F.when(k % 3 == 1, "w2").otherwise("none").alias("against_wall"), F.array(F.lit(1.0), (k % 7).cast("double"), F.lit(1.0)).alias("size"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("center"),
        F.struct(arr("measured", " Measured in part", "guessed", None).alias("size_from")).alias("confidence"),
    )
    opening = F.when(k % 100 == 50, F.struct(name.alias("id"), F.lit("door").alias("kind")))
    d = table(spark, sf_dir, "part").groupBy(F.floor(k / 100).alias("room")).agg(F.collect_list(piece).alias("objects"), F.collect_list(opening).alias("openings"))
    schema = F.when(F.col("room") % 7 == 3, "other").otherwise("scene/1")
    text = F.to_json(F.struct(schema.alias("schema"), F.struct(F.lit(2.5).alias("height"), "openings").alias("room"), "objects"))
    cut = F.when(F.col("room") % 11 == 5, F.substring(text, 1, 40)).otherwise(text)
    return room_tables(d.select("room", cut.alias("text")), "room", "text", "scene/1")["pieces"].select("room", "piece", "name", "support", "wall", "y", "margin", "opening")
