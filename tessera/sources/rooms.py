"""Room documents as normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = """struct<`schema`: string, room: struct<`type`: string, height: double, walls: array<struct<id: string, a: array<double>, b: array<double>, normal: array<double>>>,
 openings: array<struct<id: string, kind: string, wall: string, u0: double, u1: double, v0: double, v1: double, depth: double, closed: boolean>>>,
 objects: array<struct<id: string, name: string, category: string, support: string, `on`: string, wall: string, against_wall: string, size: array<double>, center: array<double>, yaw: double, confidence: struct<size_from: string>>>,
 lights: array<struct<id: string, object: string, position: array<double>, kind: string, on_at_night: boolean>>>"""
#: How far a size may be off, by how it was measured: measured, held to a measure in part, estimated. Fixed values.
MARGINS = (0.02, 0.04, 0.06)


def room_tables(df: DataFrame, key: str, text: str, schema: str) -> dict[str, DataFrame]:
    """The documents of a column as tables: rooms, walls, openings, pieces, lights; and refused (key, reason): not_json (a null too) or
    other_schema, which give no rows elsewhere. A piece stands at its box's lowest middle; its support is floor unless it is
    on_object (object), wall or ceiling; its wall is its own, else the one that it stands against (`none` is none); opening is its id
    where an opening has that id; margin follows from how its size was measured. Absent fields are null, but depth 0, closed and
    on_at_night false, yaw 0, a name its id. Each table is a narrow transform: nothing is shuffled or gathered."""
    d = df.select(F.col(key).alias("key"), F.from_json(text, _SCHEMA).alias("d"), F.get_json_object(text, "$").isNotNull().alias("json"))
    fits = F.coalesce(F.col("json") & (F.col("d.schema") == schema), F.lit(False))
    good, refused, key = d.where(fits), d.where(~fits), F.col("key").alias(key)

    def each(items: str) -> DataFrame:
        return good.select("key", F.col("d.room.openings.id").alias("opening_ids"), F.explode(f"d.{items}").alias("o"))

    at = lambda field, k: F.get(f"o.{field}", F.lit(k))
    how = F.lower(F.trim("o.confidence.size_from"))
    margin = F.when(how == "measured", MARGINS[0]).when(how.startswith("measured"), MARGINS[1]).otherwise(MARGINS[2])
    support = F.when(F.col("o.support") == "on_object", "object").when(F.col("o.support").isin("wall", "ceiling"), F.col("o.support")).otherwise("floor")
    named = lambda *names: [F.col(f"o.{n}").alias(n) for n in names]
    return {
        "rooms": good.select(key, F.coalesce("d.room.type", F.lit("room")).alias("kind"), F.col("d.room.height").alias("height")),
        "walls": each("room.walls").select(key, F.col("o.id").alias("wall"), *[at(f, k).alias(n) for n, f, k in (("ax", "a", 0), ("az", "a", 1), ("bx", "b", 0), ("bz", "b", 1), ("nx", "normal", 0), ("nz", "normal", 1))]),
        "openings": each("room.openings").select(key, F.col("o.id").alias("opening"), *named("kind", "wall", "u0", "u1", "v0", "v1"), F.coalesce("o.depth", F.lit(0.0)).alias("depth"), F.coalesce("o.closed", F.lit(False)).alias("closed")),
        "pieces": each("objects").select(
            key, F.col("o.id").alias("piece"), F.coalesce(F.nullif("o.name", F.lit("")), "o.id").alias("name"), F.coalesce("o.category", F.lit("")).alias("category"), support.alias("support"), F.col("o")["on"].alias("on"),
            F.coalesce(F.nullif("o.wall", F.lit("")), F.when(~F.col("o.against_wall").isin("", "none"), F.col("o.against_wall"))).alias("wall"), *[at("size", k).alias(f"s{c}") for k, c in enumerate("xyz")],
            at("center", 0).alias("x"), (at("center", 1) - at("size", 1) / 2).alias("y"), at("center", 2).alias("z"), F.coalesce("o.yaw", F.lit(0.0)).alias("yaw"), margin.alias("margin"),
            F.when(F.array_contains("opening_ids", F.col("o.id")), F.col("o.id")).alias("opening"),
        ),
        "lights": each("lights").select(key, F.col("o.id").alias("light"), F.col("o.object").alias("object"), *[at("position", k).alias(c) for k, c in enumerate("xyz")], F.coalesce("o.kind", F.lit("")).alias("kind"), F.coalesce("o.on_at_night", F.lit(False)).alias("on_at_night")),
        "refused": refused.select(key, F.when(F.col("json"), "other_schema").otherwise("not_json").alias("reason")),
    }
