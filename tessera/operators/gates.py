"""Gates and decision tables: content checks, ordered refusals, alerts, changes beyond a tolerance, directed relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A canonical version-4 UUID.
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def _free(name: str, *frames: DataFrame) -> str:
    """A name that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def blob_problem(content: Column, magic: bytes, least: int, most: int) -> Column:
    """missing, too_small, too_large or wrong_type (the first bytes are not `magic`); null if none. content: binary."""
    size = F.octet_length(content)
    return (
        F.when(content.isNull(), "missing").when(size < least, "too_small").when(size > most, "too_large")
        .when(F.substring(content, 1, len(magic)) != F.lit(bytearray(magic)), "wrong_type")
    )


def ordered_code(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first failed check; a check that is null has failed. Null if all hold."""
    out = F.lit(None).cast("string")
    for code, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(code))
    return out


def all_problems(checks: list[tuple[str, Column]]) -> Column:
    """The codes of all failed checks, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in checks]))


def moved(now: DataFrame, before: DataFrame, key: str, values: list[str], tolerance: float) -> DataFrame:
    """Keys of both sides any of whose values differ by more than the tolerance, and the largest difference. A value that is
    null on either side is no difference; a key with nothing but such values has not moved."""
    old = F.struct(*values)
    both = now.select(key, F.struct(*values).alias("new")).join(before.select(F.col(key).alias("of"), old.alias("old")), F.col(key) == F.col("of"))
    apart = [F.abs(F.col("new")[v] - F.col("old")[v]) for v in values]
    return both.select(key, (F.greatest(*apart) if len(apart) > 1 else apart[0]).alias("moved_by")).where(F.col("moved_by") > tolerance)


def alerts(summary: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row for each summary row and rule that fires, in the rules' order: the summary's columns, alert."""
    fired = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in rules]))
    return summary.withColumn("alert", F.explode(fired))


def heading_apart(a: Column, b: Column) -> Column:
    """Degrees between two directions without a sign: 0 to 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def settled_edges(edges: DataFrame, source: str, target: str, how: str, order: str, size_of: DataFrame, key: str, size: str) -> DataFrame:
    """Directed relations cleaned: an edge to itself is dropped; `over` onto a smaller one is dropped; `at` and `beside` run from
    the smaller to the larger; of the edges of a pair the first by `order` stays. size_of: (key, size).
    Returns order, source, target, how, action (kept, turned, dropped_self, dropped_over, dropped_second)."""
    names = [order, source, target, how]
    e = edges.select(*[F.col(c).alias(f"e{k}") for k, c in enumerate(names)])
    first, second = (size_of.select(F.col(key).alias(f"k{k}"), F.col(size).alias(f"s{k}")) for k in (1, 2))
    e = e.join(first, F.col("e1") == F.col("k1")).join(second, F.col("e2") == F.col("k2"))
    drop = F.when(F.col("e1") == F.col("e2"), "dropped_self").when((F.col("e3") == "over") & (F.col("s2") < F.col("s1")), "dropped_over")
    turned = F.col("e3").isin("at", "beside") & (F.col("s1") > F.col("s2")) & drop.isNull()
    e = e.select("e0", F.when(turned, F.col("e2")).otherwise(F.col("e1")).alias("e1"), F.when(turned, F.col("e1")).otherwise(F.col("e2")).alias("e2"), "e3", drop.alias("drop"), turned.alias("turned"))
    w = Window.partitionBy(F.least("e1", "e2"), F.greatest("e1", "e2"), F.col("drop").isNull()).orderBy("e0")
    e = e.withColumn("place", F.row_number().over(w))
    action = F.when(F.col("drop").isNotNull(), F.col("drop")).when(F.col("place") > 1, "dropped_second").when(F.col("turned"), "turned").otherwise("kept")
    return e.select(*[F.col(f"e{k}").alias(c) for k, c in enumerate(names)], action.alias("action"))


def off_planes(points: DataFrame, planes: DataFrame, key: str, coordinates: list[str], tolerance: float) -> DataFrame:
    """The points of each key further than the tolerance from every plane of that key (columns nx, ny, .. and d: the
    plane is where the normal times the point equals d). planes: few for each key, gathered into one array."""
    names = [f"n{c}" for c in coordinates]
    all_planes = _free("planes", points)
    gathered = planes.groupBy(key).agg(F.collect_list(F.struct(*names, "d")).alias(all_planes))

    def away(p: Column) -> Column:
        total = -p["d"]
        for c, n in zip(coordinates, names, strict=True):
            total = total + F.col(c) * p[n]
        return F.abs(total) > tolerance

    return points.join(gathered, key, "left").where(F.coalesce(F.forall(all_planes, away), F.lit(True))).drop(all_planes)


def rule_rows(df: DataFrame, kind: str, rules: list[tuple]) -> DataFrame:
    """Each row once for each rule of its kind; rules: (kind, side, depth), a small fixed table. Columns side and depth of df are replaced."""
    book = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.lit(float(depth)).alias("depth")) for k, side, depth in rules])
    rule = _free("rule", df)
    own = [F.col(c) for c in df.columns if c not in ("side", "depth")]
    return df.withColumn(rule, F.explode(F.filter(book, lambda r: r["k"] == F.col(kind)))).select(*own, F.col(rule)["side"].alias("side"), F.col(rule)["depth"].alias("depth"))


def turn(degrees: Column) -> Column:
    return degrees * (math.pi / 180)
