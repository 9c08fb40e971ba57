"""Fits, families and clear rectangles for each key: sums and minima that combine before the shuffle, no group gathered."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written


def disparity_error(m: Column, z: Column, scale: Column, shift: Column) -> Column:
    """How far scale * m + shift is from 1 / z, as a share of it."""
    return F.abs((scale * m + shift) * z - 1)


def robust_fit(
    df: DataFrame, key: list[str], ident: str, value: str, depth: str, inlier: float, draws: int = 32, rounds: int = 3, mix: Callable[[Column, int], Column] | None = None,
) -> DataFrame:
    """For each key the scale and shift of value by which it best agrees with 1 / depth: (key.., n, scale, shift, inliers).

    `draws` pairs of rows (those of the least `mix(ident, seed)`) each give a hypothesis; that of the least truncated
    squared error is taken (ties: the first), then refined `rounds` times by least squares over the rows within `inlier` of it.
    A hypothesis must have a positive scale; a refinement that has none, or is degenerate, ends the refining. Rows with a null or
    with a depth that is not positive count as none; keys without a hypothesis have nulls. Costs, counts and normal equations are sums.
    """
    mix = mix or (lambda i, seed: F.xxhash64(i, F.lit(seed)))
    names = [f"key{j}" for j in range(len(key))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col(ident).alias("i"), F.col(value).cast("double").alias("m"), F.col(depth).cast("double").alias("z"))
    rows = written(rows.dropna().where("z > 0"), "fit-rows")
    seeds = range(2 * draws)
    drawn = rows.groupBy(*names).agg(F.count("*").alias("n"), *[F.min(F.struct(mix(F.col("i"), s).alias("h"), "i", "m", "z")).alias(f"d{s}") for s in seeds])
    pair = lambda s: F.struct(F.lit(s // 2).alias("draw"), *[F.col(f"d{s + q}.{c}").alias(f"{c}{q}") for q in (0, 1) for c in ("m", "z")])
    pairs = drawn.select(*names, "n", F.explode(F.array(*[pair(s) for s in seeds[::2]])).alias("p")).select(*names, "n", "p.*").where("m0 <> m1")
    scale = (1 / F.col("z0") - 1 / F.col("z1")) / (F.col("m0") - F.col("m1"))
    tried = pairs.withColumn("scale", scale).withColumn("shift", 1 / F.col("z0") - F.col("scale") * F.col("m0")).where("scale > 0")
    tried = written(tried.select(*names, "draw", "scale", "shift"), "hypotheses")
    error = disparity_error(F.col("m"), F.col("z"), F.col("scale"), F.col("shift"))
    costs = rows.join(tried, names).groupBy(*names, "draw", "scale", "shift").agg(F.sum(F.least(error * error, F.lit(inlier * inlier))).alias("cost"))
    best = costs.groupBy(*names).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "draw", "scale", "shift")).alias("b"))
    model = written(best.select(*names, "b.scale", "b.shift"), "models")
    a, b = F.col("m") * F.col("z"), F.col("z")
    for _ in range(rounds):
        near = rows.join(model, names).where(error <= inlier)
        s = near.groupBy(*names).agg(F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a).alias("a1"), F.sum(b).alias("b1"))
        det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
        s = s.withColumn("det", det).where("det > 1e-9 * aa * bb").withColumn("new", (F.col("a1") * F.col("bb") - F.col("b1") * F.col("ab")) / F.col("det")).where("new > 0")
        s = s.select(*names, "new", ((F.col("aa") * F.col("b1") - F.col("ab") * F.col("a1")) / F.col("det")).alias("moved"))
        after = written(model.join(s, names, "left").select(*names, F.coalesce("new", "scale").alias("scale"), F.coalesce("moved", "shift").alias("shift")), "models")
        discard(model)
        model = after
    inliers = rows.join(model, names).where(error <= inlier).groupBy(*names).agg(F.count("*").alias("inliers"))
    out = drawn.select(*names, "n").join(model, names, "left").join(inliers, names, "left")
    return out.select(*[F.col(n).alias(k) for k, n in zip(key, names, strict=True)], "n", "scale", "shift", F.coalesce("inliers", F.lit(0)).alias("inliers"))


def direction_families(df: DataFrame, key: list[str], pos: str, heading: str, tolerance: float, turn: float = 180.0) -> DataFrame:
    """df with `leader` (the pos of the row that leads its family) and `family` (its number in the key, from 0): rows in the order of pos join
    the first leader within `tolerance` on a circle of `turn`, or lead a family of their own. pos: distinct in a key. Rows
    with a null heading have no family. A round names each key's next leader, by a minimum, and takes its rows; leaders lie
    apart, so there are at most turn / tolerance + 1 rounds. Columns of the names leader and family are replaced."""
    kept = [c for c in df.columns if c not in ("leader", "family")]
    names = [f"key{j}" for j in range(len(key))]
    rows = df.select(F.struct(*kept).alias("row"), *[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col(pos).alias("pos"), F.col(heading).cast("double").alias("heading"))
    left = written(rows.where(F.col("heading").isNotNull() & F.col("pos").isNotNull()), "headings")
    done = [rows.where(F.col("heading").isNull() | F.col("pos").isNull()).select("row.*", F.lit(None).cast(dict(df.dtypes)[pos]).alias("leader"), F.lit(None).cast("int").alias("family"))]
    for family in range(int(turn / tolerance) + 2):
        if left.isEmpty():
            break
        lead = left.groupBy(*names).agg(F.min(F.struct("pos", "heading")).alias("lead"))
        lead = lead.select(*[F.col(n).alias(f"{n}_") for n in names], "lead")
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
        apart = F.abs(F.col("heading") - F.col("lead.heading")) % turn
        near = written(left.join(lead, same).withColumn("near", F.least(apart, turn - apart) <= tolerance), "family")
        done.append(near.where("near").select("row.*", F.col("lead.pos").alias("leader"), F.lit(family).alias("family")))
        discard(left)
        left = near.where("NOT near").select("row", *names, "pos", "heading")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _widest(heights: pd.Series) -> pd.Series:
    """The most cells of a rectangle that stands on a row, by each cell's nearest smaller neighbours."""
    out = []
    for row in heights:
        stack, best = [], 0
        for k, h in enumerate([*map(int, row), 0]):
            while stack and stack[-1][1] >= h:
                _, top = stack.pop()
                best = max(best, top * (k - (stack[-1][0] if stack else -1) - 1))
            stack.append((k, h))
        out.append(best)
    return pd.Series(out, dtype="int64")


def largest_clear_rectangles(cells: DataFrame, key: list[str], row: str, column: str, free: str) -> DataFrame:
    """(key.., cells): the most cells of an axis-parallel rectangle of free cells; 0 where none is free. Cells that are not there, or
    are null, are not free; of a cell that is there twice, both must be. How many free cells stand above each other is a window over
    each grid column; a grid's row, bounded by its width, is one array."""
    names = [f"key{j}" for j in range(len(key))]
    grid = cells.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col(row).cast("long").alias("r"), F.col(column).cast("long").alias("c"), F.coalesce(F.col(free), F.lit(False)).alias("free"))
    grid = grid.groupBy(*names, "r", "c").agg(F.bool_and("free").alias("free"))
    open_ = grid.where("free").withColumn("start", F.col("r") - F.row_number().over(Window.partitionBy(*names, "c").orderBy("r")))
    high = open_.withColumn("h", F.row_number().over(Window.partitionBy(*names, "c", "start").orderBy("r")))
    # cells of a row that follow each other are one stretch; between stretches no rectangle reaches
    high = high.withColumn("stretch", F.col("c") - F.row_number().over(Window.partitionBy(*names, "r").orderBy("c")))
    rows = high.groupBy(*names, "r", "stretch").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]).alias("heights"))
    best = rows.withColumn("cells", F.pandas_udf(_widest, "long")("heights")).groupBy(*names).agg(F.max("cells").alias("cells"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    every = grid.select(*names).distinct().join(best.select(*[F.col(n).alias(f"{n}_") for n in names], "cells"), same, "left")
    return every.select(*[F.col(n).alias(k) for k, n in zip(key, names, strict=True)], F.coalesce("cells", F.lit(0)).alias("cells"))
