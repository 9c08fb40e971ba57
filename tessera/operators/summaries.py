"""Aggregates of captures: averages of rotations, points nearest to rays, hulls, modes, two-level medians, the better side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rotation(df: DataFrame, key: str, quaternion: list[str]) -> DataFrame:
    """The mean rotation of each key's quaternions (x, y, z, w, of either sign): the eigenvector of the largest eigenvalue of
    the sum of their outer products, w not negative. Ten sums for each key are all that is gathered. Null components: no row."""
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in quaternion), F.lit(0.0)))
    rows = df.dropna(subset=quaternion).where(n > 0).select(key, *[(F.col(c) / n).alias(f"_q{i}") for i, c in enumerate(quaternion)])
    sums = rows.groupBy(key).agg(*[F.sum(F.col(f"_q{i}") * F.col(f"_q{j}")).alias(f"_s{i}{j}") for i, j in pairs])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.zeros((len(f), 4, 4))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = f[f"_s{i}{j}"]
            top = np.linalg.eigh(m)[1][:, :, -1] if len(f) else np.zeros((0, 4))
            top = np.where(top[:, 3:] < 0, -top, top)
            yield pd.DataFrame({key: f[key], **{c: top[:, i] for i, c in enumerate(quaternion)}})

    return sums.mapInPandas(solve, f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{c} double" for c in quaternion))


def nearest_to_rays(df: DataFrame, key: str, origin: list[str], direction: list[str], least: float = 1e-6) -> DataFrame:
    """The point that minimises the summed squared distances to each key's rays, by nine sums and Cramer's rule: x, y, z, n;
    null for fewer than two rays or (nearly) parallel ones."""
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in direction), F.lit(0.0)))
    d = [F.col(c) / size for c in direction]
    o = [F.col(c) for c in origin]
    a = {(i, j): (1.0 if i == j else 0.0) - d[i] * d[j] for i in range(3) for j in range(i, 3)}
    at = lambda i, j: a[min(i, j), max(i, j)]
    b = [sum((at(i, j) * o[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    sums = df.where(size > 0).groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_a{i}{j}") for (i, j), c in a.items()], *[F.sum(c).alias(f"_b{i}") for i, c in enumerate(b)])
    m = [[F.col(f"_a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    rhs = [F.col(f"_b{i}") for i in range(3)]
    det3 = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    det = det3(m)
    good = (F.col("n") >= 2) & (det > least * F.pow(F.col("n"), F.lit(3.0)))
    solved = [F.when(good, det3([[rhs[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / det).alias(name) for k, name in enumerate("xyz")]
    return sums.select(key, "n", *solved)


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise from the lowest x (then y); one or two points as they are."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(order: np.ndarray) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def hull_areas(df: DataFrame, key: str, x: str, y: str, salts: int = 32) -> DataFrame:
    """Each key's convex hull: n_corners and area. The hull of a union is that of the hulls' corners, so a key is first cut into
    `salts` parts by hash, and only corners meet. Null coordinates are left out."""
    kind = dict(df.dtypes)[key]
    rows = df.dropna(subset=[x, y]).select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def part(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        c = hull(f[["x", "y"]].to_numpy())
        return pd.DataFrame({key: k[0], "x": c[:, 0], "y": c[:, 1]})

    def whole(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        c = hull(f[["x", "y"]].to_numpy())
        area = abs(float((c[:, 0] * np.roll(c[:, 1], -1) - c[:, 1] * np.roll(c[:, 0], -1)).sum())) / 2
        return pd.DataFrame({key: [k[0]], "n_corners": [len(c)], "area": [area]})

    parts = rows.withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).groupBy(key, "_s").applyInPandas(part, f"{key} {kind}, x double, y double")
    return parts.groupBy(key).applyInPandas(whole, f"{key} {kind}, n_corners long, area double")


def mode_within(df: DataFrame, key: str, value: str, radius: float, rounds: int = 8) -> DataFrame:
    """Each key's mode: from its median on, `rounds` times the median of the values within the radius of the last one."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    now = counted.groupBy(key).agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias("mode"))
    for _ in range(rounds):
        near = counted.join(now, key).where(F.abs(F.col(value) - F.col("mode")) <= radius)
        now = near.groupBy(key).agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias("mode"))
    return now


def better_side(sides: DataFrame, key: list[str], side: str, order: list[Column]) -> DataFrame:
    """Of each key's sides the first by `order`; the rows of its other sides go."""
    w = Window.partitionBy(*key).orderBy(*order, F.asc(side))
    return sides.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
