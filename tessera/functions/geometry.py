"""Geometry expressions: angles, colour spaces, voxels, distances to lines and paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import cumulated


def wrapped(angle: Column) -> Column:
    """An angle in [-pi, pi], as the remainder to the nearest whole turn (halves to even)."""
    return angle - 2 * math.pi * F.rint(angle / (2 * math.pi))


def srgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE L*a*b* (D65) of sRGB in 0..255."""
    line = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    lr, lg, lb = line(r), line(g), line(b)
    x = (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047
    y = 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb
    z = (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    return [116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))]


def voxel(x: Column, size: float) -> Column:
    return F.floor(x / size)


def signed_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Of a point to the line through two points, positive on its left; null for no line."""
    length = F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
    return ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / F.nullif(length, F.lit(0.0))


def refuted(seen_through: Column, support: Column, inside: Column, outside: Column) -> Column:
    return ((seen_through >= 2) & (seen_through > support)) | ((inside + outside >= 3) & (outside > inside))


def gap_groups(df: DataFrame, key: list[str], value: str, least: float, share: float) -> DataFrame:
    """The largest group of a key's values, where sorted values part at a gap over max(least, share *
    the value before); ties: the first group."""
    w = Window.partitionBy(*key).orderBy(value)
    before = F.lag(value).over(w)
    g = df.withColumn("_new", F.when(before.isNull() | (F.col(value) - before > F.greatest(F.lit(least), share * before)), 1).otherwise(0))
    g = g.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = g.groupBy(*key, "_g").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), F.asc("_g")))
    return n.withColumn("_r", r).where("_r = 1").drop("_r", "_g")


def trimmed_range(df: DataFrame, key: list[str], value: str, weight: str, trim: float) -> DataFrame:
    """The first value from either end whose cumulative weight is strictly over trim * total."""
    down = F.col("_all") - F.col("_cum") + F.col("_w")
    s = cumulated(df, key, value, weight)
    return s.groupBy(*key).agg(F.min(F.when(F.col("_cum") > trim * F.col("_all"), F.col(value))).alias("low"), F.max(F.when(down > trim * F.col("_all"), F.col(value))).alias("high"))


def grid_heading(df: DataFrame, key: list[str], angle: str, length: str) -> DataFrame:
    """The length-weighted mean direction of walls modulo a quarter turn, in degrees 0..90."""
    s, c = F.sum(F.sin(4 * F.radians(angle)) * F.col(length)), F.sum(F.cos(4 * F.radians(angle)) * F.col(length))
    return df.groupBy(*key).agg(F.pmod(F.degrees(F.atan2(s, c)) / 4, F.lit(90.0)).alias("heading"))


def laplacian_variance(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Population variance of the second difference; null below three values."""
    w = Window.partitionBy(*key).orderBy(*order)
    second = F.lag(value).over(w) + F.lead(value).over(w) - 2 * F.col(value)
    return df.select(*key, second.alias("_d")).groupBy(*key).agg(F.var_pop("_d").alias("variance"))


def path_lengths(df: DataFrame, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """The length along a path up to each of its points."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2)
    out = df.withColumn("_s", F.coalesce(step, F.lit(0.0)))
    return out.withColumn("along", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
