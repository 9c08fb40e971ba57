"""Scalar expressions: quaternions, projections, colours, keys and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*xs: Column) -> Column:
    out = F.lit(0.0)
    for x in xs:
        out = out + x * x
    return F.sqrt(out)


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product of (x, y, z, w) quaternions."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def quaternion_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two unit quaternions, whichever sign they have."""
    dot = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        dot = dot + x * y
    return F.degrees(2 * F.acos(F.least(F.abs(dot), F.lit(1.0))))


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a camera-space point (y up, looking down -z); null behind the camera."""
    ahead = F.when(z < 0, -z)
    return cx + fx * x / ahead, cy - fy * y / ahead


#: Fixed values of colour words. Rows: a word and the bounds below which it applies, of the hue in degrees counted from 345,
#: the saturation and the value (0 to 1; 2: no bound). The first row that fits gives the word.
COLOUR_WORDS = (
    ("black", 360, 2, 0.20), ("grey", 360, 0.18, 0.90), ("white", 360, 0.18, 2), ("brown", 65, 2, 0.45), ("red", 30, 2, 2), ("beige", 65, 0.40, 2), ("brown", 65, 2, 0.62), ("orange", 65, 2, 2),
    ("beige", 85, 0.40, 2), ("yellow", 85, 2, 2), ("green", 180, 2, 2), ("teal", 215, 2, 2), ("blue", 270, 2, 2), ("purple", 305, 2, 2), ("pink", 360, 2, 2),
)
#: Words that never tell pieces apart, and what the others need to do so.
NEVER_NAMED, BLACK_TO_NAME, WHITE_TO_NAME, SATURATION_TO_NAME = ("grey", "beige"), 0.15, 0.92, 0.35


def hex_rgb(text: Column) -> list[Column]:
    """Red, green and blue (0 to 1) of #rrggbb; null for anything else."""
    clean = F.regexp_replace(F.trim(text), "^#+", "")
    good = F.when(clean.rlike("^[0-9A-Fa-f]{6}$"), clean)
    return [F.conv(F.substring(good, k, 2), 16, 10).cast("int") / 255.0 for k in (1, 3, 5)]


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees (0 without colour), saturation and value of red, green and blue."""
    top, spread = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sixth = F.when(spread == 0, 0.0).when(top == r, F.pmod((g - b) / spread, F.lit(6.0))).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    return sixth * 60, F.when(top == 0, 0.0).otherwise(spread / top), top


def colour_reading(r: Column, g: Column, b: Column) -> Column:
    """struct(word, nameable): one of thirteen words, and whether it is far enough from the others to tell a piece by; null for nulls."""
    hue, saturation, value = hsv(r, g, b)
    turned = F.pmod(hue + 15, F.lit(360.0))
    word = F.coalesce(*[F.when((turned < h) & (saturation < s) & (value < v), name) for name, h, s, v in COLOUR_WORDS])
    named = F.when(word.isin(*NEVER_NAMED), False).when(word == "black", value <= BLACK_TO_NAME).when(word == "white", value >= WHITE_TO_NAME).otherwise(saturation >= SATURATION_TO_NAME)
    return F.when(word.isNotNull(), F.struct(word.alias("word"), named.alias("nameable")))


def content_key(*parts: Column) -> Column:
    """sha256 of canonical JSON of the parts: the same values give the same key."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
