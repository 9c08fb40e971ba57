"""Shapes: oriented rectangles, rays and planes, rotations, polygons, rectangles on a screen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(x: Column, y: Column, width: Column, depth: Column, yaw: Column) -> Column:
    """The four corners of a rectangle turned by yaw (radians), counter-clockwise: array of struct(x, y)."""
    c, s = F.cos(yaw), F.sin(yaw)

    def corner(a: float, b: float) -> Column:
        u, v = width * a, depth * b
        return F.struct((x + u * c - v * s).alias("x"), (y + u * s + v * c).alias("y"))

    return F.array(corner(0.5, 0.5), corner(-0.5, 0.5), corner(-0.5, -0.5), corner(0.5, -0.5))


def turned_penetration(a: list[Column], b: list[Column]) -> Column:
    """How deep two turned rectangles (x, y, width, depth, yaw) lie in one another: the least overlap along the four
    directions of their sides; 0 where one of these separates them."""
    (ax, ay, aw, ad, at), (bx, by, bw, bd, bt) = a, b
    least = None
    for t in (at, at + math.pi / 2, bt, bt + math.pi / 2):
        reach = lambda w, d, own, t=t: (w * F.abs(F.cos(own - t)) + d * F.abs(F.sin(own - t))) / 2
        apart = F.abs((bx - ax) * F.cos(t) + (by - ay) * F.sin(t))
        over = reach(aw, ad, at) + reach(bw, bd, bt) - apart
        least = over if least is None else F.least(least, over)
    return F.greatest(least, F.lit(0.0))


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def ray_through_pixel(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """The direction of length 1 of a camera's ray through a pixel (y up, looking down -z)."""
    x, y = (u - cx) / fx, -(v - cy) / fy
    n = F.sqrt(x * x + y * y + 1)
    return [x / n, y / n, -1 / n]


def ray_plane(origin: list[Column], direction: list[Column], normal: list[Column], offset: Column, least: float = 1e-9) -> Column:
    """How far along a ray the plane (normal times point equals offset) lies; null for parallel ones or behind the origin."""
    dot = lambda a, b: sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))
    along = dot(normal, direction)
    t = (offset - dot(normal, origin)) / along
    return F.when((F.abs(along) > least) & (t >= 0), t)


def line_crossing(nx: Column, ny: Column, d: Column, mx: Column, my: Column, e: Column, least_sine: float) -> Column:
    """struct(x, y) where two lines (normal times point equals offset; normals of length 1) meet; null if they are too parallel."""
    det = nx * my - ny * mx
    return F.when(F.abs(det) >= least_sine, F.struct(((d * my - e * ny) / det).alias("x"), ((nx * e - mx * d) / det).alias("y")))


def rotation_about_axis(axis: list[Column], angle: Column) -> list[Column]:
    """The nine elements, row by row, of the rotation about an axis of length 1."""
    x, y, z = axis
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return [t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x, t * x * z - s * y, t * y * z + s * x, t * z * z + c]


def shortest_rotation(a: list[Column], b: list[Column]) -> list[Column]:
    """The quaternion (x, y, z, w) of the shortest rotation that takes the direction a to b (both of length 1, not opposite)."""
    ax, ay, az = a
    bx, by, bz = b
    x, y, z, w = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx, 1 + ax * bx + ay * by + az * bz
    n = F.sqrt(x * x + y * y + z * z + w * w)
    return [x / n, y / n, z / n, w / n]


def euler_matrix(x: Column, y: Column, z: Column) -> list[Column]:
    """The nine elements, row by row, of the rotation by angles about x, then y, then z."""
    cx, sx, cy, sy, cz, sz = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
    return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]


def carried(x: Column, y: Column, yaw: Column, old: list[Column], new: list[Column]) -> list[Column]:
    """A pose (x, y, yaw) that moves along with a carrier from one pose to another."""
    ox, oy, ot = old
    px, py, pt = new
    turn = pt - ot
    dx, dy = x - ox, y - oy
    return [px + dx * F.cos(turn) - dy * F.sin(turn), py + dx * F.sin(turn) + dy * F.cos(turn), yaw + turn]


def covered_share(a: list[Column], b: list[Column]) -> Column:
    """The share of the screen rectangle a (x0, y0, x1, y1) that b covers."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when((w > 0) & (h > 0) & (area > 0), w * h / area).otherwise(0.0)
