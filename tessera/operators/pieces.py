"""Pieces of points that hang together in space, and the one that an observer means."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from .graphs import connected_components

#: Cells of a tile along an axis: a tile has at most TILE ** 3 cells, which one task labels.
TILE = 16
AXES = ("cx", "cy", "cz")
#: Cells along an axis of the smaller tiles in which loose cells meet the linking ones of their tile and around it.
NEAR = 4
#: The cells around one, those of the least cz first, then of the least cy.
AROUND = [(x, y, z) for z, y, x in product((-1, 0, 1), repeat=3) if (x, y, z) != (0, 0, 0)]


def _shifted(shifts: list[tuple[int, int, int]]) -> Column:
    """An array of the cells at the shifts, each with its place in the list."""
    return F.array(*[F.struct(F.lit(k).alias("turn"), *[(F.col(a) + d).alias(a) for a, d in zip(AXES, s, strict=True)]) for k, s in enumerate(shifts)])


def _within_tiles(cells: DataFrame, key: list[str]) -> DataFrame:
    """Each cell's root: the least cell that it reaches within its tile. A task reads its tiles one after another; it holds a batch
    of rows, and the last tile's until they are all there."""
    tiles = [f"t{a}" for a in AXES]

    def roots(rows: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        cells = list(zip(at, rows["cx"], rows["cy"], rows["cz"], strict=True))
        todo, found = set(cells), {}
        for first in sorted(todo):
            if first not in todo:
                continue
            todo.remove(first)
            edge = [first]
            while edge:
                t, x, y, z = c = edge.pop()
                found[c] = first
                for dx, dy, dz in AROUND:
                    to = (t, x + dx, y + dy, z + dz)
                    if to in todo:
                        todo.remove(to)
                        edge.append(to)
        return rows[[*key, *AXES]].assign(**{f"r{a}": [found[c][j + 1] for c in cells] for j, a in enumerate(AXES)})

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            rows = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(rows):
                continue
            at = (rows[[*key, *tiles]] != rows[[*key, *tiles]].shift()).any(axis=1).cumsum().to_numpy()
            whole = int(at.searchsorted(at[-1]))
            rest = rows.iloc[whole:]
            if whole:
                yield roots(rows.iloc[:whole], at[:whole].tolist())
        if rest is not None and len(rest):
            yield roots(rest, [0] * len(rest))

    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, *AXES]) + ", rcx long, rcy long, rcz long"
    dealt = cells.select(*key, *AXES, *[F.floor(F.col(a) / TILE).alias(t) for a, t in zip(AXES, tiles, strict=True)]).repartition(*key, *tiles).sortWithinPartitions(*key, *tiles)
    return dealt.mapInPandas(label, schema).select(*key, *AXES, F.struct("rcx", "rcy", "rcz").alias("root"))


def cell_pieces(cells: DataFrame, key: list[str]) -> DataFrame:
    """cells: distinct (key.., cx, cy, cz), whole numbers, no nulls. Adds root: the least cell (by cx, cy, cz) of the cells of its key that
    hang together with it by faces, edges or corners.

    Tiles of bounded size are labelled each within a task; only pieces that meet across a seam become edges of a graph, whose components are
    found by rounds. So a piece of any size is gathered nowhere. No cells give no rows."""
    local = written(_within_tiles(cells, key), "tiles")
    border = F.lit(False)
    for a in AXES:
        border = border | F.pmod(a, F.lit(TILE)).isin(0, TILE - 1)
    half = [s for s in AROUND if s > (0, 0, 0)]
    node = F.struct(*key, "root")
    reach = local.where(border).select(*key, F.struct(*[F.floor(F.col(a) / TILE) for a in AXES]).alias("tile"), node.alias("a"), F.explode(_shifted(half)).alias("to"))
    reach = reach.select(*key, "tile", "a", *[F.col("to")[a].alias(a) for a in AXES]).where(F.struct(*[F.floor(F.col(a) / TILE) for a in AXES]) != F.col("tile"))
    seams = reach.join(local.where(border).hint("merge"), [*key, *AXES]).select("a", node.alias("b")).distinct()
    whole = connected_components(seams, "a", "b").select(F.col("node")["root"].alias("root"), *[F.col("node")[c].alias(c) for c in key], F.col("component")["root"].alias("whole"))
    return local.join(whole.hint("merge"), [*key, "root"], "left").select(*key, *AXES, F.coalesce("whole", "root").alias("root"))


def _cell_codes(cells: DataFrame) -> tuple[Callable[..., Column], Callable[[Column], list[Column]]]:
    """(pack, unpack): a cell's three numbers as one, and back. Codes are ordered like (cx, cy, cz); they are numbers of 64 bits where the
    ranges of all cells allow, else structs."""
    ends = cells.agg(*[f(a) for a in AXES for f in (F.min, F.max)]).first()
    lo = [v or 0 for v in ends[::2]]
    _, ny, nz = wide = [(h or 0) - v + 1 for v, h in zip(lo, ends[1::2], strict=True)]
    if wide[0] * ny * nz >= 1 << 62:
        return (lambda *c: F.struct(*[x.alias(a) for x, a in zip(c, AXES, strict=True)])), (lambda c: [c[a] for a in AXES])
    # the differences first: the product of the ranges bounds the code, not the numbers themselves
    div = lambda a, n: F.call_function("div", a, F.lit(n).cast("long"))
    pack = lambda x, y, z: ((x - lo[0]) * ny + (y - lo[1])) * nz + (z - lo[2])
    return pack, lambda c: [div(c, ny * nz) + lo[0], div(c, nz) % ny + lo[1], c % nz + lo[2]]


def _joined_to_neighbours(loose: DataFrame, linked: DataFrame, key: list[str]) -> DataFrame:
    """loose: (key.., code, n, cx, cy, cz), linked: (key.., root, cx, cy, cz) -> (key.., code, n, root): the root of the first linked cell around
    each loose one (by z, y, x), else its own code."""
    tiles = [f"t{a}" for a in AXES]
    near = linked.select(*[F.col(c).alias(f"l{c}") for c in key], "root", *[F.col(a).alias(f"l{a}") for a in AXES])
    for a, t in zip(AXES, tiles, strict=True):
        near = near.withColumn(f"l{t}", F.explode(F.sequence(F.floor((F.col(f"l{a}") - 1) / NEAR), F.floor((F.col(f"l{a}") + 1) / NEAR))))
    own = loose.withColumns({t: F.floor(F.col(a) / NEAR) for a, t in zip(AXES, tiles, strict=True)})
    meet = F.lit(True)
    for c in [*key, *tiles]:
        meet = meet & (F.col(c) == F.col(f"l{c}"))
    dx, dy, dz = [F.col(f"l{a}") - F.col(a) for a in AXES]
    for d in (dx, dy, dz):
        meet = meet & d.between(-1, 1)
    # grouped by what the join is dealt by, and more: no further shuffle
    found = own.join(near.hint("merge"), meet, "left").groupBy(*key, *tiles, "code", "n").agg(F.min_by("root", dz * 9 + dy * 3 + dx).alias("root"))
    return found.select(*key, "code", "n", F.coalesce("root", "code").alias("root"))


def connected_object(
    points: DataFrame, key: list[str], point: str, at: tuple[str, str, str], depth: str, sheet: str, cell: float, substantial: float = 0.5, linking: int = 2,
) -> DataFrame:
    """(key.., point) of the points of each key (a frame) that belong to its object: the nearest piece of points among those of
    at least `substantial` times the points of the largest one (by the upper median of depth; ties: the least first cell), and the
    pieces at least half of whose points lie over or under it, a cell's width allowed.

    at: x, y (upwards) and z. A cell links its 26 neighbours when it holds `linking` points that are not of a sheet; another one
    joins the first linking neighbour's piece (by z, y, x) and joins no two pieces. A null sheet is none. Rows with a null in key, point,
    coordinates or depth, or a NaN or infinity there, are left out; repeated rows are points of their own. No rows give no rows.

    A cell is sent as one number where the range of all cells allows. A loose cell goes to its small tile once, a linking one to the tiles that it
    touches, so what is sent grows with the cells; no side is broadcast. Points are sent three times: to their cells, their pieces and what is kept.
    """
    named = [f"k{j}" for j in range(len(key))]
    good = F.lit(True)
    for c in [*at, depth]:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    for c in [*key, point]:
        good = good & F.col(c).isNotNull()
    cells_at = [F.floor(F.col(c).cast("double") / cell).cast("long").alias(a) for c, a in zip(at, AXES, strict=True)]
    p = points.where(good).select(*[F.col(c).alias(n) for c, n in zip(key, named, strict=True)], F.col(point).alias("point"), *cells_at, F.col(depth).alias("depth"), F.coalesce(F.col(sheet), F.lit(False)).alias("sheet"))
    pack, unpack = _cell_codes(p)
    p = p.select(*named, "point", pack(*[F.col(a) for a in AXES]).alias("code"), "depth", "sheet")
    cells = written(p.groupBy(*named, "code").agg(F.count("*").alias("n"), F.count_if(~F.col("sheet")).alias("solid")), "cells")
    axes = [c.alias(a) for c, a in zip(unpack(F.col("code")), AXES, strict=True)]
    solid = cells.where(F.col("solid") >= linking)
    linked = cell_pieces(solid.select(*named, *axes), named).select(*named, pack(*[F.col(a) for a in AXES]).alias("code"), pack(*[F.col("root")[f"r{a}"] for a in AXES]).alias("root"))
    linked = written(solid.select(*named, "code", "n").join(linked.hint("merge"), [*named, "code"]), "linked")
    loose = cells.where(F.col("solid") < linking).select(*named, "code", "n", *axes)
    placed = written(linked.unionByName(_joined_to_neighbours(loose, linked.select(*named, "root", *axes), named)), "pieces")

    rooted = written(p.select(*named, "point", "code", "depth").join(placed.select(*named, "code", "root").hint("merge"), [*named, "code"]).select(*named, "root", "depth", "point"), "rooted")
    size = placed.groupBy(*named, "root").agg(F.sum("n").alias("size"))
    turn = F.row_number().over(Window.partitionBy(*named, "root").orderBy("middle"))
    median = rooted.select(*named, "root", F.col("depth").alias("middle")).withColumn("turn", turn).join(size.hint("merge"), [*named, "root"])
    median = written(median.where(F.col("turn") == F.floor(F.col("size") / 2) + 1).drop("turn"), "medians")
    most = median.groupBy(*named).agg(F.max("size").alias("most"))
    chosen = median.join(most.hint("merge"), named).where(F.col("size") >= F.lit(substantial) * F.col("most")).groupBy(*named).agg(F.min_by("root", F.struct("middle", "root")).alias("chosen"))
    chosen = written(chosen, "chosen")
    known = placed.join(chosen.hint("merge"), named).select(*named, "root", "chosen", "n", *[axes[k] for k in (0, 2)])
    flat = F.array(*[F.struct((F.col("cx") + x).alias("cx"), (F.col("cz") + z).alias("cz")) for x in (-1, 0, 1) for z in (-1, 0, 1)])
    footprint = known.where("root = chosen").select(*named, F.explode(flat).alias("f")).select(*named, "f.cx", "f.cz").distinct()
    over = known.where("root != chosen").join(footprint.hint("merge"), [*named, "cx", "cz"]).groupBy(*named, "root").agg(F.sum("n").alias("over"))
    kept = over.join(median.select(*named, "root", "size").hint("merge"), [*named, "root"]).where(F.col("over") * 2 >= F.col("size")).select(*named, "root")
    kept = kept.unionByName(chosen.select(*named, F.col("chosen").alias("root")))
    out = rooted.select(*named, "root", "point").join(kept.hint("merge"), [*named, "root"], "left_semi")
    out = written(out.select(*[F.col(n).alias(c) for n, c in zip(named, key, strict=True)], F.col("point").alias(point)), "object")
    discard(cells, linked, placed, rooted, median, chosen)
    return out
