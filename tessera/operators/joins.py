"""Joins: overlays, missing rows, gaps, nearest neighbours, rectangles, polygons, tiers and closures.

Distance and overlap joins bin both sides into cells, so that a row meets the rows of its own and the
neighbouring cells only; none is a cross join of its tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from .graphs import connected_components
from .sequences import top_one


def overlay(base: DataFrame, entries: DataFrame, key: str, order: list[str], op: str, value: str) -> DataFrame:
    """Applies one entry for each key, the last by `order`: `remove` drops the base row, any other op
    replaces `value` where the entry has one. Base rows without an entry stay as they are."""
    last = top_one(entries, [key], [F.desc(o) for o in order]).select(key, F.col(op).alias("_op"), F.col(value).alias("_value"))
    out = base.join(last, key, "left").where(F.coalesce(F.col("_op") != "remove", F.lit(True)))
    return out.withColumn(value, F.coalesce("_value", value)).withColumn("op", F.coalesce("_op", F.lit("keep"))).drop("_op", "_value")


def orphaned(entries: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Entries with a flag: no base row has their key. None is dropped."""
    known = base.select(key).distinct().withColumn("_known", F.lit(True))
    return entries.join(known, key, "left").withColumn("orphaned", F.col("_known").isNull()).drop("_known")


def hand_overs(df: DataFrame, kind: str, ident: str, first: str, last: str, most_gap: int) -> DataFrame:
    """Pairs of rows of one kind where b begins within 0 < gap <= most_gap after a ends. Both sides are
    binned by the gap's width, so each a meets two bins of b."""
    a = df.select(kind, F.col(ident).alias("a"), F.col(last).alias("_end"))
    a = a.withColumn("_bin", F.explode(F.array(F.floor(F.col("_end") / most_gap), F.floor(F.col("_end") / most_gap) + 1)))
    b = df.select(kind, F.col(ident).alias("b"), F.col(first).alias("_begin"), F.floor(F.col(first) / most_gap).alias("_bin"))
    gap = F.col("_begin") - F.col("_end")
    return a.join(b, [kind, "_bin"]).where((F.col("a") != F.col("b")) & (gap > 0) & (gap <= most_gap)).select(kind, "a", "b", gap.alias("gap"))


def greedy_claims(pairs: DataFrame, claimant: list[str], order: list[Column]) -> DataFrame:
    """Each claimant's first pair by `order`; what is claimed may be claimed by many."""
    return top_one(pairs, claimant, order)


def purity(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """The most frequent label of each group (ties: the least), its share, and the group's rows."""
    n = df.groupBy(*group, label).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    n = n.withColumn("claimed", F.sum("_n").over(w))
    return top_one(n, group, [F.desc("_n"), F.asc(label)]).select(*group, F.col(label).alias("dominant"), F.col("_n").alias("dominant_n"), "claimed", (F.col("_n") / F.col("claimed")).alias("purity"))


def within(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, reach: float, on: list[str] | None = None) -> DataFrame:
    """Pairs no further apart than `reach`, with distance: the left side enters the nine cells around
    it, the right one its own. The join is by sorted shuffles whatever the sides' estimated sizes: nine rows for each left one
    and the compression of files are not in these, and a side that is broadcast goes through the driver whole."""
    on = on or []
    near = F.array(*[F.struct((F.floor(F.col(lx) / reach) + i).alias("_cx"), (F.floor(F.col(ly) / reach) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumn("_c", F.explode(near)).select("*", "_c._cx", "_c._cy").drop("_c")
    b = right.withColumn("_cx", F.floor(F.col(rx) / reach)).withColumn("_cy", F.floor(F.col(ry) / reach))
    d = F.sqrt((F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2)
    return a.join(b.hint("merge"), [*on, "_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= reach).drop("_cx", "_cy")


def overlapping(df: DataFrame, ident: str, cell: float, on: list[str] | None = None) -> DataFrame:
    """Pairs a < b of axis-parallel rectangles (x0, y0, x1, y1) with a common area, and its depth. A
    rectangle enters every cell that it covers; a pair is kept in the first cell that both enter."""
    on = on or []
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    c = df.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))
    a = c.select(*on, "_cx", "_cy", *[F.col(x).alias(f"a_{x}") for x in (ident, "x0", "y0", "x1", "y1")])
    b = c.select(*on, "_cx", "_cy", *[F.col(x).alias(f"b_{x}") for x in (ident, "x0", "y0", "x1", "y1")])
    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    here = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("_cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("_cy"))
    return a.join(b, [*on, "_cx", "_cy"]).where((F.col(f"a_{ident}") < F.col(f"b_{ident}")) & (w > 0) & (h > 0) & here).select(*on, F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b"), F.least(w, h).alias("depth"), (w * h).alias("area"))


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule: an odd number of the polygon's edges cross the ray to the right of the point."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y0 != y1:
            cross = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            crossings = crossings + cross.cast("int")
    return crossings % 2 == 1


def nearest_with_margin(pairs: DataFrame, anchor: str, candidate: str, distance: str, margin: float) -> DataFrame:
    """For each anchor its nearest candidate if the second is further by at least `margin` (or there is no
    second), and its furthest likewise: rows (anchor, candidate, distance, is_far)."""
    w = Window.partitionBy(anchor)
    near, far = w.orderBy(F.asc(distance), F.asc(candidate)), w.orderBy(F.desc(distance), F.desc(candidate))
    n = pairs.withColumn("_r", F.row_number().over(near)).withColumn("_g", F.lead(distance).over(near) - F.col(distance)).where("_r = 1").withColumn("is_far", F.lit(False))
    f = pairs.withColumn("_r", F.row_number().over(far)).withColumn("_g", F.col(distance) - F.lead(distance).over(far)).where("_r = 1").withColumn("is_far", F.lit(True))
    return n.unionByName(f).where(F.coalesce(F.col("_g"), F.lit(margin)) >= margin).select(anchor, candidate, distance, "is_far")


def tiered_lookup(asked: DataFrame, ask: str, tiers: list[DataFrame]) -> DataFrame:
    """tiers: tables (name, target). The first tier with hits decides; several targets there are a
    refusal. Returns every asked value once, with tier, target (null if refused or missing), hits."""
    q = asked.select(ask).distinct()
    found = None
    for k, t in enumerate(tiers):
        hit = q.join(t, q[ask] == t["name"]).select(ask, F.lit(k).alias("tier"), "target").distinct()
        found = hit if found is None else found.unionByName(hit)
    n = found.groupBy(ask, "tier").agg(F.count("*").alias("hits"), F.min("target").alias("target"))
    first = top_one(n, [ask], [F.asc("tier")])
    return q.join(first, ask, "left").select(ask, "tier", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("target")).alias("target"))


def uncovered(spans: DataFrame, cuts: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """Each key's span (lo, hi) without its cuts (cut_lo, cut_hi): the free intervals. A running maximum
    of the cuts' ends, in order, gives where the next free interval may begin."""
    edge = spans.select(*key, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    c = cuts.join(edge, key).select(*key, F.greatest("cut_lo", "_lo").alias("a"), F.least("cut_hi", "_hi").alias("b")).where("a < b")
    stops = c.unionByName(edge.select(*key, F.col("_hi").alias("a"), F.col("_hi").alias("b")))
    w = Window.partitionBy(*key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    free = stops.withColumn("_seen", F.max("b").over(w)).join(edge, key)
    return free.select(*key, F.greatest(F.coalesce("_seen", "_lo"), "_lo").alias("free_lo"), F.col("a").alias("free_hi")).where("free_lo < free_hi")


def trimmed_rms(pairs: DataFrame, key: list[str], point: str, distance: str, fraction: float, least: int = 3) -> DataFrame:
    """Of each point's least distance, the smallest max(least, floor(n * fraction)) of a key: their root
    mean square; null below `least` points."""
    d = pairs.groupBy(*key, point).agg(F.min(distance).alias("d"))
    w = Window.partitionBy(*key)
    d = d.withColumn("_r", F.row_number().over(w.orderBy("d", point))).withColumn("_n", F.count("*").over(w))
    keep = F.col("_r") <= F.greatest(F.lit(least), F.floor(F.col("_n") * fraction))
    return d.groupBy(*key).agg(F.max("_n").alias("n"), F.when(F.max("_n") >= least, F.sqrt(F.avg(F.when(keep, F.col("d") ** 2)))).alias("rms"))


def closure(edges: DataFrame, child: str, parent: str, most_depth: int = 1 << 20) -> DataFrame:
    """All (child, ancestor, depth) of a hierarchy, the least depth of each pair, by doubling the paths: log2(depth) joins, each written
    to the shared folder. A cycle, or a path of more than most_depth steps, is an error. Nulls and repeated edges count as none and one."""
    paths = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).dropna().distinct(), "paths")
    reach, n = 1, paths.count()
    while True:
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        after = written(paths.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "paths")
        discard(paths)
        paths, reach = after, reach * 2
        found, loops, deepest = paths.agg(F.count("*"), F.count_if(F.col("node") == F.col("ancestor")), F.max("depth")).first()
        if loops or (deepest or 0) > most_depth:
            raise ValueError("the hierarchy has a cycle" if loops else f"the hierarchy is deeper than {most_depth}")
        if found == n:
            return paths
        n = found


def exact_or_unique_prefix(asked: DataFrame, ask: str, names: DataFrame, name: str, least: int, most_lengths: int = 1000) -> DataFrame:
    """The name that equals what is asked, else the only one that begins with it, else null. Questions of fewer than
    `least` characters find nothing by prefix. Each name is counted under its prefixes of the lengths that are asked
    for (at most `most_lengths` of them, else it is an error); the counts, not the names, meet the questions."""
    q = asked.select(ask).distinct()
    known = names.select(F.col(name).alias("_name")).distinct()
    lengths = [r[0] for r in q.where(F.length(ask) >= least).select(F.length(ask)).distinct().limit(most_lengths + 1).collect()]
    if len(lengths) > most_lengths:
        raise ValueError(f"questions of over {most_lengths} lengths")
    at = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("_name"))
    cut = known.select("_name", F.explode(F.transform(at, lambda n: F.substring(F.col("_name"), F.lit(1), n))).alias("_p"))
    only = cut.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_name").alias("_only")).where("_n = 1").select(F.col("_p").alias(ask), "_only")
    exact = q.join(known.withColumn(ask, F.col("_name")), ask, "left")
    return exact.join(only, ask, "left").select(ask, F.coalesce("_name", "_only").alias("found"))


def nested_sets(members: DataFrame, key: str, item: str, share: int, of: int, block: int = 1024) -> DataFrame:
    """Edges (a, b) that join all keys of which one holds at least share/of of the other's items; members:
    distinct (key, item). Keys of equal sets are joined to their least key, which alone meets the others.
    A set that shares enough with a larger one has one of its own n - need + 1 rarest items in common with
    it: only blocks of about `block` sets that do share such an item meet, a pair of blocks a task, and count in full. So no pair of
    sets is a row until it is an edge; what is sent is each block for each that it meets, the square of the sets where all meet."""
    often = written(members.groupBy(item).agg(F.count("*").alias("_n")).withColumn("_id", F.monotonically_increasing_id()), "items")
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("_n", "_id"))), lambda x: x["_id"])
    sets = written(members.join(often, item).groupBy(key).agg(ranked.alias("_s")), "sets")
    least = written(sets.groupBy("_s").agg(F.min(key).alias("u")), "distinct-sets")
    equal = sets.join(least, "_s").select(F.col(key).alias("a"), F.col("u").alias("b")).where("a != b")
    need = F.ceil(F.size("_s") * share / of).cast("int")
    blocks = max(math.ceil(least.count() / block), 1)
    least = least.select("u", "_s", need.alias("need"), F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("at"))
    rare = least.select(F.col("at").alias("p"), F.explode(F.slice("_s", F.lit(1), F.size("_s") - F.col("need") + 1)).alias("_i")).distinct()
    held = least.select(F.col("at").alias("q"), F.explode("_s").alias("_i")).distinct()
    meet = written(rare.join(held, "_i").select("p", "q").distinct(), "blocks")
    side = lambda at: meet.join(least.withColumnRenamed("at", at), at).select(*[F.col(c).alias(c) for c in ("p", "q", "u", "_s", "need")]).groupBy("p", "q")
    kind = dict(members.dtypes)[key]
    found = side("p").cogroup(side("q")).applyInPandas(_nested_pairs, f"a {kind}, b {kind}")
    return found.unionByName(equal)


def _nested_pairs(small: pd.DataFrame, large: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of one block's sets with another's, b larger (ties: the later key), that share what a needs; so many items at a time."""
    na, nb = small["_s"].map(len).to_numpy(), large["_s"].map(len).to_numpy()
    ia, ib = np.concatenate(small["_s"].to_numpy()), np.concatenate(large["_s"].to_numpy())
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    both = np.intersect1d(ia, ib)
    ca, cb = (np.where(np.isin(i, both), np.searchsorted(both, i), -1) for i in (ia, ib))
    shared = np.zeros((len(na), len(nb)), dtype=np.float32)  # whole numbers below 2^24
    for lo in range(0, len(both), 4096):
        bits = []
        for c, r, n in ((ca, ra, len(na)), (cb, rb, len(nb))):
            here = (c >= lo) & (c < lo + 4096)
            m = np.zeros((n, min(4096, len(both) - lo)), dtype=np.float32)
            m[r[here], c[here] - lo] = 1
            bits.append(m)
        shared += bits[0] @ bits[1].T
    a, b = small["u"].to_numpy(), large["u"].to_numpy()
    later = (nb[None, :] > na[:, None]) | ((nb[None, :] == na[:, None]) & (b[None, :] > a[:, None]))
    i, j = np.nonzero(later & (shared >= small["need"].to_numpy()[:, None]))
    return pd.DataFrame({"a": a[i], "b": b[j]})


def components(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each node with the least node that it reaches; nodes without an edge are components of their own."""
    found = connected_components(edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))).withColumnRenamed("node", node)
    return nodes.select(node).join(found.hint("merge"), node, "left").select(node, F.coalesce("component", node).alias("component"))


def chain_groups(df: DataFrame, key: list[str], value: str, ident: str, most_gap: float) -> DataFrame:
    """Groups of each key's rows whose values form a chain of steps of at most `most_gap`, named by the least id: component,
    members, mean of the values. Rows of one value are one step, so the windows hold distinct values, not rows. Null values
    are in no group."""
    steps = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(ident).alias("_i"), F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > most_gap).cast("long"), F.lit(0))
    run = steps.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    total = F.sum(F.col(value) * F.col("_n"))
    return run.groupBy(*key, "_g").agg(F.min("_i").alias("component"), F.sum("_n").alias("members"), (total / F.sum("_n")).alias("mean")).drop("_g")
