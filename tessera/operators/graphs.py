"""Connected components of an edge table, by alternating large-star and small-star steps; orders of dependents by doubling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _linked_to_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(u, v) -> (u, v, m), m the least of u and its v. The minima are written first, so
    that both join sides are plain exchanges, which Spark can split where one u has very many v, and never a broadcast: files of
    ids are far smaller than their rows in the driver."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return pairs.join(least.hint("merge"), "u"), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """Returns (node, component): for each node of an edge the least node that it reaches.

    Nulls and self-loops are no edges; repeated and reversed edges count once. No edges: no rows.
    Each round leaves every node nearer to its least neighbour, so rounds grow with the logarithm
    of the nodes; each is written to the shared folder, and only counts and one digest of the edges come
    to the driver. If they have not settled after `most_rounds`, that is an error.
    """
    u, v = F.col(src), F.col(dst)
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    state = _digest(now)
    for _ in range(most_rounds if state[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _linked_to_least(both)
        large = written(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        discard(least, now)
        joined, least = _linked_to_least(large)
        star = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(star.where("u > v").distinct(), "small")
        discard(least, large)
        before, state = state, _digest(now)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError("the components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def dependency_order(nodes: DataFrame, node: str, target: str, pos: str) -> DataFrame:
    """Rows after what they depend on: (node, level, needed, refusal). node: distinct and not null; target: the node that it
    stands on, or null; pos: the order of input. level: how many rows it stands on in turn; needed: the least pos of the row and of all
    that stand on it. The order (needed, level) is that of a visit in input order that goes to each row's targets
    first. refusal: `missing` (the row or one below it names no row), `cycle` (it stands on itself, or on a row that
    does); level and needed are null there.

    Pointers are doubled, so that rounds are the logarithm of the longest chain; each is written to the shared folder. No side
    is broadcast, so that the driver gets no rows.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(target).alias("up"), F.col(pos).alias("needed"))
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    rows = rows.join(known.hint("merge"), "up", "left").withColumn("missing", F.col("up").isNotNull() & F.col("known").isNull())
    now = rows.select("node", F.when(~F.col("missing"), F.col("up")).alias("up"), "missing", "needed")
    now = written(now.withColumn("level", F.col("up").isNotNull().cast("long")), "pointers")
    n = now.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        if now.where("up IS NOT NULL").isEmpty():
            break
        below = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("missing").alias("m"), F.col("level").alias("l"))
        above = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.min("needed").alias("above"))
        step = now.join(below.hint("merge"), "up", "left").join(above.hint("merge"), "node", "left")
        after = step.select("node", F.col("next").alias("up"), (F.col("missing") | F.coalesce("m", F.lit(False))).alias("missing"), F.least("needed", "above").alias("needed"), (F.col("level") + F.coalesce("l", F.lit(0))).alias("level"))
        after = written(after, "pointers")
        discard(now)
        now = after
    refusal = F.when(F.col("up").isNotNull(), "cycle").when(F.col("missing"), "missing")
    return now.select(F.col("node").alias(node), F.when(refusal.isNull(), F.col("level")).alias("level"), F.when(refusal.isNull(), F.col("needed")).alias("needed"), refusal.alias("refusal"))
