"""One-to-one matching and nearest neighbours, by rounds over what is still open."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def greedy_matching(edges: DataFrame, left: str, right: str, order: list[Column], most_rounds: int = 100) -> DataFrame:
    """The edges that a serial greedy takes in ascending `order` (ties: least left, then right), each end in one edge at most.

    A round takes every edge that is the first of both its ends, and drops the others of these ends: what the serial greedy
    would have taken is the same. Rounds grow with the longest chain of edges that wait for each other, commonly with the
    logarithm of the edges; each is written to the shared folder. Where edges are open after `most_rounds`, that is an
    error. Null ends match nothing; of repeated edges the first counts; nulls in the order come first.
    """
    o = _free(edges, "o")
    open_ = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn(o, F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r")))
    open_ = written(open_, "open-edges")
    taken = []
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        first = [open_.groupBy(end).agg(F.min(o).alias(o)).select(o) for end in (left, right)]
        best = written(first[0].intersect(first[1]), "best-edges")
        rows = open_.join(best, o, "left_semi").dropDuplicates([left, right])
        taken.append(written(rows.drop(o), "matched"))
        rest = open_.join(best.select(F.col(f"{o}.l").alias(left)), left, "left_anti").join(best.select(F.col(f"{o}.r").alias(right)), right, "left_anti")
        after = written(rest, "open-edges")
        discard(open_, best)
        open_ = after
    else:
        if not open_.isEmpty():
            raise RuntimeError(f"edges are open after {most_rounds} rounds")
    out = open_.drop(o)
    for part in taken:
        out = out.unionByName(part)
    return out.select(*edges.columns)


def nearest(left: DataFrame, ident: str, right: DataFrame, other: str, at: list[str], on: list[str], most_rounds: int = 64) -> DataFrame:
    """For each row of left the exactly nearest row of right with the same `on`, by the coordinates `at` that both have:
    (on.., ident, other, distance), ties by the least `other`; nulls where right has none, or a coordinate is null or not finite.

    Cells are as wide as a key's points lie apart on average. Who finds a row within a cell's width among the neighbouring cells
    has its nearest one; the others go on with cells twice as wide, until those of a key hold all of its points. Few rows go
    far, if most have others near; a left side that lies wholly apart from the right one meets all of it, and costs the
    product of both within its key. All joins are sorted shuffles, whose memory is a task's, and spills.
    """
    finite = lambda df: df.dropna(subset=[*at, *on]).where(F.forall(F.array(*[F.col(c).cast("double") for c in at]), lambda x: F.abs(x) < float("inf")))
    points = [F.struct(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(at)]).alias("p")]
    b = written(finite(right).select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(on)], F.col(other).alias("b"), *points), "right-points")
    a = finite(left).select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(on)], F.col(ident).alias("a"), *points)
    keys, dims = [f"k{j}" for j in range(len(on))], range(len(at))
    spread = b.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(f"p.x{j}").alias(f"lo{j}") for j in dims], *[F.max(f"p.x{j}").alias(f"hi{j}") for j in dims])
    sides = a.groupBy(*keys).agg(*[F.min(f"p.x{j}").alias(f"l{j}") for j in dims], *[F.max(f"p.x{j}").alias(f"h{j}") for j in dims])
    # the widest side of both, from which on neighbouring cells hold all
    whole = F.greatest(*[F.greatest(f"hi{j}", f"h{j}") - F.least(f"lo{j}", f"l{j}") for j in dims], F.lit(0.0))
    wide = F.greatest(*[F.col(f"hi{j}") - F.col(f"lo{j}") for j in dims], F.lit(0.0))
    reach = spread.join(sides.hint("merge"), keys).select(*keys, F.when(wide > 0, wide / F.pow(F.col("n").cast("double"), 1 / len(at))).otherwise(F.when(whole > 0, whole).otherwise(1.0)).alias("reach"), whole.alias("whole"))
    a = written(a.join(reach.hint("merge"), keys), "open-points")
    b = written(b.join(reach.select(*keys, "reach").hint("merge"), keys), "right-cells")
    found = []
    for turn in range(most_rounds):
        if a.isEmpty():
            break
        step = F.col("reach") * float(2**turn)
        cell = lambda j: F.floor(F.col(f"p.x{j}") / step).cast("double")
        around = F.array(*[F.struct(*[(cell(j) + d).alias(f"c{j}") for j, d in enumerate(ds)]) for ds in product((-1, 0, 1), repeat=len(at))])
        asks = a.withColumn("c", F.explode(around)).select(*keys, "a", F.col("p").alias("pa"), step.alias("step"), *[F.col(f"c.c{j}").alias(f"c{j}") for j in dims])
        has = b.select(*keys, "b", F.col("p").alias("pb"), *[cell(j).alias(f"c{j}") for j in dims])
        apart = F.sqrt(sum(((F.col(f"pa.x{j}") - F.col(f"pb.x{j}")) ** 2 for j in dims), F.lit(0.0)))
        best = asks.join(has.hint("merge"), [*keys, *[f"c{j}" for j in dims]]).groupBy(*keys, "a", "pa", "step").agg(F.min(F.struct(apart.alias("distance"), F.col("b"))).alias("best"))
        sure = written(best.where(F.col("best.distance") <= F.col("step")).select(*keys, "a", F.col("pa").alias("p"), "best.b", "best.distance"), "nearest")
        found.append(sure)
        rest = written(a.join(sure.select(*keys, "a", "p").distinct().hint("merge"), [*keys, "a", "p"], "left_anti"), "open-points")
        discard(a)
        a = rest
    else:
        if not a.isEmpty():
            raise RuntimeError(f"points are open after {most_rounds} rounds")
    out = left.select(*on, ident, *at)
    if not found:
        return out.select(*on, ident, F.lit(None).cast(dict(right.dtypes)[other]).alias(other), F.lit(None).cast("double").alias("distance"))
    hits = found[0]
    for part in found[1:]:
        hits = hits.unionByName(part)
    hits = hits.select(*[F.col(f"k{j}").alias(k) for j, k in enumerate(on)], F.col("a").alias(ident), F.col("b").alias(other), "distance", "p")
    return out.withColumn("p", points[0]).join(hits.hint("merge"), [*on, ident, "p"], "left").select(*on, ident, other, "distance")

