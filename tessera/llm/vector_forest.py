"""Near-duplicate embeddings by a random-projection tree forest.

Each tree splits the vectors at random, again and again: by the projection on the difference of two
sampled vectors, at a random place near the middle. A vector near a split goes to both sides, so
that neighbours are seldom parted. The forest is fitted on a bounded sample; every vector is sent
down all trees, compared with all others of its leaves, and the links of all trees are united. Leaves that
the sample leaves too large are split again, by trees on samples of their own, until none is: so leaves do
not grow with the table, however large it is.

Equal vectors are one class throughout. A leaf gives a spanning forest of its links and the number
of links of each vector, never a list of pairs; a pair that meets in several leaves counts in the
first of them alone. A leaf of over `part` vectors is compared in parts, all pairs of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, written
from ..operators.graphs import connected_components


@dataclass
class Tree:
    """Node k: direction[k], place[k], children[k]; a child below zero is the leaf -1 - child."""

    direction: np.ndarray
    place: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray, spill: float) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves that rows of x reach."""
        out, open_ = [], [(0 if len(self.place) else -1, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out.append((-1 - node, rows))
                continue
            at = x[rows] @ self.direction[node] - self.place[node]
            for child, on in zip(self.children[node].tolist(), (at <= spill, at >= -spill), strict=True):
                if on.any():
                    open_.append((child, rows[on]))
        return out


def grow_tree(sample: np.ndarray, leaf: int, seed: int) -> Tree:
    r = np.random.default_rng(seed)
    direction, place, children, leaves = [], [], [], 0
    open_ = [(np.arange(len(sample)), None, 0)]
    while open_:
        rows, parent, side = open_.pop()
        node = None
        for _ in range(4 if len(rows) > leaf else 0):
            a, b = sample[r.choice(rows, 2, replace=False)]
            size = np.linalg.norm(a - b)
            if size < 1e-9:
                continue
            d = (a - b) / size
            at = sample[rows] @ d
            cut = float(np.quantile(at, r.uniform(0.35, 0.65)))
            left = at <= cut
            if left.any() and not left.all():
                node = len(place)
                direction.append(d)
                place.append(cut)
                children.append([0, 0])
                open_ += [(rows[left], node, 0), (rows[~left], node, 1)]
                break
        if node is None:
            node, leaves = -1 - leaves, leaves + 1
        if parent is not None:
            children[parent][side] = node
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(direction).reshape(len(direction), width), np.array(place), np.array(children, dtype=np.int64).reshape(-1, 2), leaves)


def units(raw: list[bytes], width: int) -> np.ndarray:
    """Vectors kept as float32 (where that is exact) or float64, as float64 of length 1."""
    x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * width else np.float64).astype(np.float64) for b in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaf_links(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, leaves: list, leaf: int, own: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of one leaf, or two parts of one (own: the part of each row): the weight of the rows that each
    row links with, not counting pairs that share an earlier leaf, and a spanning forest of the links."""
    links = x @ x.T >= cosine
    np.fill_diagonal(links, False)
    i, j = np.nonzero(links)
    counted = own[i] != own[j] if own.min() != own.max() else np.ones(len(i), dtype=bool)  # else another task's
    earlier = [[c for c in cs if c < leaf] for cs in leaves]
    names = sorted({c for k in np.unique(i) for c in earlier[k]})
    if names:
        place, held = {c: k for k, c in enumerate(names)}, np.zeros((len(ids), len(names)), dtype=bool)
        for k in np.unique(i):
            held[k, [place[c] for c in earlier[k]]] = True
        step = max(1, (32 << 20) // len(names))
        for at in range(0, len(i), step):
            pairs = slice(at, at + step)
            counted[pairs] &= ~(held[i[pairs]] & held[j[pairs]]).any(1)
    degree = np.bincount(i[counted], weight[j[counted]], len(ids))
    edges, new = [], links.any(1)
    for k in np.flatnonzero(new).tolist():
        if new[k]:
            new[k], edge = False, [k]
            while edge:
                reached = np.flatnonzero(links[edge.pop()] & new)
                new[reached] = False
                edges += [(int(ids[k]), int(ids[q])) for q in reached]
                edge += reached.tolist()
    return degree, edges


def split_again(routed: DataFrame, width: int, leaf: int, most_leaf: int, most_sample: int, spill: float, most_rounds: int = 8, salted: int = 20_000) -> DataFrame:
    """routed (node, n, raw, leaves) with every leaf of over `most_leaf` vectors replaced by the leaves of a tree grown on a
    sample of its own. A leaf's vectors are sent down in parts of about `salted`. A leaf that no plane parts stays."""
    whole = F.lit(False)
    for _ in range(most_rounds):
        at = routed.select("node", "raw", F.explode("leaves").alias("leaf"))
        sizes = at.groupBy("leaf").agg(F.count("*").alias("m"))
        large = written(sizes.where((F.col("m") > most_leaf) & ~whole), "large-leaves")
        if large.isEmpty():
            break
        inside = at.join(large, "leaf")
        some = inside.where(F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)) < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(most_sample) / F.col("m")))

        def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            small = max(8, round(leaf * len(rows) / max(int(rows["m"].iloc[0]), 1)))
            tree = grow_tree(units(list(rows.sort_values("node")["raw"]), width), small, int(key[0]) % (1 << 32))
            return pd.DataFrame({"leaf": [key[0]], "m": [int(rows["m"].iloc[0])], "leaves_of": [tree.leaves], "tree": [pickle.dumps(tree)]})

        trees = written(some.groupBy("leaf").applyInPandas(grow, "leaf long, m long, leaves_of long, tree binary"), "leaf-trees")
        salts = F.ceil(F.col("m") / salted).cast("int")
        for_parts = trees.select("leaf", "tree", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        parts = inside.select("leaf", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "node", "raw")

        def send(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(tree):
                return pd.DataFrame({"node": [], "leaf": [], "new": []}).astype("int64")
            old, nodes, out = int(rows["leaf"].iloc[0]), rows["node"].to_numpy(), []
            for name, reached in pickle.loads(tree["tree"].iloc[0]).route(units(list(rows["raw"]), width), spill):
                out += [(int(k), old, xxhash.xxh64_intdigest(f"{old} {name}") >> 1) for k in nodes[reached]]
            return pd.DataFrame(out, columns=["node", "leaf", "new"]).astype("int64")

        moved = parts.groupBy("leaf", "salt").cogroup(for_parts.groupBy("leaf", "salt")).applyInPandas(send, "node long, leaf long, new long")
        moved = written(moved.groupBy("node").agg(F.collect_set("leaf").alias("old"), F.collect_set("new").alias("new")), "moved")
        kept = F.when(F.col("old").isNull(), F.col("leaves")).otherwise(F.array_union(F.array_except("leaves", "old"), "new"))
        routed = written(routed.join(moved, "node", "left").select("node", "n", "raw", F.sort_array(kept).alias("leaves")), "routed")
        # a leaf that came out as one leaf has a new name, by which it is not tried again
        stuck = [xxhash.xxh64_intdigest(f"{r[0]} 0") >> 1 for r in trees.where("leaves_of <= 1").select("leaf").limit(10_000).collect()]
        whole = whole | F.col("leaf").isin(stuck) if stuck else whole
    return routed


def link_vectors(
    vectors: DataFrame, cosine: float = 0.95, trees: int = 6, leaf: int = 400, spill: float = 0.015, most_sample: int = 20_000, part: int = 1024, most_leaf: int = 4096,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """Links vectors with a cosine (in double precision) of at least `cosine`, among those that share a
    leaf of a tree; returns vec_id, n_links, component_id (least id reachable by links) and kept (the row
    whose id that is).

    The trees are fitted on at most `most_sample` distinct vectors (those of the smallest hashes), and leaves of over
    `most_leaf` vectors are split again on samples of about as many of their own; all vectors are indexed. Vectors that are null, empty, zero, hold nulls or values that are not finite,
    or have another length than most vectors, link with nothing and are components of their own. A
    null id takes part in links but names no component: component_id is the least id that is not null, and
    null where links reach none; rows without an id are never kept. Repeated rows are rows of their own: equal
    vectors link. Other columns are not read; no rows give no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    width = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = width["n"] if width else 0

    def classed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            high, low, raws = [], [], []
            for v in b.column(1).to_pylist():
                x = np.array(v, dtype=np.float64) + 0.0 if v is not None and len(v) == width and None not in v else None
                good = x is not None and np.isfinite(x).all()
                if good:  # scaled by a power of two, which changes no cosine, so that squares neither vanish nor overflow
                    top = np.abs(x).max()
                    good = top > 0
                    x = x / 2.0 ** np.floor(np.log2(top)) if good else x
                h = np.frombuffer(xxhash.xxh128_digest(x.tobytes()), ">i8").tolist() if good else (None, None)
                short = x.astype(np.float32) if good else x
                raw = (short if (short == x).all() else x).tobytes() if good else None
                high.append(h[0])
                low.append(h[1])
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(raws, pa.binary())], names=["vec_id", "high", "low", "raw"])

    every = written(rows.mapInArrow(classed, "vec_id long, high long, low long, raw binary"), "vectors")
    reps = written(every.where("high is not null").groupBy("high", "low").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw")), "vector-classes")
    n_reps = reps.count()
    # Nodes have numbers of their own: ids may be null, or the same for unequal vectors
    numbered = written(reps.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sample = [bytes(r[0]) for r in hash_sample(numbered, F.col("high"), most_sample).select("raw").collect()]  # at most most_sample vectors
    points = units(sample, width) if sample else np.zeros((0, width))
    # as many in a sampled leaf as make about `leaf` of all
    small = max(8, round(leaf * len(points) / max(n_reps, 1)))
    forest = vectors.sparkSession.sparkContext.broadcast([grow_tree(points, small, seed) for seed in range(trees)])
    first = np.cumsum([0] + [t.leaves for t in forest.value]).tolist()

    def route(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            if b.num_rows:
                x, at = units(b.column(2).to_pylist(), width), [[] for _ in range(b.num_rows)]
                for k, tree in enumerate(forest.value):
                    for name, reached in tree.route(x, spill):
                        for j in reached.tolist():
                            at[j].append(first[k] + name)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(a) for a in at], pa.list_(pa.int64()))], names=["node", "n", "raw", "leaves"])

    routed = written(numbered.select("node", "n", "raw").mapInArrow(route, "node long, n long, raw binary, leaves array<long>"), "routed")
    routed = split_again(routed, width, leaf, most_leaf, most_sample, spill)
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("m"))
    cut = F.ceil(F.col("m") / part).cast("int")
    spread = routed.select("node", "n", "raw", "leaves", F.explode("leaves").alias("leaf")).join(sizes, "leaf").withColumn("own", F.pmod(F.xxhash64("node"), cut).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), cut - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b")))
    spread = spread.select("leaf", "node", "n", "raw", "leaves", "own", F.explode(pairs).alias("p")).select("*", "p.a", "p.b").drop("p")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["node"].to_numpy()
        degree, edges = leaf_links(ids, rows["n"].to_numpy(), units(list(rows["raw"]), width), list(rows["leaves"]), key[0], rows["own"].to_numpy(), cosine)
        some = np.flatnonzero(degree)
        return pd.DataFrame(
            {
                "src": np.concatenate([ids[some], [a for a, _ in edges]]).astype(np.int64),
                "dst": pd.array([None] * len(some) + [b for _, b in edges], dtype="Int64"),
                "degree": np.concatenate([degree[some], np.zeros(len(edges))]).astype(np.int64),
            }
        )

    found = written(spread.groupBy("leaf", "a", "b").applyInPandas(compare, "src long, dst long, degree long"), "links")
    joined = connected_components(found.where("dst is not null").select("src", "dst"))
    # a component is named by the least id of its classes
    named = joined.join(numbered.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("name"))
    joined = joined.join(named, "component").select("node", "name")
    degrees = found.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("degree").alias("degree"))
    of_class = numbered.select("high", "low", "n", "node", "rep").join(joined, "node", "left").join(degrees, "node", "left")
    of_class = written(of_class.select("high", "low", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("name", "rep").alias("component")), "class-links")
    out = every.select("vec_id", "high", "low").join(of_class, ["high", "low"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
