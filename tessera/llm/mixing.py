"""Mixing sources to target weights: iterative proportional fitting of token weights.

Documents are summed into cells (one for each combination of the axes' values). The cells' tokens
are raked until their sums along each axis have the target shares, no cell giving more than it has: a cell
that would is fixed at what it has, and the others are raked again around it. A cell's probability is its
raked tokens over its own. Documents are then taken by a hash of their id against that probability, so any
run takes the same ones.

The topic axis is a clustering of the corpus's own texts: spherical k-means over signed hashed words, its
rounds run over all documents. All sums are of whole numbers, so the clusters do not depend on their order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import batches, discard, free_name, hash_sample, sized_words, written

#: Stands for null in an axis.
NONE = "(none)"
#: Dimensions of a text's vector, and the bytes that a word must have to count in it (shorter ones are mostly grammar).
WIDTH, LEAST_BYTES = 64, 5


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each whole text, and its vector: roots of signed counts of hashed words, scaled to the
    length 127 and rounded; zero without a word of LEAST_BYTES."""
    h, size, starts = sized_words([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])
    n = np.diff(starts)
    row = np.repeat(np.arange(len(texts)), n)
    h, row = h[size >= LEAST_BYTES], row[size >= LEAST_BYTES]
    sign = 1.0 - 2.0 * ((h >> np.uint64(8)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(row * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64), sign, len(texts) * WIDTH).reshape(-1, WIDTH)
    v = np.sign(v) * np.sqrt(np.abs(v))
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return n, np.rint(127 * v / np.where(length > 0, length, 1))


def fit_topics(docs: DataFrame, topics: int = 8, rounds: int = 5, most_seeds: int = 2_000, text: str = "text") -> np.ndarray:
    """Centres of at most `topics` clusters of the texts. They begin at far-apart ones of the `most_seeds` vectors of the
    smallest hashes; each round is over the vectors of all texts. No texts with long words: no centres."""

    def vectors(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, 4 << 20):
            _, v = text_vectors(b.column(0).to_pylist())
            v = v[v.any(1)].astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v], pa.binary())], names=["v"])

    every = written(docs.select(F.col(text).alias("text")).mapInArrow(vectors, "v binary"), "vectors")
    seeds = sorted(bytes(r[0]) for r in hash_sample(every.distinct(), F.xxhash64("v"), most_seeds).collect())  # at most most_seeds
    x = np.array([np.frombuffer(s, np.int8) for s in seeds], dtype=np.float64).reshape(-1, WIDTH)
    chosen = [0] if len(x) else []
    while len(chosen) < min(topics, len(x)):
        nearest = (x @ x[chosen].T).max(1)
        if nearest.min() >= 127 * 120:
            break
        chosen.append(int(nearest.argmin()))
    centres = x[chosen]
    for _ in range(rounds if len(centres) else 0):

        def sums(tables: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), WIDTH), dtype=np.int64)
            for b in tables:
                if b.num_rows:
                    v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int8).reshape(-1, WIDTH).astype(np.float64)
                    near = (v @ centres.T).argmax(1)
                    np.add.at(total, near, v.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(centres)), WIDTH)), pa.array(np.tile(np.arange(WIDTH), len(centres))), pa.array(total.ravel())], names=["k", "d", "s"])

        got = every.mapInArrow(sums, "k long, d long, s long").groupBy("k", "d").agg(F.sum("s").alias("s")).collect()  # topics * WIDTH rows
        new = np.zeros_like(centres)
        for k, d, s in got:
            new[k, d] = s
        length = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(length > 0, np.rint(127 * new / np.where(length > 0, length, 1)), centres)
        if (new == centres).all():
            break
        centres = new
    discard(every)
    return centres


def with_topics(docs: DataFrame, centres: np.ndarray, text: str, n_tokens: str, topic: str) -> DataFrame:
    """docs with the number of white-space words of each whole text and its topic: t and the number of the nearest
    centre (ties: the first); `none` for texts without a word of LEAST_BYTES."""
    columns = docs.columns
    at, shared = columns.index(text), docs.sparkSession.sparkContext.broadcast(centres)  # topics * WIDTH numbers

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, 4 << 20):
            n, v = text_vectors(b.column(at).to_pylist())
            known = v.any(1)
            near = (v @ shared.value.T).argmax(1) if len(shared.value) else np.zeros(len(v), np.int64)
            names = [f"t{k}" if yes else "none" for k, yes in zip(near.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(names, pa.string())], names=[*columns, n_tokens, topic])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(n_tokens, LongType()), StructField(topic, StringType())]))


def softened(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Target shares between the observed ones (power 1) and equal ones (power 0)."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict[str, float]], fraction: float = 1.0, bounded: bool = False, rounds: int = 200, close: float = 1e-9) -> np.ndarray:
    """Raked token weights of the cells, summing to `fraction` of the tokens. Values without a target get none; targets
    of values that no cell has are shared among the others in proportion. bounded: no cell gets over its tokens;
    where the targets cannot be met so (a value has too few), they are met as nearly as the last round comes."""
    want = fraction * tokens.sum()
    weight, fixed, axes = tokens.astype(np.float64) * fraction, np.zeros(len(tokens), dtype=bool), []
    for j, target in enumerate(targets):
        names = {n: k for k, n in enumerate(sorted({c[j] for c in cells}))}
        code = np.array([names[c[j]] for c in cells], dtype=np.int64)
        share = np.array([target.get(n, 0.0) for n in names])
        axes.append((code, share / share.sum() if share.sum() > 0 else np.full(len(names), 1 / len(names))))
    while True:
        for _ in range(rounds):
            before = weight
            for code, share in axes:
                held = np.bincount(code, weight * fixed, len(share))
                free = np.bincount(code, weight * ~fixed, len(share))
                need = np.maximum(share * want - held, 0)
                weight = np.where(fixed, weight, weight * np.divide(need, free, out=np.zeros_like(need), where=free > 0)[code])
            if np.abs(weight - before).max(initial=0) < close * max(want, 1e-300):
                break
        over = ~fixed & (weight > tokens)
        if not bounded or not over.any():
            return weight
        weight, fixed = np.where(over, tokens, weight), fixed | over


def probabilities(weight: np.ndarray, tokens: np.ndarray, fraction: float) -> np.ndarray:
    """min(1, scale * weight / tokens), with the scale at which fraction of all tokens is expected."""
    rate = np.divide(weight, tokens, out=np.zeros(len(weight)), where=tokens > 0)
    low, high = 0.0, float(1 / rate[rate > 0].min()) if (rate > 0).any() else 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(1, middle * rate) * tokens).sum() < fraction * tokens.sum() else (low, middle)
    return np.where(tokens > 0, np.minimum(1, high * rate), fraction)


@dataclass
class Mix:
    """The cells, their probabilities, and for each axis and value the target share of the tokens taken and the one
    that the probabilities give; where they differ, the value's tokens do not suffice."""

    axes: tuple[str, ...]
    cells: list[tuple]
    chance: np.ndarray
    shares: list[tuple[str, str, float, float]]
    centres: np.ndarray


def fit_mix(
    docs: DataFrame, axes: tuple[str, ...] = ("source", "lang", "topic"), targets: dict[str, dict[str, float]] | None = None, power: float = 0.5,
    fraction: float = 0.5, most_cells: int = 200_000, text: str = "text",
) -> Mix:
    """The plan of a mix. Targets of an axis that are not given are its observed shares raised to `power`. The axis
    `topic` is the clustering of the texts, whatever column of that name docs has. The number of cells is bounded by the
    axes' values, not by the documents; over `most_cells` it is an error, and an axis needs coarser values. Nulls in an axis
    are the value `(none)`; null and empty texts have no tokens. No rows: no cells."""
    own = [a for a in axes if a != "topic"]
    slim = docs.select(F.col(text).alias("text"), *[F.coalesce(F.col(a).cast("string"), F.lit(NONE)).alias(f"axis{k}") for k, a in enumerate(own)])
    centres = fit_topics(slim) if "topic" in axes else np.zeros((0, WIDTH))
    own_at = {a: f"axis{k}" for k, a in enumerate(own)} | {"topic": "topic"}
    found = with_topics(slim, centres, "text", "n", "topic").groupBy(*[own_at[a] for a in axes]).agg(F.sum("n").alias("tokens"))
    summed = written(found, "cells")
    if (n := summed.count()) > most_cells:
        raise ValueError(f"{n} cells; the bound is {most_cells}")
    got = sorted(tuple(r) for r in summed.collect())  # at most most_cells rows
    discard(summed)
    cells, tokens = [r[:-1] for r in got], np.array([r[-1] or 0 for r in got], dtype=np.float64)
    wanted, seen = [], [Counter() for _ in axes]
    for c, t in zip(cells, tokens, strict=True):
        for j in range(len(axes)):
            seen[j][c[j]] += t
    wanted = [(targets or {}).get(a) or softened(seen[j], power) for j, a in enumerate(axes)]
    chance = probabilities(rake(cells, tokens, wanted, fraction, bounded=True), tokens, fraction) if cells else np.zeros(0)
    taken, shares = chance * tokens, []
    for j, a in enumerate(axes):
        given = Counter()
        for c, t in zip(cells, taken, strict=True):
            given[c[j]] += t
        shares += [(a, v, float(wanted[j].get(v, 0.0)), float(given[v] / max(taken.sum(), 1e-300))) for v in sorted(given)]
    return Mix(axes, cells, chance, shares, centres)


def mix_sources(docs: DataFrame, mix: Mix | None = None, seed: int = 17, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Adds n_tokens, topic, probability and taken to docs (columns of those names are replaced), by the given plan or
    one fitted to docs (`how`: see fit_mix).

    Null and empty texts have no tokens; their cell's probability holds, and that is the fraction wanted where the cell has no
    tokens at all. Rows of one id and text are taken or left together; null ids are told apart by the text. Values of an
    axis that the plan has not seen are not taken. No rows give no rows.
    """
    mix = mix or fit_mix(docs, text=text, **how)
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "topic", "probability", "taken")])
    if [c for c in mix.axes if c != "topic" and c not in own.columns] or text not in own.columns:
        raise ValueError("an axis or the text has the name of a column that is replaced")
    own = with_topics(own, mix.centres, text, "n_tokens", "topic")
    names = []
    for k, a in enumerate(mix.axes):
        names.append(free_name(own, f"axis{k}"))
        own = own.withColumn(names[-1], F.coalesce(F.col(a).cast("string"), F.lit(NONE)))
    schema = ", ".join([*[f"{n} string" for n in names], "probability double"])
    table = docs.sparkSession.createDataFrame([(*c, float(p)) for c, p in zip(mix.cells, mix.chance, strict=True)], schema)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    joined = own.join(F.broadcast(table), names, "left").drop(*names)  # at most most_cells rows
    return joined.withColumn("probability", F.coalesce("probability", F.lit(0.0))).withColumn("taken", u < F.col("probability"))
