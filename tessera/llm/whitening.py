"""Whitening of embeddings by a compensated covariance.

Every number is kept as a pair of doubles, a high part and the low part that rounding cuts off it
(double-double); sums and products go by error-free transformations. Tasks accumulate centred outer products
so, and their high and low parts are merged in two levels. The covariance, of a vector's dimensions alone,
goes to the driver: `numpy.linalg.eigh` makes it tridiagonal and solves that by divide and conquer (LAPACK's syevd), and its
eigenvectors are refined against the double-double covariance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written

Pair = tuple[np.ndarray, np.ndarray]
#: Parts that one merge adds up.
MERGED = 256


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """Upper and lower 26 bits of doubles (Veltkamp)."""
    t = a * 134217729.0
    upper = t - (t - a)
    return upper, a - upper


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    p, (a1, a2), (b1, b2) = a * b, halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: Pair) -> Pair:
    """The sum over the first axis, halves added to halves."""
    high, low = x
    while len(high) > 1:
        if len(high) % 2:
            high, low = np.concatenate([high, np.zeros_like(high[:1])]), np.concatenate([low, np.zeros_like(low[:1])])
        m = len(high) // 2
        high, low = add((high[:m], low[:m]), (high[m:], low[m:]))
    return high[0], low[0]


def divide(a: Pair, n: int) -> Pair:
    """A double-double by a whole number below 2^53."""
    n = np.float64(n)
    q = a[0] / n
    p, e = two_product(q, n)
    return two_sum(q, ((a[0] - p) - e + a[1]) / n)


def outer_sum(a: Pair, b: Pair, rows: int = 256, upper: bool = False) -> Pair:
    """The sum over k of a[k, i] * b[k, j]; with `upper`, for j >= i alone (the others stay 0)."""
    high, low = np.zeros((a[0].shape[1], b[0].shape[1])), np.zeros((a[0].shape[1], b[0].shape[1]))
    for k in range(0, len(a[0]), rows):
        (ah, al), (bh, bl) = (tuple(x[k : k + rows] for x in y) for y in (a, b))
        b1, b2 = halves(bh)
        for i in range(ah.shape[1]):
            x, xl, on = ah[:, i, None], al[:, i, None], slice(i if upper else 0, None)
            x1, x2 = halves(x)
            p = x * bh[:, on]
            e = ((x1 * b1[:, on] - p) + x1 * b2[:, on] + x2 * b1[:, on]) + x2 * b2[:, on]
            high[i, on], low[i, on] = add((high[i, on], low[i, on]), total((p, e + (x * bl[:, on] + xl * bh[:, on]))))
    return high, low


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, Pair]:
    """n*x - S, exact, and x - S/n as a double-double. Beyond 64 bits the first is an array of Python's integers."""
    most = max([int(np.abs(x).max(initial=0)) * n, *map(abs, sums)])
    if most < 1 << 62:
        d = x * np.int64(n) - np.array(sums, dtype=np.int64)
        high = d.astype(np.float64)
        low = (d - high.astype(np.int64)).astype(np.float64)
    else:
        d = x.astype(object) * n - np.array(sums, dtype=object)
        high = d.astype(np.float64)
        low = (d - np.vectorize(int, otypes=[object])(high)).astype(np.float64) if d.size else high.copy()
    return d, divide((high, low), n)


def eigenpairs(v: Pair, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric double-double matrix, to double precision.

    The divide-and-conquer solution of the high part is refined by the residuals of the whole (Ogita and Aishima): each
    vector takes a share of every other that its residual and the gap of their values name.
    """
    value, x = np.linalg.eigh(v[0])
    value, x = value[::-1].copy(), x[:, ::-1].copy()
    zero, size = np.zeros_like(x), len(value)
    for _ in range(rounds):
        vx = outer_sum(v, (x, zero))  # v is symmetric
        s, sl = outer_sum((x, zero), vx)
        g, gl = outer_sum((x, zero), (x, zero))
        r = (np.eye(size) - g) - gl
        value = (np.diag(s) + np.diag(sl)) / (1 - np.diag(r))
        off = (s - np.diag(value)) + sl
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm(off) + np.abs(value).max(initial=0) * np.linalg.norm(r))
        x = x + x @ np.where(near, r / 2, (off + value[None, :] * r) / np.where(near, 1, gap))
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order] / np.linalg.norm(x[:, order], axis=0)


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): each entry c as floor(scale * c) + shift. Vectors that are null or empty, or hold null, NaN or
    infinite entries, are left out, and so are those that have not the commonest number of entries (ties: the larger one)."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    rows = rows.where(F.size("c") > 0).where(F.forall("c", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    sizes = rows.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("c") == (sizes[0] if sizes else 0))
    most = float(1 << 52)  # beyond it a double has no fractions, and x stays within 64 bits
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))).cast("long") + F.lit(shift).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def sums(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            x = _matrix(b.column(0))
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "high": [(x >> 32).sum(0)], "low": [(x & 0xFFFFFFFF).sum(0)]})

    parts = fit.mapInArrow(sums, "n long, high array<long>, low array<long>").select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.groupBy("dim").agg(F.sum("n"), wide("s.high"), wide("s.low")).orderBy("dim").collect()  # a row a dimension
    return (rows[0][1], [(int(r[2]) << 32) + int(r[3]) for r in rows]) if rows else (0, [])


def covariance(fit: DataFrame, n: int, sums: list[int]) -> Pair:
    """The covariance of the vectors x of fit (n of them, with these sums), divisor n."""
    size = len(sums)

    def outer(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros((size, size)), np.zeros((size, size))
        for b in batches(tables, 4 << 20):
            if b.num_rows:
                _, c = centred(_matrix(b.column(0)), n, sums)
                part = add(part, outer_sum(c, c, upper=True))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": [task] * size, "dim": pa.array(range(size), pa.int32()), "high": [r.tobytes() for r in part[0]], "low": [r.tobytes() for r in part[1]]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        high, low = total(tuple(np.stack([np.frombuffer(r) for r in rows[c]]) for c in ("high", "low")))
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // MERGED], "dim": [int(rows["dim"].iloc[0])], "high": [high.tobytes()], "low": [low.tobytes()]})

    schema = "part long, dim int, high binary, low binary"
    parts = fit.mapInArrow(outer, schema)
    parts = parts.groupBy("dim", F.expr(f"part div {MERGED}")).applyInPandas(merge, schema)
    rows = parts.groupBy("dim").applyInPandas(merge, schema).orderBy("dim").collect()  # a row a dimension
    whole = (np.stack([np.frombuffer(r[c]) for r in rows]) for c in ("high", "low"))
    return divide(tuple(np.triu(m) + np.triu(m, 1).T for m in whole), n)


def whiten(vectors: DataFrame, components: int = 16, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Returns vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    The covariance is fitted on the distinct vectors, all of them. Vectors are left out as whole_vectors() says. Repeated rows
    and null ids are rows of their own. Components without variance (at most 1e-13 of the whole) are not given: one distinct vector
    gives no rows, as an empty table does. Other columns are not read. A task holds two matrices of a vector's
    dimensions squared.
    """
    rows = whole_vectors(vectors, vec_id, vector, scale, shift)
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    n, sums = fit_sums(fit)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    value, axes, trace = np.zeros(0), np.zeros((len(sums), 0)), 0.0
    if n:
        v = covariance(fit, n, sums)
        value, axes = eigenpairs(v)
        trace = float(np.trace(v[0]) + np.trace(v[1]))
        some = value[:components] > 1e-13 * trace
        value, axes = value[:components][some], axes[:, :components][:, some]
    k, root = len(value), np.sqrt(value)

    def squares(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, 16 << 20):
            if b.num_rows:
                _, (c, _) = centred(_matrix(b.column(0)), n, sums)
                w = c @ axes / root
                yield pa.RecordBatch.from_pydict({"s": [np.concatenate([w.sum(0), (w.T @ w).ravel()])]})

    error = None
    if k:
        parts = fit.mapInArrow(squares, "s array<double>").select(F.posexplode("s").alias("at", "s"))
        s = np.array([r[1] for r in parts.groupBy("at").agg(F.sum("s")).orderBy("at").collect()]) / n  # components squared, and as many means
        error = float(np.abs(s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) - np.eye(k)).max())

    def project(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, 1 << 20):
            if not b.num_rows or not k:
                continue
            d, (c, _) = centred(_matrix(b.column(1)), n, sums)
            if d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
                deviation = pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
            else:
                found = [sum(int(y) ** 2 for y in r) for r in d.tolist()]
                deviation = pa.array([f if f < 10**38 else None for f in found], pa.decimal128(38, 0))
            m, back = b.num_rows * k, np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()).take(pa.array(back)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, n)),
                    deviation.take(pa.array(back)), pa.array((c @ axes / root).ravel()), pa.array(np.tile(value / trace, b.num_rows)),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return rows.mapInArrow(project, schema).withColumn("identity_error", F.lit(error).cast("double"))
