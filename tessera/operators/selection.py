"""Greedy and top-k selection with explicit ties. The set cover sees one group at a time, whose size the
caller bounds before (frames of a capture); farthest points and diverse picks hold no group as a whole."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written


def newest_first(df: DataFrame, ts: str, ident: str, limit: int) -> DataFrame:
    """The newest rows; a limit outside 1..100 is an error, not clamped."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in 1..100")
    return df.orderBy(F.desc(ts), F.asc(ident)).limit(limit)


def first_per_key(df: DataFrame, key: list[str], severity: str, good: Column, tie: str) -> DataFrame:
    """The first row of each key by falling severity, problems before good news, then the tie-break."""
    w = Window.partitionBy(*key).orderBy(F.desc(severity), good.asc(), F.asc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cheapest_or_refusal(asked: DataFrame, candidates: DataFrame, key: str, allowed: Column, cost: str, ident: str) -> DataFrame:
    """For each asked key the allowed candidate of least cost (ties: least id), or a refusal row."""
    best = candidates.where(allowed).groupBy(key).agg(F.min(F.struct(cost, ident)).alias("_b"), F.count("*").alias("candidates"))
    return asked.select(key).distinct().join(best, key, "left").select(key, F.col(f"_b.{ident}").alias(ident), F.col(f"_b.{cost}").alias(cost), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.col("_b").isNull().alias("refused"))


def winner_by_margin(df: DataFrame, key: list[str], option: str, score: str, default: str, margin: float) -> DataFrame:
    """The option with the best score, if the second is worse by at least `margin`; else the default one."""
    best = df.groupBy(*key, option).agg(F.max(score).alias("_s"))
    w = Window.partitionBy(*key).orderBy(F.desc("_s"), F.asc(option))
    r = best.withColumn("_n", F.row_number().over(w)).withColumn("_gap", F.col("_s") - F.lead("_s").over(w)).where("_n = 1")
    clear = F.coalesce(F.col("_gap") >= margin, F.lit(False))
    return r.select(*key, F.when(clear, F.col(option)).otherwise(F.lit(default)).alias("choice"), clear.alias("decided"), F.col("_gap").alias("margin"))


def pose_distance(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distance of positions plus half the angle between directions (of no length: 0, 0, -1)."""
    v = unit(v)
    return np.linalg.norm(p[:, None] - p[None], axis=2) + 0.5 * np.arccos(np.clip(v @ v.T, -1, 1))


def farthest_points(distance: np.ndarray, k: int, chosen: list[int] | None = None) -> list[int]:
    """k row numbers by farthest-point sampling, in input order: the first is that of the largest sum of
    distances, each next one the furthest from all chosen; ties: the lowest number."""
    n = len(distance)
    if n <= k:
        return list(range(n))
    out = list(chosen or [int(distance.sum(1).argmax())])
    least = distance[out].min(0)
    while len(out) < k:
        least[out] = -1
        out.append(int(least.argmax()))
        least = np.minimum(least, distance[out[-1]])
    return sorted(out[:k])


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n < 1e-6, np.array([0.0, 0.0, -1.0]), v / np.maximum(n, 1e-6))


def sample_poses(df: DataFrame, key: list[str], order: str, position: list[str], direction: list[str], k: int = 12, block: int = 1024) -> DataFrame:
    """The k rows of each key whose poses lie furthest apart. A key's first row is that of the largest sum of
    distances, by pairs of blocks of about `block` rows; each of the k rounds after it measures every row
    against the last one taken. Each round is written to the shared folder."""
    doubles = lambda names: F.array(*[F.col(c).cast("double") for c in names])

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(_v=list(unit(np.stack(f["_v"]).astype(float))))

    # a struct, so that null keys are a key too
    rows = df.select(F.struct(*df.columns).alias("_row"), F.struct(*key).alias("_k"), F.col(order).alias("_o"), doubles(position).alias("_p"), doubles(direction).alias("_v"))
    rows = rows.withColumn("_r", F.monotonically_increasing_id())
    rows = written(rows, "poses")
    poses = rows.select("_k", "_r", "_p", "_v")
    poses = written(poses.mapInPandas(units, poses.schema), "units")
    blocks = poses.groupBy("_k").agg(F.ceil(F.count("*") / block).cast("int").alias("_m"))
    own = poses.join(blocks, "_k").withColumn("_b", F.pmod(F.xxhash64("_r"), F.col("_m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    left = own.withColumn("_c", other).select("_k", "_b", "_c", "_r", "_p", "_v")
    right = own.withColumnRenamed("_b", "_c").withColumn("_b", other).select("_k", "_b", "_c", "_r", "_p", "_v").toDF("k", "b", "c", "r", "p", "v")

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"_r": [], "_c": [], "_s": []}).astype({"_r": "int64", "_c": "int32", "_s": "float64"})
        y = y.sort_values("r")
        p, v, q, w = (np.stack(c).astype(float) for c in (x["_p"], x["_v"], y["p"], y["v"]))
        far = np.sqrt(sum((p[:, i, None] - q[None, :, i]) ** 2 for i in range(p.shape[1])))
        return pd.DataFrame({"_r": x["_r"], "_c": int(y["c"].iloc[0]), "_s": (far + 0.5 * np.arccos(np.clip(v @ w.T, -1, 1))).sum(1)})

    parts = left.groupBy("_k", "_b", "_c").cogroup(right.groupBy("k", "b", "c")).applyInPandas(sums, "_r long, _c int, _s double")
    # added in the order of the blocks, so that a run gives the same sums again
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("_c", "_s"))), F.lit(0.0), lambda t, x: t + x["_s"])
    now = poses.join(parts.groupBy("_r").agg(total.alias("_least")), "_r").join(rows.select("_r", "_o"), "_r").withColumn("_taken", F.lit(False))
    now = written(now, "round")
    for n in range(k):
        free = now.where(~F.col("_taken"))
        last = free.groupBy("_k").agg(F.min_by(F.struct(F.col("_r").alias("r"), F.col("_p").alias("p"), F.col("_v").alias("v")), F.struct(-F.col("_least"), "_o", "_r")).alias("_l"))
        along = lambda a, b, f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda t, x: t + x)
        apart = F.sqrt(along(F.col("_p"), F.col("_l.p"), lambda x, y: (x - y) * (x - y))) + 0.5 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along(F.col("_v"), F.col("_l.v"), lambda x, y: x * y))))
        # a key without a row left has no last one
        before = now
        now = now.join(last, "_k", "left").select(
            "_k", "_r", "_o", "_p", "_v", F.coalesce(apart if n == 0 else F.least("_least", apart), "_least").alias("_least"), (F.col("_taken") | F.coalesce(F.col("_r") == F.col("_l.r"), F.lit(False))).alias("_taken")
        )
        now = written(now, "round")
        discard(before)
    return rows.join(now.where("_taken").select("_r"), "_r").select("_row.*")


def cover(rows: pd.DataFrame, frame: str, item: str, value: str, k: int) -> list:
    """Greedy weighted set cover: each round the frame with the most value over items not yet covered
    (ties: the lowest frame), until none gains or k are taken."""
    left, out = set(rows[item]), []
    by = {f: list(zip(g[item], g[value], strict=True)) for f, g in rows.groupby(frame)}
    while left and len(out) < k:
        gain = {f: sum(v for i, v in g if i in left) for f, g in by.items()}
        best = min(gain, key=lambda f: (-gain[f], f))
        if gain[best] <= 0:
            break
        out.append(best)
        left -= {i for i, _ in by[best]}
    return out


def set_cover(df: DataFrame, key: str, frame: str, item: str, value: str, k: int) -> DataFrame:
    """Returns key, pick (from 0), frame of the greedy cover, for each key by itself."""
    kinds = dict(df.dtypes)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        out = cover(rows, frame, item, value, k)
        return pd.DataFrame({key: rows[key].iloc[0], "pick": range(len(out)), frame: out})[[key, "pick", frame]]

    return df.select(key, frame, item, value).groupBy(key).applyInPandas(pick, f"{key} {kinds[key]}, pick int, {frame} {kinds[frame]}")


def diverse(df: DataFrame, key: str, ident: str, score: str, angle: str, k: int, apart: float) -> DataFrame:
    """By falling score, the rows whose angle (degrees) is at least `apart` from all taken before, up to k.
    A key's rows stream through a task in sorted order; the fold carries at most k angles."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = object(), []
        for f in frames:
            good = []
            for x, missing, a in zip(f[key], f[key].isna(), f[angle], strict=True):
                x = None if missing else x
                if x != now:
                    now, taken = x, []
                good.append(len(taken) < k and all(abs((a - t + 180) % 360 - 180) >= apart for t in taken))
                if good[-1]:
                    taken.append(a)
            yield f[good]

    by = [F.asc(key), F.isnan(F.col(score).cast("double")).asc(), F.desc_nulls_last(score), F.asc_nulls_last(ident)]
    return df.repartition(key).sortWithinPartitions(*by).mapInPandas(fold, df.schema)


def round_robin(df: DataFrame, key: str, ident: str, slots: int) -> DataFrame:
    """Deals slots to the rows of a key in turn: each row's share, larger by one for the first by id."""
    w = Window.partitionBy(key)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(ident)) - 1).withColumn("_n", F.count("*").over(w))
    return r.withColumn("share", (F.floor(F.lit(slots) / F.col("_n")) + (F.col("_i") < F.lit(slots) % F.col("_n")).cast("int")).cast("long")).drop("_i", "_n")


def bearing(x: Column, y: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def golden_angle(n: int) -> float:
    return n * 180 * (3 - math.sqrt(5)) % 360
