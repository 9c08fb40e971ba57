"""Aggregations: weighted quantiles, bands, clipped ranges, histograms, similarities and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .sequences import top_one


def cumulated(df: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """(key.., value, _w, _cum, _all): the weight of each distinct value of a key, of all up to it, and of the key. Values are dealt
    over tasks by ranges; the sums of ranges, few for each key, are cumulated by themselves, so a hot key is no single task."""
    s = df.groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    s = written(s.repartitionByRange(*key, value).withColumn("_part", F.spark_partition_id()), "ranges")
    ranges = s.groupBy(*[F.col(k).alias(f"_{k}") for k in key], F.col("_part").alias("_at")).agg(F.sum("_w").alias("_sum"))
    w = Window.partitionBy(*[f"_{k}" for k in key])
    before = F.coalesce(F.sum("_sum").over(w.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).withColumn("_all", F.sum("_sum").over(w))
    own = F.sum("_w").over(Window.partitionBy(*key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_part") == F.col("_at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return s.withColumn("_own", own).join(ranges, same).select(*key, value, "_w", (F.col("_own") + F.col("_before")).alias("_cum"), "_all")


def weighted_quantile(df: DataFrame, key: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The first value whose cumulative weight reaches q of the total; no interpolation. Equal values
    are summed first, which a key of very many rows needs. Null without weight."""
    reached = (F.col("_cum") >= q * F.col("_all")) & (F.col("_all") > 0)
    return cumulated(df, key, value, weight).groupBy(*key).agg(F.min(F.when(reached, F.col(value))).alias("quantile"))


def clipped_range(df: DataFrame, key: list[str], axes: dict[str, Column], low: float, high: float) -> DataFrame:
    """For each axis the range between two percentiles, by linear interpolation."""
    return df.groupBy(*key).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{n}") for n, c in axes.items()]).select(*key, *[F.get(f"_{n}", F.lit(k)).alias(f"{n}_{e}") for n in axes for k, e in enumerate(("low", "high"))])


def capped_histogram(df: DataFrame, key: list[str], x: Column, y: Column, percent: float) -> DataFrame:
    """Counts of the filled bins, none over the given percentile of its key's counts."""
    n = df.groupBy(*key, x.alias("bin_x"), y.alias("bin_y")).agg(F.count("*").alias("n"))
    cap = n.groupBy(*key).agg(F.percentile("n", percent).alias("cap"))
    return n.join(cap, key).select(*key, "bin_x", "bin_y", F.least(F.col("n").cast("double"), "cap").alias("density"))


def soft_similarity(a: DataFrame, b: DataFrame, on: list[str], cell: list[str], value: str) -> DataFrame:
    """sum(min) / sum(max) and sum(min) / the smaller sum, over cells that either side fills; 0, not 1, if empty."""
    l, r = a.select(*on, *cell, F.col(value).alias("_l")), b.select(*on, *cell, F.col(value).alias("_r"))
    j = l.join(r, [*on, *cell], "full").fillna(0.0, ["_l", "_r"])
    s = j.groupBy(*on).agg(F.sum(F.least("_l", "_r")).alias("low"), F.sum(F.greatest("_l", "_r")).alias("high"), F.least(F.sum("_l"), F.sum("_r")).alias("small"))
    zero = lambda c: F.coalesce(F.try_divide("low", F.nullif(c, F.lit(0.0))), F.lit(0.0))
    return s.select(*on, zero("high").alias("soft_iou"), zero("small").alias("containment"))


def instance_summary(df: DataFrame, key: list[str], order: str, area: str, score: str, sentinel: float) -> DataFrame:
    """Count, first and last, the sorted list, median and largest area, mean score above the sentinel, sentinels."""
    s = F.col(score)
    return df.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.median(area).alias("median_area"), F.max(area).alias("largest"),
        F.avg(F.when(s > sentinel, s)).alias("mean_score"), F.count_if(s <= sentinel).alias("sentinels"),
    )


def lowest_cluster(df: DataFrame, key: list[str], height: str, weight: str, reach: float) -> DataFrame:
    """Rows within `reach` of their key's least height: how many, and their weighted mean height."""
    low = F.min(height).over(Window.partitionBy(*key))
    near = df.withColumn("_low", low).where(F.col(height) <= F.col("_low") + reach)
    return near.groupBy(*key).agg(F.count("*").alias("members"), F.try_divide(F.sum(F.col(height) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0.0))).alias("floor"))


def two_reading_agreement(a: DataFrame, b: DataFrame, key: str, verdict: str) -> DataFrame:
    """Joins two readings; the verdict where both agree, else a tie; counts by verdict, and splits."""
    j = a.select(key, F.col(verdict).alias("_a")).join(b.select(key, F.col(verdict).alias("_b")), key)
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return j.withColumn("outcome", F.when(same, F.col("_a").cast("string")).otherwise("tie")).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(~same).alias("splits"))


def nearest_in_cell(df: DataFrame, cell: list[Column], depth: str, tie: str, value: str) -> DataFrame:
    """For each cell the value of the row of least depth (ties: least tie-break)."""
    return df.groupBy(*cell).agg(F.min_by(value, F.struct(depth, tie)).alias("front"), F.min(depth).alias("depth"), F.count("*").alias("n"))


def ledger_report(df: DataFrame, mode: str, billed: Column, priced: str) -> DataFrame:
    return df.groupBy(mode).agg(F.count("*").alias("calls"), F.sum(F.when(billed, F.col(priced)).otherwise(0.0)).alias("billed"), F.sum(priced).alias("priced"))


def running_spend(df: DataFrame, user: str, ts: str, order: str, amount: str) -> DataFrame:
    """Each user's spend by UTC day, and over all days so far: days are summed before the window."""
    d = df.groupBy(user, F.to_date(ts).alias("day")).agg(F.sum(amount).alias("spent"), F.count("*").alias("n"))
    return d.withColumn("so_far", F.sum("spent").over(Window.partitionBy(user).orderBy("day")))


def shoelace(df: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    """The area of the polygon of a key's points in order."""
    w = Window.partitionBy(*key).orderBy(order)
    first = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead(x).over(w), F.first(x).over(first)), F.coalesce(F.lead(y).over(w), F.first(y).over(first))
    return df.withColumn("_c", F.col(x) * ny - nx * F.col(y)).groupBy(*key).agg((F.abs(F.sum("_c")) / 2).alias("area"), F.count("*").alias("corners"))


def dominant_band(df: DataFrame, key: list[str], luma: str, channels: list[str], weight: str, q: float, width: float) -> DataFrame:
    """The rows within `width` of the luma's weighted q-quantile, and the weighted median of each channel among them. Rows are
    counted by luma and channel before they meet the quantile, so that a key of very many rows is no single task."""
    ref = weighted_quantile(df, key, luma, weight, q).withColumnRenamed("quantile", "_ref")
    out = None
    for c in channels:
        seen = df.groupBy(*key, luma, F.col(c).alias("_v")).agg(F.sum(weight).alias("_s"), F.count("*").alias("_c"))
        band = written(seen.join(ref, key).where(F.abs(F.col(luma) - F.col("_ref")) <= width), "band")
        middle = weighted_quantile(band, key, "_v", "_s", 0.5).withColumnRenamed("quantile", c)
        out = (band.groupBy(*key).agg(F.sum("_c").alias("n")) if out is None else out).join(middle, key)
    return out


def unanimous_challenger(df: DataFrame, key: list[str], rank: str, gain: Column, votes: list[Column]) -> DataFrame:
    """The challenger (rank > 0) with the best gain among those for whom all votes hold, a vote that is
    unknown abstaining; without one, the champion of rank 0. Ties: the lower rank."""
    ok = F.lit(True)
    for v in votes:
        ok = ok & F.coalesce(v, F.lit(True))
    return top_one(df.withColumn("_gain", F.when(F.col(rank) == 0, F.lit(0.0)).otherwise(gain)).where((F.col(rank) == 0) | (ok & (F.col("_gain") > 0))), key, [F.desc("_gain"), F.asc(rank)])
