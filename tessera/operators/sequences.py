"""Ordered sequences: runs, scores, quotas, change points, lags, interpolation and gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, key: list[str], order: list[str], starts: Column) -> DataFrame:
    """Adds run (1, 2, ... within the key), place (from 0) and run_length; a row begins a run where
    `starts`, which may look back with F.lag over the key's window, is true or null."""
    w = Window.partitionBy(*key).orderBy(*order)
    runs = df.withColumn("run", F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*key, "run")
    return runs.withColumn("place", F.row_number().over(inside.orderBy(*order)) - 1).withColumn("run_length", F.count("*").over(inside))


def centred_score(place: Column, length: Column) -> Column:
    """1 in the middle of a run and 0 at its ends; 0 for a run of one."""
    c = (length - 1) / 2
    return F.when(length <= 1, 0.0).otherwise(1 - F.abs(place - c) / c)


def weighted_score(df: DataFrame, among: list[str], terms: dict[str, float]) -> DataFrame:
    """Adds score: each term min-max scaled within `among` (no spread: 1), missing terms left out of
    the sum and of the weights; null if all are missing."""
    w = Window.partitionBy(*among)
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, share in terms.items():
        x = F.nanvl(F.col(name).cast("double"), F.lit(None))
        low, high = F.min(x).over(w), F.max(x).over(w)
        scaled = F.when(high == low, 1.0).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))
        top = top + F.when(x.isNotNull(), share * scaled).otherwise(0.0)
        weight = weight + F.when(x.isNotNull(), share).otherwise(0.0)
    return df.withColumn("score", top / F.nullif(weight, F.lit(0.0)))


def scoring_set(df: DataFrame, key: list[str], kept: Column) -> DataFrame:
    """Kept rows; of a key without any, all rows, with is_fallback."""
    any_kept = F.max(kept.cast("int")).over(Window.partitionBy(*key))
    return df.withColumn("is_fallback", any_kept == 0).where(kept | F.col("is_fallback"))


def top_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_top", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_top = 1").drop("_top")


def spoken_names(df: DataFrame, scope: list[str], label: str, colour: str, ident: str) -> DataFrame:
    """Adds name: a label that is alone; else its colour with it where that is unique among the label's;
    else an ordinal over the label's remaining rows by id: first ... tenth, 11th, 12th ..."""
    of_label, of_colour = Window.partitionBy(*scope, label), Window.partitionBy(*scope, label, colour)
    counted = df.withColumn("_l", F.count("*").over(of_label)).withColumn("_c", F.when(F.col(colour).isNotNull(), F.count("*").over(of_colour)))
    left = (F.col("_l") > 1) & (F.coalesce(F.col("_c"), F.lit(2)) > 1)
    counted = counted.withColumn("_r", F.when(left, F.row_number().over(Window.partitionBy(*scope, label, left).orderBy(ident))))
    words = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
    r = F.col("_r")
    suffix = F.when((r % 100).between(11, 13), "th").when(r % 10 == 1, "st").when(r % 10 == 2, "nd").when(r % 10 == 3, "rd").otherwise("th")
    ordinal = F.when(r <= 10, F.get(F.array(*map(F.lit, words)), (r - 1).cast("int"))).otherwise(F.concat(r.cast("string"), suffix))
    name = F.when(F.col("_l") == 1, F.col(label)).when(~left, F.concat_ws(" ", colour, label)).otherwise(F.concat_ws(" ", ordinal, label))
    return counted.withColumn("name", name).drop("_l", "_c", "_r")


def last_n(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def daily_admission(df: DataFrame, user: str, ts: str, order: list[str], first_of: str, quota: int) -> DataFrame:
    """Adds day, charged (the first row of each first_of value) and admitted (charged rows up to the quota
    of the user's UTC day; repeats of an admitted value are replays: admitted and not charged)."""
    day = df.withColumn("day", F.to_date(ts)).withColumn("charged", F.row_number().over(Window.partitionBy(user, first_of).orderBy(*order)) == 1)
    used = F.sum(F.col("charged").cast("int")).over(Window.partitionBy(user, "day").orderBy(*order))
    day = day.withColumn("used", used)
    own = F.col("charged") & (F.col("used") <= quota)
    return day.withColumn("admitted", F.max(own).over(Window.partitionBy(user, first_of)))


def two_level_split(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """For each key the split of its ordered values into two levels of the least squared error: split (the
    rows before it), sse, left and right means. Keys of one row have none. Ties: the first split."""
    w = Window.partitionBy(*key).orderBy(*order)
    every = Window.partitionBy(*key)
    v = F.col(value).cast("double")
    s = df.select(*key, F.row_number().over(w).alias("i"), F.count("*").over(every).alias("n"), F.sum(v).over(w).alias("a"), F.sum(v * v).over(w).alias("aa"), F.sum(v).over(every).alias("t"), F.sum(v * v).over(every).alias("tt"))
    s = s.where("i < n")
    sse = F.col("aa") - F.col("a") ** 2 / F.col("i") + (F.col("tt") - F.col("aa")) - (F.col("t") - F.col("a")) ** 2 / (F.col("n") - F.col("i"))
    s = s.withColumn("sse", F.round(sse, 4)).withColumn("left_mean", F.col("a") / F.col("i")).withColumn("right_mean", (F.col("t") - F.col("a")) / (F.col("n") - F.col("i")))
    return top_one(s, key, [F.asc("sse"), F.asc("i")]).select(*key, F.col("i").alias("split"), "sse", "left_mean", "right_mean")


def autocorrelation(df: DataFrame, key: list[str], order: list[str], value: str, most_lag: int) -> DataFrame:
    """Autocorrelation of each key's values around their mean, for lags 1 to most_lag: a join of rows on
    their numbers, so no row meets more than most_lag others."""
    x = df.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("i"), (F.col(value) - F.avg(value).over(Window.partitionBy(*key))).alias("x"))
    later = x.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most_lag)))).select(*key, (F.col("i") - F.col("lag")).alias("i"), "lag", F.col("x").alias("y"))
    power = x.groupBy(*key).agg(F.sum(F.col("x") ** 2).alias("power"))
    top = x.join(later, [*key, "i"]).groupBy(*key, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("top"))
    return top.join(power, key).select(*key, "lag", F.try_divide("top", F.nullif("power", F.lit(0.0))).alias("r"))


def fill_gaps(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Adds filled: missing values between two known ones by linear interpolation over `order`; the ends
    take the nearest known value."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    a, b = F.last(value, ignorenulls=True).over(before), F.first(value, ignorenulls=True).over(after)
    ta, tb = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    between = a + (b - a) * (F.col(order) - ta) / F.nullif(tb - ta, F.lit(0))
    return df.withColumn("filled", F.coalesce(F.col(value), between, a, b))


def as_of(left: DataFrame, right: DataFrame, key: list[str], ts: str, values: list[str]) -> DataFrame:
    """The right side's last row at or before each left row, by one sorted union and a window rather
    than a range join: prev_* columns, null where there is none."""
    rows = left.withColumn("_side", F.lit(1)).unionByName(right.select(*key, ts, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_p", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_p.{v}").alias(f"prev_{v}") for v in values])


def smoothstep(x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return t * t * (3 - 2 * t)


def fold_runs(df: DataFrame, key: list[str], order: str, kind: str, text: str, joint: str = " ") -> DataFrame:
    """One row for each run of one kind: its first place, its rows and its texts, joined in order."""
    w = Window.partitionBy(*key).orderBy(order)
    runs = with_runs(df, key, [order], F.col(kind) != F.lag(kind).over(w))
    got = runs.groupBy(*key, "run").agg(F.min(order).alias("first"), F.first(kind).alias(kind), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, text))).alias("_t"))
    return got.withColumn("text", F.array_join(F.transform("_t", lambda t: t[text]), joint)).drop("_t")


def widest_strip(df: DataFrame, key: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Over all strips of k rows in order, the largest of their least values, and the place where the
    first such strip begins; keys of fewer than k rows have none."""
    w = Window.partitionBy(*key).orderBy(*order)
    s = df.select(*key, (F.row_number().over(w) - 1).alias("begin"), F.min(value).over(w.rowsBetween(0, k - 1)).alias("least"), F.count("*").over(w.rowsBetween(0, k - 1)).alias("_n"))
    return top_one(s.where(F.col("_n") == k), key, [F.desc("least"), F.asc("begin")]).drop("_n")


def nearest_rank(df: DataFrame, key: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p/100 * n) of the sorted ones."""
    w = Window.partitionBy(*key)
    r = df.select(*key, F.col(value).alias("_v"), F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("_n"))
    return r.groupBy(*key).agg(*[F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.ceil(F.col("_n") * p / 100)), F.col("_v"))).alias(f"p{p}") for p in percents])


def state_durations(df: DataFrame, key: list[str], ts: str, tie: str, state: str) -> DataFrame:
    """Seconds that each key has spent in each state, until the next row; the last row lasts 0 seconds."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    seconds = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return df.withColumn("_s", F.coalesce(seconds, F.lit(0.0))).groupBy(*key, state).agg(F.sum("_s").alias("seconds"), F.count("*").alias("n"))


def longest_flagged_run(df: DataFrame, key: list[str], order: list[str], flag: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    f = F.coalesce(flag, F.lit(False))
    marked = df.withColumn("_f", f)
    runs = with_runs(marked, key, order, F.col("_f") != F.lag("_f").over(w))
    return runs.groupBy(*key).agg(F.max(F.when(F.col("_f"), F.col("run_length")).otherwise(0)).alias("longest"))


def gate(df: DataFrame, key: list[str], order: list[str], value: str, step: float) -> DataFrame:
    """Keeps a key's first row, and each later one whose value differs from the last KEPT row's by at least
    `step`. The fold carries one number, so a key's rows stream through a task in sorted order and are
    never held together."""
    schema = df.schema
    names = df.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0.0
        for f in frames:
            keys, take = list(zip(*[f[k] for k in key], strict=True)), []
            for k, v in zip(keys, f[value].to_numpy(), strict=True):
                good = k != now or abs(v - last) >= step
                if good:
                    now, last = k, v
                take.append(good)
            yield f[take][names]

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(fold, schema)
