"""Ordered validation, collected problems, vocabularies and state edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failure(checks: list[tuple[str, Column, Column]]) -> Column:
    """struct(code, detail) of the first check (code, holds, detail) that does not hold; null if all do.
    A check whose value is unknown does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, holds, detail in checks])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that fire, in rule order; an empty array if none does."""
    return F.array_compact(F.array(*[F.when(fires, F.lit(name)) for name, fires in rules]))


def path_problem(path: Column, most_chars: int = 128, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The first problem of a relative path's grammar, or null: empty, absolute, a store's url, parent
    segments, too long, more than one folder, a folder or extension that is not allowed, characters."""
    parts = F.split(path, "/")
    checks = [("empty", path != ""), ("absolute", ~path.startswith("/")), ("store_url", ~path.startswith("gs://")), ("parent_segment", ~F.array_contains(parts, "..")), ("too_long", F.length(path) <= most_chars), ("too_deep", F.size(parts) <= 2)]
    if kinds:
        extension = F.regexp_extract(path, r"\.([^./]*)$", 1)
        allowed = F.lit(False)
        for folder, extensions in kinds.items():
            allowed = allowed | ((F.when(F.size(parts) == 2, parts[0]).otherwise("") == folder) & extension.isin(*extensions))
        checks.append(("kind", allowed))
    checks.append(("characters", F.element_at(parts, -1).rlike(r"^[A-Za-z0-9._-]+$")))
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in checks])


def set_problems(df: DataFrame, group: list[str], name: str, size: str, required: str, most_rows: int, most_total: int) -> DataFrame:
    """The first violation of each group's whole-set rules, in order: too many rows, a repeated name, a
    required name missing, too large a sum. One aggregation; null if none."""
    named = df.groupBy(*group, name).agg(F.count("*").alias("_n"), F.sum(size).alias("_b"))
    whole = named.groupBy(*group).agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most"), F.max((F.col(name) == required).cast("int")).alias("_has"), F.sum("_b").alias("_b"))
    problem = F.when(F.col("_n") > most_rows, "too_many").when(F.col("_most") > 1, "repeated").when(F.col("_has") == 0, "missing").when(F.col("_b") > most_total, "too_large")
    return whole.select(*group, F.col("_n").alias("n"), F.col("_b").alias("bytes"), problem.alias("problem"))


def keep_first(df: DataFrame, key: list[str], order: list[Column], most: int | None = None, cap_key: list[str] | None = None) -> DataFrame:
    """The first row of each key by `order`; then at most `most` rows of each cap_key in that order."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1")
    if most is not None:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*cap_key).orderBy(*order))).where(F.col("_n") <= most)
    return first.drop("_n")


def label_split(label: Column, denied: list[str]) -> Column:
    """Whether a label, without regard to case and outer space, is on the deny list; null is not."""
    return F.coalesce(F.lower(F.trim(label)).isin(*denied), F.lit(False))


def vocabulary_gaps(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two anti joins: values (side, value) of one side that the other lacks."""
    a, b = left.select(F.col(on).alias("value")).distinct(), right.select(F.col(on).alias("value")).distinct()
    return a.join(b, "value", "left_anti").select(F.lit("left").alias("side"), "value").unionByName(b.join(a, "value", "left_anti").select(F.lit("right").alias("side"), "value"))


#: The states of a scene and their edges.
STATE_EDGES = {
    "queued": ("processing", "failed", "failed_incomplete", "failed_invalid"),
    "processing": ("ready", "failed"),
    "failed": ("queued",),
    "failed_incomplete": ("queued",),
    "ready": (),
    "failed_invalid": (),
}


def edge_allowed(state: Column, to: Column) -> Column:
    """Whether the state machine has the edge; unknown states have none."""
    out = F.lit(False)
    for a, bs in STATE_EDGES.items():
        if bs:
            out = out | ((state == a) & to.isin(*bs))
    return F.coalesce(out, F.lit(False))


def expiry_after(state: Column, now: Column, expires: Column, days: int) -> Column:
    """Terminal failures expire `days` after now, a queued row never, others keep what they have."""
    return F.when(state.isin("failed", "failed_incomplete", "failed_invalid"), now + F.expr(f"INTERVAL {days} DAYS")).when(state == "queued", F.lit(None)).otherwise(expires)
