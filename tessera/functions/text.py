"""Text expressions: numbers in words, lists, slugs, units, sentences and event blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def down_to(x: Column, step: float) -> Column:
    return F.floor(x / step) * step


def to_nearest(x: Column, step: float) -> Column:
    return F.round(x / step) * step


def spoken_list(items: Column) -> Column:
    """`a`, `a and b`, `a, b and c`; an empty text for no items."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def normalised(text: Column) -> Column:
    """Lower case without punctuation, articles and repeated space."""
    bare = F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r" +", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def last_sentence(text: Column) -> Column:
    """The last run of characters up to a sentence mark, with the mark."""
    return F.trim(F.regexp_extract(text, r"([^.!?]*[.!?]?)\s*$", 1))


def estimated_tokens(text: Column, per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / per_token)


def ago(seconds: Column) -> Column:
    """A phrase for an age."""
    s = F.floor(seconds)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(s < 60, "just now").when(s < 3600, plural(F.floor(s / 60), "minute")).when(s < 86400, plural(F.floor(s / 3600), "hour")).otherwise(plural(F.floor(s / 86400), "day"))


def sse_block(kind: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def parse_sse(block: Column) -> Column:
    """struct(event, data): the last event line, and all data lines joined; null without data."""
    lines = F.split(block, "\n")
    pick = lambda field: F.transform(F.filter(lines, lambda x: x.startswith(f"{field}:")), lambda x: F.regexp_replace(x, f"^{field}: ?", ""))
    data = pick("data")
    return F.when(F.size(data) > 0, F.struct(F.coalesce(F.try_element_at(pick("event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data")))


def suffix_swapped(uri: Column, to: str) -> Column:
    """The uri with another extension; a query or fragment is cut."""
    return F.concat(F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"\.[^./]*$", ""), F.lit(to))
