"""N-gram Jaccard join: the size-aware heavy-light join.

Sets are ordered by size. Small (light) sets list all subsets of the size that two linked sets of
their sizes must share, and meet in them: a shared subset is a link. Large (heavy) sets scan
inverted lists: their shingles are ordered from rare to frequent, by counts over the whole corpus,
and only as many of the rarest are looked up as a linked set cannot avoid. The boundary is the size at
which listing subsets would cost more than scanning lists.

Equal sets are one class throughout. Verification is exact and per list. First every set of a list is compared
with the list's most central one alone (the one of the largest share of shingles that others hold, which the
base of a family of near copies is), and verified links are united. Then only lists that still hold two
components are open: their sets are compared all with all, in parts of bounded size and pairs of parts, frequent
shingles by matrix products, rare ones by their short lists. Lists of the same sets are one list. Sets that
open lists join, directly or through others, are compared as one group while that is small, else list by
list, so that chance meetings never make a group of unbounded size. A part gives a spanning forest of its
links, so a group of near copies never becomes a list of its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, shingle_hashes, word_hashes, written
from ..operators.graphs import connected_components
from .exchange import count_keys, for_each_block, make_blocks

#: Sizes above this are never light: their subsets cost more than any list.
MOST_LIGHT = 16


def needed(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of sizes a and b: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """A linked set shares at least percent % of a set, so one of its first so many shingles."""
    return size - -(-percent * size // 100) + 1


def subset_keys(items: np.ndarray, percent: int, most: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(smaller size, larger size, subset) for all sizes up to `most` with which this set can link. Sets of
    the smaller and of the larger size that meet in one link; two of the larger size need not."""
    n, values = len(items), items.tolist()
    for other in range(-(-percent * n // 100), min(most, 100 * n // percent) + 1):
        a, b = min(n, other), max(n, other)
        if (c := needed(a, b, percent)) <= a:
            for s in itertools.combinations(values, c):
                yield a, b, s


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """The boundary of the least cost. A light set costs its subsets; a heavy one two postings for each
    shingle that it looks up, and its shingles once more when it is verified."""
    best, gain, at = 0.0, 0.0, 0
    for n in range(1, MOST_LIGHT + 1):
        subsets = sum(math.comb(n, needed(min(n, o), max(n, o), percent)) for o in range(-(-percent * n // 100), 100 * n // percent + 1) if needed(min(n, o), max(n, o), percent) <= min(n, o))
        gain += sizes.get(n, 0) * (2 * prefix_length(n, percent) + n - subsets)
        if gain > best:
            best, at = gain, n
    return at


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, percent: int, dense: int = 24, columns: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, as pairs of ids. Shingles that over `dense` of
    the sets hold are counted by matrix products of `columns` at a time, the others by their lists."""
    n = len(sets)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(n), lengths)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), dtype=np.float32)
    frequent = np.flatnonzero(count > dense)
    place = np.full(len(count), -1, dtype=np.int64)
    place[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), columns):
        inside = (place[col] >= at) & (place[col] < at + columns)
        m = np.zeros((n, min(columns, len(frequent) - at)), dtype=np.float32)
        m[row[inside], place[col[inside]] - at] = 1
        shared += m @ m.T
    few = np.flatnonzero((count[col] > 1) & (count[col] <= dense))
    few = few[np.argsort(col[few], kind="stable")]
    r, c = row[few], col[few]
    for step in range(1, dense):  # each row of a list with the one `step` places before it
        same = c[step:] == c[:-step] if len(c) > step else np.zeros(0, dtype=bool)
        if not same.any():
            break
        np.add.at(shared, (r[step:][same], r[:-step][same]), 1)
        np.add.at(shared, (r[:-step][same], r[step:][same]), 1)
    links = 100 * shared.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - shared.astype(np.int64))
    out, new = [], np.ones(n, dtype=bool)
    for k in range(n):  # breadth first
        if not new[k]:
            continue
        new[k], edge = False, [k]
        while edge:
            at = edge.pop()
            reached = np.flatnonzero(links[at] & new)
            new[reached] = False
            out += [(int(ids[k]), int(ids[j])) for j in reached]
            edge += reached.tolist()
    return out


SETS = "kind string, doc_id long, n_shingles long, high long, low long, shingles binary, prefix array<long>"


def shingle_sets(docs: DataFrame, n: int, percent: int, doc_id: str, text: str, block_bytes: int = 8 << 20) -> DataFrame:
    """A written table. kind `doc`: every row's id, set size and class (128 bits; null: no words). kind
    `set`: each block's distinct sets that may link with another text: the shingles that two texts or
    more hold (the others meet none; all, of small sets), and the rarest ones to look up."""
    blocks = make_blocks(docs, doc_id, text, block_bytes)

    def sets_of(texts: list[bytes]) -> list[np.ndarray]:
        words, at = word_hashes(texts)
        return [np.unique(shingle_hashes(words[a:b], n)) for a, b in zip(at[:-1], at[1:], strict=True)]

    def distinct(sets: list[np.ndarray]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for k, s in enumerate(sets):
            if len(s):
                out.setdefault(xxhash.xxh128_digest(s.tobytes()), k)
        return out

    def keys_of(ids: list, texts: list[bytes]) -> dict:
        sets = sets_of(texts)
        once = [sets[k] for k in distinct(sets).values()]
        return {0: np.unique(np.concatenate(once), return_counts=True)} if once else {}

    def sets_to_link(ids: list, texts: list[bytes], told) -> pd.DataFrame:
        sets = sets_of(texts)
        classes = distinct(sets)
        rows = []
        for i, s in zip(ids, sets, strict=True):
            high, low = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), ">i8").tolist() if len(s) else (None, None)
            rows.append(("doc", i, len(s), high, low, None, None))
        if classes:
            keys = np.unique(np.concatenate([sets[k] for k in classes.values()]))
            counts = told(0, keys)
            for digest, k in classes.items():
                s = sets[k]
                held = counts[np.searchsorted(keys, s)]
                rare = np.lexsort((s, held))[: prefix_length(len(s), percent)]
                rare = rare[held[rare] > 1]
                if len(rare) or len(s) <= MOST_LIGHT:
                    high, low = np.frombuffer(digest, ">i8").tolist()
                    kept = s if len(s) <= MOST_LIGHT else s[held > 1]
                    rows.append(("set", ids[k], len(s), high, low, kept.tobytes(), s[rare].view(np.int64).tolist()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SETS.split(", ")])
        for c in ("doc_id", "high", "low"):
            out[c] = pd.array(out[c].to_list(), dtype="Int64")
        return out

    counts = count_keys(blocks, keys_of, {0: 40})  # a count that is too high only gives more to verify
    return written(for_each_block(blocks, counts, sets_to_link, SETS), "sets")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, part: int = 1024, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Links texts whose sets of distinct n-word shingles have 100 * intersection >= percent * union, and
    returns doc_id, n_shingles and component_id (the least id reachable by links) for each row.

    Words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. A text of fewer than n words is one shingle of all its
    words; without words (null, empty, white space) the set is empty and links with nothing. Equal
    sets link. A null id has no component unless it shares one with other ids; repeated rows each
    give a row. Other columns are not read; no rows give no rows.
    """
    found = shingle_sets(docs, n, percent, doc_id, text, block_bytes)
    every = found.where("kind = 'doc'").select("doc_id", "n_shingles", "high", "low")
    # the least id of each class stands for it
    named = every.where("high is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    sets = found.where("kind = 'set'").groupBy("high", "low").agg(F.first("n_shingles").alias("size"), F.first("shingles").alias("shingles"), F.first("prefix").alias("prefix"))
    sets = written(sets.join(named, ["high", "low"]).where("rep is not null").select("rep", "size", "shingles", "prefix"), "reps")

    small = {r[0]: r[1] for r in sets.where(F.col("size") <= MOST_LIGHT).groupBy("size").agg(F.count("*")).collect()}  # at most MOST_LIGHT rows
    light = light_boundary(small, percent)

    def subsets(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            reps, keys, small, large = [], [], [], []
            for rep, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in subset_keys(np.frombuffer(raw, np.uint64), percent, light):
                    reps.append(rep)
                    keys.append(xxhash.xxh128_hexdigest(repr(x)))
                    small.append(len(raw) == 8 * x[0])
                    large.append(len(raw) == 8 * x[1])
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(keys, pa.string()), pa.array(small, pa.bool_()), pa.array(large, pa.bool_())], names=["rep", "key", "small", "large"])

    met = sets.where(F.col("size") <= light).select("rep", "shingles").mapInArrow(subsets, "rep long, key string, small boolean, large boolean")
    least = met.groupBy("key").agg(F.min("rep").alias("least"), F.max("small").alias("small"), F.max("large").alias("large")).where("small and large").drop("small", "large")
    light_links = met.join(least, "key").select(F.col("rep").alias("src"), F.col("least").alias("dst")).where("src != dst").distinct()

    # A list is kept for each shingle and band of sizes; linked sets lie in one band or in two next to
    # each other, and a set enters its own band and the next one.
    heavy = F.col("size") > F.lit(percent * light // 100)
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9))
    # how central a set is: the share of its shingles that other sets hold
    central = F.octet_length("shingles") / (8 * F.col("size"))
    posted = sets.where(heavy).select("rep", F.explode("prefix").alias("shingle"), band.alias("band"), central.alias("central"))
    posted = written(posted.select("rep", "shingle", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "central"), "postings")
    heads = posted.groupBy("shingle", "band").agg(
        F.max(F.struct("central", -F.col("rep"))).alias("top"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")
    )
    # lists of the same sets, by 128 bits, are one
    lists = heads.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("shingle", "band")).alias("at"), F.first("top").alias("top"))
    lists = lists.select("at.shingle", "at.band", "n", (-F.col("top.col2")).alias("head"))
    members = written(posted.join(lists, ["shingle", "band"]).select("shingle", "band", "n", "head", "rep"), "members")

    def star_links(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, 8 << 20):
            src, dst = [], []
            for rep, head, n, m, s, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                shared = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                if 100 * shared >= percent * (n + m - shared):
                    src.append(rep)
                    dst.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    stars = members.where("rep != head").select("rep", "head").distinct()
    stars = stars.join(sets.select("rep", "size", "shingles"), "rep").join(sets.select(F.col("rep").alias("head"), F.col("size").alias("m"), F.col("shingles").alias("t")), "head")
    stars = stars.select("rep", "head", "size", "m", "shingles", "t").mapInArrow(star_links, "src long, dst long")
    links = written(stars.unionByName(light_links), "links")
    joined = connected_components(links)

    label = F.coalesce("component", "rep")
    labelled = members.join(joined, members["rep"] == joined["node"], "left").select("shingle", "band", "n", "head", "rep", label.alias("label"))
    open_ = labelled.groupBy("shingle", "band").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("shingle", "band")
    todo = written(labelled.join(open_, ["shingle", "band"]).select(F.xxhash64("shingle", "band").alias("list"), "n", "head", "rep"), "open-lists")
    if not todo.isEmpty():
        groups = connected_components(todo.where("rep != head").select(F.col("rep").alias("src"), F.col("head").alias("dst")))
        counted = groups.groupBy("component").agg(F.count("*").alias("in_group"))
        of_group = written(groups.join(counted, "component").select(F.col("node").alias("rep"), "component", "in_group"), "groups")
        in_lists = todo.select("list", "n", "rep").join(of_group, "rep")
        small = of_group.where(F.col("in_group") <= part).select("rep", F.xxhash64(F.lit("group"), "component").alias("g"), F.col("in_group").alias("n"))
        large = in_lists.where(F.col("in_group") > part).select("rep", F.xxhash64(F.lit("list"), "list").alias("g"), "n")
        spots = written(small.unionByName(large), "spots")
        bins = max(1, -(-spots.where(F.col("n") <= part).count() // (part // 2)))
        # small ones fill bins; a large one is cut into parts, and each pair of its parts is one task's work
        cut = F.ceil(F.col("n") / part).cast("int")
        own = F.pmod(F.xxhash64("rep"), cut).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), cut - 1), lambda j: F.struct(F.col("g"), F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
        in_bin = F.array(F.struct(F.pmod("g", F.lit(bins)).alias("g"), F.lit(-1).alias("a"), F.lit(-1).alias("b")))
        spots = spots.select("rep", F.explode(F.when(F.col("n") <= part, in_bin).otherwise(pairs)).alias("to")).select("rep", "to.*").distinct()

        def verify(rows: pd.DataFrame) -> pd.DataFrame:
            sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            return pd.DataFrame(linked_forest(rows["rep"].to_numpy(), sets, rows["size"].to_numpy(), percent), columns=["src", "dst"], dtype=np.int64)

        more = spots.join(sets.select("rep", "size", "shingles"), "rep").groupBy("g", "a", "b").applyInPandas(verify, "src long, dst long")
        joined = connected_components(written(links.unionByName(more), "all-links"))
    of_class = named.join(joined, named["rep"] == joined["node"], "left").select("high", "low", F.coalesce("component", "rep").alias("component_id"))
    of_class = written(of_class, "classes")
    return every.join(of_class, ["high", "low"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
