"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fit one sequence. The program (as few sequences as
cover all pieces) is solved by multiplicative weights: a price for each length, an unbounded
knapsack by dynamic programming that finds the dearest configurations, prices that fall with
coverage, until every length is covered. It is then rounded, and what the rounding leaves is filled
best-fit, a configuration at a time.
All of this sees only the histogram, of at most `size` numbers, however many pieces there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, written
from .tokens import encoder


def knapsack(prices: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each room up to `size`: the highest price, the largest room no larger where a length is taken
    last, and that length; unbounded."""
    value = np.full(size + 1, -1.0)
    value[lengths] = prices
    best, take = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        with_last = value[1 : c + 1] + best[c - 1 :: -1]
        k = int(with_last.argmax())
        if with_last[k] > best[c - 1]:
            best[c], take[c] = with_last[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, np.maximum.accumulate(np.where(take > 0, np.arange(size + 1), 0)), take


def filled(first: int, room: int, down: list[int], take: list[int]) -> dict[int, int]:
    """The dearest configuration {length: count} that holds `first`."""
    out, c = {first: 1}, room - first
    while (c := down[c]) > 0:
        out[take[c]] = out.get(take[c], 0) + 1
        c -= take[c]
    return out


def covering(lengths: np.ndarray, count: np.ndarray, size: int, rounds: int | None, step: float, slack: float = 0.02) -> tuple[dict[tuple, float], np.ndarray]:
    """Amounts of configurations that cover each length at least once, and the coverage.

    A round solves one knapsack and takes, for each length still short of coverage, the dearest
    configuration with it, as long as its price by now is within `slack` of the dearest of all; prices
    only fall, so the knapsack stays an upper bound. Each one taken covers some length by `step` more,
    and a length covered well above the least is worth next to nothing: so rounds end by the number
    of lengths and the step. `rounds` is for callers who want a coarser program sooner.
    """
    place = {int(k): j for j, k in enumerate(lengths)}
    covered, used, done = np.zeros(len(lengths)), {}, 0
    while covered.min() < 1 - 1e-9 and (rounds is None or done < rounds):
        done += 1
        # the least covered lengths cost most; a length's own size is its fair price
        base = covered.min()
        prices = lengths / size * np.exp(-(covered - base) / step)
        best, down, take = knapsack(prices, lengths, size)
        with_each = prices + best[size - lengths]
        down, take, prices = down.tolist(), take.tolist(), prices.tolist()
        least = (1 - slack) * float(best[size])
        for j in np.lexsort((-lengths, covered)).tolist():
            if with_each[j] < least or (covered[j] >= 1 and with_each[j] < best[size] - 1e-12):
                continue
            found = filled(int(lengths[j]), size, down, take)
            at = [place[k] for k in found]
            if sum(a * prices[q] for a, q in zip(found.values(), at, strict=True)) < least:
                continue
            amount = step * min(count[q] / a for a, q in zip(found.values(), at, strict=True))
            key = tuple(sorted(found.items()))
            used[key] = used.get(key, 0.0) + amount
            for (k, a), q in zip(found.items(), at, strict=True):
                covered[q] += amount * a / count[q]
                prices[q] = k / size * math.exp(-(covered[q] - base) / step)
    return used, covered


def configurations(histogram: dict[int, int], size: int, rounds: int | None = None, step: float = 0.25) -> list[tuple[dict[int, int], int]]:
    """[(configuration, copies)] that hold each piece of the histogram exactly once."""
    return program(histogram, size, rounds, step)[0]


def program(histogram: dict[int, int], size: int, rounds: int | None = None, step: float = 0.25) -> tuple[list[tuple[dict[int, int], int]], dict[str, float]]:
    """The configurations, and of the covering program: the least coverage, and the shares of pieces and
    of ids that its rounded amounts place."""
    left = {int(k): int(n) for k, n in sorted(histogram.items()) if n > 0}
    if not left:
        return [], {"coverage": 1.0, "pieces": 1.0, "ids": 1.0}
    lengths = np.array(list(left), dtype=np.int64)
    count = np.array([left[k] for k in left], dtype=np.float64)
    used, covered = covering(lengths, count, size, rounds, step)
    plan: dict[tuple, int] = {}

    def put(found: tuple, most: float) -> None:
        n = int(min(most, *(left[k] // a for k, a in found)))
        if n > 0:
            plan[found] = plan.get(found, 0) + n
            for k, a in found:
                left[k] -= a * n

    # rounded up as far as pieces are left; what fills a sequence worse than the program does on the whole is left to best-fit
    fill = {found: sum(k * a for k, a in found) for found in used}
    mean = sum(fill[found] * amount for found, amount in used.items()) / sum(used.values()) if used else 0
    for found, amount in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        if fill[found] >= mean - 1e-6:
            put(found, math.ceil(amount))
    over = np.array([left[k] for k in left], dtype=np.float64)
    report = {"coverage": float(covered.min()), "pieces": float(1 - over.sum() / count.sum()), "ids": float(1 - (over @ lengths) / (count @ lengths))}
    # what remains: the longest first, then always the longest that still fits; each turn uses up a length
    while remaining := [k for k in sorted(left, reverse=True) if left[k]]:
        room, found = size, {}
        for k in remaining:
            n = min(room // k, left[k])
            if n:
                found[k] = n
                room -= n * k
        put(tuple(sorted(found.items())), float("inf"))
    return [(dict(k), n) for k, n in plan.items()], report


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: rows (length, first rank, first sequence, offset)."""
    rows, seen, sequence = [], {}, 0
    for found, copies in plan:
        offset = 0
        for k in sorted(found, reverse=True):
            for _ in range(found[k]):
                rows.append((k, seen.get(k, 0), sequence, offset))
                seen[k] = seen.get(k, 0) + copies
                offset += k
        sequence += copies
    rows.sort()
    return {n: np.array([r[j] for r in rows], dtype=np.int64) for j, n in enumerate(("length", "rank", "sequence", "offset"))}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block string, rank long"


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of at most `size` ids of every whole text. `rank` numbers the pieces of one length in a block."""

    def cut(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, tail = encoder(tokenizer), b"" if end is None else int(end).to_bytes(4, "little")
        task = TaskContext.get().partitionId()
        for turn, b in enumerate(batches(tables, 4 << 20)):
            out, seen = [[] for _ in range(7)], {}
            for i, ids in zip(b.column(0).to_pylist(), codec.encode(b.column(1).to_pylist()), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    for col, v in zip(out, (i, k, at // 4, n, zlib.crc32(part), f"{task}-{turn}", seen.get(n, 0)), strict=True):
                        col.append(v)
                    seen[n] = seen.get(n, 0) + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end: int | None = 0, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """Packs every whole text; returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents of more than `size` ids are cut, into pieces of `size` ids and a last shorter one.
    Null texts and empty ones have the end id alone (without one: no piece). Null ids and repeated
    rows are packed as rows of their own. Other columns are not read. An empty table gives no rows.
    """
    pieces = written(token_pieces(docs, tokenizer, size, end, doc_id, text), "pieces")
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    where = slots(configurations(histogram, size, rounds))
    keys = (where["length"] << 44) + where["rank"] if histogram else np.zeros(0, dtype=np.int64)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    table = docs.sparkSession.sparkContext.broadcast((keys, where))  # bounded by the number of lengths

    def place(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, where = table.value
        for b in tables:
            rank = b.column(5).to_numpy()
            k = np.searchsorted(keys, (b.column(3).to_numpy() << 44) + rank, "right") - 1
            sequence = where["sequence"][k] + rank - where["rank"][k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(where["offset"][k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
