"""Packing into full windows by non-negative least squares over the histogram of lengths.

Texts are cut into windows of `size` ids and a last shorter piece each. Shallow combinations of the
shorter lengths (several of one, and up to two others) that fill a window to the last id are enumerated, and their
repeat counts are solved against the histogram by non-negative least squares and rounded. What the
rounding leaves is packed greedily, the longest first; where nothing fits, a piece is cut to fill the window. The last
ids of all make windows of falling powers of two. So there is no padding, and few pieces are cut.
All of this sees at most `size` numbers, however many texts there are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, written
from .tokens import byte_encoder, vocabulary_size

#: Combinations enumerated for each length: how often it may occur itself, and lengths tried as the second one.
REPEATS, SECONDS = 6, 12


def combinations(count: dict[int, int], size: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, times), ..) of at most three of these lengths that fill `size` exactly."""
    common = sorted(sorted(count, key=lambda k: (-count[k], k))[: 8 * SECONDS])
    found = set()
    for a in sorted(count):
        most = size // a
        for m in sorted({*range(1, min(most, REPEATS) + 1), *range(max(1, most - REPEATS + 1), most + 1)}):
            rest = size - m * a
            if rest == 0:
                found.add(((a, m),))
                continue
            if rest in count and rest != a:
                found.add(tuple(sorted([(a, m), (rest, 1)])))
            # seconds spread over the commoner lengths below the rest, a different slice for each length and repeat
            below = [b for b in common if b < rest and b != a and rest - b in count]
            for b in below[(a + m) % max(1, len(below) // SECONDS) :: max(1, len(below) // SECONDS)][:SECONDS]:
                c = rest - b
                if c != a:
                    found.add(tuple(sorted([(a, m), (b, 2)] if b == c else [(a, m), (b, 1), (c, 1)])))
    return sorted(found)


def least_squares(columns: list[tuple[tuple[int, int], ...]], count: dict[int, int], rounds: int = 2000, slack: float = 1e-4) -> tuple[np.ndarray, float]:
    """Amounts x >= 0 of the columns for which their sums come nearest to the counts, and the distance's share of the
    counts. Accelerated projected gradients on columns of unit length, started anew where the distance grows; they
    end when no length is off by more than `slack` of the largest count, or after `rounds`."""
    lengths = sorted(count)
    place = {k: j for j, k in enumerate(lengths)}
    goal = np.array([count[k] for k in lengths], dtype=np.float64)
    row = np.array([place[k] for c in columns for k, _ in c], dtype=np.int64)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    times = np.array([m for c in columns for _, m in c], dtype=np.float64)
    if not len(columns):
        return np.zeros(0), 1.0
    norm = np.sqrt(np.bincount(col, times**2, len(columns)))
    unit = times / norm[col]
    forth = lambda y: np.bincount(row, unit * y[col], len(goal))
    back = lambda r: np.bincount(col, unit * r[row], len(columns))
    v = np.ones(len(columns))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(forth(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(columns))
    t, before = 1.0, np.inf
    for _ in range(rounds):
        r = forth(y) - goal
        after = float(r @ r)
        if np.abs(r).max() <= slack * goal.max():
            x = np.maximum(y, 0)
            break
        new = np.maximum(y - back(r) / (1.05 * bound), 0)
        if after > before:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t, before = new, new + (t - 1) / s * (new - x), s, after
    return x / norm, float(np.linalg.norm(forth(x) - goal) / np.linalg.norm(goal))


class Stock:
    """Pieces by length, as runs (origin, start, first, n): n pieces from rank `first` on of those that were cut from texts
    with length `origin`, each from its id `start` on."""

    def __init__(self, count: dict[int, int]):
        self.runs = {k: deque([(k, 0, 0, n)]) for k, n in count.items()}
        self.left = dict(count)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.left[length] -= n
        runs = self.runs[length]
        while n:
            origin, start, first, have = runs.popleft()
            got = min(have, n)
            out.append((origin, start, first, got))
            if have > got:
                runs.appendleft((origin, start, first + got, have - got))
            n -= got
        if not self.left[length]:
            del self.left[length], self.runs[length]
        return out

    def give(self, length: int, runs: list[tuple[int, int, int, int]]) -> None:
        self.runs.setdefault(length, deque()).extend(runs)
        self.left[length] = self.left.get(length, 0) + sum(r[3] for r in runs)


def plan(count: dict[int, int], size: int) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Where pieces go: rows (origin, start, first, n, length, times, sequence, offset), `times` of them beside each other
    in one sequence; and a report of the program's distance, the shares that its rounded counts place, sequences and cuts."""
    stock, rows = Stock({k: n for k, n in count.items() if n}), []
    pieces, ids = sum(count.values()), sum(k * n for k, n in count.items())
    columns = combinations(stock.left, size)
    amount, distance = least_squares(columns, stock.left) if columns else (np.zeros(0), 1.0)
    sequence = cuts = 0

    def put(runs: list[tuple[int, int, int, int]], length: int, times: int, first_sequence: int, offset: int) -> None:
        """Runs of n pieces in all, `times` to a sequence; a run may end within a sequence."""
        at = 0
        for origin, start, first, n in runs:
            rows.append((origin, start, first, n, length, times, first_sequence, offset, at))
            at += n

    for j in np.argsort(-amount, kind="stable").tolist():
        copies = min(int(round(float(amount[j]))), *(stock.left.get(k, 0) // m for k, m in columns[j]))
        if copies <= 0:
            continue
        offset = 0
        for k, m in columns[j]:
            put(stock.take(k, copies * m), k, m, sequence, offset)
            offset += k * m
        sequence += copies
    placed = {"distance": distance, "pieces": 1 - sum(stock.left.values()) / max(1, pieces), "ids": 1 - sum(k * n for k, n in stock.left.items()) / max(1, ids)}

    residue = sum(k * n for k, n in stock.left.items())
    windows = [size] * (residue // size) + [1 << b for b in range(size.bit_length(), -1, -1) if (residue % size) >> b & 1]
    at = 0
    while at < len(windows):
        room = windows[at]
        found = []
        for k in sorted(stock.left, reverse=True):
            if m := min(room // k, stock.left[k]):
                found.append((k, m))
                room -= k * m
        used = dict(found)
        cut = max((k for k in stock.left if k > room and stock.left[k] > used.get(k, 0)), default=0) if room else 0
        same = next((j for j in range(at, len(windows)) if windows[j] != windows[at]), len(windows)) - at
        copies = min([same, *(stock.left[k] // (m + (k == cut)) for k, m in found)])
        copies = max(1, min(copies, stock.left[cut]) if cut else copies)
        offset = 0
        for k, m in found:
            put(stock.take(k, copies * m), k, m, sequence, offset)
            offset += k * m
        if cut:
            runs = stock.take(cut, copies)
            put(runs, room, 1, sequence, offset)
            stock.give(cut - room, [(o, s + room, f, n) for o, s, f, n in runs])
            cuts += copies
        sequence, at = sequence + copies, at + copies
    rows.sort()
    names = ("origin", "start", "first", "n", "length", "times", "sequence", "offset", "before")
    return {n: np.array([r[j] for r in rows], dtype=np.int64) for j, n in enumerate(names)}, {**placed, "sequences": sequence, "cuts": cuts}


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, own long, block string, rank long"
PLACED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _wide(ids: list[bytes], width: int) -> pa.Array:
    """Ids of `width` bytes as little-endian uint32."""
    if width == 4:
        return pa.array(ids, pa.binary())
    sizes = np.cumsum([0, *map(len, ids)], dtype=np.int64) * (4 // width)
    flat = np.frombuffer(b"".join(ids), f"<u{width}").astype("<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(sizes), pa.py_buffer(flat)]).cast(pa.binary())


def _pieces(docs: DataFrame, tokenizer: str, width: int, size: int, end: int | None, doc_id: str, text: str) -> DataFrame:
    """Windows of `size` ids and last pieces of every text. `own` numbers windows, `rank` the other pieces of one length in a block."""

    def cut(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, tail = byte_encoder(tokenizer, width), b"" if end is None else int(end).to_bytes(width, "little")
        task = TaskContext.get().partitionId()
        own = task << 32
        for turn, b in enumerate(batches(tables, 4 << 20)):
            out, seen = [[] for _ in range(8)], {}
            for i, ids in zip(b.column(0).to_pylist(), codec.encode(b.column(1).to_pylist()), strict=True):
                ids += tail
                for at in range(0, len(ids), width * size):
                    part = ids[at : at + width * size]
                    n = len(part) // width
                    for col, v in zip(out, (i, at // width, n, part, len(ids) // width, own if n == size else None, f"{task}-{turn}", seen.get(n, 0)), strict=True):
                        col.append(v)
                    seen[n] = seen.get(n, 0) + 1
                    own += n == size
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack_windows(docs: DataFrame, tokenizer: str, size: int = 2048, end: int | None = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every whole text by a byte-level tokenizer; `size` is a power of two, up to 2,048.

    Returns pieces: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset. All sequences hold
    `size` ids but the last few, whose sizes are falling powers of two. Null texts and empty ones have the end id alone (without
    one: no piece). Null ids and repeated rows are packed as rows of their own. Other columns are not read. An empty
    table gives no rows. Windows within one text stay where they are; only last pieces are joined and sent.
    """
    if size > 2048 or size & (size - 1):
        raise ValueError("size must be a power of two up to 2048")
    width = 2 if max(vocabulary_size(tokenizer), end or 0) <= 1 << 16 else 4  # what is written and sent is as short as can be
    pieces = written(_pieces(docs, tokenizer, width, size, end, doc_id, text), "window-pieces")
    short = pieces.where(F.col("length") < size)
    counts = short.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    where, report = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = short.join(bases, ["block", "length"]).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))
    table = docs.sparkSession.sparkContext.broadcast(where)  # bounded by the combinations

    def place(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = table.value
        keys = (where["origin"] << 51) + (where["start"] << 40) + where["first"]
        for b in tables:
            origin, rank, base = b.column(2).to_numpy(), b.column(5).to_numpy(), b.column(1).to_numpy()
            row, start = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            while len(row):
                k = np.searchsorted(keys, (origin[row] << 51) + (start << 40) + rank[row], "right") - 1
                turn = where["before"][k] + rank[row] - where["first"][k]
                length, times = where["length"][k], where["times"][k]
                ids = b.column(3).take(pa.array(row)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(row)), pa.array(base[row] + start), pa.array(length),
                        _wide([i[width * s : width * (s + n)] for i, s, n in zip(ids, start.tolist(), length.tolist(), strict=True)], width), b.column(4).take(pa.array(row)),
                        pa.array(where["sequence"][k] + turn // times), pa.array(where["offset"][k] + turn % times * length),
                    ],
                    names=[f.split()[0] for f in PLACED.split(", ")],
                )
                more = start + length < origin[row]
                row, start = row[more], (start + length)[more]

    def widen(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            yield b.set_column(3, "ids", _wide(b.column(3).to_pylist(), width))

    sequence = (F.col("own") + int(report["sequences"])).alias("sequence_id")
    whole = pieces.where(F.col("length") == size).select("doc_id", "start", "length", "ids", "doc_tokens", sequence, F.lit(0).cast("long").alias("offset"))
    return whole.mapInArrow(widen, PLACED).unionByName(ranked.mapInArrow(place, PLACED))
