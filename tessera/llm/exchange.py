"""Counting keys over the whole corpus, and telling each block of documents the counts of its own.

Documents are packed into blocks of bounded size. A block sends its distinct 64-bit keys, sorted and
cut into buckets, as a few packed rows; a bucket's task adds up the counts of all blocks and answers
each of them. So a key of a very frequent word comes once from each block, however often it occurs,
and nothing is broadcast or sent to the driver. The number of buckets follows from the bytes of text
in the blocks, so that a bucket gets about BUCKET_KEYS keys at most, whatever the corpus: at 100 TB give
larger blocks too, so that a block still has many keys for each bucket.
A key is the upper bits of its hash: the bucket's and, by the caller's choice, 36 to 48 more. Of the 10^6 keys of a
bucket, one in 70,000 (36 bits), in 10^6 (40 bits) or in 3 * 10^8 (48 bits) meets another and is counted with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written

BUCKET_KEYS = 2_000_000
#: A word and its space take so many bytes or more in most texts; a guess that only sizes the buckets.
KEY_BYTES = 5


def pack(values: np.ndarray) -> bytes:
    """Counts as bytes: a tag for the width, then the values in it, squeezed."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps: the width of the widest step, then the steps' bytes, all lowest bytes first."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


BLOCK = "block string, ids binary, null binary, sizes binary, texts binary, n_bytes long"
#: What a row counts towards its block's bytes beside its text, so that rows without text fill a block too.
ROW_BYTES = 64


def make_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bytes: int = 8 << 20) -> DataFrame:
    """A written table of blocks: the ids and whole texts of some rows, up to about most_bytes, or one row."""

    def blocks(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def row() -> pa.RecordBatch:
            raw = [t for _, t in waiting]
            return pa.RecordBatch.from_pydict(
                {
                    "block": [f"{task}-{turn}"],
                    "ids": [np.array([i or 0 for i, _ in waiting], dtype="<i8").tobytes()],
                    "null": [bytes(i is None for i, _ in waiting)],
                    "sizes": [np.array([len(r or b"") for r in raw], dtype="<i8").tobytes()],
                    "texts": [squeeze.compress(b"".join(r or b"" for r in raw))],
                    "n_bytes": [sum(len(r or b"") for r in raw)],
                }
            )

        for b in batches(tables, most_bytes):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = None if t is None else t.encode("utf-8", "surrogatepass")
                more = ROW_BYTES + len(raw or b"")
                if waiting and size + more > most_bytes:
                    yield row()
                    waiting, size, turn = [], 0, turn + 1
                waiting.append((i, raw))
                size += more
        if waiting:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(blocks, BLOCK), "blocks")


def block_rows(ids: bytes, null: bytes, sizes: bytes, texts: bytes, n_bytes: int = 0) -> tuple[list[int | None], list[bytes]]:
    """The ids and the texts (utf-8; null: empty) of a block."""
    at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
    raw = zstandard.ZstdDecompressor().decompress(texts)
    return [None if n else int(i) for i, n in zip(np.frombuffer(ids, "<i8"), null, strict=True)], [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def distinct_keys(keys: np.ndarray, learns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs (with learns: where that is set)."""
    ordered = np.sort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    distinct = ordered[new]
    if learns is None:
        return distinct, np.diff(np.flatnonzero(new), append=len(keys))
    some = np.sort(keys[learns])
    return distinct, np.searchsorted(some, distinct, "right") - np.searchsorted(some, distinct, "left")


@dataclass
class Counts:
    """The counts of keys over all blocks: a written table (block, grp, bucket, counts) that answers each block, and
    for each group and bucket a row with no block and n and total: its keys with a count, and the sum of counts."""

    answers: DataFrame
    bucket_bits: int
    low_bits: dict[int, int]

    def totals(self) -> dict[int, tuple[int, int]]:
        """{group: (distinct keys with a count, sum of counts)}: a row for each group comes to the driver."""
        rows = self.answers.where("block is null").groupBy("grp").agg(F.sum("n"), F.sum("total"))
        return {r[0]: (r[1], r[2]) for r in rows.collect()}


def count_keys(blocks: DataFrame, keys_of: Callable[..., dict[int, tuple[np.ndarray, np.ndarray]]], low_bits: dict[int, int]) -> Counts:
    """keys_of(ids, texts) -> {group: (sorted distinct keys, counts)} of a block; low_bits: of each group's
    keys, beside the bits of the bucket. A group has no more keys than a text has words, or so."""
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bucket_bits = max(4, math.ceil(math.log2(max(1, n_bytes / KEY_BYTES / BUCKET_KEYS))))

    def send(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for row in b.to_pylist():
                name = row.pop("block")
                for group, (keys, counts) in keys_of(*block_rows(**row)).items():
                    low = np.uint64(low_bits[group])
                    short = keys >> np.uint64(64 - bucket_bits - low_bits[group])
                    first = np.flatnonzero(np.diff(short, prepend=~short[:1]))  # keys that have become one
                    counts = np.add.reduceat(counts, first) if len(first) else counts
                    short = short[first]
                    buckets = short >> low
                    edges = np.flatnonzero(np.diff(buckets, prepend=~buckets[:1], append=~buckets[-1:]))
                    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                    mask = np.uint64((1 << low_bits[group]) - 1)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([name] * len(spans), pa.string()),
                            "grp": pa.array([group] * len(spans), pa.int32()),
                            "bucket": pa.array([int(buckets[x]) for x, _ in spans], pa.int32()),
                            "keys": pa.array([pack_keys(short[x:y] & mask) for x, y in spans], pa.binary()),
                            "counts": pa.array([pack(counts[x:y]) for x, y in spans], pa.binary()),
                        }
                    )

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in rows["keys"]]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        keys.clear()
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, back, np.concatenate([unpack(c) for c in rows["counts"]]))
        answers = [pack(total[at]) for at in np.split(back, cuts)]
        out = pd.DataFrame({"block": [*rows["block"], None], "grp": key[0], "bucket": key[1], "counts": [*answers, None]})
        out["n"] = pd.array([None] * len(answers) + [int(np.count_nonzero(total))], dtype="Int64")
        out["total"] = pd.array([None] * len(answers) + [int(total.sum())], dtype="Int64")
        return out

    sent = blocks.mapInArrow(send, "block string, grp int, bucket int, keys binary, counts binary")
    answers = written(sent.groupBy("grp", "bucket").applyInPandas(add_up, "block string, grp int, bucket int, counts binary, n long, total long"), "answers")
    return Counts(answers, bucket_bits, low_bits)


def for_each_block(blocks: DataFrame, counts: Counts, work: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """work(ids, texts, told) -> rows, for each block; told(group, keys) gives the counts over all blocks of the
    block's keys of that group, which must be all of them, sorted and distinct."""
    bucket_bits, low_bits = counts.bucket_bits, counts.low_bits

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        right = right.sort_values(["grp", "bucket"])
        packed = {int(g): list(rows) for g, rows in right.groupby("grp")["counts"]}

        def told(group: int, keys: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(0, dtype=np.int64)
            short = keys >> np.uint64(64 - bucket_bits - low_bits[group])
            place = np.cumsum(np.diff(short, prepend=short[:1]) > 0)
            return np.concatenate([unpack(c) for c in packed[group]])[place]

        row = left.iloc[0]
        return work(*block_rows(row["ids"], row["null"], row["sizes"], row["texts"]), told)

    told = counts.answers.where("block is not null").select("block", "grp", "bucket", "counts")
    return blocks.drop("n_bytes").groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, schema)
