"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

Layout of a file (all numbers little-endian):
  data frames      zstandard frames of uint32 ids; whole documents up to FRAME_IDS ids a frame, a
                   longer document in frames of its own
  document index   a skippable frame (magic 0x184D2A50): zstandard of n, doc_id[n] int64,
                   null[n] uint8, n_tokens[n] int64, in the order of the ids
  seek table       a skippable frame (magic 0x184D2A5E) as in zstandard's seekable format: for each
                   data frame compressed size, size, low 32 bits of the xxh64 of its ids, all
                   uint32; then the number of frames uint32, the descriptor 0x80, 0x8F92EAB1
A reader takes the last nine bytes, the table, the index, and only the frames that it needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches
from .tokens import encoder

FRAME_IDS, INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 32_768, 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class FrameWriter:
    """Writes documents, one after another, to a binary stream."""

    def __init__(self, out, level: int = 3):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level)
        self.waiting, self.size, self.frames, self.ids, self.lengths = [], 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size + len(ids) > 4 * FRAME_IDS:
            self._flush()
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        while len(ids) > 4 * FRAME_IDS:
            self.waiting, self.size = [ids[: 4 * FRAME_IDS]], 4 * FRAME_IDS
            self._flush()
            ids = ids[4 * FRAME_IDS :]
        self.waiting.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        if self.size:
            raw = b"".join(self.waiting)
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self._flush()
        null = np.array([i is None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        index = self.zip.compress(struct.pack("<Q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.lengths, dtype="<i8").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        for magic, content in ((INDEX_MAGIC, index), (TABLE_MAGIC, table)):
            self.out.write(struct.pack("<II", magic, len(content)) + content)


class FrameReader:
    """Reads documents of a file that can seek; decompresses only the frames that they lie in."""

    def __init__(self, source, size: int):
        self.source, self.unzip, self.decompressed = source, zstandard.ZstdDecompressor(), 0
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end")
        top = size - 9 - 12 * n - 8
        table = np.frombuffer(self._at(top + 8, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        head = int(self.packed[-1])
        index = self.unzip.decompress(self._at(head + 8, top - head - 8))
        (m,) = struct.unpack("<Q", index[:8])
        self.doc_ids = np.frombuffer(index, "<i8", m, 8)
        self.null = np.frombuffer(index, "u1", m, 8 + 8 * m)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<i8", m, 8 + 9 * m))])
        self._last = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = self.unzip.decompress(self._at(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k])), max_output_size=int(self.plain[k + 1] - self.plain[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.decompressed += 1
            self._last = (k, raw)
        return self._last[1]

    def document(self, k: int) -> bytes:
        a, b = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        if a == b:
            return b""
        first, last = int(np.searchsorted(self.plain, a, "right")) - 1, int(np.searchsorted(self.plain, b, "left")) - 1
        return b"".join(self._frame(f)[max(0, a - int(self.plain[f])) : b - int(self.plain[f])] for f in range(first, last + 1))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int | None = 1) -> DataFrame:
    """Writes the ids of every whole text, in ascending id order over the files part-00000-.., to
    `path`, a folder that all executors share, and returns the manifest: part, file, n_docs, n_ids.

    Null texts and empty ones have no ids but the end id. Null ids come first; rows that repeat
    an id all stay, in text order. An empty table gives files without documents, or none. Each attempt of a
    task writes a file of its own, and the manifest, which Spark commits, names those that count; files
    of lost attempts are never read.
    """

    def write(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, tail = encoder(tokenizer), b"" if end is None else struct.pack("<I", end)
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        part, n_ids = task.partitionId(), 0
        name = f"part-{part:05d}-{task.taskAttemptId()}.ids.zst"
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            w = FrameWriter(out)
            for b in batches(tables, 4 << 20):
                for i, ids in zip(b.column(0).to_pylist(), codec.encode(b.column(1).to_pylist()), strict=True):
                    w.add(i, ids + tail)
                    n_ids += w.lengths[-1]
            w.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(w.ids)], "n_ids": [n_ids]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    rows.mapInArrow(write, "part int, file string, n_docs long, n_ids long").write.parquet(f"{path}/_manifest")
    return docs.sparkSession.read.schema("part int, file string, n_docs long, n_ids long").parquet(f"{path}/_manifest")


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """Reads doc_id, start (ids of all documents before it), n_tokens and ids (uint32 bytes) back,
    of all documents or of the `wanted` ids alone, of whose frames no others are decompressed."""
    files = [tuple(r) for r in spark.read.parquet(f"{path}/_manifest").select("part", "file", "n_ids").orderBy("part").collect()]  # a row a file
    base, rows = 0, []
    for _, name, n in files:
        rows.append((name, base))
        base += n
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    among = None if wanted is None else np.array(sorted(set(wanted)), dtype=np.int64)

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for b in tables:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    r = FrameReader(f, f.size())
                    picked = range(len(r.doc_ids)) if among is None else np.flatnonzero(np.isin(r.doc_ids, among) & (r.null == 0)).tolist()
                    # as many at a time as have about a million ids, or one
                    turn = (np.cumsum(r.starts[np.array(picked, dtype=np.int64) + 1] - r.starts[np.array(picked, dtype=np.int64)]) - 1) >> 20 if len(picked) else np.zeros(0, np.int64)
                    for some in np.split(np.array(picked, dtype=np.int64), np.flatnonzero(np.diff(turn)) + 1) if len(picked) else []:
                        ks = some.tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if r.null[k] else int(r.doc_ids[k]) for k in ks], pa.int64()),
                                pa.array([start + int(r.starts[k]) for k in ks], pa.int64()),
                                pa.array([int(r.starts[k + 1] - r.starts[k]) for k in ks], pa.int64()),
                                pa.array([r.document(k) for k in ks], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    listed = spark.createDataFrame(rows, "file string, base long").repartition(len(rows), "file")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
