"""Binary sources: point files whose header declares their columns, wire-format messages, and bit-packed rasters as runs."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# The scalar types of the header, their layout, and the columns' types.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
_COLUMNS = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
_WRITTEN = {"tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}
#: A header is looked for in so many bytes.
HEADER_BYTES = 1 << 20
_CHECKS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Header:
    binary: bool
    dtype: np.dtype
    count: int
    start: int


def parse_header(head: bytes, where: str = "file") -> Header:
    """The first element must be `vertex`, of scalars alone, in binary little-endian or ascii; anything else is an error."""
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0 or (start := head.find(b"\n", end)) < 0:
        raise ValueError(f"{where}: no header")
    form, elements, fields = "", [], []
    for words in map(str.split, head[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2])))
        elif words[:1] == ["property"] and len(elements) == 1:
            if words[1] not in TYPES:
                raise ValueError(f"{where}: property {words[-1]} is of type {words[1]}")
            fields.append((words[2], "<" + TYPES[words[1]]))
    if not elements or elements[0][0] != "vertex":
        raise ValueError(f"{where}: the first element is not vertex")
    if form not in ("binary_little_endian", "ascii"):
        raise ValueError(f"{where}: format {form!r}")
    return Header(form != "ascii", np.dtype(fields), elements[0][1], start + 1)


def _files(path: str) -> tuple:
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._"]
    return fs, sorted(found, key=lambda f: f.path)


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


class _PointReader(DataSourceReader):
    """Records first to before last of a file, a batch at a time. Only the columns of the asked schema are made; a range of
    binary records is read by its place in the file. Text files are not split."""

    def __init__(self, options, schema):
        self.path, self.split, self.names, self.filters = options["path"], int(options.get("splitbytes", 64 << 20)), schema.names, []
        self.types = {f.name: f.dataType.simpleString() for f in schema}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _CHECKS and len(f.attribute) == 1 and isinstance(f.value, int | float) and not isinstance(f.value, bool):
                self.filters.append((f.attribute[0], _CHECKS[type(f)], f.value))
            else:
                yield f

    def _open(self, path: str):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path)[0].open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        out = []
        for info in _files(self.path)[1]:
            with self._open(info.path) as f:
                h = parse_header(f.read(HEADER_BYTES), info.path)
            if h.binary and info.size < h.start + h.count * h.dtype.itemsize:
                raise ValueError(f"{info.path}: {h.count} records are declared, the file ends before")
            step = max(1, self.split // h.dtype.itemsize) if h.binary else max(1, h.count)
            out += [_Range(info.path, k, min(k + step, h.count)) for k in range(0, h.count, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with self._open(partition.path) as f:
            h = parse_header(f.read(HEADER_BYTES), partition.path)
            missing = [n for n in self.names if n not in h.dtype.names]
            if missing:
                raise ValueError(f"{partition.path}: no property {missing[0]}")
            step = max(1, (4 << 20) // max(1, h.dtype.itemsize))
            if h.binary:
                f.seek(h.start + partition.first * h.dtype.itemsize)
                rows = (np.frombuffer(f.read(min(step, partition.last - k) * h.dtype.itemsize), h.dtype) for k in range(partition.first, partition.last, step))
            else:
                f.seek(h.start)
                rows = self._text(f, h, partition.last, step)
            for r in rows:
                keep = np.ones(len(r), dtype=bool)
                for name, check, value in self.filters:
                    keep &= check(r[name], value)
                arrays = [pa.array(np.ascontiguousarray(r[n][keep])).cast(_arrow(self.types[n])) for n in self.names]
                yield pa.RecordBatch.from_arrays(arrays, names=self.names) if arrays else pa.RecordBatch.from_struct_array(pa.array([{}] * int(keep.sum()), pa.struct([])))

    @staticmethod
    def _text(f, h: Header, count: int, step: int) -> Iterator[np.ndarray]:
        import io

        lines = io.TextIOWrapper(io.BufferedReader(f), "ascii", errors="replace")
        got = 0
        while got < count:
            part = [tuple(line.split()[: len(h.dtype)]) for _, line in zip(range(min(step, count - got)), lines, strict=False)]
            if not part:
                raise ValueError(f"{count} records are declared, there are {got}")
            got += len(part)
            yield np.array([tuple(map(float, p)) for p in part], dtype=[(n, "f8") for n in h.dtype.names]).astype(h.dtype)


def _arrow(spark_type: str) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[spark_type]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _PointWriter(DataSourceArrowWriter):
    """A file for each batch. Tasks write under names of their own; those of the attempts that count are moved into place."""

    def __init__(self, options, schema):
        self.path, self.dtype = options["path"], [(f.name, _WRITTEN[f.dataType.simpleString()]) for f in schema]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_parts", recursive=True)
        names = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.empty(b.num_rows, dtype=[(n, "<" + TYPES[t]) for n, t in self.dtype])
            for k, (n, _) in enumerate(self.dtype):
                rows[n] = b.column(k).to_numpy(zero_copy_only=False)
            head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *[f"property {t} {n}" for n, t in self.dtype], "end_header", ""])
            names.append(f"{uuid.uuid4().hex}.ply")
            with fs.open_output_stream(f"{root}/_parts/{names[-1]}") as f:
                f.write(head.encode() + rows.tobytes())
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for name in [n for m in messages if m for n in m.names]:
            fs.move(f"{root}/_parts/{name}", f"{root}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        pass  # what was not moved is not read


class PointFiles(DataSource):
    """Point files: a header of scalar properties, then records. `path` is a file or folder that driver and executors reach
    by pyarrow's file systems. Without a schema, the columns are those of the first file's header; with one, only its columns are
    read. Options: splitBytes, of a partition. Written columns are numbers without nulls."""

    @classmethod
    def name(cls) -> str:
        return "point_files"

    def schema(self) -> str:
        fs, found = _files(self.options["path"])
        if not found:
            raise ValueError(f"no files in {self.options['path']}")
        with fs.open_input_file(found[0].path) as f:
            h = parse_header(f.read(HEADER_BYTES), found[0].path)
        return ", ".join(f"`{n}` {_COLUMNS[h.dtype[n].str[1:]]}" for n in h.dtype.names)

    def reader(self, schema) -> DataSourceReader:
        return _PointReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PointWriter(self.options, schema)


def read_points(spark: SparkSession, path: str, schema: str | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Point files as a table; comparisons with numbers are checked where records are read."""
    spark.dataSource.register(PointFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("point_files").option("path", path).option("splitBytes", split_bytes)
    return (reader.schema(schema) if schema else reader).load()


def write_points(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(PointFiles)
    df.write.format("point_files").mode("append").option("path", path).save()


# --- wire-format messages --------------------------------------------------------------------

#: {field number: (name, kind)}; kind: int, sint, bool, float, double, string, bytes, or a Message, each in a list if repeated.
Message = dict[int, tuple[str, object]]
_FIXED = {5: ("<f", 4), 1: ("<d", 8)}
_SPARK = {"int": "long", "sint": "long", "bool": "boolean", "float": "float", "double": "double", "string": "string", "bytes": "binary"}


def message_schema(message: Message) -> str:
    def of(kind) -> str:
        if isinstance(kind, list):
            return f"array<{of(kind[0])}>"
        return f"struct<{', '.join(f'`{n}`:{of(k)}' for n, k in kind.values())}>" if isinstance(kind, dict) else _SPARK[kind]

    return of(message)


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out & (1 << 64) - 1, at
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def _scalar(kind: str, wire: int, raw):
    if wire == 0:
        if kind == "bool":
            return raw != 0
        return (raw >> 1) ^ -(raw & 1) if kind == "sint" else raw - (1 << 64) if raw >> 63 else raw
    if wire in _FIXED:
        return struct.unpack(_FIXED[wire][0] if kind in ("float", "double") else "<i" if wire == 5 else "<q", raw)[0]
    return bytes(raw).decode("utf-8") if kind == "string" else bytes(raw)


def decode_message(data: bytes | memoryview, message: Message) -> dict:
    """A message by its declaration: unknown fields are skipped, the last of a repeated single field counts, packed numbers are
    spread, absent fields are null (absent lists empty). What is cut off or of another wire type is an error."""
    data, at = memoryview(data), 0
    out = {n: [] if isinstance(k, list) else None for n, k in message.values()}
    while at < len(data):
        key, at = _varint(data, at)
        field, wire = key >> 3, key & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            raw, at = data[at : at + _FIXED[wire][1]], at + _FIXED[wire][1]
        elif wire == 2:
            n, at = _varint(data, at)
            raw, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(data):
            raise ValueError("the message is cut off")
        if field not in message:
            continue
        name, kind = message[field]
        many = isinstance(kind, list)
        kind = kind[0] if many else kind
        if isinstance(kind, dict):
            if wire != 2:
                raise ValueError(f"{name}: wire type {wire}")
            values = [decode_message(raw, kind)]
        elif wire == 2 and kind not in ("string", "bytes"):
            values, k = [], 0
            width = {"float": 5, "double": 1}.get(kind)
            while k < len(raw):
                if width:
                    values.append(_scalar(kind, width, raw[k : k + _FIXED[width][1]]))
                    k += _FIXED[width][1]
                else:
                    v, k = _varint(raw, k)
                    values.append(_scalar(kind, 0, v))
        elif (wire == 2) != (kind in ("string", "bytes")):
            raise ValueError(f"{name}: wire type {wire}")
        else:
            values = [_scalar(kind, wire, raw)]
        if many:
            out[name] += values
        elif values:
            out[name] = values[-1]
    return out


def decode_messages(df: DataFrame, column: str, message: Message) -> DataFrame:
    """df with `message` (a struct, null where the bytes are null or broken) and `problem` (null, or what is wrong), in place of
    columns of these names."""

    @F.pandas_udf(f"struct<message:{message_schema(message)}, problem:string>")
    def decode(data: pd.Series) -> pd.DataFrame:
        found, problems = [], []
        for raw in data:
            one = problem = None
            try:
                one = None if raw is None else decode_message(raw, message)
            except (ValueError, IndexError, UnicodeDecodeError, struct.error) as e:
                problem = "the message is cut off" if isinstance(e, IndexError | struct.error) else str(e)
            found.append(one)
            problems.append(problem)
        return pd.DataFrame({"message": pd.Series(found, dtype=object), "problem": problems})

    return df.withColumn("message", decode(column)).select(*[c for c in df.columns if c not in ("message", "problem")], "message.message", "message.problem")


def _number(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def encode_message(value: dict, message: Message) -> bytes:
    """The bytes of a message; nulls are left out, lists are not packed."""
    out = b""
    for field, (name, kind) in message.items():
        many = isinstance(kind, list)
        for v in (value.get(name) or []) if many else [value.get(name)]:
            k = kind[0] if many else kind
            if v is None:
                continue
            if isinstance(k, dict) or k in ("string", "bytes"):
                raw = encode_message(v, k) if isinstance(k, dict) else v.encode() if k == "string" else bytes(v)
                out += _number(field << 3 | 2) + _number(len(raw)) + raw
            elif k in ("float", "double"):
                out += _number(field << 3 | (5 if k == "float" else 1)) + struct.pack("<f" if k == "float" else "<d", v)
            else:
                out += _number(field << 3) + _number((v << 1) ^ (v >> 63) if k == "sint" else int(v))
    return out


def sized_files(spark: SparkSession, path: str, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(whole files up to most_bytes with their content, the others with their length): sizes are known from the listing,
    so that content is read of those alone that pass."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") <= most_bytes).select("path", "length", "content"), files.where(F.col("length") > most_bytes).select("path", "length")


# --- bit-packed rasters ------------------------------------------------------------------------

RUNS = "array<struct<row:int,lo:int,hi:int>>"


def packed_bits(cells: Column | str) -> Column:
    """A raster's cells, row by row, as bits, the highest first; the last byte is filled with zeros. Null cells are not set."""
    return F.pandas_udf(_packed, "binary")(cells)


def _packed(cells: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else np.packbits(np.array([bool(x) for x in c], dtype=np.uint8)).tobytes() for c in cells], dtype=object)


def bit_runs(bits: Column | str, height: Column | str, width: Column | str) -> Column:
    """The set cells of a bit-packed raster as runs (row, lo, hi), hi exclusive, in order. Too few bytes are an error."""
    return F.pandas_udf(_runs, RUNS)(bits, height, width)


def _runs(bits: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for raw, h, w in zip(bits, height, width, strict=True):
        if raw is None or pd.isna(h) or pd.isna(w):
            out.append(None)
            continue
        h, w = int(h), int(w)
        if 8 * len(raw) < h * w:
            raise ValueError(f"{len(raw)} bytes for {h} x {w} cells")
        cells = np.zeros((h, w + 2), dtype=np.int8)
        cells[:, 1:-1] = np.unpackbits(np.frombuffer(raw, np.uint8), count=h * w).reshape(h, w)
        step = np.diff(cells, axis=1)
        row, lo = np.nonzero(step == 1)
        out.append([{"row": int(r), "lo": int(a), "hi": int(z)} for r, a, z in zip(row, lo, np.nonzero(step == -1)[1], strict=True)])
    return pd.Series(out, dtype=object)


def runs_area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + (r["hi"] - r["lo"]))


def union_runs(df: DataFrame, key: list[str], runs: str) -> DataFrame:
    """(key.., row, lo, hi): the union of all rows' runs, as runs that neither touch nor overlap. A window over each
    key's raster row; runs of one place are one first, so copies do not add up."""
    flat = df.select(*key, F.explode(runs).alias("r")).select(*key, "r.row", "r.lo", "r.hi")
    flat = flat.groupBy(*key, "row", "lo").agg(F.max("hi").alias("hi"))
    at = Window.partitionBy(*key, "row").orderBy("lo")
    begins = (F.col("lo") > F.max("hi").over(at.rowsBetween(Window.unboundedPreceding, -1))) | (F.row_number().over(at) == 1)
    parts = flat.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(at))
    return parts.groupBy(*key, "row", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def common_runs(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key.., row, lo, hi) of the cells in both of two tables of union_runs."""
    b = right.select(*key, "row", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = left.join(b, [*key, "row"]).where("lo < hi2 AND lo2 < hi")
    return both.select(*key, "row", F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))


def measured_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """Cells, bounds (exclusive ends) and mass centre of each key's runs."""
    n = F.col("hi") - F.col("lo")
    sums = runs.groupBy(*key).agg(
        F.sum(n).alias("cells"), F.min("row").alias("top"), (F.max("row") + 1).alias("bottom"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(n * F.col("row")).alias("rows"), F.sum(n * (F.col("lo") + F.col("hi") - 1)).alias("columns"),
    )
    return sums.select(*key, "cells", "top", "bottom", "lo", "hi", (F.col("rows") / F.col("cells")).alias("row_mean"), (F.col("columns") / F.col("cells") / 2).alias("column_mean"))
