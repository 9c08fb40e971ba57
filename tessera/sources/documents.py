"""Sources and sinks: strict and permissive JSON, key-value text, ledgers, incremental tables, binary records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def strict_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parses JSON; a malformed document is an error."""
    return df.withColumn("doc", F.from_json(column, schema, {"mode": "FAILFAST"}))


def permissive_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parses JSON and never fails: (doc, null) or (null, reason)."""
    parsed = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_p", parsed)
    reason = F.when(F.col(column).isNull(), "missing").when(F.col("_p._bad").isNotNull(), "malformed")
    return out.withColumn("reason", reason).withColumn("doc", F.when(reason.isNull(), F.col("_p"))).drop("_p")


def key_values(text: Column) -> Column:
    """Lines `KEY: value` as a map; other lines are skipped; the last of a repeated key stays."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    pairs = F.transform(lines, lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)), F.trim(F.regexp_replace(s, r"^[^:]*:", ""))))
    keys = F.transform(pairs, lambda p: p["col1"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys) + 1), p["col1"]) == 0)
    return F.map_from_entries(last)


def canonical(*columns: str) -> Column:
    """Canonical JSON: the columns in name order, without white space."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends rows as lines of JSON."""
    df.write.mode("append").json(path)


def pending(now: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Incremental materialisation: the rows whose key (uri, generation, size) the index lacks."""
    return now.join(index.select(*key).distinct(), key, "left_anti")


class _Records(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file]
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.value) as f:
            (n,) = struct.unpack("<I", f.read(4))
            for _ in range(n):
                yield struct.unpack("<qfff", f.read(20))


class BinaryRecords(DataSource):
    """Binary little-endian records: a count (uint32), then (id int64, x, y, z float32). One file, one
    partition. spark.dataSource.register(BinaryRecords); spark.read.format("binary_records").load(uri)"""

    @classmethod
    def name(cls) -> str:
        return "binary_records"

    def schema(self) -> str:
        return "id long, x float, y float, z float"

    def reader(self, schema) -> DataSourceReader:
        return _Records(self.options)


def pack_records(rows: list[tuple[int, float, float, float]]) -> bytes:
    return struct.pack("<I", len(rows)) + b"".join(struct.pack("<qfff", *r) for r in rows)


def frames_source(spark: SparkSession, n: int, step_us: int = 33_333) -> DataFrame:
    """A synthetic capture of n frames."""
    return spark.range(n).select(F.col("id").cast("int").alias("frame_index"), (F.col("id") * step_us).alias("timestamp_us"), F.format_string("frames/%05d.jpg", F.col("id").cast("int")).alias("path"))


class DocumentStore:
    """JSON documents under a folder that any Hadoop file system holds: write by name, read one, list by prefix."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, name: str) -> None:
        """One folder of JSON lines for a name; writing it again replaces it."""
        df.write.mode("overwrite").json(f"{self.root}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.root}/{name}")

    def list(self, prefix: str, schema: str) -> DataFrame:
        """All documents whose name begins with the prefix, with their name."""
        rows = self.spark.read.schema(schema).json(f"{self.root}/{prefix}*")
        return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def pack_mask(cells: Column) -> Column:
    """A mask (array of booleans) as text of 0 and 1; `unpack_mask` gives it back. Null cells are false."""
    return F.array_join(F.transform(cells, lambda c: F.when(c, "1").otherwise("0")), "")


def unpack_mask(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c == "1")


def persist_once(batch: DataFrame, number: int, path: str) -> None:
    """A foreachBatch sink that a repeated micro-batch does not double: each batch owns its folder and replaces it whole."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
