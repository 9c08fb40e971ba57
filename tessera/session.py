"""Sessions and tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def attach(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver runs it from a folder (a cluster takes --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a single-machine session (local[..])
    takes a temporary folder; any other session is refused, since its executors would not see the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.scratch.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
