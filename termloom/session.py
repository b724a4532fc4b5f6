"""Session helpers: where shared intermediate tables go, and how big a frame may be to be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local one is set for tests on one machine; with any
    other master that is an error, since executors elsewhere could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="termloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet (zstd) into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def checked_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collects a frame that must stay small; more than ``limit`` rows is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is expected to be a small table")
    return rows
