"""The stateless describe plan over a growing folder of CSF Parquet files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.describe import describe_frame
from termloom.schema import CSF_SCHEMA


def describe_stream(spark: SparkSession, input_dir: str, output_dir: str, peel: list[str], checkpoint: str, normalize: bool = False, once: bool = False) -> StreamingQuery:
    """Appends descriptors (with idx) of every new Parquet file to ``output_dir``; exactly once by the file sink."""
    source = spark.readStream.schema(CSF_SCHEMA).parquet(input_dir)
    writer = describe_frame(source, peel, normalize).writeStream.format("parquet").option("path", output_dir).option("checkpointLocation", checkpoint).option("compression", "zstd")
    return (writer.trigger(availableNow=True) if once else writer).start()
