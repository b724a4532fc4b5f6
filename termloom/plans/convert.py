"""CSF text to Parquet: one narrow job writes the records and observes the counts."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.functions.scalars import is_ascii, is_oversize, is_too_long, truncate_line
from termloom.schema import DEFAULT_CHUNK_SIZE, DEFAULT_MAX_LINE_LEN
from termloom.sources import files
from termloom.sources.csf_text import read_csf_text
from termloom.sources.header import header_text

LINES = ("line1", "line2", "line3")
LOG = logging.getLogger("termloom")


def _positive(name: str, value: int | None, default: int | None) -> int | None:
    if value is None:
        return default
    if value <= 0:
        raise ValueError(f"{name} must be greater than 0")
    return value


def convert_frame(records: DataFrame, max_line_len: int = DEFAULT_MAX_LINE_LEN) -> DataFrame:
    """Checks and cuts the lines of (idx, line1, line2, line3); adds ``truncated``, the number of lines cut.

    A non-ASCII line ends the job with its 1-based data line number. Null lines stay null.
    """
    out = {}
    for k, c in enumerate(LINES):
        where = F.concat(F.lit("data line "), (F.col("idx") * 3 + k + 1).cast("string"), F.lit(" holds a non-ASCII character"))
        out[c] = F.when(~is_ascii(F.col(c)), F.raise_error(where).cast("string")).otherwise(truncate_line(F.col(c), max_line_len))
    cut = sum((F.coalesce(is_too_long(F.col(c), max_line_len).cast("int"), F.lit(0)) for c in LINES), F.lit(0))
    return records.withColumns({"truncated": cut, "oversize": sum((F.coalesce(is_oversize(F.col(c)).cast("int"), F.lit(0)) for c in LINES), F.lit(0)), **out})


def convert_csfs(
    input_path: str | Path,
    output_path: str | Path,
    max_line_len: int | None = DEFAULT_MAX_LINE_LEN,
    chunk_size: int | None = DEFAULT_CHUNK_SIZE,
    num_workers: int | None = None,
    spark: SparkSession | None = None,
    single_file: bool = False,
) -> dict:
    """Converts a CSF text file to Parquet (idx, line1, line2, line3; uncompressed) plus ``{stem}_header.toml``.

    ``chunk_size`` is the most lines a partition should hold, by the length of the file's first lines, and
    ``num_workers`` the number of partitions. Zero for a tuning argument raises ValueError. Data and I/O errors give
    ``{"success": False, "error": ...}`` and no output. The output may be on any file system Spark writes to. A short
    header, overlong lines and left-over lines are logged as warnings.
    """
    max_line_len = _positive("max_line_len", max_line_len, DEFAULT_MAX_LINE_LEN)
    chunk_size = _positive("chunk_size", chunk_size, DEFAULT_CHUNK_SIZE)
    num_workers = _positive("num_workers", num_workers, None)
    spark = spark or SparkSession.builder.getOrCreate()
    target = str(output_path)
    begun = False
    try:
        if not files.exists(spark, files.parent(target)):
            raise FileNotFoundError(f"no such directory: {files.parent(target)}")
        text = read_csf_text(spark, str(input_path), partitions=num_workers, lines=chunk_size)
        seen = Observation()
        frame = convert_frame(text.records, max_line_len)
        frame = frame.observe(seen, F.count(F.lit(1)).alias("csf_count"), F.sum("truncated").alias("truncated_count"), F.sum("oversize").alias("oversize_count"))
        frame = frame.select("idx", *LINES)
        begun = True
        (frame.coalesce(1) if single_file else frame).write.mode("overwrite").option("compression", "none").parquet(target)
        counts = seen.get
        stats = {"csf_count": counts["csf_count"] or 0, "total_lines": text.total_lines, "truncated_count": counts["truncated_count"] or 0}
        header = files.beside(target, f"{Path(str(input_path)).stem or 'csfs'}_header.toml")
        files.write_text(spark, header, header_text(text.header_lines, stats))
    except Exception as e:
        if begun:
            files.delete(spark, target)
        return {"success": False, "error": str(e)}
    if text.header_missing:
        LOG.warning("%s: the header lacks %d of its lines", input_path, text.header_missing)
    if counts["oversize_count"]:
        LOG.warning("%s: %d lines are longer than a megabyte", input_path, counts["oversize_count"])
    if text.total_lines % 3:
        LOG.warning("%s: the last %d lines make no record", input_path, text.total_lines % 3)
    return {
        "success": True,
        "input_file": str(input_path),
        "output_file": target,
        "header_file": header,
        "max_line_len": max_line_len,
        "oversize_count": counts["oversize_count"] or 0,
        **stats,
    }
