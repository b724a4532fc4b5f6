"""Comparison of two descriptor outputs as they lie on storage, as a function and as a command.

    python -m termloom.plans.compare --old a.parquet --new b.parquet [--header run_header.toml] [--raw run.parquet]

The exit code is 0 for the same values, 1 for differences beyond the tolerance and 2 for outputs that can't be compared.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import compare
from termloom.schema import peel_table
from termloom.session import small_side
from termloom.sources.header import read_peel_subshells


def positioned(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet output with ``idx``: its own column, or the row's position over the part files in order of name."""
    df = spark.read.parquet(path)
    if "idx" in df.columns:
        return df
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = sorted((r["_file"], r["n"]) for r in at.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())
    first, rows = 0, []
    for name, n in files:
        rows.append((name, first))
        first += n
    begins = small_side(spark.createDataFrame(rows, "_file string, _first long"))
    return at.join(begins, "_file").select((F.col("_first") + F.col("_row")).alias("idx"), *df.columns)


def compare_outputs(spark: SparkSession, old: str, new: str, header: str | None = None, raw: str | None = None, tolerance: float = compare.TOLERANCE, rows: int = 10, columns: int = 8) -> dict:
    """The comparison of two outputs by idx or position, with samples of differing rows beside their raw records."""
    a, b = positioned(spark, old), positioned(spark, new)
    peel = peel_table(spark, read_peel_subshells(header)).select("pos", "subshell") if header else None
    source = positioned(spark, raw) if raw else None
    return compare.compare_descriptors(a, b, peel, tolerance, source, rows, columns)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Compares two descriptor outputs.")
    p.add_argument("--old", required=True)
    p.add_argument("--new", required=True)
    p.add_argument("--header")
    p.add_argument("--raw")
    p.add_argument("--tol", type=float, default=compare.TOLERANCE)
    p.add_argument("--sample-rows", type=int, default=10)
    p.add_argument("--sample-cols", type=int, default=8)
    a = p.parse_args(argv)
    out = compare_outputs(SparkSession.builder.getOrCreate(), a.old, a.new, a.header, a.raw, a.tol, a.sample_rows, a.sample_cols)
    for name, value in out.items():
        if isinstance(value, list):
            print(f"{name}: {len(value)}")
            for x in value:
                print(f"  {x}")
        else:
            print(f"{name}: {value}")
    return out["status"]


if __name__ == "__main__":
    sys.exit(main())
