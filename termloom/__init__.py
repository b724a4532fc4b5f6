"""Atomic-structure configuration data on Spark: convert, describe, compare, check."""

from termloom.plans.convert import convert_csfs
from termloom.plans.describe import generate_descriptors_from_parquet
from termloom.sources.header import read_peel_subshells
from termloom.sources.parquet_info import get_parquet_info

__version__ = "0.1.0"
__all__ = ["__version__", "convert_csfs", "generate_descriptors_from_parquet", "get_parquet_info", "read_peel_subshells"]
