"""Driver-side file work on any file system Spark writes to: plain paths are local, URIs go through Hadoop's API."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import SparkSession


def is_uri(path: str | Path) -> bool:
    return "://" in str(path) or str(path).startswith("file:")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str | Path) -> bool:
    if not is_uri(path):
        return Path(path).exists()
    system, at = _hadoop(spark, str(path))
    return system.exists(at)


def delete(spark: SparkSession, path: str | Path) -> None:
    """Removes a file or folder; a missing one is no error."""
    if is_uri(path):
        system, at = _hadoop(spark, str(path))
        system.delete(at, True)
    elif Path(path).is_dir():
        shutil.rmtree(path, ignore_errors=True)
    else:
        Path(path).unlink(missing_ok=True)


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    if not is_uri(path):
        Path(path).write_text(text, encoding="utf-8")
        return
    system, at = _hadoop(spark, str(path))
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def parent(path: str | Path) -> str:
    return str(path).rstrip("/").rsplit("/", 1)[0] if is_uri(path) else str(Path(path).parent)


def beside(path: str | Path, name: str) -> str:
    return f"{parent(path)}/{name}"
