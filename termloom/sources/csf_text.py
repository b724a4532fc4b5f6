"""Reads a CSF text file of any size as ordered three-line records, without a shuffle.

The file is cut into byte ranges. A first narrow job counts the lines that begin in each range; the
driver keeps one number per range. In the second job each task knows the number of its first line, so
it starts at the first record that begins in its range and reads past its end to finish the last one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from termloom.schema import CSF_SCHEMA, HEADER_LINES

DEFAULT_RANGE_BYTES = 64 * 1024 * 1024
TAIL_BYTES = 1 << 16


def filesystem(path: str):
    """pyarrow file system and path; plain paths are local (or mounted everywhere), URIs name theirs."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _open(path: str):
    system, at = filesystem(path)
    return system.open_input_file(at)


def file_size(path: str) -> int:
    system, at = filesystem(path)
    info = system.get_file_info(at)
    if not info.is_file:
        raise FileNotFoundError(f"no such file: {path}")
    return info.size


def _begin_of_line(f, start: int, size: int) -> int:
    """Offset of the first line that begins at or after ``start``."""
    if start == 0:
        return 0
    f.seek(start - 1)
    at = start - 1
    while at < size:
        got = f.read(TAIL_BYTES)
        hit = got.find(b"\n")
        if hit >= 0:
            return at + hit + 1
        at += len(got)
    return size


def _lines_in(path: str, start: int, end: int, size: int) -> int:
    """Lines that begin in [start, end)."""
    with _open(path) as f:
        at = _begin_of_line(f, start, size)
        if at >= min(end, size):
            return 0
        f.seek(at)
        n, left = 1, min(end, size) - 1 - at
        while left > 0:
            got = f.read(min(left, 1 << 24))
            n += got.count(b"\n")
            left -= len(got)
        return n


def _text(lines: list[bytes]) -> pa.Array:
    out = pa.array([x[:-1] if x.endswith(b"\r") else x for x in lines], pa.binary())
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid as e:
        raise ValueError("the CSF text holds bytes that are not UTF-8") from e


def _records(path: str, start: int, end: int, size: int, first_line: int, lines: int) -> Iterator[pa.RecordBatch]:
    """Complete records whose first line begins in [start, end)."""
    data_line = first_line - HEADER_LINES
    skip = max(-data_line, 0)
    if data_line + skip < 0 or lines == 0:
        return
    skip += -(data_line + skip) % 3
    if skip >= lines:
        return
    record = (data_line + skip) // 3
    with _open(path) as f:
        at = _begin_of_line(f, start, size)
        f.seek(at)
        data = f.read(min(end, size) - at)
        missing = (3 - (lines - skip) % 3) % 3
        parts, feeds = [data], data.count(b"\n")
        while data and feeds < lines + missing:
            more = f.read(TAIL_BYTES)
            if not more:
                break
            parts.append(more)
            feeds += more.count(b"\n")
        data = b"".join(parts)
    own = data.split(b"\n")
    if own and own[-1] == b"":
        own.pop()
    own = own[skip : lines + missing]
    own = own[: len(own) // 3 * 3]
    for k in range(0, len(own), 3 * 65536):
        part = own[k : k + 3 * 65536]
        n = len(part) // 3
        idx = pa.array(np.arange(record + k // 3, record + k // 3 + n, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([idx, _text(part[0::3]), _text(part[1::3]), _text(part[2::3])], names=["idx", "line1", "line2", "line3"])


@dataclass
class CsfText:
    """An opened CSF text: its header, its count of data lines and the (lazy) records in file order."""

    header_lines: list[str]
    total_lines: int
    records: DataFrame
    header_missing: int = 0


def read_header(path: str) -> list[str]:
    """First five lines, padded with empty strings when the file is shorter."""
    out: list[str] = []
    with _open(path) as f:
        data = b""
        while data.count(b"\n") < HEADER_LINES:
            got = f.read(TAIL_BYTES)
            if not got:
                break
            data += got
    lines = data.split(b"\n")
    if lines and lines[-1] == b"":
        lines.pop()
    for x in lines[:HEADER_LINES]:
        out.append((x[:-1] if x.endswith(b"\r") else x).decode("utf-8"))
    return out + [""] * (HEADER_LINES - len(out))


def read_csf_text(spark: SparkSession, path: str, range_bytes: int = DEFAULT_RANGE_BYTES, partitions: int | None = None, lines: int | None = None) -> CsfText:
    """Scans ``path``. idx is the 0-based record number; one or two left-over lines at the end give no record.

    An empty file or one with only a header gives no records. A line ends at a line feed, before which one
    carriage return is dropped; a lone carriage return belongs to the line. Bytes that are not UTF-8 raise.
    ``partitions`` sets the number of ranges; ``lines`` makes them as short as so many lines like the first ones.
    """
    size = file_size(path)
    if partitions:
        range_bytes = max(1, -(-size // partitions))
    elif lines:
        with _open(path) as f:
            sample = f.read(TAIL_BYTES)
        range_bytes = max(1, min(range_bytes, lines * len(sample) // max(1, sample.count(b"\n"))))
    n = max(1, -(-size // range_bytes))
    step = range_bytes

    def count(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_lines_in(path, i * step, (i + 1) * step, size) for i in ids], pa.int64())], names=["id", "lines"])

    counts = np.zeros(n, np.int64)
    for i, held in spark.range(0, n, 1, n).mapInArrow(count, "id long, lines long").collect():
        counts[i] = held
    first = np.concatenate([[0], np.cumsum(counts)])

    def records(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from _records(path, i * step, (i + 1) * step, size, int(first[i]), int(counts[i]))

    out = spark.range(0, n, 1, n).mapInArrow(records, CSF_SCHEMA)
    return CsfText(read_header(path), max(0, int(first[-1]) - HEADER_LINES), out, max(0, HEADER_LINES - int(first[-1])))
