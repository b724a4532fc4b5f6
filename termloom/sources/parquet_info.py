"""Footer-only facts about a Parquet file or a directory of part files."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq


def _parts(path: Path) -> list[Path]:
    if path.is_dir():
        return sorted(p for p in path.rglob("*.parquet") if not any(x.startswith(("_", ".")) for x in p.relative_to(path).parts))
    return [path]


def get_parquet_info(input_path: str | Path) -> dict:
    """file_path, file_size, num_rows, num_columns (top-level), compression, created_by.

    For a directory sizes and rows are summed over its part files. compression is that of the first column
    of the first row group, ``Unknown`` when no row group exists. A missing or unreadable file raises OSError.
    """
    path = Path(input_path)
    if not path.exists():
        raise OSError(f"no such file: {input_path}")
    parts = _parts(path)
    if not parts:
        raise OSError(f"no Parquet files in {input_path}")
    out = {"file_path": str(input_path), "file_size": 0, "num_rows": 0, "num_columns": 0, "compression": "Unknown", "created_by": None}
    for p in parts:
        try:
            f = pq.ParquetFile(p)
        except Exception as e:
            raise OSError(f"not a readable Parquet file: {p}: {e}") from e
        meta = f.metadata
        out["file_size"] += p.stat().st_size
        out["num_rows"] += meta.num_rows
        out["num_columns"] = len(f.schema_arrow)
        out["created_by"] = out["created_by"] or meta.created_by
        if out["compression"] == "Unknown" and meta.num_row_groups and meta.num_columns:
            out["compression"] = meta.row_group(0).column(0).compression
    return out
