"""The companion header file (TOML) and the peel subshell list in it."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.schema import HEADER_LINES

PEEL_LINE = 3


def is_subshell_token(token: str) -> bool:
    return any(c.isalpha() for c in token) and all(c.isalnum() or c in "+-_" for c in token)


def peel_tokens(line: Column) -> Column:
    """Tokens of a header line that look like subshells: letters, digits, ``+ - _``, with at least one letter."""
    shaped = lambda t: t.rlike(r"^[\p{L}\p{N}+_-]+\z") & t.rlike(r"\p{L}")
    return F.filter(F.split(F.regexp_replace(line, r"(?U)^\s+|\s+\z", ""), r"(?U)\s+"), shaped)


def header_lines_of(header_path: str | Path) -> list[str]:
    with open(header_path, "rb") as f:
        return [str(x) for x in tomllib.load(f)["header_info"]["header_lines"]]


def read_peel_subshells(header_path: str | Path) -> list[str]:
    """Ordered peel subshells of a header file. A missing file, section or line, or an empty list, raises."""
    lines = header_lines_of(header_path)
    if len(lines) <= PEEL_LINE:
        raise ValueError(f"{header_path}: no line of peel subshells")
    found = [t for t in lines[PEEL_LINE].replace("\r\n", "\n").split() if is_subshell_token(t)]
    if not found:
        raise ValueError(f"{header_path}: the line of peel subshells is empty")
    return found


def find_header_file(parquet_path: str | Path) -> Path | None:
    """Header beside a Parquet file: ``{stem}_header.toml``, ``{stem}.toml`` or ``{stem}_header``."""
    p = Path(parquet_path)
    for name in (f"{p.stem}_header.toml", f"{p.stem}.toml", f"{p.stem}_header"):
        if (p.parent / name).is_file():
            return p.parent / name
    return None


def _quoted(text: str) -> str:
    out = []
    for c in text:
        if c in '"\\':
            out.append("\\" + c)
        elif ord(c) < 32 or ord(c) == 127:
            out.append(f"\\u{ord(c):04X}")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def header_text(header_lines: list[str], stats: dict[str, int]) -> str:
    """The header file: the first lines of the CSF text, padded to five, and the counts of the conversion."""
    lines = (header_lines + [""] * HEADER_LINES)[:HEADER_LINES]
    text = "[header_info]\nheader_lines = [\n" + "".join(f"    {_quoted(x)},\n" for x in lines) + "]\n\n[conversion_stats]\n"
    return text + "".join(f"{k} = {int(stats[k])}\n" for k in ("csf_count", "total_lines", "truncated_count"))


def write_header(path: str | Path, header_lines: list[str], stats: dict[str, int]) -> Path:
    Path(path).write_text(header_text(header_lines, stats), encoding="utf-8")
    return Path(path)
