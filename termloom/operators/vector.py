"""Whole-batch parse and normalize: the same rules as the Column builders, over Arrow batches.

The higher-order functions of the Column form leave generated code and cost some 200 microseconds a record;
fixed-width text maps onto byte matrices, where a record costs a few. Each distinct text block (a name, a
count, a J) is read once a batch and looked up from there.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termloom.operators.parse import Peel
from termloom.schema import BLOCK, capacity_of

SPACE = " \t\n\x0b\x0c\r"
MATRIX_BYTES = 1 << 24
MOST_WARNINGS = 5
LOG = logging.getLogger("termloom")
_INT = re.compile(r"[+-]?[0-9]+")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True


def int_of(text: str) -> int | None:
    if _INT.fullmatch(text):
        value = int(text)
        if -(2**31) <= value < 2**31:
            return value
    return None


def two_j_of(text: str) -> int | None:
    text = text.strip(SPACE)
    if "/" in text:
        return int_of(text.split("/", 1)[0])
    whole = int_of(text.rstrip("-").rstrip("+"))
    return 2 * whole if whole is not None and -(2**30) <= whole < 2**30 else None


def middle_of(block: str) -> int:
    """2Q of a line2 block: what follows the first semicolon, 0 when unreadable."""
    return two_j_of(block.split(";", 1)[1] if ";" in block else block) or 0


def _looked_up(chars: np.ndarray, read: Callable[[str], int], memo: dict[int, int]) -> np.ndarray:
    """``read`` of each text along the last axis (at most 9 seven-bit characters), each distinct text once."""
    width = chars.shape[-1]
    key = np.zeros(chars.shape[:-1], np.int64)
    for k in range(width):
        key = (key << 7) | chars[..., k]
    codes, distinct = pd.factorize(key.ravel())
    values = np.empty(len(distinct), np.int64)
    for i, d in enumerate(distinct.tolist()):
        if d not in memo:
            memo[d] = read("".join(chr((d >> (7 * k)) & 127) for k in range(width - 1, -1, -1)))
        values[i] = memo[d]
    return values[codes].reshape(key.shape) if len(distinct) else key


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string column; a null has length 0."""
    a = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(1, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _matrix(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a blank-padded byte matrix, and the length of each without trailing white space."""
    width = int(lengths.max(initial=0))
    if width == 0:
        return np.full((len(lengths), 1), 32, np.uint8), np.zeros(len(lengths), np.int64)
    at = np.arange(width, dtype=np.int32)
    small = np.int32 if len(data) + width < 2**31 else np.int64
    m = np.take(data, starts.astype(small)[:, None] + at, mode="clip")
    np.putmask(m, at >= lengths.astype(np.int32)[:, None], 32)
    ink = ~_IS_SPACE[m]
    return m, np.where(ink.any(1), width - ink[:, ::-1].argmax(1), 0)


def _grid(m: np.ndarray, first: int, blocks: int) -> np.ndarray:
    """(rows, blocks, 9) characters from column ``first``, blank beyond the matrix."""
    out = np.full((len(m), blocks * BLOCK), 32, np.uint8)
    part = m[:, first : first + blocks * BLOCK]
    out[:, : part.shape[1]] = part
    return out.reshape(len(m), blocks, BLOCK)


class Describer:
    """Turns batches of three lines into (rows, 3N) descriptor matrices."""

    def __init__(self, peel: Sequence[str], normalize: bool):
        self.peel, self.normalize = Peel(peel), normalize
        caps = [capacity_of(p) for p in self.peel.subshells]
        self.caps = None if any(g is None for g in caps) else np.array(caps, np.int64)
        self.memo: list[dict[int, int]] = [{} for _ in range(5)]
        self.unknown = 0

    def place(self, name: str) -> int:
        """Position of a subshell in the peel list, -1 where it has none; the first few unknown names are logged."""
        name = name.strip(SPACE)
        at = self.peel.position.get(name, -1)
        if at < 0 and name:
            self.unknown += 1
            if self.unknown <= MOST_WARNINGS:
                LOG.warning("subshell %s is not in the peel list and is left out", name)
            elif self.unknown == MOST_WARNINGS + 1:
                LOG.warning("further unknown subshells are not reported")
        return at

    def raw(self, lines: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """int64 (rows, N, 3) and whether each record could be described."""
        rows = len(lines[0])
        out = np.zeros((rows, self.peel.orbitals, 3), np.int64)
        ok = np.ones(rows, bool)
        for a in lines:
            ok &= a.is_valid().to_numpy(zero_copy_only=False)
        parts = [_buffers(a) for a in lines]
        longest = np.max([p[2] for p in parts], axis=0) if rows else np.zeros(0, int)
        order = np.argsort(longest, kind="stable")
        k = 0
        while k < rows:  # rows of like length together, so that one very long line doesn't widen the rest
            n = min(rows - k, max(1, MATRIX_BYTES // max(1, int(longest[order[min(rows - 1, k + 4095)]]))), 4096)
            at = order[k : k + n]
            out[at], ok[at] = self._raw([(d, s[at], c[at]) for d, s, c in parts], ok[at])
            k += n
        return out, ok

    def _raw(self, parts: list[tuple], ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (m1, n1), (m2, n2), (m3, n3) = (_matrix(*p) for p in parts)
        ok = ok & ~((m1 > 127).any(1) | (m2 > 127).any(1) | (m3 > 127).any(1))
        for m in (m1, m2, m3):
            m &= 127
        rows, nb = len(m1), -(-n1 // BLOCK)
        out = np.zeros((rows, self.peel.orbitals, 3), np.int64)
        final_at = np.maximum(n3 - 5, 0)[:, None] + np.arange(4)
        final_in = final_at < np.maximum(n3 - 1, 0)[:, None]
        final = np.where(final_in, np.take_along_axis(m3, np.minimum(final_at, m3.shape[1] - 1), 1), 32).astype(np.uint8)
        last = _looked_up(final, lambda t: _NONE if (v := two_j_of(t)) is None else v, self.memo[0])
        ok &= last != _NONE
        blocks = int(nb.max(initial=0))
        if blocks == 0 or not ok.any():
            return out, ok
        size = np.clip(n1[:, None] - BLOCK * np.arange(blocks), 0, BLOCK)
        b1, b2 = _grid(m1, 0, blocks), _grid(m2, 0, blocks)
        m3[np.arange(m3.shape[1]) >= np.where(n3 >= BLOCK, n3 - 5, n3)[:, None]] = 32
        b3 = np.where((n3 >= BLOCK)[:, None, None], _grid(m3, 4, blocks), _grid(m3, 0, blocks))
        position = self.peel.position
        pos = _looked_up(b1[..., :5], self.place, self.memo[1])
        pos = np.where(size >= 5, pos, position.get("", -1))
        pos = np.where(np.arange(blocks) < nb[:, None], pos, -1)
        n = np.where(size >= 8, _looked_up(b1[..., 6:8], lambda t: int_of(t.strip(SPACE)) or 0, self.memo[2]), 0)
        q = _looked_up(b2, middle_of, self.memo[3])
        j = _looked_up(b3, lambda t: (two_j_of(t) or 0) if t.strip(SPACE) else _NONE, self.memo[4])
        j = np.where(j == _NONE, q, j)
        j = np.where(np.arange(blocks) == nb[:, None] - 1, last[:, None], j)
        none = n == 0
        triple = np.stack([n, np.where(none, 0, q), np.where(none, 0, j)], 2)
        row = np.arange(rows)
        for b in range(blocks):  # in line order, so that of equal names the last block stays
            hit = (pos[:, b] >= 0) & ok
            out[row[hit], pos[hit, b]] = triple[hit, b]
        return out, ok

    def describe(self, lines: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, 3N) of int32 or, normalized, float32, zeros where the record fails; and what failed."""
        raw, ok = self.raw(lines)
        rows = len(raw)
        if not self.normalize:
            return np.where(ok[:, None], raw.reshape(rows, -1), 0).astype(np.int32), ok
        if self.caps is None:
            return np.zeros((rows, 3 * self.peel.orbitals), np.float32), np.zeros(rows, bool)
        return normalize_matrix(raw, self.caps, ok)


_NONE = np.int64(2**40)


def normalize_matrix(raw: np.ndarray, caps: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, orbitals, _ = raw.shape
    n = raw[..., 0]
    held = n[:, ::-1] > 0
    last = orbitals - 1 - held.argmax(1)
    target = np.where(held.any(1), raw[np.arange(rows), last, 2], 0)
    ok = ok & ((n >= 0) & (n <= caps)).all(1) & (target >= 0)
    u = n * (caps - n)
    prefix = u.cumsum(1)
    bound = np.minimum(prefix, target[:, None] + prefix[:, -1:] - prefix)
    out = np.zeros((rows, orbitals, 3), np.float64)
    np.divide(n, caps, out=out[..., 0])
    np.divide(raw[..., 1], u, out=out[..., 1], where=u != 0)
    np.divide(raw[..., 2], bound, out=out[..., 2], where=bound != 0)
    out[~ok] = 0
    return out.reshape(rows, -1).astype(np.float32), ok


def described(d: Describer, lines: list[pa.Array]) -> list[pa.Array]:
    """The cells of a batch, column by column."""
    cells, _ = d.describe(lines)
    return [pa.array(c) for c in np.ascontiguousarray(cells.T)]


def describe_arrow(df: DataFrame, peel: Sequence[str], normalize: bool, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and col_0 .. col_{3N-1} of a frame with line1, line2 and line3; a narrow plan."""
    columns = Peel(peel).columns
    cell = T.FloatType() if normalize else T.IntegerType()
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, cell) for c in columns])
    keep, names = list(keep), [*keep, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Describer(peel, normalize)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *described(d, [b.column(f"_line{i}") for i in (1, 2, 3)])], names=names)

    lines = [df[f"line{i}"].alias(f"_line{i}") for i in (1, 2, 3)]
    return df.select(*[df[c] for c in keep], *lines).mapInArrow(run, schema)
