"""Encoding of a corpus by a public byte-level BPE vocabulary, and back.

The pre-token rule is applied to whole batches at once, on arrays of code points. Each distinct pre-token is
then encoded once a worker by the backtracking encoder: the Aho-Corasick automaton over the vocabulary gives,
at a byte, the longest token that starts there, and a table of prefixes the next shorter ones; a token is taken if it is compatible with the one before
it (the pair alone would encode to just these two tokens), else the next shorter one, else the encoder steps
back. That finds the exact merges in linear time. The ids of a text are gathered from the table of pre-tokens.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH_CHARS = 2_000_000
TABLE_PIECES = 500_000
TABLE_PAIRS = 2_000_000

# The contractions that the pre-token pattern splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BacktrackingEncoder:
    """Exact byte-level BPE of short byte strings (pre-tokens)."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.offset, self.pool = self._offsets()
        self.split = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                self.split[rank] = self._halves(token, rank)
        self.merge = {pair: i for i, pair in self.split.items() if pair}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks))
        self.shorter = {i: next((r for n in range(len(t) - 1, 0, -1) if (r := ranks.get(t[:n])) is not None), -1) for t, i in ranks.items()}

    def _offsets(self) -> tuple[np.ndarray, np.ndarray]:
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size + 1, np.int64)
        for i, t in self.bytes_of.items():
            lengths[i + 1] = len(t)
        pool = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        return lengths.cumsum(), pool

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge that makes the token: what the merges of lower rank leave of it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]])

    def compatible(self, left: int, right: int) -> bool:
        """Whether left + right, encoded on its own, gives exactly these two tokens."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > TABLE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges that build the two tokens.

        Walking down from the two whole tokens to their parts at the border: a merge of the current neighbours of
        lower rank than ``limit``, the later of the merges undone so far, would have happened first.
        """
        limit = 1 << 40
        a, b = left, right
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and joined < limit:
                return False
            sa, sb = self.split.get(a), self.split.get(b)
            # undo the later of the two merges
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and a > b):
                limit = a
                a = sa[1]
            else:
                # on equal ranks the left one was merged first, so the right one is undone first; a merge over the
                # border then needs a rank below the right token's
                limit = b + 1
                b = sb[0]

    def _match(self, text: str, piece: bytes, at: int) -> int:
        """The longest token that begins at ``at``; every other one there is among its prefixes."""
        n = self.automaton.longest_prefix(text[at : at + self.longest])
        while n:
            token = self.ranks.get(piece[at : at + n])
            if token is not None:
                return token
            n -= 1
        return -1

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n, at = piece.decode("latin-1"), len(piece), 0
        dead = bytearray(n + 1)
        out: list[int] = []
        length, shorter = self.bytes_of, self.shorter
        token = self._match(text, piece, 0)
        while at < n:
            while token >= 0 and (dead[at + len(length[token])] or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += len(length[token])
                token = self._match(text, piece, at) if at < n else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(length[last])
                token = shorter[last]
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(self.pool[self.offset[i] : self.offset[i + 1]].tobytes() for i in ids)


def class_table() -> np.ndarray:
    """Class of every code point by the pre-token pattern: letter, number, white space, other."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        hits = "".join(regex.findall(pattern, every))
        table[np.frombuffer(hits.encode("utf-32-le"), np.uint32)] = kind
    return table


def piece_bounds(cp: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Start offsets of the pre-tokens of many texts at once.

    ``cp`` holds the code points of the texts one after another; ``first`` marks the first one of each text.
    """
    n = len(cp)
    k = kinds[cp]
    start = first.copy()
    start[1:] |= k[1:] != k[:-1]
    # white space: the last one before other text goes with it if it is a blank, else stands alone
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    space = k == SPACE
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    blank = before & (cp == 32)
    start |= before
    follows = np.flatnonzero(blank) + 1
    start[follows] = False
    # contractions: an apostrophe of its own, right before letters
    apostrophe = np.flatnonzero((cp == 39) & start & ~last)
    apostrophe = apostrophe[k[apostrophe + 1] == LETTER] if len(apostrophe) else apostrophe
    if len(apostrophe):
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        c1, c2 = pad[apostrophe + 1], pad[apostrophe + 2]
        two_inside = (apostrophe + 2 < n) & ~np.concatenate([first, np.ones(3, bool)])[apostrophe + 2]
        one = np.isin(c1, [ord(c) for c in CONTRACTIONS if len(c) == 1])
        two = np.zeros(len(apostrophe), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                two |= (c1 == ord(c[0])) & (c2 == ord(c[1])) & two_inside
        hit = one | two
        at, length = apostrophe[hit], np.where(one[hit], 1, 2)
        start[at + 1] = False
        rest = at + 1 + length
        inside = rest < n
        start[rest[inside]] = True
    return np.flatnonzero(start)


class CorpusEncoder:
    """Encodes batches of texts; keeps the table of pre-tokens it has met."""

    def __init__(self, path: str):
        self.encoder = BacktrackingEncoder(load_ranks(path))
        self.kinds = class_table()
        self.mix = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.mix ^= self.mix >> np.uint64(29)
        self.mix *= np.uint64(0xBF58476D1CE4E5B9)
        self._powers(1 << 16)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.ids, self.id_at = array("i"), array("q", [0])
        self.text, self.text_at = array("I"), array("q", [0])

    def _powers(self, n: int) -> None:
        base = np.uint64(0x5851F42D4C957F2D)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = lengths.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        if total == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(total, bool)
        begins = ends - lengths
        first[begins[lengths > 0]] = True
        starts = piece_bounds(cp, first, self.kinds)
        stops = np.append(starts[1:], total)
        if total >= len(self.up):
            self._powers(total)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(self.mix[cp] * self.up[:total], out=sums[1:])
        keys = (sums[stops] - sums[starts]) * self.down[starts]
        codes, distinct = pd.factorize(keys)
        if len(self.rows) > TABLE_PIECES:
            self._clear()
        at = np.full(len(distinct), -1, np.int64)
        one = np.zeros(len(distinct), np.int64)
        one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        get = self.rows.get
        keys_seen = distinct.tolist()
        new = []
        for i, key in enumerate(keys_seen):
            row = get(key, -1)
            if row < 0:
                new.append(i)
            else:
                at[i] = row
        if new:
            which = one[new]
            at[new] = base = np.arange(len(self.rows), len(self.rows) + len(new))
            self._add_many(cp, starts[which], stops[which])
            self.rows.update(zip((keys_seen[i] for i in new), base.tolist()))
        row = at[codes]
        id_at, pool = np.frombuffer(self.id_at, np.int64), np.frombuffer(self.ids, np.int32)
        first_id, count = id_at[row], id_at[row + 1] - id_at[row]
        for i in self._strangers(cp, starts, stops, row).tolist():
            own = self._encoded(cp[starts[i] : stops[i]])
            first_id[i], count[i] = len(pool), len(own)
            pool = np.concatenate([pool, np.array(own, np.int32)])
        out_at = np.concatenate([[0], count.cumsum()])
        where = np.repeat(first_id - out_at[:-1], count) + np.arange(int(out_at[-1]))
        ids = pool[where]
        piece_at = np.searchsorted(starts, np.append(begins, total))
        offsets = out_at[piece_at]
        del id_at, pool
        return ids, offsets

    def _add_many(self, cp: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Encodes pre-tokens and appends them to the table."""
        size = stops - starts
        ends = size.cumsum()
        points = cp[np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]))]
        self.text.frombytes(points.astype(np.uint32).tobytes())
        self.text_at.frombytes((self.text_at[-1] + ends).astype(np.int64).tobytes())
        lists = [self._encoded(points[e - n : e]) for e, n in zip(ends.tolist(), size.tolist())]
        counts = np.array([len(x) for x in lists], np.int64)
        self.id_at.frombytes((self.id_at[-1] + counts.cumsum()).astype(np.int64).tobytes())
        self.ids.frombytes(np.array([i for x in lists for i in x], np.int32).tobytes())

    def _encoded(self, points: np.ndarray) -> list[int]:
        return self.encoder.encode(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"))

    def _strangers(self, cp: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Pre-tokens are found by a 64-bit hash; here each one is compared with the text the table holds. Returned are
        the places of those that only share the hash of another."""
        text_at, text = np.frombuffer(self.text_at, np.int64), np.frombuffer(self.text, np.uint32)
        size = stops - starts
        same = text_at[row + 1] - text_at[row] == size
        at = np.where(same, text_at[row], 0)
        # where the lengths differ any text will do for the comparison
        place = np.minimum(np.repeat(at - starts, size) + np.arange(len(cp)), len(text) - 1)
        differs = np.add.reduceat((text[place] != cp).astype(np.int64), starts) > 0
        del text_at, text
        return np.flatnonzero(~same | differs)


_ENCODERS: dict[str, CorpusEncoder] = {}


def encoder_of(path: str) -> CorpusEncoder:
    """One encoder a worker process: its table of pre-tokens outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CorpusEncoder(path)
    return _ENCODERS[path]


def batches_of(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, as_column: str = "ids") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; strings like special tokens are plain text.

    Null and empty texts give an empty list, blank ones are encoded as they are. Every row is encoded, repeated
    ones too; a null key stays. An empty table gives an empty one.
    """
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(as_column, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = encoder_of(path)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s, e in batches_of(texts):
                ids, offsets = encoder.encode_texts(texts[s:e])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), lists], names=[key, as_column])

    return df.select(key, text).mapInArrow(run, schema)


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, as_column: str = "text") -> DataFrame:
    """(key, text) of lists of ids, by the offset table; a null list gives null, an unknown id ends the job."""
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(as_column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = encoder_of(path).encoder
            texts = [None if x is None else encoder.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, as_column])

    return df.select(key, ids).mapInArrow(run, schema)
