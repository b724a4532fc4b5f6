"""Evaluation passages in a training corpus, found by spaced seeds.

A seed of a word window keeps the words at the positions of a fixed mask and ignores the others, so a passage
with words exchanged at ignored places still meets the seed of the item. The seeds of the items go, as a bitmap
sized by their number, to the workers that read the corpus; only windows that pass it are shuffled and joined with the
items' seeds. For exact passages a hit is verified on its words; for passages with exchanged words the hit gives
the alignment of the two texts, and the longest passage along it is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import small_side, written

SPAN = 13
# Positions kept by the mask of exact passages; it has the span of the shortest passage, so none is missed.
MASK = (0, 1, 3, 4, 7, 8, 10, 11, 12)


def _tolerant_masks() -> tuple[tuple[int, ...], ...]:
    """Masks of which one is free of exchanged words in any passage of at least SPAN words alike in 0.8 of them.

    Longer passages hold one of 13 words with 2 exchanges, 15 with 3, 20 with 4 or 25 with 5. 13 words: seven groups,
    any two of which are on a line of the Fano plane; a mask keeps the groups off a line. Without such 13 words inside,
    15 words have their exchanges at 2..12: six groups, of which a mask keeps two of the same three. Without these,
    20 words and 25 words have their five first and last words equal.
    """
    out = []
    for i in range(7):
        line = {i, (i + 1) % 7, (i + 3) % 7}
        out.append(tuple(p for p in range(13) if p % 7 not in line))
    for three in ((0, 1, 2), (3, 4, 5)):
        out += [(0, 1, *(p for p in range(2, 13) if (p - 2) % 6 in two), 13, 14) for two in combinations(three, 2)]
    return (*out, (*range(5), *range(15, 20)), (*range(5), *range(20, 25)))


TOLERANT_MASKS = _tolerant_masks()
TOLERANT_SPANS = (13,) * 7 + (15,) * 6 + (20, 25)
TOLERANT_CHARS = 400_000
SPARE_BITS = 7
LEAST_BITS, MOST_BITS = 16, 30
BATCH_CHARS = 2_000_000
SEEDS = "key long, h long, win string"
PLACES = "key long, mask int, h long, at int"


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
    return table


_WORD = _word_bytes()
_MIX = (np.arange(256, dtype=np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
_MIX ^= _MIX >> np.uint64(32)
_MIX *= np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 16)
        _POWERS["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
        _POWERS["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of many texts: lower-cased runs of a-z and 0-9, with a hash and the text of each."""

    def __init__(self, texts: Sequence[str | None]):
        parts = [(t or "").lower().encode("utf-8") for t in texts]
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        ink = np.concatenate([[False], _WORD[raw], [False]])
        edge = np.flatnonzero(ink[1:] != ink[:-1])
        self.start, self.stop = edge[0::2], edge[1::2]
        up, down = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_MIX[raw] * up[: len(raw)], out=sums[1:])
        h = (sums[self.stop] - sums[self.start]) * down[self.start]
        h ^= h >> np.uint64(33)
        self.hash = h * np.uint64(0xC2B2AE3D27D4EB4F)
        self.text = np.searchsorted(sizes.cumsum(), self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(parts) + 1))

    def seeds(self, mask: Sequence[int], span: int = SPAN) -> np.ndarray:
        """A hash per window of ``span`` words, from the words at the positions of the mask."""
        n = max(0, len(self.hash) - span + 1)
        out = np.full(n, np.uint64(mask[0] + 1))
        for p in mask:
            out = (out ^ self.hash[p : p + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        return out

    def windows(self, span: int = SPAN) -> np.ndarray:
        """Whether the window at each word lies within one text."""
        n = max(0, len(self.hash) - span + 1)
        return self.text[:n] == self.text[span - 1 : span - 1 + n]

    def joined(self, a: int, b: int) -> str:
        return " ".join(self.data[s:e].decode("ascii") for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist()))


def _passes(h: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(h), bool)
    bit = (h >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _seed_rows(keys: pa.Array, texts: list[str | None], bitmap: np.ndarray | None) -> pa.RecordBatch:
    w = Words(texts)
    h = w.seeds(MASK)
    at = np.flatnonzero(w.windows() & _passes(h, bitmap))
    # a text that repeats a window says it once
    _, first = np.unique(np.column_stack([w.text[at], h[at].view(np.int64)]), axis=0, return_index=True)
    at = at[np.sort(first)]
    win = pa.array([w.joined(i, i + SPAN) for i in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([keys.take(pa.array(w.text[at])), pa.array(h[at].astype(np.int64)), win], names=["key", "h", "win"])


def _place_rows(keys: pa.Array, texts: list[str | None], bitmap: np.ndarray | None) -> pa.RecordBatch:
    w = Words(texts)
    text, at, seed, number = [], [], [], []
    for m, (mask, span) in enumerate(zip(TOLERANT_MASKS, TOLERANT_SPANS)):
        h = w.seeds(mask, span)
        i = np.flatnonzero(w.windows(span) & _passes(h, bitmap))
        text.append(w.text[i])
        at.append(i - w.first[w.text[i]])
        seed.append(h[i].astype(np.int64))
        number.append(np.full(len(i), m))
    columns = [keys.take(pa.array(np.concatenate(text))), np.concatenate(number).astype(np.int32), np.concatenate(seed), np.concatenate(at).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "mask", "h", "at"])


def seeds_of(df: DataFrame, key: str, text: str, bitmap: np.ndarray | None = None, rows_of: Callable = _seed_rows, schema: str = SEEDS, chars: int = BATCH_CHARS) -> DataFrame:
    """Seeds of every window (that passes the bitmap), with their words or their place in the text."""
    sent = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else sent.value
        for b in batches:
            texts, at, size = b.column(1).to_pylist(), 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or (size and size + len(texts[i] or "") > chars):
                    if i > at:
                        yield rows_of(b.column(0).slice(at, i - at), texts[at:i], bits)
                    at, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, schema)


def bitmap_of(seeds: DataFrame) -> np.ndarray:
    """Bitmap of the seeds' leading bits, with at least 2^SPARE_BITS bits a seed: few other windows pass it, however
    many items there are. It takes 128 MB at most; beyond some eight million seeds more windows pass and are joined."""
    bits = min(MOST_BITS, max(LEAST_BITS, seeds.count().bit_length() + SPARE_BITS))
    bit = F.shiftrightunsigned("h", 64 - bits)
    words = seeds.select(bit.alias("bit")).selectExpr("shiftright(bit, 6) AS w", "shiftleft(1L, cast(bit % 64 AS int)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out.view(np.uint8)


def leaked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", question: str = "question") -> DataFrame:
    """(doc_key, item_key): texts that share at least 13 consecutive words with an item's question.

    Words are the longest runs of a-z and 0-9 after lower-casing. Null, empty and shorter texts or questions share
    nothing; equal texts are each reported; other columns are not looked at. Empty tables give no rows.
    """
    own = written(seeds_of(items, item_key, question), "p9-items")
    theirs = seeds_of(docs, doc_key, text, bitmap_of(own))
    # the items' windows are few beside the corpus: where their number allows it the corpus side isn't shuffled, so an
    # opening phrase shared by many items and documents is no hot key
    same = theirs.withColumnRenamed("key", doc_key).join(small_side(own.withColumnRenamed("key", item_key)), ["h", "win"])
    return same.select(doc_key, item_key).distinct()


def best_passage(equal: np.ndarray, least: Fraction) -> tuple[int, int] | None:
    """(matched, compared) of the longest run of at least SPAN words of which ``least`` are equal, without unequal
    words at its ends beyond SPAN; None if there is none."""
    e = np.concatenate([[0], equal.astype(np.int64).cumsum()])
    over = least.denominator * e - least.numerator * np.arange(len(e))
    # from the first place at which the surplus is no greater than at the end
    first = np.searchsorted(-np.minimum.accumulate(over), -over, side="left")
    size = np.arange(len(e)) - first
    if size.max() < SPAN:
        return None
    b = int(size.argmax())
    a = int(first[b])
    while b - a > SPAN and not equal[b - 1]:
        b -= 1
    while b - a > SPAN and not equal[a]:
        a += 1
    return int(e[b] - e[a]), b - a


_WORDS = re.compile("[a-z0-9]+")


def overlaps(docs: DataFrame, items: DataFrame, least: float = 0.8, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", question: str = "question") -> DataFrame:
    """(doc_key, item_key, matched, compared): substitution-tolerant overlaps. The two texts are laid side by side as
    a hit aligns them; the pair counts when at least ``least`` of the words of some passage of at least SPAN words are
    equal, whatever surrounds it. The best passage is given. No passage is missed for ``least`` of 0.8 or more."""
    own = written(seeds_of(items, item_key, question, None, _place_rows, PLACES, TOLERANT_CHARS), "p9-items")
    theirs = seeds_of(docs, doc_key, text, bitmap_of(own), _place_rows, PLACES, TOLERANT_CHARS)
    pairs = theirs.withColumnsRenamed({"key": "doc", "at": "doc_at"}).join(small_side(own.withColumnRenamed("key", "item")), ["mask", "h"])
    # many windows and masks meet along one alignment, so most rows end before the shuffle
    pairs = pairs.select("doc", "item", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    pairs = written(pairs.groupBy("doc", "item").agg(F.collect_list("shift").alias("shifts")), "p9-pairs")
    q = items.select(F.col(item_key).cast("long").alias("k"), F.col(question).alias("question"))
    t = docs.select(F.col(doc_key).cast("long").alias("k"), F.col(text).alias("text"))
    both = pairs.join(t, F.col("doc").eqNullSafe(t["k"])).select("doc", "item", "shifts", "text")
    both = both.join(q, F.col("item").eqNullSafe(q["k"])).select("doc", "item", "shifts", "question", "text")
    share = Fraction(least).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}

        def words(x: str | None) -> np.ndarray:
            if x not in held:
                held[x] = np.array([number.setdefault(w, len(number)) for w in _WORDS.findall((x or "").lower())], np.int64)
            return held[x]

        for b in batches:
            keep, matched, compared = [], [], []
            for i, (shifts, q, t) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))):
                if len(held) > 200 or len(number) > 1_000_000:
                    held.clear()
                    number.clear()
                x, y = words(q), words(t)
                best = None
                for d in shifts:
                    lo, hi = max(0, -d), min(len(x), len(y) - d)
                    if hi - lo >= SPAN:
                        got = best_passage(x[lo:hi] == y[lo + d : hi + d], share)
                        best = max(filter(None, (best, got)), default=None)
                if best:
                    keep.append(i)
                    matched.append(best[0])
                    compared.append(best[1])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(matched, pa.int32()), pa.array(compared, pa.int32())], names=[doc_key, item_key, "matched", "compared"])

    good = both.mapInArrow(run, f"{doc_key} long, {item_key} long, matched int, compared int")
    return good.groupBy(doc_key, item_key).agg(F.max(F.struct("matched", "compared")).alias("m")).select(doc_key, item_key, "m.matched", "m.compared")
