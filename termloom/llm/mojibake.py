"""Passages that were decoded with the wrong encoding: found and, where possible, restored.

A code-page swap is a substitution cipher: bytes of one encoding shown as the letters of another. It is learned per
source by expectation-maximization against the bigrams of the languages. Expectation: each token is deciphered under
the swaps that public encodings give as starting points, weighed by how often the source shows them so far, and the
decipherment that the bigrams prefer by far takes the token's place. Maximization: the bigrams, the swaps' shares in
each source and each source's table from shown letters to bytes or letters are counted anew. What stays unlikely in a
source after that may come from a page that is no starting point: for these tokens the whole substitution is unknown,
and :func:`solved` learns it from uniform probabilities. Every source ends with its own tables; they are applied by
translate().

Everything sent around is bounded: a table of hashed bigram counts, alphabets of at most 128 letters a language, and a
bitmap of the garbled tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

# Names of public encodings that text is commonly confused between.
SHOWN_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp852", "mac_cyrillic", "iso8859_5", "iso8859_15", "cp1253", "cp1254", "cp1257")
SHOWN_AS_WIDE = ("gb18030", "cp932", "euc_jp", "big5", "euc_kr")
WRITTEN_IN = ("utf-8", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1250", "iso8859_2", "cp852", "cp1252", "mac_roman", "cp850", "cp437", "cp932", "euc_jp", "gb18030", "big5")

TABLE_BITS = 21
EVERY = "*"
EVERY_SHARE = 0.1
LEAST_COUNT = 0.05
MARGIN = 1.5
LONE_MARGIN = 2.5
ROUNDS = 3
MEMO = 200_000
OWN_SHARE = 0.1
SHARE_BONUS = 0.3
PAGE = 128
UNLIKELY = 1.5
LEARNED_MARGIN = 1.0
LEAST_TOKENS = 30
CIPHER_ROUNDS = 100
CIPHER_STARTS = 10
CIPHER_TASKS = 48
HIT_BITS = 24
LEARNED = "learned"
_CUT = re.compile(r"[\x00-@\[-`{-\x7f]+")
_BLANKS = "\n\t\r\x0b\x0c"
_BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=None)
def byte_table(codec: str) -> dict[int, int]:
    """Code point to byte of a single-byte encoding; a byte without a character stands for its control code."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


@lru_cache(maxsize=None)
def translation(codec: str) -> dict[int, int]:
    """For str.translate: characters of the encoding to the byte they show; those of other encodings are moved out of reach."""
    table = {c: 0x110000 - 1 for c in range(128, 256)}
    table.update(byte_table(codec))
    return table


def bytes_shown(token: str, codec: str) -> bytes | None:
    try:
        if codec in SHOWN_AS_WIDE:
            return token.encode(codec)
        return token.translate(translation(codec)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def decipherments(token: str) -> dict[str, tuple[str, str]]:
    """Readings of a token under each swap: reading to (written in, shown as)."""
    out: dict[str, tuple[str, str]] = {}
    seen: set[bytes] = set()
    for shown in (*SHOWN_AS, *SHOWN_AS_WIDE):
        raw = bytes_shown(token, shown)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for written_in in WRITTEN_IN:
            if written_in == shown or (len(token) < 3 and written_in != "utf-8"):
                continue  # one or two characters may be any others: that is no evidence
            try:
                reading = raw.decode(written_in)
            except UnicodeDecodeError:
                continue
            if reading != token and not _BROKEN.search(reading):
                out.setdefault(reading, (written_in, shown))
    return out


def readings_of(token: str) -> dict[str, tuple[str, str]]:
    """Readings under one swap, or under two where the first shows UTF-8; none where characters are lost for good."""
    if "\ufffd" in token:
        return {}
    first: dict[str, tuple[str, str]] = {}
    for shown in (*SHOWN_AS, *SHOWN_AS_WIDE):
        raw = bytes_shown(token, shown)
        if raw is not None and _UTF8.search(raw):
            try:
                first.setdefault(raw.decode("utf-8"), ("utf-8", shown))
            except UnicodeDecodeError:
                pass
    out = decipherments(token)
    for reading, swap in first.items():
        if not reading.isascii():
            for again in decipherments(reading):
                out.setdefault(again, swap)
    out.pop(token, None)
    return out


def language(tag: str | None) -> str:
    """Two letters of a language tag, whatever its spelling; EVERY when unknown."""
    t = (tag or "").strip().lower()[:2]
    return t if len(t) == 2 and t.isalpha() else EVERY


def tokens_of(text: str) -> list[str]:
    """Pieces of letters and other characters beyond ASCII (cut at blanks and at ASCII that is no letter)."""
    if text.isascii():
        return []
    out: list[str] = []
    for blank in _BLANKS:
        text = text.replace(blank, " ")
    for word in text.split(" "):
        if not word.isascii():
            out += [p for p in _CUT.split(word) if not p.isascii()]
    return out


def _slots(points: np.ndarray, second: np.ndarray, lang: np.ndarray | np.uint64) -> np.ndarray:
    h = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (second.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ lang) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _lang_number(lang: str) -> int:
    return int.from_bytes(lang.encode("utf-8")[:8].ljust(8, b"\0"), "little")


def _pairs(tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of tokens with their borders that hold a character beyond ASCII, and how many each token has."""
    p = np.frombuffer("".join(f"\x02{t}\x03" for t in tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(p):
        return p, p, np.zeros(len(tokens), np.int64)
    owner = np.repeat(np.arange(len(tokens)), [len(t) + 2 for t in tokens])
    keep = ((p[:-1] > 127) | (p[1:] > 127)) & (owner[:-1] == owner[1:])
    return p[:-1][keep], p[1:][keep], np.bincount(owner[:-1][keep], minlength=len(tokens))


class Model:
    """Hashed bigram counts per language."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.memo: dict[tuple[str, str], tuple[float, list[tuple[float, str, tuple[str, str]]]]] = {}

    def expected(self, a: np.ndarray, b: np.ndarray, number: np.ndarray | np.uint64) -> np.ndarray:
        """Log counts of bigrams, in their language and, at a tenth, in all."""
        every = np.uint64(_lang_number(EVERY))
        n = EVERY_SHARE * self.counts[_slots(a, b, every)] + self.counts[_slots(a, b, number)]
        return np.log(np.where(number == every, n / (1 + EVERY_SHARE), n) + LEAST_COUNT)

    def scores(self, tokens: Sequence[str], langs: Sequence[str]) -> np.ndarray:
        """Mean log count of each token's bigrams."""
        a, b, size = _pairs(tokens)
        known = {g: _lang_number(g) for g in set(langs)}
        number = np.repeat(np.array([known[g] for g in langs], np.uint64), size)
        sums = np.concatenate([[0.0], self.expected(a, b, number).cumsum()])
        ends = size.cumsum()
        return np.where(size > 0, (sums[ends] - sums[ends - size]) / np.maximum(size, 1), -50.0)

    def judge(self, tokens: Sequence[str], langs: Sequence[str], shares: Sequence[dict[str, float] | None] | None = None) -> list[tuple[str, str | None, float]]:
        """(reading, swap, score as it stands) of each token: itself and None when it stands, swap ``?>?`` when it is
        broken for good. A swap that its source is known to show (``shares``) needs a smaller lead."""
        keys = list(zip(tokens, langs))
        new = [k for k in dict.fromkeys(keys) if k not in self.memo]
        held = self.memo
        if new:
            if len(self.memo) > MEMO:
                self.memo = held = {k: self.memo[k] for k in keys if k in self.memo}
            held.update(zip(new, self._candidates(new)))
        return [_preferred(k[0], *held[k], shares[i] if shares else None) for i, k in enumerate(keys)]

    def _candidates(self, keys: list[tuple[str, str]]) -> list[tuple[float, list[tuple[float, str, tuple[str, str]]]]]:
        at, readings, swaps = [], [], []
        for i, (token, _) in enumerate(keys):
            for r, swap in readings_of(token).items():
                at.append(i)
                readings.append(r)
                swaps.append(swap)
        out: list[tuple[float, list]] = [(s, []) for s in self.scores([t for t, _ in keys], [g for _, g in keys]).tolist()]
        if at:
            for i, r, swap, s in zip(at, readings, swaps, self.scores(readings, [keys[i][1] for i in at]).tolist()):
                if s > out[i][0]:
                    out[i][1].append((s, r, swap))
        return out


def _preferred(token: str, here: float, candidates: list[tuple[float, str, tuple[str, str]]], shares: dict[str, float] | None) -> tuple[str, str | None, float]:
    best, out = here, (token, "?>?" if _BROKEN.search(token) else None, here)
    if candidates:
        margin = LONE_MARGIN if sum(c > "\x7f" for c in token) == 1 else MARGIN
        least = here + margin
        for s, r, swap in candidates:
            name = f"{swap[0]}>{swap[1]}"
            s += SHARE_BONUS * ((shares or {}).get(name) or 0.0) ** 0.5
            if s > least and s > best:
                best, out = s, (r, name, here)
    return out


def token_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, token, n, texts): occurrences, and distinct texts that hold the token (a text of several sources
    counts at the first); added up per task before the shuffle, so a hot source has no one task."""
    schema = "lang string, source string, token string, n long, texts long"
    keyed = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).where(F.octet_length("text") > F.length("text"))
    keyed = keyed.withColumns({"h": F.xxhash64("text"), "size": F.length("text")}).repartition("h", "size")
    copies = keyed.groupBy("h", "size", "lang", "source").agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("h", "size", "lang").orderBy("source")) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for b in batches:
            for t, g, s, copied, one in zip(*(b.column(i).to_pylist() for i in range(5))):
                g = language(g)
                for w, n in Counter(tokens_of(t)).items():
                    sums = held.setdefault((g, s, w), [0, 0])
                    sums[0] += n * copied
                    sums[1] += one
            if len(held) > 500_000:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)

    tokens = copies.select("text", "lang", "source", "copies", first.alias("one")).mapInArrow(run, schema)
    return tokens.groupBy("lang", "source", "token").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _counted(held: dict[tuple, list[int]]) -> pa.RecordBatch:
    keys, sums = list(held), list(held.values())
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([n[i] for n in sums], pa.int64()) for i in range(2)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "token", "n", "texts"])


def bigram_table(tokens: DataFrame, column: str) -> np.ndarray:
    """Bigram counts of a token table, each token once per distinct text, so that neither copies of a text nor
    repeats within one make a garbled token language; what the one source that shows a bigram most says of it counts
    OWN_SHARE, so that no source makes its own garbling language. At most 2^TABLE_BITS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources, words, texts = (batch.column(i).to_pylist() for i in range(4))
            a, b, size = _pairs(words)
            names = list(dict.fromkeys(sources))
            place = {x: i for i, x in enumerate(names)}
            own = np.repeat(np.array([place[x] for x in sources], np.int64), size)
            n = np.repeat(np.asarray(texts, np.float64), size)
            number = np.repeat(np.array([_lang_number(g) for g in langs], np.uint64), size)
            every = np.uint64(_lang_number(EVERY))
            named = number != every
            slot = np.concatenate([_slots(a, b, every), _slots(a, b, number)[named]])
            key = np.concatenate([own, own[named]]) << TABLE_BITS | slot
            keys, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, np.concatenate([n, n[named]]), len(keys)) if len(keys) else np.zeros(0)
            which = pa.array((keys & ((1 << TABLE_BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([which, pa.array(names, pa.string()).take(pa.array(keys >> TABLE_BITS)), pa.array(total)], names=["slot", "source", "n"])

    per = tokens.select("lang", "source", column, "texts").mapInArrow(run, "slot int, source string, n double").groupBy("slot", "source").agg(F.sum("n").alias("n"))
    sums = per.groupBy("slot").agg((F.sum("n") - (1 - OWN_SHARE) * F.max("n")).alias("n")).toArrow()
    out = np.zeros(1 << TABLE_BITS, np.float32)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out


TOKEN = ("lang", "source", "token", "n", "texts")
JUDGED = "lang string, source string, token string, n long, texts long, reading string, swap string, score double"


def shares_of(judged_tokens: DataFrame) -> DataFrame:
    """(source, shares): of the source's distinct garbled tokens the share of each swap; at most one entry a swap."""
    n = judged_tokens.where("swap IS NOT NULL").groupBy("source", "swap").agg(F.countDistinct("token").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    return share.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("swap", "share"))).alias("shares"))


def judged(tokens: DataFrame, model: Model, shares: DataFrame | None = None) -> DataFrame:
    """Each (lang, source, token) with the reading the model prefers, the swap (null when it stands) and the token's score."""
    sent = tokens.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(sent.value)
        for b in batches:
            known = [dict(x) if x else None for x in b.column(5).to_pylist()]
            got = m.judge(b.column(2).to_pylist(), b.column(0).to_pylist(), known)
            added = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *added], names=[*TOKEN, "reading", "swap", "score"])

    rows = tokens.select(*TOKEN)
    rows = rows.withColumn("shares", F.lit(None).cast("map<string,double>")) if shares is None else rows.join(shares, "source", "left").select(*TOKEN, "shares")
    return rows.mapInArrow(run, JUDGED)


def _stands_for(token: str, reading: str, swap: str) -> list[tuple[str, str]]:
    """What each shown character stands for: a byte (as its latin-1 character) of UTF-8, or a letter. Characters that
    stand for no single one (wide encodings, two swaps in turn) give none."""
    written_in, shown = swap.split(">")
    if shown in SHOWN_AS and written_in == "utf-8":
        raw = bytes_shown(token, shown)
        if raw is None or raw.decode("utf-8", "replace") != reading:
            return []
        return [p for p in zip(token, raw.decode("latin-1")) if p[0] > "\x7f"]
    if shown in SHOWN_AS and len(token) == len(reading):
        return [p for p in zip(token, reading) if p[0] > "\x7f"]
    return []


def learned_tables(judged_tokens: DataFrame) -> DataFrame:
    """(source, swap, shown, stands_for, n): per source and swap the substitution its tokens show; of several readings
    of a character the most frequent. At most as many rows per source and swap as the page has characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: Counter = Counter()
            for source, token, n, reading, swap in zip(*(b.column(i).to_pylist() for i in range(5))):
                for shown, letter in _stands_for(token, reading, swap):
                    sums[source, swap, shown, letter] += n
            cols = [pa.array([k[i] for k in sums], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(sums.values()), pa.int64())], names=["source", "swap", "shown", "stands_for", "n"])

    hits = judged_tokens.where("swap IS NOT NULL AND swap <> '?>?'").select("source", "token", "texts", "reading", "swap")
    rows = hits.mapInArrow(run, "source string, swap string, shown string, stands_for string, n long")
    rows = rows.groupBy("source", "swap", "shown", "stands_for").agg(F.sum("n").alias("n"))
    best = rows.groupBy("source", "swap", "shown").agg(F.max(F.struct("n", "stands_for")).alias("m"))
    return best.select("source", "swap", "shown", "m.stands_for", "m.n")


def solved(shown: np.ndarray, letters: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, log_p: np.ndarray, fixed: dict[int, int], rounds: int = CIPHER_ROUNDS) -> tuple[np.ndarray, float]:
    """Letter probabilities (shown, letters) of an unknown substitution, by expectation-maximization over bigrams.

    ``first`` and ``second`` are code points of bigrams with their ``counts``; ``letters`` are the language's symbols
    and ``log_p`` their bigrams' log counts; code points in ``fixed`` stand for themselves (position in ``letters``).
    What is learned is how often each letter is shown as each character. Starts are uniform, biased by rank of
    frequency, biased by the order of code points, and random; the likeliest three after some rounds go on, and the likeliest end
    is taken, with its mean log count.
    """
    n, m = len(shown), len(letters)
    free = np.array([i for i in range(m) if int(letters[i]) not in fixed], np.int64)
    at = {int(c): i for i, c in enumerate(shown)} | {c: n + k for k, c in enumerate(fixed)}
    ia, ib = (np.array([at[int(c)] for c in x], np.int64) for x in (first, second))
    w = counts.astype(np.float64)
    often = np.bincount(ia, w, n + len(fixed))[:n] + np.bincount(ib, w, n + len(fixed))[:n]
    p = np.exp(log_p)
    p /= p.sum()
    common = p.sum(0)[free] + p.sum(1)[free]
    held = np.zeros((n + len(fixed), m))
    for k, c in enumerate(fixed):
        held[n + k, fixed[c]] = 1.0

    def biased(order_shown: np.ndarray, order_letters: np.ndarray) -> np.ndarray:
        rank, other = np.empty(n), np.empty(len(free))
        rank[order_shown], other[order_letters] = (np.arange(n) + 0.5) / n, (np.arange(len(free)) + 0.5) / len(free)
        return np.exp(-(((rank[:, None] - other[None, :]) / 0.15) ** 2)) + 0.05

    rng = np.random.default_rng(0)
    starts = [np.ones((n, len(free))), biased(np.argsort(-often), np.argsort(-common)), biased(np.argsort(shown), np.argsort(letters[free]))]
    starts += [rng.random((n, len(free))) for _ in range(CIPHER_STARTS)]
    by = [(o := np.argsort(i, kind="stable"), *np.unique(i[o], return_index=True)) for i in (ia, ib)]

    def improved(t: np.ndarray, times: int) -> tuple[np.ndarray, float]:
        for _ in range(times):
            ta, tb = t[ia], t[ib]
            right, left = tb @ p.T, ta @ p
            mass = np.maximum((ta * right).sum(1), 1e-300)
            new = np.zeros_like(t)
            for (order, name, begin), part in zip(by, (ta * right, tb * left)):
                new[name] += np.add.reduceat((part * (w / mass)[:, None])[order], begin, axis=0)
            t = held.copy()
            t[:n] = new[:n] / np.maximum(new[:n].sum(0), 1e-300)
        return t, float((w * np.log(mass)).sum())

    tried = []
    for start in starts:
        t = held.copy()
        t[:n, free] = start * often[:, None]
        t[:n] /= np.maximum(t[:n].sum(0), 1e-300)
        tried.append(improved(t, max(1, rounds // 5)))
    tried = [improved(t, rounds) for t, _ in sorted(tried, key=lambda x: -x[1])[:3]]
    best = max(tried, key=lambda x: x[1])[0] * (p.sum(0) + p.sum(1))
    top = best.argmax(1)
    mean = float((w * log_p[top[ia], top[ib]]).sum() / max(w.sum(), 1))
    best = best[:n] / np.maximum(best[:n].sum(1, keepdims=True), 1e-300)
    return best, mean


def unknown_pages(judged_tokens: DataFrame, model: Model) -> DataFrame:
    """(lang, source, shown, stands_for, n) of pages that are no starting point, learned from the tokens of a source
    that are UNLIKELY by their language and have no reading. A language of more letters than a page holds, and a
    source whose unlikely tokens no substitution makes likely, have no table."""
    spark = judged_tokens.sparkSession
    clean = judged_tokens.where("swap IS NULL")
    usual = clean.groupBy("lang").agg(F.percentile(F.round("score", 2), F.lit(0.5), F.col("texts")).alias("usual"))
    seen = clean.join(usual, "lang").withColumn("odd", F.col("score") < F.col("usual") - UNLIKELY)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: Counter = Counter()
            for lang, token, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                for c in token:
                    if c > "\x7f" and c.isalpha():
                        sums[lang, c] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "letter", "n"])

    held = seen.where("NOT odd").select("lang", "token", "texts").mapInArrow(letters, "lang string, letter string, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang")
    held = held.withColumns({"all": F.count(F.lit(1)).over(w), "share": F.col("n") / F.sum("n").over(w)}).where((F.col("all") <= 40 * PAGE) & (F.col("share") > 1e-4))
    held = held.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "letter"))).where(F.col("r") <= 2 * PAGE).groupBy("lang").agg(F.collect_list("letter").alias("letters"))
    alphabets = {r["lang"]: sorted(r["letters"]) for r in held.collect() if 3 <= len(r["letters"]) <= PAGE and r["lang"] != EVERY}
    schema = "lang string, source string, shown string, stands_for string, n double"
    if not alphabets:
        return spark.createDataFrame([], schema)
    level = {r["lang"]: r["usual"] for r in usual.where(F.col("lang").isin(list(alphabets))).collect()}

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sources, words = (b.column(i).to_pylist() for i in range(3))
            first, second, size = _pairs(words)
            own = np.repeat(np.arange(len(words)), size)
            sums = Counter(zip([langs[i] for i in own], [sources[i] for i in own], first.tolist(), second.tolist()))
            cols = [pa.array([k[i] for k in sums], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "a", "b", "n"])

    odd = seen.where(F.col("odd") & F.col("lang").isin(list(alphabets))).select("lang", "source", "token")
    pairs = odd.mapInArrow(bigrams, "lang string, source string, a long, b long, n long").groupBy("lang", "source", "a", "b").agg(F.sum("n").alias("n"))
    # a page shows at most 128 characters; rows of others are no bigrams of one page
    ends = pairs.select("lang", "source", F.explode(F.array("a", "b")).alias("c"), "n").where("c > 127").groupBy("lang", "source", "c").agg(F.sum("n").alias("n"))
    page = ends.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("n"), "c"))).where(F.col("r") <= PAGE).select("lang", "source", "c")
    for x in "ab":
        ok = page.select("lang", "source", F.col("c").alias(x), F.lit(True).alias(f"ok_{x}"))
        pairs = pairs.join(ok, ["lang", "source", x], "left").where((F.col(x) <= 127) | F.col(f"ok_{x}")).drop(f"ok_{x}")
    sent = spark.sparkContext.broadcast(model.counts)

    def cipher(keys: tuple, t: pa.Table) -> pa.Table:
        lang, source = (k.as_py() for k in keys)
        a, b, n = (t.column(c).to_numpy() for c in ("a", "b", "n"))
        found: list[tuple[str, str, float]] = []
        if n.sum() >= 4 * LEAST_TOKENS:
            plain = sorted({int(c) for c in (*a, *b) if c <= 127})
            letters = np.array([*plain, *map(ord, alphabets[lang])], np.int64)
            m = Model(sent.value)
            log_p = m.expected(np.repeat(letters, len(letters)), np.tile(letters, len(letters)), np.uint64(_lang_number(lang))).reshape(len(letters), -1)
            shown = np.unique(np.concatenate([a[a > 127], b[b > 127]]))
            theta, likely = solved(shown, letters, a, b, n, log_p, {c: i for i, c in enumerate(plain)})
            if likely >= level[lang] - UNLIKELY:
                found = [(chr(c), chr(letters[p.argmax()]), float(p.max())) for c, p in zip(shown.tolist(), theta) if p.max() >= 0.5]
        cols = [[lang] * len(found), [source] * len(found), *([f[i] for f in found] for i in range(3))]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(),) * 4 + (pa.float64(),))], names=["lang", "source", "shown", "stands_for", "n"])

    # few rows but much work a group, so the groups are spread by number and not by size
    return pairs.repartition(CIPHER_TASKS, "lang", "source").groupBy("lang", "source").applyInArrow(cipher, schema)


def _as_map(tables: DataFrame, *keys: str) -> DataFrame:
    return tables.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("shown", "stands_for"))).alias("table"))


def deciphered(tokens: DataFrame, tables: DataFrame, model: Model) -> DataFrame:
    """Judged rows of tokens that a learned page (``unknown_pages``) reads better by LEARNED_MARGIN (by LONE_MARGIN
    with fewer than three letters), where at least LEAST_TOKENS distinct tokens of the source say so."""
    sent = tokens.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(sent.value)
        for b in batches:
            words, langs = b.column(2).to_pylist(), b.column(0).to_pylist()
            readings = [t.translate({ord(k): v for k, v in x}) for t, x in zip(words, b.column(6).to_pylist())]
            here, there = b.column(5).to_numpy(), m.scores(readings, langs)
            lone = np.array([sum(c > "\x7f" for c in t) < 3 for t in words], bool)
            hit = pa.array(there > here + np.where(lone, LONE_MARGIN, LEARNED_MARGIN))
            out = pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(readings, pa.string()), pa.array([LEARNED] * len(words), pa.string()), b.column(5)], names=[*TOKEN, "reading", "swap", "score"])
            yield out.filter(hit)

    rows = tokens.where("swap IS NULL").join(_as_map(tables, "lang", "source"), ["lang", "source"]).select(*TOKEN, "score", "table")
    found = written(rows.mapInArrow(run, JUDGED), "p10-deciphered")
    enough = found.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_TOKENS).select("lang", "source")
    return found.join(enough, ["lang", "source"], "left_semi")


def applied(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """(lang, source, token, n, texts, reading, swap): readings by translate() with the source's own table; bytes of
    UTF-8 are decoded then. What no table can say (wide encodings, two swaps in turn) keeps the judged reading; broken
    tokens have a null reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for token, reading, swap, table in zip(*(b.column(i).to_pylist() for i in (2, 5, 6, 7))):
                if swap == "?>?":
                    reading = None
                elif table and len(_stands_for(token, reading, swap)) > 0:
                    shown = token.translate({ord(k): v for k, v in table})
                    try:
                        reading = shown.encode("latin-1").decode("utf-8") if swap.startswith("utf-8>") else shown
                    except UnicodeError:
                        pass
                out.append(reading)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.string()), b.column(6)], names=[*TOKEN, "reading", "swap"])

    rows = hits.join(_as_map(tables, "source", "swap"), ["source", "swap"], "left").select(*TOKEN, "reading", "swap", "table")
    return rows.mapInArrow(run, "lang string, source string, token string, n long, texts long, reading string, swap string")


def learn(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(hits, tables): the garbled (lang, source, token) with their swap and reading, and each source's substitution
    tables, after ``rounds`` of expectation and maximization over the tokens of all texts."""
    tokens = written(token_counts(df, text, lang, source), "p10-tokens")
    model, shares, out = Model(bigram_table(tokens, "token")), None, None
    for _ in range(rounds):
        out = written(judged(tokens, model, shares), "p10-judged")
        model = Model(bigram_table(out.where("NOT coalesce(swap = '?>?', false)"), "reading"))
        shares = shares_of(out)
    known = out.where("swap IS NOT NULL")
    pages = written(unknown_pages(out, model), "p10-pages")
    tables = written(learned_tables(known), "p10-tables")
    hits = applied(known, tables)
    every = tables
    if not pages.isEmpty():
        more = deciphered(out, pages, model)
        hits = hits.unionByName(more.drop("score"))
        every = tables.unionByName(pages.select("source", F.lit(LEARNED).alias("swap"), "shown", "stands_for", F.lit(None).cast("long").alias("n")))
    return written(hits, "p10-hits"), every


def _hashed(tokens: Sequence[str]) -> np.ndarray:
    """A place in the bitmap for each token."""
    return pd.util.hash_array(np.array(tokens, object)).view(np.uint64) >> np.uint64(64 - HIT_BITS)


def hit_bitmap(hits: DataFrame) -> np.ndarray:
    """Bitmap of the garbled tokens: 2 MB whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashed(words)).astype(np.int64) if words else np.zeros(0, np.int64))], names=["bit"])

    words = hits.select("token").distinct().mapInArrow(run, "bit long").selectExpr("bit >> 6 AS w", "shiftleft(1L, cast(bit % 64 AS int)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (HIT_BITS - 6), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out.view(np.uint8)


def _met(df: DataFrame, hits: DataFrame, key: str, text: str, lang: str, source: str, whole: bool) -> DataFrame:
    """(row, key, lang, source, tokens [, text]): the distinct tokens of each text that pass the bitmap; ``row`` tells
    rows of equal keys apart. Texts without one give no row."""
    sent = df.sparkSession.sparkContext.broadcast(hit_bitmap(hits))
    kind = df.schema[key].dataType.simpleString()
    schema = f"row long, {key} {kind}, lang string, source string, tokens array<string>" + (", text string" if whole else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            texts, keep, found = b.column(2).to_pylist(), [], []
            for i, t in enumerate(texts):
                words = list(dict.fromkeys(tokens_of(t))) if t else []
                if words:
                    at = _hashed(words)
                    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    if hit.any():
                        keep.append(i)
                        found.append([w for w, h in zip(words, hit.tolist()) if h])
            at = pa.array(keep, pa.int64())
            langs = pa.array([language(g) for g in b.column(3).take(at).to_pylist()], pa.string())
            cols = [b.column(0).take(at), b.column(1).take(at), langs, b.column(4).take(at), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols + ([b.column(2).take(at)] if whole else []), names=["row", key, "lang", "source", "tokens"] + (["text"] if whole else []))

    rows = df.select(F.monotonically_increasing_id().alias("row"), key, F.col(text).alias("text"), F.col(lang).alias("lang"), F.coalesce(source, F.lit("")).alias("source"))
    return rows.mapInArrow(run, schema)


def garbled(df: DataFrame, hits: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, swaps, tokens): texts with at least one garbled token, the swaps met and the number of such distinct tokens.

    Null, empty and ASCII texts have none. Letters of any language, symbols, box drawing and decomposed accents
    stand as they are. Repeated texts are each reported.
    """
    met = _met(df, hits, key, text, lang, source, False).select("row", key, "lang", "source", F.explode("tokens").alias("token"))
    both = met.join(hits.select("lang", "source", "token", "swap"), ["lang", "source", "token"])
    per = both.groupBy("row", key).agg(F.sort_array(F.collect_set("swap")).alias("swaps"), F.count(F.lit(1)).cast("int").alias("tokens"))
    return per.select(key, "swaps", "tokens")


def restored(df: DataFrame, hits: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, text, unrestored): garbled texts with every token that has a reading put right, and the number of
    distinct tokens that stay broken. Only texts that pass the bitmap are shuffled."""
    met = written(_met(df, hits, key, text, lang, source, True), "p10-met")
    kind = df.schema[key].dataType.simpleString()
    each = met.select("row", "lang", "source", F.explode("tokens").alias("token")).join(hits.select("lang", "source", "token", "reading"), ["lang", "source", "token"])
    per = each.groupBy("row").agg(F.collect_list(F.struct("token", "reading")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, left = [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                right = {x["token"]: x["reading"] for x in found if x["reading"] is not None}
                texts.append(put_right(t, right))
                left.append(len(found) - len(right))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(left, pa.int32())], names=[key, "text", "unrestored"])

    return met.join(per, "row").select(key, "text", "found").mapInArrow(run, f"{key} {kind}, text string, unrestored int")


def put_right(text: str, readings: dict[str, str]) -> str:
    """Replaces whole tokens by their readings."""
    if not readings:
        return text
    pattern = re.compile("|".join(map(re.escape, sorted(readings, key=len, reverse=True))))
    return pattern.sub(lambda hit: readings[hit.group()], text)


def swaps_of(hits: DataFrame) -> DataFrame:
    """(source, swap, tokens, n_distinct): how often each swap was met in each source."""
    return hits.groupBy("source", "swap").agg(F.sum("n").alias("tokens"), F.countDistinct("token").alias("n_distinct"))
