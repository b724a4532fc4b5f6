"""Differences between two copies of a table by set reconciliation.

Every distinct row is an element of GF(2^61 - 1): a hash of its key and cells. Elements fall into buckets by
the key. Each side states, per bucket, its number of elements and the values of its characteristic polynomial
prod(z - x) at a few points; the elements the sides share cancel in the ratio of those values, so a rational
function whose degree is the number of differences interpolates it. Its zeros are the elements of one side
only, its poles those of the other. The degree bound starts low and doubles for the buckets whose solution
fails at further check points. At last the rows with differing keys are fetched and compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import small_side, written

P = (1 << 61) - 1
_M32, _M29 = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
_P = np.uint64(P)
CHECKS = 2
SOLVE_TASKS = 48


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2^61 - 1 of reduced uint64 arrays."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    ah, al, bh, bl = a >> np.uint64(32), a & _M32, b >> np.uint64(32), b & _M32
    mid = ah * bl + al * bh  # below 2^62
    low = al * bl
    # 2^64 = 8 and 2^61 = 1; mid * 2^32 splits at bit 29
    s = ((ah * bh) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & _M29) << np.uint64(32)) + (low >> np.uint64(61)) + (low & _P)
    s = (s & _P) + (s >> np.uint64(61))
    return np.where(s >= _P, s - _P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s >= _P, s - _P, s)


def power(a: np.ndarray, e: int) -> np.ndarray:
    out = np.ones_like(a)
    while e:
        if e & 1:
            out = mul(out, a)
        a, e = mul(a, a), e >> 1
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    return power(a, P - 2)


def points(m: int) -> np.ndarray:
    """Fixed evaluation points, the same on both sides; spread so that a hash rarely equals one."""
    k = np.arange(1, m + 1, dtype=np.uint64)
    return mul(k * np.uint64(0x9E3779B9), np.full(m, 0x1234567890ABCDE, np.uint64)) | np.uint64(1)


def products(values: np.ndarray, bucket: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their sizes, and per bucket prod over its values of (z_j - value) for each point.

    Neighbours of one bucket are multiplied in rounds, for all buckets at once.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], sub(z[None, :], values[order][:, None])
    names, size = np.unique(bucket, return_counts=True)
    while len(bucket) > len(names):
        first = np.searchsorted(bucket, names)
        place = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        left = np.flatnonzero(place % 2 == 0)
        paired = (left + 1 < len(bucket)) & (bucket[np.minimum(left + 1, len(bucket) - 1)] == bucket[left])
        out = rows[left]
        out[paired] = mul(out[paired], rows[left[paired] + 1])
        bucket, rows = bucket[left], out
    return names, size, rows


def vanishes(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is a zero of its own polynomial (rows of ascending coefficients)."""
    out = np.zeros_like(x)
    for k in range(coefficients.shape[1] - 1, -1, -1):
        out = add(mul(out, x), coefficients[:, k])
    return out == 0


def solve(a: np.ndarray) -> np.ndarray:
    """A solution of each augmented system in ``a`` (systems, rows, columns + 1), free variables at 0."""
    a = a.copy()
    systems, rows, width = a.shape
    cols = width - 1
    at = np.zeros(systems, np.int64)
    pivot = np.full((systems, cols), -1)
    one = np.arange(systems)
    for c in range(cols):
        candidate = (a[:, :, c] != 0) & (np.arange(rows) >= at[:, None])
        has = candidate.any(1)
        r = np.where(has, candidate.argmax(1), 0)
        s, to = one[has], at[has]
        if not len(s):
            continue
        top = a[s, r[has]].copy()
        a[s, r[has]] = a[s, to]
        top = mul(top, inverse(top[:, c])[:, None])
        a[s, to] = top
        factor = a[s, :, c].copy()
        factor[np.arange(len(s)), to] = 0
        a[s] = sub(a[s], mul(factor[:, :, None], top[:, None, :]))
        pivot[s, c] = to
        at[s] += 1
    out = np.zeros((systems, cols), np.uint64)
    for c in range(cols):
        got = pivot[:, c] >= 0
        out[got, c] = a[one[got], pivot[got, c], width - 1]
    return out


def rational(ratio: np.ndarray, z: np.ndarray, delta: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators and denominators (monic, ascending) that meet ratio at the points, and which also meet the checks.

    ``ratio`` is (buckets, bound + CHECKS); the sides differ in size by ``delta``; degrees sum to at most ``bound``.
    """
    da, db = (bound + delta) // 2, (bound - delta) // 2
    m = da + db
    powers = np.ones((len(z), max(da, db) + 1), np.uint64)
    for k in range(1, powers.shape[1]):
        powers[:, k] = mul(powers[:, k - 1], z)
    n = len(ratio)
    a = np.zeros((n, m, m + 1), np.uint64)
    a[:, :, :da] = powers[None, :m, :da]
    a[:, :, da:m] = sub(np.zeros((), np.uint64), mul(ratio[:, :m, None], powers[None, :m, :db]))
    a[:, :, m] = sub(mul(ratio[:, :m], powers[None, :m, db]), powers[None, :m, da])
    x = solve(a) if m else np.zeros((n, 0), np.uint64)
    one = np.ones((n, 1), np.uint64)
    top, low = np.concatenate([x[:, :da], one], 1), np.concatenate([x[:, da:], one], 1)
    ok = np.ones(n, bool)
    for j in range(len(z)):
        zj = np.full(n, z[j])
        t, d = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(da, -1, -1):
            t = add(mul(t, zj), top[:, k])
        for k in range(db, -1, -1):
            d = add(mul(d, zj), low[:, k])
        ok &= t == mul(d, ratio[:, j])
    return top, low, ok


def elements(df: DataFrame, key: Sequence[str], cells: Sequence[str], buckets: int) -> DataFrame:
    """Distinct rows as (bucket, x, key): x is a hash of key and cells in 1 .. 2^61 - 2, nulls included."""
    marked: list[Column] = []
    for c in [*key, *cells]:
        marked += [F.col(c).isNull(), F.col(c)]
    x = F.pmod(F.xxhash64(*marked), F.lit(P - 2)) + 1
    bucket = F.pmod(F.hash(*[F.col(k) for k in key]), F.lit(buckets))
    return df.select(bucket.cast("int").alias("bucket"), x.alias("x"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()


def sketch(items: DataFrame, side: str, m: int) -> DataFrame:
    """(bucket, side, size, values) per bucket, multiplied up within each partition before the shuffle."""
    schema = "bucket int, side string, size long, vals array<long>"
    z = points(m)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size: dict[int, int] = {}
        value: dict[int, np.ndarray] = {}
        for f in frames:
            for b, n, v in zip(*products(f["x"].to_numpy().astype(np.uint64), f["bucket"].to_numpy(), z)):
                value[b] = mul(value[b], v) if b in value else v
                size[b] = size.get(b, 0) + int(n)
        if size:
            yield pd.DataFrame({"bucket": list(size), "side": side, "size": list(size.values()), "vals": [value[b].astype(np.int64) for b in size]})

    return items.select("bucket", "x").mapInPandas(run, schema)


SOLVED = "bucket int, ok boolean, top array<long>, low array<long>"


def _solve_chunk(m: int):
    z = points(m + CHECKS)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        size = {"a": {}, "b": {}}
        value = {"a": {}, "b": {}}
        for b, side, n, v in f[["bucket", "side", "size", "vals"]].itertuples(index=False):
            v = np.asarray(v, np.int64).astype(np.uint64)
            size[side][b] = size[side].get(b, 0) + n
            value[side][b] = mul(value[side][b], v) if b in value[side] else v
        out = []
        ones = np.ones(len(z), np.uint64)
        by: dict[int, list[int]] = {}
        for b in {*size["a"], *size["b"]}:
            by.setdefault(size["a"].get(b, 0) - size["b"].get(b, 0), []).append(b)
        for d, group in by.items():
            if abs(d) > m:
                out += [(b, False, None, None) for b in group]
                continue
            bound = m if (m + d) % 2 == 0 else m - 1
            ratio = mul(np.stack([value["a"].get(b, ones) for b in group]), inverse(np.stack([value["b"].get(b, ones) for b in group])))
            top, low, ok = rational(ratio, z, d, bound)
            out += [(b, bool(o), t.astype(np.int64), w.astype(np.int64)) if o else (b, False, None, None) for b, t, w, o in zip(group, top, low, ok)]
        return pd.DataFrame(out, columns=["bucket", "ok", "top", "low"])

    return run


def _roots(items: DataFrame, solved: DataFrame, which: str) -> DataFrame:
    """Elements of a side that are zeros of their bucket's polynomial."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            degree = f["poly"].map(len).to_numpy()
            hit = np.zeros(len(f), bool)
            for n in np.unique(degree):
                at = np.flatnonzero(degree == n)
                polynomials = np.stack(f["poly"].iloc[at].to_list()).astype(np.uint64)
                hit[at] = vanishes(polynomials, f["x"].to_numpy()[at].astype(np.uint64))
            yield f.loc[hit, ["bucket", "x"]]

    return items.join(solved.where("ok").select("bucket", F.col(which).alias("poly")), "bucket").mapInPandas(run, "bucket int, x long")


def differing(a: DataFrame, b: DataFrame, buckets: int, first_bound: int = 16, chunk: int = 64) -> tuple[DataFrame, DataFrame]:
    """Elements of ``a`` only and of ``b`` only. Loops while buckets are unsolved, with twice the bound each time.

    A bound of at least the bucket's whole size always solves it, so the loop ends; only the count of open
    buckets comes to the driver.
    """
    left, right = [], []
    m, open_a, open_b = first_bound, a, b
    while True:
        per = max(1, chunk * first_bound // m)
        both = sketch(open_a, "a", m + CHECKS).unionByName(sketch(open_b, "b", m + CHECKS))
        # few rows but much work a chunk, so the chunks are spread by number and not by size
        solved = written(both.withColumn("chunk", F.floor(F.col("bucket") / per)).repartition(SOLVE_TASKS, "chunk").groupBy("chunk").applyInPandas(_solve_chunk(m), SOLVED), "p4-solved")
        left.append(_roots(open_a, solved, "top"))
        right.append(_roots(open_b, solved, "low"))
        if solved.where("not ok").isEmpty():
            break
        still = solved.where("not ok").select("bucket")
        open_a, open_b = open_a.join(still, "bucket", "left_semi"), open_b.join(still, "bucket", "left_semi")
        m *= 2
    return reduce(DataFrame.unionByName, left), reduce(DataFrame.unionByName, right)


def reconcile(a: DataFrame, b: DataFrame, key: str, cells: Sequence[str], buckets: int, first_bound: int = 16, labels: tuple[str, str] = ("only_a", "only_b")) -> DataFrame:
    """(key, field): one row per key missing on a side (field is the label of the side that has it) and per
    differing cell. Null equals null and differs from any value; a null key is a key. Repeated equal rows count
    once. Where a side holds several versions of a key, a field differs when the sides' sets of values do.
    Two empty tables give no rows; columns other than ``key`` and ``cells`` aren't compared.
    """
    ea, eb = (written(elements(x, [key], cells, buckets), f"p4-{s}") for x, s in ((a, "a"), (b, "b")))
    da, db = differing(ea, eb, buckets, first_bound)
    hits = written(da.unionByName(db).select("x"), "p4-differing").distinct()
    own = ea.unionByName(eb).join(small_side(hits), "x", "left_semi")
    keys = own.select(F.col("_k0").alias("_k")).distinct()
    keys = written(keys, "p4-keys")
    found = small_side(keys)

    def fetched(df: DataFrame, side: str) -> DataFrame:
        got = df.select(key, *cells).join(found, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
        text = [F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")))).alias(f"{side}_{c}") for c in cells]
        return got.groupBy(F.col(key).alias(f"{side}_key")).agg(F.lit(True).alias(side), *text)

    both = fetched(a, "a").join(fetched(b, "b"), F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    fields = F.filter(F.array(*[F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(c)) for c in cells]), lambda f: f.isNotNull())
    fields = F.when(F.col("b").isNull(), F.array(F.lit(labels[0]))).when(F.col("a").isNull(), F.array(F.lit(labels[1]))).otherwise(fields)
    return both.select(F.when(F.col("a").isNull(), F.col("b_key")).otherwise(F.col("a_key")).alias(key), F.explode(fields).alias("field"))
