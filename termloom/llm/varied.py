"""A varied subset of a given size: mini-batch k-means, quotas per cluster, sampling within the quotas.

Seeds are drawn from all rows with a chance that grows with the squared distance to the seeds so far, so that rare
kinds get a cluster of their own; mini-batches over all rows move the centres; every row is then assigned.
A cluster's quota follows the square root of its size; slots that small clusters cannot fill go to the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.neighbors import binary_of, matrix_of, packed
from termloom.session import written

SEED_ROUNDS = 2
BATCH_ROUNDS = 1
MOST_CLUSTERS = 4_096
TILE = 4_096


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and squared distance, in tiles."""
    c = c.astype(np.float32)
    norm = (c**2).sum(1)
    near, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for s in range(0, len(x), TILE):
        p = x[s : s + TILE]
        d = norm - 2 * p @ c.T
        at = d.argmin(1)
        near[s : s + TILE] = at
        dist[s : s + TILE] = d[np.arange(len(p)), at] + (p**2).sum(1)
    return near, np.maximum(dist, 0)


def _drawn(vectors: DataFrame, centres: dict[int, np.ndarray], number: int) -> dict[int, np.ndarray]:
    """For each wanted size its next seeds: a weighted sample without replacement of as many rows, MOST_CLUSTERS at most.

    A row's key is log(u) / weight with u from a hash of its id; the greatest keys are the sample. Each task hands on
    no more than it could contribute, then each of 64 parts, so neither a task nor the driver meets more rows as sizes
    or tables grow.
    """
    most = {size: min(size, MOST_CLUSTERS) for size in centres}
    width = next(iter(centres.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            x = matrix_of(b.column(1), width)
            u = (b.column(2).to_numpy().astype(np.float64) + 2.0**63 + 0.5) / 2.0**64
            for size, c in centres.items():
                _, d = _nearest(x, c)
                key = np.log(np.clip(u, 1e-300, 1 - 1e-16)) / np.maximum(d, 1e-12)
                best = np.argsort(-key)[: most[size]]
                k, v = key[best], x[best]
                if size in held:
                    k, v = np.concatenate([held[size][0], k]), np.concatenate([held[size][1], v])
                    top = np.argsort(-k)[: most[size]]
                    k, v = k[top], v[top]
                held[size] = (k, v)
        for size, (k, v) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size, np.int32)), pa.array(k), binary_of(v)], names=["size", "key", "vec"])

    drawn = vectors.select("idx", "vec", F.xxhash64("idx", F.lit(100 + number)).alias("u")).mapInArrow(run, "size int, key double, vec binary")
    bound = F.least("size", F.lit(MOST_CLUSTERS))
    for keys in (["size", F.pmod(F.xxhash64("vec"), F.lit(64))], ["size"]):
        drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("key"), "vec"))).where(F.col("r") <= bound).drop("r")
    got = drawn.select("size", "vec").toArrow()
    sizes = got.column(0).to_numpy()
    x = matrix_of(got.column(1), width)
    return {size: x[sizes == size] for size in centres}


def _spread(candidates: np.ndarray, k: int) -> np.ndarray:
    """k of the candidates, each the furthest from those chosen so far."""
    x = candidates.astype(np.float32)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        at = int(far.argmax())
        if far[at] <= 0:
            break
        chosen.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
    return x[chosen]


def _moved(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One pass of mini-batch k-means: each task moves its copy of the centres batch by batch; the tasks' sums meet
    per centre, and only the new centres come to the driver."""
    width = next(iter(centres.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own = {size: c.astype(np.float64) for size, c in centres.items()}
        count = {size: np.ones(len(c)) for size, c in centres.items()}
        sums = {size: np.zeros(c.shape) for size, c in centres.items()}
        seen = {size: np.zeros(len(c)) for size, c in centres.items()}
        for b in batches:
            x = matrix_of(b.column(0), width)
            for size in centres:
                near, _ = _nearest(x, own[size])
                order = np.argsort(near, kind="stable")
                at, begin, n = np.unique(near[order], return_index=True, return_counts=True)
                total = np.add.reduceat(x[order].astype(np.float64), begin, axis=0)
                count[size][at] += n
                rate = (n / count[size][at])[:, None]
                own[size][at] = (1 - rate) * own[size][at] + rate * total / n[:, None]
                sums[size][at] += total
                seen[size][at] += n
        for size in centres:
            at = np.flatnonzero(seen[size])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32)), pa.array(seen[size][at]), pa.array(list(sums[size][at]), pa.list_(pa.float64()))], names=["size", "centre", "n", "total"])

    parts = vectors.select("vec").mapInArrow(run, "size int, centre int, n double, total array<double>")
    means = parts.groupBy("size", "centre").applyInPandas(_mean, "size int, centre int, mean array<double>").collect()
    out = {size: c.astype(np.float64).copy() for size, c in centres.items()}
    for size, centre, mean in means:
        out[size][centre] = mean
    return out


def _mean(f: pd.DataFrame) -> pd.DataFrame:
    mean = np.stack(f["total"].to_list()).sum(0) / f["n"].sum()
    return pd.DataFrame({"size": [f["size"].iloc[0]], "centre": [f["centre"].iloc[0]], "mean": [mean]})


def quotas(sizes: np.ndarray, slots: int) -> np.ndarray:
    """Slots per cluster by the square root of its size, one at least as far as they go, never more than its rows;
    what is left over is dealt out again."""
    out = np.zeros(len(sizes), np.int64)
    slots = int(min(slots, sizes.sum()))
    order = np.argsort(-sizes, kind="stable")
    out[order[:slots]] = np.minimum(1, sizes[order[:slots]])
    while (left := slots - int(out.sum())) > 0:
        room = out < sizes
        share = np.sqrt(sizes) * room
        more = np.minimum(np.floor(left * share / share.sum()).astype(np.int64), sizes - out)
        if not more.any():
            need = np.where(room, np.sqrt(sizes) / (out + 1), -1.0)
            more = np.zeros_like(out)
            more[np.argsort(-need, kind="stable")[:left]] = 1
            more *= room
        out += more
    return out


def varied_subsets(df: DataFrame, key: str, cells: Sequence[str], sizes: Sequence[int], among: DataFrame | None = None) -> DataFrame:
    """(size, key): for each wanted size as many distinct keys (fewer only if there are fewer), spread over clusters.

    Rows of zeros and with null keys or cells are left out, repeated rows count once; ``among`` restricts the keys to
    those found in that frame. An empty table gives an empty subset.
    """
    vectors = packed(df, key, cells)
    if among is not None:
        vectors = vectors.join(among.select(F.col(key).cast("long").alias("idx")), "idx", "left_semi")
    vectors = written(vectors, "p3-vectors")
    first = vectors.orderBy(F.xxhash64("idx", F.lit(3)), "idx").limit(min(max(sizes), MOST_CLUSTERS)).select("vec").toArrow()
    if first.num_rows == 0:
        return vectors.select(F.lit(0).alias("size"), F.col("idx").alias(key)).limit(0)
    x = matrix_of(first.column(0), len(cells))
    seeds = {s: x[: min(s, MOST_CLUSTERS)] for s in sizes}
    for number in range(SEED_ROUNDS):
        new = _drawn(vectors, seeds, number)
        seeds = {s: np.concatenate([seeds[s], new[s]]) for s in sizes}
    # the latest draws are the most outlying ones; spreading starts from a draw of the common kind
    centres = {s: _spread(c, min(s, MOST_CLUSTERS)) for s, c in seeds.items()}
    for _ in range(BATCH_ROUNDS):
        centres = _moved(vectors, centres)
    width = len(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix_of(b.column(1), width)
            for size, c in centres.items():
                near, _ = _nearest(v, c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), size, np.int32)), pa.array(near.astype(np.int32)), b.column(0)], names=["size", "centre", "idx"])

    placed = written(vectors.mapInArrow(assign, "size int, centre int, idx long"), "p3-placed")
    counts = placed.groupBy("size", "centre").count().collect()
    rows = []
    for size in sizes:
        own = sorted((r["centre"], r["count"]) for r in counts if r["size"] == size)
        share = quotas(np.array([n for _, n in own]), size)
        rows += [(size, c, int(q)) for (c, _), q in zip(own, share) if q]
    wanted = F.broadcast(df.sparkSession.createDataFrame(rows, "size int, centre int, quota int"))
    chance = F.xxhash64("idx", F.lit(11))
    picks = placed.join(wanted, ["size", "centre"]).withColumn("u", chance)
    # first within 64 parts of a cluster, then over what is left: no task sees a whole hot cluster
    part = Window.partitionBy("size", "centre", F.pmod("u", F.lit(64))).orderBy("u", "idx")
    whole = Window.partitionBy("size", "centre").orderBy("u", "idx")
    picks = picks.withColumn("r", F.row_number().over(part)).where("r <= quota")
    return picks.withColumn("r", F.row_number().over(whole)).where("r <= quota").select("size", F.col("idx").alias(key))
