"""Most similar vectors for every vector: probed lists, scanned by blocks of rotated dimensions.

The index is fitted on a bounded sample: a rotation by principal components and the centroids of the lists
(bisecting k-means, so that heavy regions get several lists). Equal vectors are folded into one row that stands for all of them; every row is
then indexed. A row searches its own list first; with the distance of its k-th hit as radius it probes each further list whose region the radius
reaches. Within a list the distances grow by blocks of rotated dimensions; after each block a hypothesis test
abandons the candidates for which a distance within the radius is as good as excluded, and only those that pass
every test get their whole distance, in double precision. A list of any size is cut into blocks that are searched pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import small_side, written

SAMPLE_ROWS = 20_000
LIST_ROWS = 8_192
MAX_LISTS = 4_096
BLOCK_ROWS = 16_384
QUERY_TILE, CANDIDATE_TILE, SEED_ROWS = 256, 2_048, 1_024
PAIRS = 200_000
DIMENSIONS = (24, 40, 60)
ABANDON_LEVELS = (8e-4, 1e-4, 1e-4)
INDEXED = "idx long, vec binary, leaf int, away double"


def packed(df: DataFrame, key: str, cells: Sequence[str]) -> DataFrame:
    """(idx, vec): one row per key, its cells as packed 32-bit floats. Left out: rows with a null key or cell and
    rows of zeros only. If a key comes with unlike cells the least vector by bytes stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)]).astype(np.float32)
            keep = np.isfinite(m).all(1) & (m != 0).any(1) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), binary_of(m[keep])], names=["idx", "vec"])

    wide = df.select(F.col(key).cast("long"), *[F.col(c).cast("float") for c in cells])
    return wide.mapInArrow(run, "idx long, vec binary").groupBy("idx").agg(F.min("vec").alias("vec"))


def binary_of(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.float32)
    width = 4 * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * width).astype(np.int32)), pa.py_buffer(m)])


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.frombuffer(b"".join(p.to_pylist()), np.float32).reshape(-1, width) for p in parts if len(p)]
    return np.concatenate(out) if out else np.zeros((0, width), np.float32)


def sample_of(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The rows with the least hashes: a sample of bounded size that does not depend on order or partitions."""
    got = vectors.select("vec").orderBy(F.xxhash64("idx", F.lit(7)), "idx").limit(rows).toArrow()
    blobs = got.column(0).to_pylist()
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1) if blobs else np.zeros((0, 1), np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, 1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def bisected(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by splitting the fullest list in two until there are ``lists`` or none can be split."""
    parts, whole = [x.astype(np.float64)], []
    while parts and len(parts) + len(whole) < lists:
        p = parts.pop(max(range(len(parts)), key=lambda i: len(parts[i])))
        if len(p) < 4 or not np.ptp(p, axis=0).any():
            whole.append(p)
            continue
        c = kmeans(p, 2, seed=len(parts) + len(whole) + 1)
        near = ((p - c[0]) ** 2).sum(1) > ((p - c[1]) ** 2).sum(1)
        if near.all() or not near.any():  # cut at the mean of the widest dimension, which always leaves two sides
            k = int(np.ptp(p, axis=0).argmax())
            near = p[:, k] > p[:, k].mean()
        parts += [p[near], p[~near]] if near.any() and not near.all() else []
        whole += [p] if near.all() or not near.any() else []
    return np.array([p.mean(0) for p in (*whole, *parts)])


@dataclass
class Index:
    """``ends`` are the last dimensions of the blocks, ``shares`` the tests' quantiles after each."""

    rotation: np.ndarray
    centroids: np.ndarray
    ends: tuple[int, ...]
    shares: tuple[float, ...]
    reach: np.ndarray | None = None


def fit(sample: np.ndarray, rows: int, exact: bool = False) -> Index:
    """Rotation, lists and the tests' quantiles from the sample; ``rows`` is the size of the whole collection. With
    ``exact`` a candidate is abandoned only when its partial distance alone is too great."""
    x = sample.astype(np.float64)
    width = x.shape[1]
    if len(x) == 0:
        return Index(np.eye(width), np.zeros((1, width)), (width,), (1.0,))
    _, vectors = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and width > 1 else np.eye(width))
    rotation = np.ascontiguousarray(vectors[:, ::-1])
    lists = int(np.clip(-(-rows // LIST_ROWS), 1, min(MAX_LISTS, max(1, len(x) // 8))))
    centroids = bisected(x, lists)
    ends = tuple(e for e in DIMENSIONS if e < width) or (width,)
    ratios: list[np.ndarray] = []
    if len(x) > 10 and ends[0] < width and not exact:
        queries, norm = x[:: max(1, len(x) // 1000)], (x**2).sum(1)
        for s in range(0, len(queries), 50):
            q = queries[s : s + 50]
            near = np.argpartition(norm - 2 * q @ x.T, 4, 1)[:, :4]
            diff = (((q[:, None, :] - x[near]) @ rotation) ** 2).reshape(-1, width)
            whole = diff.sum(1)
            sums = diff.cumsum(1)[:, [e - 1 for e in ends]]
            ratios.append(sums[whole > 0] / whole[whole > 0, None])
    ratio = np.concatenate(ratios) if ratios else np.zeros((0, len(ends)))
    # together the tests lose a neighbour as if once in a thousand; the first, which spares most, has most of that
    shares = np.array([min(1.0, np.quantile(r, 1 - level)) for r, level in zip(ratio.T, ABANDON_LEVELS)] if len(ratio) else [1.0] * len(ends))
    return Index(rotation, centroids, ends, tuple(shares.tolist()))


def indexed(vectors: DataFrame, index: Index) -> DataFrame:
    """Every row with the list it belongs to and its distance to that list's centroid."""
    c = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b.column(1), c.shape[1]).astype(np.float64)
            d = (c**2).sum(1) - 2 * x @ c.T
            leaf = d.argmin(1)
            away = np.sqrt(((x - c[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.astype(np.int32)), pa.array(away)], names=["idx", "vec", "leaf", "away"])

    return vectors.mapInArrow(run, INDEXED)


class Best:
    """The k least (distance, id) hits of each query."""

    def __init__(self, queries: int, k: int, limit: np.ndarray):
        self.d = np.full((queries, k), np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.limit = limit.copy()

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        k = self.d.shape[1]
        rows, at = np.unique(q, return_inverse=True)
        q = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
        d, ids = np.concatenate([d, self.d[rows].ravel()]), np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        begin = np.searchsorted(q, np.arange(len(rows)))
        pick = begin[:, None] + np.arange(k)
        self.d[rows], self.id[rows] = d[pick], ids[pick]
        self.limit[rows] = np.minimum(self.limit[rows], self.d[rows, -1])


def scan(index: Index, q: np.ndarray, qg: np.ndarray, c: np.ndarray, cg: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray) -> Best:
    """Hits of queries ``q`` among candidates ``c`` within squared ``limit``; equal groups (``qg``, ``cg``) are no hits."""
    order = np.argsort(ids, kind="stable")
    c, cg, ids = c[order], cg[order], ids[order]
    best = Best(len(q), k, limit)
    if not len(q) or not len(c):
        return best
    centre = c.mean(0, dtype=np.float64)
    last, first = index.ends[-1], index.ends[0]
    turn = index.rotation[:, :last]
    qr, cr = ((q - centre) @ turn).astype(np.float32), ((c - centre) @ turn).astype(np.float32)
    q1, c1 = np.ascontiguousarray(qr[:, :first]), np.ascontiguousarray(cr[:, :first])
    qn, cn = (q1**2).sum(1), (c1**2).sum(1)
    slack = 4e-6 * float(max((qr**2).sum(1).max(), (cr**2).sum(1).max()))
    # one product gives the first block's distances: (-2q, 1, |q|^2) by (c, |c|^2, 1)
    qa = np.column_stack([-2 * q1, np.ones(len(q), np.float32), qn])
    ca = np.column_stack([c1, cn, np.ones(len(c), np.float32)])
    q64, c64 = q.astype(np.float64), c.astype(np.float64)
    grouped = not np.array_equal(cg, ids)
    spans = [(0, min(SEED_ROWS, len(c)))] + [(s, min(s + CANDIDATE_TILE, len(c))) for s in range(SEED_ROWS, len(c), CANDIDATE_TILE)]
    for t in range(0, len(q), QUERY_TILE):
        rows = slice(t, min(t + QUERY_TILE, len(q)))
        for s, e in spans:
            partial = qa[rows] @ ca[s:e].T
            limits = best.limit[rows]
            # ids ascend, so once the k-th hit is at distance 0 no later candidate can come before it
            bound = np.where((best.d[rows, -1] == 0), -1.0, index.shares[0] * limits + slack).astype(np.float32)
            near = partial <= bound[:, None]
            if grouped:  # most of what is near is of the query's own group
                near &= qg[rows, None] != cg[s:e]
            hit_q, hit_c = np.divmod(np.flatnonzero(near), e - s)
            for p in range(0, len(hit_q), PAIRS):
                a, b = hit_q[p : p + PAIRS] + t, hit_c[p : p + PAIRS] + s
                other = qg[a] != cg[b]
                a, b = a[other], b[other]
                grown = partial[a - t, b - s]
                for begin, end, share in zip(index.ends, index.ends[1:], index.shares[1:]):
                    grown = grown + ((qr[a, begin:end] - cr[b, begin:end]) ** 2).sum(1)
                    stays = grown <= share * best.limit[a] + slack
                    a, b, grown = a[stays], b[stays], grown[stays]
                d = ((q64[a] - c64[b]) ** 2).sum(1)
                near = d <= best.limit[a]
                best.add(a[near], d[near], ids[b[near]])
    return best


FOUND = "idx long, nbr long, d2 double, leaf int, vec binary, grp long, tau2 double"


def _result(index: Index, width: int, idx: np.ndarray, best: Best, probes: tuple | None = None) -> pa.Table:
    at, j = np.nonzero(np.isfinite(best.d))
    n, m = len(at), 0
    columns = [idx[at], best.id[at, j], best.d[at, j]]
    out = pa.table([*map(pa.array, columns), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=["idx", "nbr", "d2", "leaf", "vec", "grp", "tau2"])
    if probes is not None:
        q, leaf, x, g, tau = probes
        m = len(q)
        more = pa.table([pa.array(idx[q]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(leaf.astype(np.int32)), binary_of(x[q]), pa.array(g[q]), pa.array(tau[q])], names=out.schema.names)
        out = pa.concat_tables([out, more])
    return out


def _probes(index: Index, x: np.ndarray, home: int, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) for each further list whose region comes within the query's radius."""
    c = index.centroids
    x = x.astype(np.float64)
    d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0)
    apart = np.sqrt(((c - c[home]) ** 2).sum(1))
    apart[home] = np.inf
    radius = np.sqrt(tau)[:, None] * (1 + 1e-9) + 1e-9
    near = (d - d[:, home : home + 1] <= 2 * apart * radius) & (np.sqrt(d) - index.reach <= radius)
    near[:, home] = False
    return np.nonzero(near)


def _blocks(spark, sizes: dict[int, int], rows: int, name: str) -> DataFrame:
    return spark.createDataFrame([(leaf, -(-n // rows)) for leaf, n in sizes.items()] or [(-1, 1)], f"leaf int, {name} int")


def search(rows: DataFrame, index: Index, k: int, radius: float) -> DataFrame:
    """(idx, nbr, d2): the k nearest of each row within ``radius``, by (distance, id).

    ``rows`` has the columns of :func:`indexed`, plus ``grp`` (rows of one group are no neighbours; the row's own
    idx makes it only exclude itself) and ``ask`` (whether the row is a query). Every row is a candidate.
    """
    spark = rows.sparkSession
    width = len(index.centroids[0])
    stat = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")).collect()
    sizes = {r["leaf"]: r["n"] for r in stat}
    index.reach = np.zeros(len(index.centroids))
    for r in stat:
        index.reach[r["leaf"]] = r["reach"]
    limit = radius * radius * (1 + 1e-9)
    blocks = F.broadcast(_blocks(spark, sizes, BLOCK_ROWS, "nb"))
    block = F.pmod(F.xxhash64("idx"), F.col("nb")).cast("int")
    placed = rows.join(blocks, "leaf").withColumn("b", block)
    # role 0 candidate, 1 query, 2 both
    spread = F.expr(
        "concat(array(struct(b AS cb, b AS qb, 2 AS role)),"
        " transform(filter(sequence(0, nb - 1), j -> j <> b), j -> struct(b AS cb, j AS qb, 0 AS role)),"
        " transform(filter(sequence(0, nb - 1), j -> j <> b AND ask), j -> struct(j AS cb, b AS qb, 1 AS role)))"
    )
    own = placed.select("idx", "vec", "leaf", "grp", "ask", F.inline(spread))

    def first(keys: tuple, t: pa.Table) -> pa.Table:
        leaf, cb, qb = (k.as_py() for k in keys)
        role = t.column("role").to_numpy()
        x, idx, grp = matrix_of(t.column("vec"), width), t.column("idx").to_numpy(), t.column("grp").to_numpy()
        ask = t.column("ask").to_numpy().astype(bool) & (role > 0)
        is_c = role != 1
        q = x[ask]
        best = scan(index, q, grp[ask], x[is_c], grp[is_c], idx[is_c], k, np.full(len(q), limit))
        probes = None
        if cb == qb and len(q):
            hit, lists = _probes(index, q, leaf, best.limit)
            probes = (hit, lists, q, grp[ask], best.limit)
        return _result(index, width, idx[ask], best, probes)

    found = written(own.groupBy("leaf", "cb", "qb").applyInArrow(first, FOUND), "p7-own")
    probes = found.where("nbr IS NULL").select("idx", "vec", "leaf", "grp", "tau2")
    asked = {r["leaf"]: r["count"] for r in probes.groupBy("leaf").count().collect()}
    chunks = F.broadcast(_blocks(spark, asked, BLOCK_ROWS, "nq"))
    a = rows.join(blocks, "leaf").join(chunks, "leaf").withColumn("cb", block)
    a = a.select("idx", "vec", "leaf", "grp", F.lit(None).cast("double").alias("tau2"), "cb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"))
    p = probes.join(blocks, "leaf").join(chunks, "leaf").withColumn("qb", F.pmod(F.xxhash64("idx"), F.col("nq")).cast("int"))
    p = p.select("idx", "vec", "leaf", "grp", "tau2", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("cb"), "qb").select(a.columns)

    def further(t: pa.Table) -> pa.Table:
        x, idx, grp = matrix_of(t.column("vec"), width), t.column("idx").to_numpy(), t.column("grp").to_numpy()
        tau = t.column("tau2").to_numpy().astype(np.float64)
        ask = np.isfinite(tau)
        best = scan(index, x[ask], grp[ask], x[~ask], grp[~ask], idx[~ask], k, tau[ask])
        return _result(index, width, idx[ask], best)

    more = a.unionByName(p).groupBy("leaf", "cb", "qb").applyInArrow(further, FOUND)
    every = found.where("nbr IS NOT NULL").select("idx", "nbr", "d2").unionByName(more.select("idx", "nbr", "d2"))
    # a query meets a list block once and gets at most k hits of each, so these arrays stay short
    top = every.groupBy("idx").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "nbr"))), 1, k).alias("t"))
    return top.select("idx", F.inline("t")).select("idx", "nbr", "d2").where(F.sqrt("d2") <= radius)


def folded(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, copies): one row (idx, vec, n) for each distinct vector, named by its least id and standing for n, and
    (idx, rep) of the other ids. Vectors are equal when two 64-bit hashes are; only those are shuffled for it, and
    counted before the shuffle, so a vector of a third of all rows is no hot key."""
    hashed = vectors.select("idx", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g"))
    many = hashed.groupBy("h", "g").agg(F.min("idx").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = written(many, "p7-equal")
    members = written(hashed.join(small_side(many), ["h", "g"]).select("idx", "rep", "n"), "p7-copies")
    copies = members.where("idx <> rep").select("idx", "rep")
    heads = members.where("idx = rep").select("idx", "n")
    rows = vectors.join(small_side(copies.select("idx")), "idx", "left_anti").join(small_side(heads), "idx", "left")
    return rows.select("idx", "vec", F.coalesce("n", F.lit(1)).cast("long").alias("n")), copies


def prepared(df: DataFrame, key: str, cells: Sequence[str], exact: bool = False) -> tuple[DataFrame, Index, DataFrame]:
    """Indexed rows of distinct vectors (written once, with ``n``, ``grp`` = idx and ``ask``), the index fitted on a
    bounded sample, and the copies (idx, rep) that are no rows of their own."""
    vectors = written(packed(df, key, cells), "p7-vectors")
    rows, copies = folded(vectors)
    rows = written(rows, "p7-distinct")
    index = fit(sample_of(rows), rows.count(), exact)
    placed = written(indexed(rows.select("idx", "vec"), index), "p7-indexed")
    counted = placed if copies.isEmpty() else placed.join(small_side(rows.where("n > 1").select("idx", "n")), "idx", "left")
    n = F.lit(1) if copies.isEmpty() else F.coalesce("n", F.lit(1))
    return counted.select("idx", "vec", "leaf", "away", n.cast("long").alias("n"), F.col("idx").alias("grp"), F.lit(True).alias("ask")), index, copies


def nearest(df: DataFrame, key: str, cells: Sequence[str], k: int, radius: float) -> DataFrame:
    """(idx, nbr, d2): up to k nearest others of every distinct key, no further than ``radius``, ties to the smaller id.

    Rows of zeros, null keys and rows with null cells are no vectors; repeated rows count once; equal vectors are
    neighbours at distance 0. Fewer than k rows, or an empty table, give what there is.
    """
    rows, index, copies = prepared(df, key, cells)
    found = search(rows, index, k, radius)
    if copies.isEmpty():
        return found
    # of each distinct vector the k + 1 least ids are enough for any row's k nearest
    ranked = copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("idx"))).where(F.col("r") <= k)
    least = written(ranked.select("rep", F.col("idx").alias("id")), "p7-least")
    ids = small_side(least)
    hits = found.select("idx", "d2", F.col("nbr").alias("id"))
    hits = hits.unionByName(found.join(ids.withColumnRenamed("rep", "nbr"), "nbr").select("idx", "d2", "id"))
    heads = least.select(F.col("rep").alias("idx")).distinct()
    zero = F.lit(0.0).alias("d2")
    hits = hits.unionByName(heads.select("idx", zero, F.col("idx").alias("id"))).unionByName(least.select(F.col("rep").alias("idx"), zero, "id"))
    top = hits.groupBy("idx").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, k + 1).alias("t"))
    every = copies.unionByName(copies.select(F.col("rep").alias("idx"), "rep").distinct())
    own = top.join(every.withColumnsRenamed({"idx": "row", "rep": "idx"}), "idx", "left").select(F.coalesce("row", "idx").alias("row"), "t")
    own = own.select("row", F.slice(F.filter("t", lambda x: x["id"] != F.col("row")), 1, k).alias("t"))
    return own.select(F.col("row").alias("idx"), F.inline("t")).select("idx", F.col("id").alias("nbr"), "d2")


def neighbour_pairs(df: DataFrame, key: str, cells: Sequence[str], k: int, radius: float) -> DataFrame:
    """(idx_a, idx_b), idx_a < idx_b: pairs in which at least one is among the k nearest of the other."""
    n = nearest(df, key, cells, k, radius)
    return n.select(F.least("idx", "nbr").alias("idx_a"), F.greatest("idx", "nbr").alias("idx_b")).distinct()
