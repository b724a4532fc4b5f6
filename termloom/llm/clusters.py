"""Hierarchical density clusters: neighbour graph, minimum spanning tree, condensed hierarchy, stable clusters.

The graph joins every row to its nearest others within a radius, at the mutual-reachability distance. Its minimum
spanning forest is built in two steps. Per list of the index a task merges what it can prove: an edge belongs to
the forest when no edge that leaves the list is lighter at that component. What remains goes through distributed
Borůvka rounds: each component picks its lightest edge, the picks are hooked together and pointers jumped. A graph
of nearest neighbours can leave one group in parts, so the parts then search again for their nearest row of another
part, until none is found. The forest cut at a distance gives the groups at that distance; condensing it gives the
hierarchy, whose most stable clusters are selected and described by their most persistent members.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.neighbors import prepared, search
from termloom.session import written

NEIGHBOURS = 4
LOCAL_ROWS = 150_000
FINISH_EDGES = 300_000
CLOSEST = 1e-12
EDGE = "a long, b long, w double"
LOCAL = "kind int, a long, b long, w double"


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _local(t: pa.Table) -> pa.Table:
    """Proven forest edges and contracted rest of one part of the graph (columns a, b, w, inside)."""
    a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
    inside = t.column("inside").to_numpy(zero_copy_only=False).astype(bool)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    guard = np.full(len(names), np.inf)
    np.minimum.at(guard, ia[~inside], w[~inside])
    np.minimum.at(guard, ib[~inside], w[~inside])
    parent = np.arange(len(names))
    take = np.flatnonzero(inside)
    order = take[np.lexsort((b[take], a[take], w[take]))]
    kept: list[int] = []
    rest: list[int] = []
    for e in order.tolist():
        u, v = _find(parent, int(ia[e])), _find(parent, int(ib[e]))
        if u == v:
            continue
        if w[e] <= guard[u] or w[e] <= guard[v]:
            u, v = min(u, v), max(u, v)
            parent[v] = u
            guard[u] = min(guard[u], guard[v])
            kept.append(e)
        else:
            # an edge that isn't proven may be needed: for what it joins it counts like an edge that leaves
            guard[u], guard[v] = min(guard[u], w[e]), min(guard[v], w[e])
            rest.append(e)
    root = np.array([_find(parent, i) for i in range(len(names))])
    moved = np.flatnonzero(root != np.arange(len(names)))
    kind = np.concatenate([np.zeros(len(kept)), np.ones(len(rest)), np.full(len(moved), 2)]).astype(np.int32)
    e = np.array(kept + rest, np.int64)
    return pa.table({"kind": kind, "a": np.concatenate([a[e], names[moved]]), "b": np.concatenate([b[e], names[root[moved]]]), "w": np.concatenate([w[e], np.zeros(len(moved))])})


def _jumped(parents: DataFrame) -> DataFrame:
    """(c, root): pointers c -> p followed to the end by doubling; only whether they still move comes to the driver."""
    now = written(parents.select("c", F.col("p").alias("root")), "p2-hooks")
    while True:
        up = now.select(F.col("c").alias("root"), F.col("root").alias("next"))
        nxt = now.join(up, "root", "left").select("c", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved"))
        now = written(nxt, "p2-hooks")
        moving = not now.where("moved").isEmpty()
        now = now.select("c", "root")
        if not moving:
            return now


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest edges, labels): minimum spanning forest of (a, b, w) and (node, root) of every node that an edge meets."""
    spark = edges.sparkSession
    forest = spark.createDataFrame([], EDGE)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    live = written(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b", "w"), "p2-live")
    while (n := live.count()) > 0:
        if n <= FINISH_EDGES:  # the last rounds of a graph this small go through one task, with the same forest
            done = live.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w", F.lit(True).alias("inside"), F.lit(0).alias("part"))
            done = written(done.groupBy("part").applyInArrow(_local, LOCAL), "p2-finish")
            kept = done.where("kind = 0").select(F.col("a").alias("ca"), F.col("b").alias("cb"))
            forest = forest.unionByName(live.join(kept, ["ca", "cb"]).select("a", "b", "w"))
            roots = done.where("kind = 2").select(F.col("a").alias("root"), F.col("b").alias("r"))
            labels = written(labels.join(roots, "root", "left").select("node", F.coalesce("r", "root").alias("root")), "p2-labels")
            break
        key = F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        ends = live.select(F.col("ca").alias("c"), F.struct(key.alias("k"), F.col("cb").alias("to")).alias("e"))
        ends = ends.unionByName(live.select(F.col("cb").alias("c"), F.struct(key.alias("k"), F.col("ca").alias("to")).alias("e")))
        picks = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.k.w", "e.k.x", "e.k.y", "e.to"), "p2-picks")
        forest = forest.unionByName(picks.select(F.col("x").alias("a"), F.col("y").alias("b"), "w").distinct())
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("its"))
        parents = picks.join(back, "to", "left").select("c", F.when((F.col("its") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        roots = _jumped(parents)
        labels = written(labels.join(roots.select(F.col("c").alias("root"), F.col("root").alias("r")), "root", "left").select("node", F.coalesce("r", "root").alias("root")), "p2-labels")
        live = live.join(roots.withColumnsRenamed({"c": "ca", "root": "ra"}), "ca").join(roots.withColumnsRenamed({"c": "cb", "root": "rb"}), "cb").where("ra <> rb")
        live = live.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("ca", "cb", "e.a", "e.b", "e.w")
        live = written(live, "p2-live")
    return forest, labels


def spanning_forest(edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest and (node, root) of (a, b, w) edges whose nodes have a (node, part): parts first, then Borůvka rounds."""
    pa_, pb = (parts.select(F.col("node").alias(x), F.col("part").alias(f"p{x}")) for x in "ab")
    e = edges.join(pa_, "a").join(pb, "b")
    same = F.col("pa") == F.col("pb")
    # an edge between parts goes to both, only as a guard
    sides = F.when(same, F.array("pa")).otherwise(F.array("pa", "pb"))
    e = written(e.withColumn("inside", same), "p2-edges")
    local = written(e.select("a", "b", "w", "inside", F.explode(sides).alias("part")).groupBy("part").applyInArrow(_local, LOCAL), "p2-local")
    proven = local.where("kind = 0").select("a", "b", "w")
    moved = local.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("root"))
    open_edges = local.where("kind = 1").select("a", "b", "w").unionByName(e.where("NOT inside").select("a", "b", "w"))
    ra, rb = (moved.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    contracted = open_edges.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", "w", F.coalesce("ra", "a").alias("ca"), F.coalesce("rb", "b").alias("cb"))
    # Borůvka works on the contracted nodes; its picks are translated back to the edges they stand for
    best = written(contracted.where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.min(F.struct("w", "a", "b")).alias("e")), "p2-open")
    more, labels = boruvka(best.select("a", "b", F.col("e.w").alias("w")))
    more = more.distinct().join(best.select("a", "b", "e"), ["a", "b"]).select("e.a", "e.b", "e.w")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    final = nodes.join(moved.withColumnRenamed("root", "m"), "node", "left").select("node", F.coalesce("m", "node").alias("mid"))
    final = final.join(labels.withColumnsRenamed({"node": "mid", "root": "r"}), "mid", "left").select("node", F.coalesce("r", "mid").alias("root"))
    return written(proven.unionByName(more), "p2-forest"), written(final, "p2-final")


def forest_of(df: DataFrame, key: str, cells: Sequence[str], radius: float, min_samples: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, forest, labels, copies): indexed rows of distinct vectors (idx, vec, leaf, n), their spanning forest within
    ``radius``, (node, root) of the rows it joins, and (idx, rep) of the rows that a node stands for besides itself."""
    rows, index, copies = prepared(df, key, cells, exact=True)
    k = max(NEIGHBOURS, min_samples)
    near = written(search(rows, index, k, radius), "p2-near")
    core = None
    if min_samples > 1:
        # the distance within which there are min_samples others, the copies of a row and of its neighbours included
        n = rows.select("idx", "n")
        met = near.select("idx", "nbr", "d2").join(n.withColumnsRenamed({"idx": "nbr", "n": "m"}), "nbr").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("d2", "m"))).alias("met"))  # at most k a row
        reached = F.filter("met", lambda x, i: F.col("n") - 1 + F.aggregate(F.slice("met", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["m"]) >= min_samples)
        core = n.join(met, "idx", "left").select(F.col("idx").alias("node"), F.when(F.col("n") > min_samples, 0.0).otherwise(F.coalesce(F.sqrt(F.get(reached, F.lit(0))["d2"]), F.lit(radius))).alias("core"))
        core = written(core, "p2-core")

    def weighed(found: DataFrame) -> DataFrame:
        e = found.groupBy(F.least("idx", "nbr").alias("a"), F.greatest("idx", "nbr").alias("b")).agg(F.sqrt(F.min("d2")).alias("w"))
        if core is None:
            return e
        for x in "ab":
            e = e.join(core.withColumnsRenamed({"node": x, "core": f"core_{x}"}), x, "left")
        return e.select("a", "b", F.greatest("w", F.coalesce("core_a", F.lit(radius)), F.coalesce("core_b", F.lit(radius))).alias("w"))

    sizes = rows.groupBy("leaf").count()
    cut = rows.join(F.broadcast(sizes), "leaf").select(F.col("idx").alias("node"), F.concat_ws("/", "leaf", F.pmod(F.xxhash64("idx"), F.ceil(F.col("count") / LOCAL_ROWS))).alias("part"))
    parts = written(cut, "p2-parts")
    edges = written(weighed(near), "p2-graph")
    # a row whose list isn't full knows all within the radius
    open_rows = written(near.groupBy("idx").count().where(F.col("count") >= k).select("idx"), "p2-full")
    while True:
        forest, labels = spanning_forest(edges, parts)
        grouped = rows.join(labels.select(F.col("node").alias("idx"), "root"), "idx", "left").withColumn("grp", F.coalesce("root", "idx"))
        # all others ask for their nearest row of another part, but for those of the one heaviest part: each link of
        # it that isn't known yet ends at a row of another part that asks
        top = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp").limit(1).select("grp", F.lit(True).alias("top"))
        asking = grouped.join(F.broadcast(top), "grp", "left").join(open_rows.withColumn("open", F.lit(True)), "idx", "left")
        asking = written(asking.select("idx", "vec", "leaf", "away", "grp", (F.col("open").isNotNull() & F.col("top").isNull()).alias("ask")), "p2-asking")
        links = written(search(asking, index, 1, radius), "p2-links")
        if links.isEmpty():
            return rows, forest, labels, copies
        # parts only grow, so a row that found none needs not ask again
        settled = asking.where("ask").select("idx").join(links.select("idx"), "idx", "left_anti")
        open_rows = written(open_rows.join(settled, "idx", "left_anti"), "p2-full")
        # the forest of all edges is the forest of the forest so far and the new ones
        edges = written(forest.unionByName(weighed(links)).groupBy("a", "b").agg(F.min("w").alias("w")), "p2-graph")


def groups_at(df: DataFrame, key: str, cells: Sequence[str], distance: float) -> DataFrame:
    """(idx_a, idx_b): every row but the first of its group, with the smallest id of the group, for groups of rows
    that the forest joins at no more than ``distance``. Groups of one give no row.

    Distinct keys count; rows of zeros, null keys and rows with null cells belong to no group. Equal vectors join at
    distance 0. Empty tables give no rows.
    """
    _, _, labels, copies = forest_of(df, key, cells, distance)
    every = with_copies(labels, copies)
    least = every.groupBy("root").agg(F.min("node").alias("idx_a"))
    return every.join(least, "root").where("node <> idx_a").select("idx_a", F.col("node").alias("idx_b"))


def with_copies(labels: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, root) with the copies beside the rows they equal."""
    if copies.isEmpty():
        return labels
    roots = labels.withColumnsRenamed({"node": "rep"})
    heads = copies.select("rep").distinct().join(roots.select("rep"), "rep", "left_anti")
    more = copies.join(roots, "rep", "left").select(F.col("idx").alias("node"), F.coalesce("root", "rep").alias("root"))
    return labels.unionByName(more).unionByName(heads.select(F.col("rep").alias("node"), F.col("rep").alias("root")))


MEMBERS = "root long, node long, cluster long, persistence double, stability double"


def condensed(a: np.ndarray, b: np.ndarray, w: np.ndarray, weight: dict[int, int], least: int) -> list[tuple[int, int, float, float]]:
    """(node, cluster, persistence, stability) of the stable clusters of one tree; noise has no row.

    The tree is merged from its lightest edge up. A cluster is born where two sides of at least ``least`` rows meet
    and its stability is the sum over its rows of 1/d where they leave minus 1/d where it is born.
    """
    order = np.lexsort((b, a, w))
    names = np.unique(np.concatenate([a, b]))
    at = {int(n): i for i, n in enumerate(names)}
    n = len(names)
    parent = np.arange(2 * n)
    size = np.zeros(2 * n, np.int64)
    size[:n] = [weight.get(int(x), 1) for x in names]
    left, right, level = np.full(2 * n, -1), np.full(2 * n, -1), np.zeros(2 * n)
    top = np.arange(n)
    union = np.arange(n)
    nxt = n
    for e in order.tolist():
        u, v = _find(union, at[int(a[e])]), _find(union, at[int(b[e])])
        if u == v:
            continue
        left[nxt], right[nxt], level[nxt] = top[u], top[v], w[e]
        size[nxt] = size[top[u]] + size[top[v]]
        parent[top[u]] = parent[top[v]] = nxt
        union[v] = u
        top[u] = nxt
        nxt += 1
    root = nxt - 1
    leaving = {i: 0.0 for i in range(n)}
    clusters: list[dict] = [{"birth": 0.0, "rows": [], "children": [], "stability": 0.0}]
    todo = [(root, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            clusters[c]["rows"].append(node)
            if size[node] > 1:  # equal rows, which leave at the least distance
                leaving[node] = 1.0 / CLOSEST
                clusters[c]["stability"] += (1.0 / CLOSEST - clusters[c]["birth"]) * size[node]
            continue
        inv = 1.0 / max(level[node], CLOSEST)
        sides = [left[node], right[node]]
        big = [s for s in sides if size[s] >= least]
        if len(big) == 2:
            clusters[c]["stability"] += (inv - clusters[c]["birth"]) * size[node]
            for s in big:
                clusters.append({"birth": inv, "rows": [], "children": [], "stability": 0.0})
                clusters[c]["children"].append(len(clusters) - 1)
                todo.append((s, len(clusters) - 1))
        else:
            for s in sides:
                if size[s] >= least:
                    todo.append((s, c))
                else:  # falls out of the cluster here
                    stack = [s]
                    while stack:
                        x = stack.pop()
                        if x < n:
                            leaving[x] = inv
                            clusters[c]["rows"].append(x)
                            clusters[c]["stability"] += (inv - clusters[c]["birth"]) * size[x]
                        else:
                            stack += [left[x], right[x]]
    best = [0.0] * len(clusters)
    chosen = [True] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(best[k] for k in clusters[c]["children"])
        if clusters[c]["children"] and below > clusters[c]["stability"]:
            chosen[c], best[c] = False, below
        else:
            best[c] = clusters[c]["stability"]
    out = []
    todo2 = [(0, -1)]
    while todo2:
        c, own = todo2.pop()
        if own < 0 and chosen[c]:
            own = c
        for r in clusters[c]["rows"]:
            if own >= 0:
                out.append((int(names[r]), own, leaving[r], clusters[own]["stability"]))
        todo2 += [(k, own) for k in clusters[c]["children"]]
    return out


SLICED = "root long, slice int, x long, y long, w double, a long, b long, wa long, wb long, la int, lb int"
PIECES = "root long, slice int, frag long, piece int, parent int, birth double, gain double, n long, node long, last int, leaving double"
CHOSEN = "root long, slice int, frag long, piece int, cluster long, stability double"


def _contracted(edges: DataFrame, lo: int, hi: int) -> list[DataFrame]:
    """Edges (SLICED) of the slices lo..hi-1, each slice with what all lighter slices join contracted to one node.

    A node is named by its least row; it comes with its rows and the last slice in which it grew (-1: a single row).
    """
    if hi - lo <= 1:
        return [edges]
    mid = (lo + hi) // 2
    low, high = edges.where(F.col("slice") < mid), edges.where(F.col("slice") >= mid)
    _, labels = boruvka(low.select("a", "b", "w"))
    nodes = low.select(F.col("a").alias("node"), F.col("wa").alias("n"), "slice").unionByName(low.select(F.col("b").alias("node"), F.col("wb").alias("n"), "slice"))
    nodes = nodes.groupBy("node").agg(F.max("n").alias("n"), F.max("slice").alias("last")).join(labels, "node")
    named = nodes.groupBy("root").agg(F.min("node").alias("name"), F.sum("n").alias("n"), F.max("last").alias("last"))
    new = written(labels.join(named, "root").select("node", "name", "n", "last"), "p2-contracted")
    for x in "ab":
        high = high.join(new.withColumnsRenamed({"node": x, "name": f"n{x}"}), x, "left")
        high = high.withColumns({x: F.coalesce(f"n{x}", x), f"w{x}": F.coalesce("n", f"w{x}"), f"l{x}": F.coalesce("last", f"l{x}")}).drop(f"n{x}", "n", "last")
    return _contracted(low, lo, mid) + _contracted(written(high.select(*edges.columns), "p2-slices"), mid, hi)


def _pieces(f: pd.DataFrame, least: int) -> pd.DataFrame:
    """The condensed hierarchy of one slice of a tree, in pieces (PIECES).

    Rows with a null node are pieces of clusters: piece 0 of a fragment goes on from the slice above, and its gain
    counts from its own birth, the fragment's heaviest edge. The other rows are the leaves: where they fall out of
    a piece (``leaving``), or go on in a fragment of a lighter slice (``leaving`` null). Fragments of fewer than
    ``least`` rows have piece -1 only.
    """
    f = f.sort_values(["w", "x", "y"])
    names, at = np.unique(np.concatenate([f["a"], f["b"]]), return_inverse=True)
    n = len(names)
    size, low = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    last = np.full(n, -1)
    size[at], last[at], low[:n] = np.concatenate([f["wa"], f["wb"]]), np.concatenate([f["la"], f["lb"]]), names
    left, right, level = np.full(2 * n, -1), np.full(2 * n, -1), np.zeros(2 * n)
    top, union, nxt = np.arange(n), np.arange(n), n
    for u, v, d in zip(at[: len(f)].tolist(), at[len(f) :].tolist(), f["w"].tolist()):
        u, v = _find(union, u), _find(union, v)
        l, r = top[u], top[v]
        left[nxt], right[nxt], level[nxt] = l, r, d
        size[nxt], low[nxt] = size[l] + size[r], min(low[l], low[r])
        union[v] = u
        top[u] = nxt
        nxt += 1
    out: list[tuple] = []
    for tree in sorted({int(top[_find(union, i)]) for i in range(n)}):
        frag = int(low[tree])
        inv = 1.0 / max(level[tree], CLOSEST)
        held = [[-1, inv, 0.0, 0]]  # parent, birth, gain, rows
        todo = [(tree, 0 if size[tree] >= least else -1, 0.0 if size[tree] < least else None)]
        while todo:
            node, c, leaving = todo.pop()
            if node < n:
                if leaving is None and last[node] < 0:
                    leaving = 0.0
                    if size[node] > 1 and c >= 0:  # equal rows, which leave at the least distance
                        leaving = 1.0 / CLOSEST
                        held[c][2] += (leaving - held[c][1]) * size[node]
                        held[c][3] += int(size[node])
                out.append((frag, c, None, None, None, None, int(names[node]), int(last[node]), leaving))
                continue
            sides = [int(left[node]), int(right[node])]
            if leaving is not None:
                todo += [(s, c, leaving) for s in sides]
                continue
            inv = 1.0 / max(level[node], CLOSEST)
            if all(size[s] >= least for s in sides):
                held[c][2] += (inv - held[c][1]) * size[node]
                held[c][3] += int(size[node])
                for s in sides:
                    held.append([c, inv, 0.0, 0])
                    todo.append((s, len(held) - 1, None))
                continue
            for s in sides:
                if size[s] < least:  # falls out of the cluster here
                    held[c][2] += (inv - held[c][1]) * size[s]
                    held[c][3] += int(size[s])
                todo.append((s, c, None if size[s] >= least else inv))
        if size[tree] >= least:
            out += [(frag, i, *h, None, None, None) for i, h in enumerate(held)]
    got = pd.DataFrame(out, columns=["frag", "piece", "parent", "birth", "gain", "n", "node", "last", "leaving"]).astype({"parent": "Int64", "n": "Int64", "node": "Int64", "last": "Int64"})
    got.insert(0, "root", f["root"].iloc[0])
    got.insert(1, "slice", f["slice"].iloc[0])
    return got


def _selected(p: pd.DataFrame) -> pd.DataFrame:
    """The stable cluster (CHOSEN) each piece of one tree belongs to; pieces of noise have no row."""
    ends = p[p["node"].notna()]
    goes_on = {(s, g, c): (t, x) for s, g, c, t, x in zip(*(ends[k].tolist() for k in ("slice", "frag", "piece", "last", "node")))}
    # from the heaviest slice down, so that what a piece comes from is met before it
    p = p[p["node"].isna()].sort_values(["slice", "frag", "piece"], ascending=[False, True, True])
    cluster: dict[tuple, int] = {}
    birth, stability, children = [], [], []
    for s, g, c, parent, born, gain, n in zip(*(p[k].tolist() for k in ("slice", "frag", "piece", "parent", "birth", "gain", "n"))):
        if (s, g, c) not in cluster:
            cluster[s, g, c] = len(birth)
            if c:
                children[cluster[s, g, int(parent)]].append(len(birth))
            birth.append(born if c else 0.0)
            stability.append(0.0)
            children.append([])
        own = cluster[s, g, c]
        stability[own] += gain + (born - birth[own]) * n
        if (s, g, c) in goes_on:
            cluster[(*goes_on[s, g, c], 0)] = own
    best, chosen, own = list(stability), [True] * len(birth), [-1] * len(birth)
    for c in range(len(birth) - 1, -1, -1):
        below = sum(best[k] for k in children[c])
        if children[c] and below > stability[c]:
            chosen[c], best[c] = False, below
    for c in range(len(birth)):
        if own[c] < 0 and chosen[c]:
            own[c] = c
        for k in children[c]:
            own[k] = own[c]
    root = p["root"].iloc[0] if len(p) else 0
    return pd.DataFrame([(root, *k, own[c], stability[own[c]]) for k, c in cluster.items() if own[c] >= 0], columns=["root", "slice", "frag", "piece", "cluster", "stability"])


def _condensed_hot(edges: DataFrame, least: int) -> DataFrame:
    """MEMBERS of trees of any size, as :func:`condensed` gives them. The edges (root, a, b, w, na, nb; na and nb are
    the rows that a and b stand for) are cut into slices
    by weight (ties by a and b, as there); each slice is condensed in a task of its own, and one task a tree joins
    the pieces of its clusters."""
    spark = edges.sparkSession
    count = -(-edges.count() // LOCAL_ROWS) + 1
    cut = edges.repartitionByRange(count, "root", "w", "a", "b").withColumn("slice", F.spark_partition_id())
    single = F.lit(-1)
    cut = cut.select("root", "slice", F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b", F.col("na").alias("wa"), F.col("nb").alias("wb"), single.alias("la"), single.alias("lb"))
    every = spark.createDataFrame([], SLICED)
    for part in _contracted(written(cut, "p2-slices"), 0, count):
        every = every.unionByName(part)
    made = written(every.groupBy("root", "slice").applyInPandas(lambda f: _pieces(f, least), PIECES), "p2-pieces")
    own = made.where("node IS NULL OR leaving IS NULL").groupBy("root").applyInPandas(_selected, CHOSEN)
    leaves = made.where("node IS NOT NULL AND leaving IS NOT NULL")
    rows = leaves.where("last < 0").select("root", "slice", "frag", "piece", "node", "leaving")
    up = leaves.where("last >= 0").select("root", F.col("last").alias("slice"), F.col("node").alias("frag"), F.col("slice").alias("s"), F.col("frag").alias("g"), F.col("piece").alias("p"), F.col("leaving").alias("l"))
    out = rows.where("piece >= 0")
    rows = rows.where("piece < 0")
    while not rows.isEmpty():  # fragments under ``least`` rows fall out with what they are part of: fewer than ``least`` turns
        rows = rows.select("root", "slice", "frag", "node").join(up, ["root", "slice", "frag"])
        rows = written(rows.select("root", F.col("s").alias("slice"), F.col("g").alias("frag"), F.col("p").alias("piece"), "node", F.col("l").alias("leaving")), "p2-fallen")
        out = out.unionByName(rows.where("piece >= 0"))
        rows = rows.where("piece < 0")
    return out.join(own, ["root", "slice", "frag", "piece"]).select("root", "node", "cluster", F.col("leaving").alias("persistence"), "stability")


def clusters(df: DataFrame, key: str, cells: Sequence[str], radius: float, min_samples: int = 3, min_cluster: int = 5, exemplars: int = 3) -> DataFrame:
    """(cluster, size, exemplars): the stable clusters, with their most persistent members (ties to the smaller id).

    A tree of more than LOCAL_ROWS rows is condensed by slices of its edges, each in a task of its own, with the same
    result. Trees with fewer than ``min_cluster`` rows are noise.
    """
    rows, forest, labels, copies = forest_of(df, key, cells, radius, min_samples)
    n = rows.select("idx", "n")
    labels = labels.join(n.withColumnRenamed("idx", "node"), "node")
    edges = forest.join(labels.select(F.col("node").alias("a"), "root", F.col("n").alias("na")), "a").join(n.withColumnsRenamed({"idx": "b", "n": "nb"}), "b")
    edges = written(edges.select("root", "a", "b", "w", "na", "nb"), "p2-tree")
    sizes = written(labels.groupBy("root").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nodes")), "p2-sizes")
    hot = written(edges.join(sizes.where(F.col("nodes") > LOCAL_ROWS).select("root"), "root"), "p2-hot")
    small = edges.join(sizes.where((F.col("nodes") <= LOCAL_ROWS) & (F.col("n") >= min_cluster)).select("root"), "root")

    def tree(f: pd.DataFrame) -> pd.DataFrame:
        weight = {**dict(zip(f["a"].tolist(), f["na"].tolist())), **dict(zip(f["b"].tolist(), f["nb"].tolist()))}
        found = condensed(f["a"].to_numpy(), f["b"].to_numpy(), f["w"].to_numpy(), weight, min_cluster)
        return pd.DataFrame([(f["root"].iloc[0], *r) for r in found], columns=["root", "node", "cluster", "persistence", "stability"])

    found = small.groupBy("root").applyInPandas(tree, MEMBERS)
    if not hot.isEmpty():
        found = found.unionByName(_condensed_hot(hot, min_cluster))
    if not copies.isEmpty():
        alone = n.where(F.col("n") >= min_cluster).join(labels.select(F.col("node").alias("idx")), "idx", "left_anti")
        lasting = F.lit(1.0 / CLOSEST)
        alone = alone.select(F.col("idx").alias("root"), F.col("idx").alias("node"), F.lit(0).cast("long").alias("cluster"), lasting.alias("persistence"), (lasting * F.col("n")).alias("stability"))
        found = written(found.unionByName(alone), "p2-found")
        found = found.unionByName(copies.join(found.withColumnRenamed("node", "rep"), "rep").select("root", F.col("idx").alias("node"), "cluster", "persistence", "stability"))
    found = written(found.withColumnRenamed("node", "idx"), "p2-members")
    keys = ["root", "cluster"]
    first = Window.partitionBy(*keys, F.pmod(F.xxhash64("idx"), F.lit(64))).orderBy(F.desc("persistence"), "idx")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= exemplars)
    typical = top.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("persistence")).alias("p"), "idx"))), 1, exemplars).alias("t"))
    size = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("cluster_id"), F.first("stability").alias("stability"))
    return size.join(typical, keys).select("cluster_id", "size", "stability", F.col("t.idx").alias("exemplars"))
