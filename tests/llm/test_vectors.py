import itertools

import numpy as np
import pytest

from termloom.llm import clusters, neighbors, varied

WIDTH = 30
CELLS = [f"col_{k}" for k in range(WIDTH)]
SCHEMA = "idx long, vec string, " + ", ".join(f"{c} float" for c in CELLS)


def blobs(seed=0, sizes=(400, 90, 30, 8, 3, 1, 1)):
    rng = np.random.default_rng(seed)
    parts = [rng.random(WIDTH) + 0.01 * rng.standard_normal((n, WIDTH)) / np.sqrt(WIDTH) * 3 for n in sizes]
    x = np.concatenate(parts).astype(np.float32)
    return x, np.repeat(np.arange(len(sizes)), sizes)


def frame(spark, x, ids=None, extra=()):
    ids = ids if ids is not None else range(len(x))
    rows = [(int(i), "v", *map(float, r)) for i, r in zip(ids, x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def distances(x):
    return np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2))


def exact(x, k, radius):
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    return {(i, j) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] if d[i, j] <= radius}


ODD = [(None, "v", *[0.5] * WIDTH), (10_000, "v", *[0.0] * WIDTH), (10_001, "v", *[0.1] * (WIDTH - 1), None)]


@pytest.mark.parametrize("small", [False, True])
def test_nearest_against_brute_force(spark, monkeypatch, small):
    if small:  # many lists and several blocks a list
        monkeypatch.setattr(neighbors, "LIST_ROWS", 60)
        monkeypatch.setattr(neighbors, "BLOCK_ROWS", 40)
    x, _ = blobs()
    df = frame(spark, x, extra=ODD)
    df = df.unionByName(df.limit(50))
    got = {(r.idx, r.nbr) for r in neighbors.nearest(df, "idx", CELLS, 3, 0.1).collect()}
    want = exact(x, 3, 0.1)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    pairs = {tuple(r) for r in neighbors.neighbour_pairs(df, "idx", CELLS, 3, 0.1).collect()}
    assert pairs == {tuple(sorted(p)) for p in got}


def test_copies_tie_to_the_smaller_id(spark):
    x = np.full((40, WIDTH), 0.25, np.float32)
    got = {(r.idx, r.nbr) for r in neighbors.nearest(frame(spark, x), "idx", CELLS, 3, 0.1).collect()}
    assert got == exact(x, 3, 0.1)


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_few_rows(spark, rows):
    df = frame(spark, blobs()[0][:rows], extra=ODD)
    assert neighbors.nearest(df, "idx", CELLS, 3, 0.1).count() == (2 if rows == 2 else 0)
    assert clusters.groups_at(df, "idx", CELLS, 0.1).count() == max(0, rows - 1)
    assert varied.varied_subsets(df, "idx", CELLS, (5,)).count() == rows


def forest_weight(edges, n):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0.0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    return total, [find(i) for i in range(n)]


@pytest.mark.parametrize("finish", [0, 300_000])
def test_spanning_forest_is_minimal(spark, monkeypatch, finish):
    monkeypatch.setattr(clusters, "FINISH_EDGES", finish)
    rng = np.random.default_rng(3)
    edges = {}
    for _ in range(500):
        a, b = sorted(map(int, rng.integers(0, 120, 2)))
        if a != b:
            edges[a, b] = float(rng.integers(1, 30)) / 10
    edges = [(a, b, w) for (a, b), w in edges.items() if (a < 60) == (b < 60)]
    total, root = forest_weight(edges, 120)
    df = spark.createDataFrame(edges, "a long, b long, w double")
    parts = spark.createDataFrame([(i, str(i % 3)) for i in range(120)], "node long, part string")
    forest, labels = clusters.spanning_forest(df, parts)
    rows = forest.collect()
    assert sum(r.w for r in rows) == pytest.approx(total)
    got = {r.node: r.root for r in labels.collect()}
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a, b in itertools.combinations(got, 2))


def test_groups_and_clusters(spark, monkeypatch):
    x, label = blobs(1)
    df = frame(spark, x, extra=ODD)
    got = {r.idx_b: r.idx_a for r in clusters.groups_at(df, "idx", CELLS, 0.1).collect()}
    first = [int(np.flatnonzero(label == label[i])[0]) for i in range(len(x))]
    assert got == {i: first[i] for i in range(len(x)) if first[i] != i}
    for rows in (150_000, 100):  # the second contracts the largest tree
        monkeypatch.setattr(clusters, "LOCAL_ROWS", rows)
        found = clusters.clusters(df, "idx", CELLS, 0.1, min_samples=2, min_cluster=5).collect()
        assert found and all(len({int(label[e]) for e in r.exemplars}) == 1 for r in found)
        assert {int(label[r.exemplars[0]]) for r in found} >= {1, 2, 3} and sum(r["size"] for r in found) <= len(x)


def test_condensed_tree_splits_two_dense_parts():
    a = [0, 1, 2, 3, 5, 6, 7, 8, 4]
    b = [1, 2, 3, 4, 6, 7, 8, 9, 5]
    w = [0.01] * 4 + [0.02] * 4 + [1.0]
    rows = clusters.condensed(np.array(a), np.array(b), np.array(w), {}, 3)
    by = {}
    for node, c, _, _ in rows:
        by.setdefault(c, set()).add(node)
    assert sorted(map(sorted, by.values())) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_quotas():
    for sizes, slots in (([100, 25, 1], 3), ([100, 25, 1], 30), ([5, 5], 100), ([1] * 10, 4), ([10_000, 1, 1], 50)):
        q = varied.quotas(np.array(sizes), slots)
        assert q.sum() == min(slots, sum(sizes)) and (q <= sizes).all()
    assert varied.quotas(np.array([100, 25, 1]), 16).tolist() == sorted(varied.quotas(np.array([100, 25, 1]), 16).tolist(), reverse=True)


def test_varied_subset_meets_every_kind(spark):
    x, label = blobs(4)
    df = frame(spark, x, extra=ODD)
    df = df.unionByName(df)
    among = spark.createDataFrame([(i,) for i in range(len(x)) if i != 5], "idx long")
    rows = varied.varied_subsets(df, "idx", CELLS, (7, 40, 10_000), among).collect()
    for size in (7, 40, 10_000):
        own = [r.idx for r in rows if r["size"] == size]
        assert len(own) == len(set(own)) == min(size, len(x) - 1) and 5 not in own
        assert len({int(label[i]) for i in own}) == 7


@pytest.mark.parametrize("kind", ["copies", "ties", "random"])
def test_hot_tree_equals_the_whole_one(spark, monkeypatch, kind):
    monkeypatch.setattr(clusters, "LOCAL_ROWS", 40)
    rng = np.random.default_rng(5)
    n = 300
    a = np.array([int(rng.integers(max(0, i - 30), i)) for i in range(1, n)])
    b = np.arange(1, n)
    w = {"copies": np.zeros(n - 1), "ties": rng.integers(0, 4, n - 1) / 10, "random": rng.random(n - 1)}[kind]
    edges = spark.createDataFrame([(1, int(x), int(y), float(z)) for x, y, z in zip(a, b, w)], "root long, a long, b long, w double").selectExpr("*", "1L AS na", "1L AS nb")

    def groups(rows):
        by = {}
        for node, c, persistence, stability in rows:
            by.setdefault(c, []).append((node, float(f"{persistence:.9g}"), float(f"{stability:.9g}")))
        return sorted(sorted(g) for g in by.values())

    got = [(r.node, r.cluster, r.persistence, r.stability) for r in clusters._condensed_hot(edges, 5).collect()]
    assert got and groups(got) == groups(clusters.condensed(a, b, w, {}, 5))


def test_copies_beyond_one_task_are_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LOCAL_ROWS", 20)
    rows = clusters.clusters(frame(spark, np.full((60, WIDTH), 0.25, np.float32)), "idx", CELLS, 0.1).collect()
    assert [(r.cluster_id, r["size"]) for r in rows] == [(0, 60)]


def test_parts_of_two_lists_meet_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LIST_ROWS", 100)
    at = np.concatenate([np.arange(200) * 0.002, 0.48 + np.arange(190) * 0.002])
    x = np.full((len(at), WIDTH), 0.5, np.float32)
    x[:, 0] = at
    ids = np.arange(len(at))
    ids[[0, 100]], ids[[200, 300]] = ids[[100, 0]], ids[[300, 200]]  # the least id of each line is in its middle
    got = clusters.groups_at(frame(spark, x, ids), "idx", CELLS, 0.1).collect()
    assert {(r.idx_a, r.idx_b) for r in got} == {(0, i) for i in range(1, len(at))}


def test_copies_are_folded(spark, monkeypatch):
    """A vector that half of the rows share neither stops the lists from being split nor changes any result."""
    monkeypatch.setattr(neighbors, "LIST_ROWS", 60)
    x, label = blobs(6, (200, 60, 20, 3, 1))
    x = np.concatenate([x, np.repeat(x[[5]], 150, 0), np.repeat(x[[283]], 9, 0)])
    ids = np.random.default_rng(1).permutation(len(x))
    df = frame(spark, x, ids)
    order = np.argsort(ids)
    want = exact(x[order], 3, 0.1)
    got = {(r.idx, r.nbr) for r in neighbors.nearest(df, "idx", CELLS, 3, 0.1).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    rows, index, copies = neighbors.prepared(df, "idx", CELLS)
    assert copies.count() == 159 and len(index.centroids) > 3
    d = distances(x[order]) <= 0.1
    first = d.argmax(1)
    groups = {r.idx_b: r.idx_a for r in clusters.groups_at(df, "idx", CELLS, 0.1).collect()}
    assert groups == {i: int(first[i]) for i in range(len(x)) if first[i] != i}


def test_lists_are_made_beside_equal_rows():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros((3000, 8)), rng.random((3000, 8))])
    assert len(neighbors.bisected(x, 100)) == 100


@pytest.mark.parametrize("weights", [{}, {3: 7, 40: 2, 90: 30}])
def test_copies_in_a_tree_count_like_rows(weights):
    rng = np.random.default_rng(8)
    n = 120
    a, b, w = np.array([int(rng.integers(0, i)) for i in range(1, n)]), np.arange(1, n), 0.01 + rng.random(n - 1)
    more = [(k, 1000 * k + j) for k, m in weights.items() for j in range(1, m)]
    a2 = np.concatenate([a, [p[0] for p in more]]).astype(np.int64)
    b2 = np.concatenate([b, [p[1] for p in more]]).astype(np.int64)
    w2 = np.concatenate([w, np.zeros(len(more))])

    def groups(rows):
        by = {}
        for node, c, persistence, stability in rows:
            if node < n:
                by.setdefault(c, []).append((node, float(f"{persistence:.9g}"), float(f"{stability:.6g}")))
        return sorted(sorted(g) for g in by.values())

    assert groups(clusters.condensed(a, b, w, weights, 5)) == groups(clusters.condensed(a2, b2, w2, {}, 5))
