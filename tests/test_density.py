"""Neighbour join, spanning tree and density clusters against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import condense, density, tree
from tessera.operators.neighbors import knn
import plain_density as plain


def cloud(seed, far=True):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(60, 2)), rng.normal(size=(50, 2)) * 0.3 + 6, rng.normal(size=(30, 2)) * 0.1 + [6, 8], rng.uniform(-9, 12, (30, 2))]
    x = np.concatenate(parts).round(4)
    if far:
        x[0] = [5e6, -5e6]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, emb_x double, emb_y double")


def test_curve_visits_every_cell_next_to_the_last():
    for d, bits in ((1, 5), (2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        key = tree.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize(("metric", "k", "own"), [("euclidean", 3, True), ("manhattan", 1, False), ("euclidean", 200, True)])
def test_neighbours_equal_a_scan(spark, metric, k, own):
    rng = np.random.default_rng(k)
    x = np.concatenate([cloud(3), np.zeros((40, 2)), [[-0.0, 0.0]]]).round(1)  # ties, and many points at one place
    part = rng.integers(0, 2, len(x))
    rows = [(i, int(g), float(a), float(b)) for i, (g, (a, b)) in enumerate(zip(part, x))]
    probes = spark.createDataFrame([*rows, (999, 0, None, 1.0), (998, 0, float("nan"), 1.0)], "id long, g long, x double, y double")
    cands = probes if own else probes.withColumn("id", F.col("id") + 1000)
    got = knn(probes, cands, k, ("x", "y"), "id", ("g",), metric, exclude_self=own, capacity=16)
    got = sorted((r["probe_id"], r["rank"], r["match_id"], r["dist"]) for r in got.collect())
    want = []
    for i, g, a, b in rows:
        near = []
        for j, h, c, d in rows:
            if g == h and not (own and i == j):
                near.append((abs(a - c) + abs(b - d) if metric == "manhattan" else (a - c) ** 2 + (b - d) ** 2, j if own else j + 1000))
        want += [(i, r + 1, j, w if metric == "manhattan" else w**0.5) for r, (w, j) in enumerate(sorted(near)[:k])]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])


def test_neighbours_of_text_ids_repeated_ids_and_nothing(spark):
    rows = [("b", 0.0, 0.0), ("a", 0.0, 0.0), ("b", 5.0, 0.0), ("c", 1.0, 0.0)]
    points = spark.createDataFrame(rows, "id string, x double, y double")
    got = sorted((r["probe_id"], r["match_id"], r["dist"]) for r in knn(points, points, 1, ("x", "y"), exclude_self=True).collect())
    assert got == [("a", "b", 0.0), ("b", "a", 0.0), ("b", "c", 4.0), ("c", "a", 1.0)]
    assert knn(points.limit(0), points, 1, ("x", "y")).count() == 0
    assert knn(points, points.limit(0), 1, ("x", "y")).count() == 0


def test_one_far_point_changes_no_work(spark, monkeypatch):
    """Rows met per point outside its own leaf: with a far point no more than without one."""
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 2))
    met = []
    real = tree.dealt

    def counted(pairs, keys, weight, first):
        met.append(pairs.count())
        return real(pairs, keys, weight, first)

    monkeypatch.setattr(tree, "dealt", counted)
    for far in (False, True):
        if far:
            x[0] = [1e9, 1e9]
        points = frame(spark, x)
        knn(points, points, 3, ("emb_x", "emb_y"), exclude_self=True, capacity=64).count()
    assert met[1] <= 1.2 * met[0] and met[1] < 4000


@pytest.mark.parametrize("metric", ["manhattan"])
def test_spanning_tree_equals_kruskal(spark, metric):
    x = cloud(5)
    got = sorted((r["u"], r["v"]) for r in density.mst_edges(frame(spark, x), 3, metric=metric, capacity=16).collect())
    assert got == sorted(e[:2] for e in plain.spanning_tree(plain.weights(x, 3, metric)))


@pytest.fixture(scope="module")
def trees(spark):
    """Spanning trees of plain NumPy as tables: the cluster tests need no search."""
    out = {}
    for seed, metric in ((1, "euclidean"), (2, "manhattan"), (4, "cosine")):
        x = cloud(seed, far=seed == 1)
        edges = plain.spanning_tree(plain.weights(x, 2, metric))
        out[metric] = x, spark.createDataFrame(edges, "u long, v long, w double").cache()
    return out


@pytest.mark.parametrize(("metric", "m", "method", "epsilon", "limit"), [
    ("euclidean", 8, "eom", 0.0, 10**6), ("euclidean", 5, "eom", 0.6, 60), ("euclidean", 3, "leaf", 0.4, 10**6),
    ("manhattan", 6, "eom", 0.0, 10**6), ("cosine", 6, "eom", 0.0, 10**6), ("euclidean", 400, "eom", 0.0, 10**6)])
def test_clusters_equal_plain(spark, trees, metric, m, method, epsilon, limit):
    x, edges = trees[metric]
    points = frame(spark, x)
    condensed = density.condensed_tree(edges, points, m, limit)
    got = density.label_points(condensed, density.select_clusters(condensed, method, epsilon), points)
    want = plain.labels(x, m, 2, method, epsilon, metric)
    assert [r["cluster"] for r in got.orderBy("id").collect()] == want
    clusters, _ = plain.condensed(len(x), plain.spanning_tree(plain.weights(x, 2, metric)), m)
    if m <= len(x):
        sizes = sorted((r["size"], round(r["stability"], 6)) for r in condensed.nodes.collect())
        assert sizes == sorted((s, round(lam - s * b, 6)) for _, b, s, lam in clusters.values())


def test_whole_clustering(spark):
    x = cloud(7)
    res = density.hdbscan(frame(spark, x), min_cluster_size=8, min_samples=3, method="eom", epsilon=0.0)
    assert sorted((r["u"], r["v"]) for r in res.tree.collect()) == sorted(e[:2] for e in plain.spanning_tree(plain.weights(x, 3, "euclidean")))
    assert [r["cluster"] for r in res.labels.orderBy("id").collect()] == plain.labels(x, 8, 3, "eom", 0.0, "euclidean")
    assert -1.0 <= res.relative_validity <= 1.0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_cells_give_most_of_the_spanning_tree(spark, monkeypatch, metric):
    """Points with ties and copies: the cells' edges belong to the tree, and few rounds remain."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 2)), rng.integers(-6, 6, size=(250, 2)) / 4, np.tile([[0.3, 0.7]], (80, 1))])
    left = []
    real = density._best_foreign_edges

    def counted(cur, *args):
        left.append(cur.select("comp").distinct().count())
        return real(cur, *args)

    monkeypatch.setattr(density, "_best_foreign_edges", counted)
    got = sorted((r["u"], r["v"]) for r in density.mst_edges(frame(spark, x), 3, metric=metric, capacity=16).collect())
    assert got == sorted(e[:2] for e in plain.spanning_tree(plain.weights(x, 3, metric)))
    assert left[0] < len(x) / 2  # the rest are copies on the side of a cell, and what lies near one


def test_repeated_rows_end(spark):
    """Rows that come twice: the tree is that of the points with their copies as neighbours, and the search ends."""
    x = cloud(5)[:60]
    once = frame(spark, x)
    twice = once.unionByName(once.where("id < 20"))
    edges = density.mst_edges(twice, 1, capacity=16)
    assert len(edges.collect()) == len(x) - 1
    condensed = density.condensed_tree(edges, twice, 5)
    assert density.label_points(condensed, density.select_clusters(condensed), twice).count() == len(x) + 20


def test_a_band_tries_no_groups_twice(spark, monkeypatch):
    """The first band of a long chain is found with one search of components."""
    tried = []
    real = condense.connected_components
    monkeypatch.setattr(condense, "connected_components", lambda *a: tried.append(1) or real(*a))
    n = 400
    order = np.random.default_rng(1).permutation(n - 1)
    edges = spark.createDataFrame([(i, i + 1, 1.0 + float(order[i])) for i in range(n - 1)], "u long, v long, w double")
    ranked = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").cast("long").alias("rank"))

    def grouped(band):
        return band.join(condense._components(band.selectExpr("explode(array(a, b)) v").distinct(), band.select("a", "b")).withColumnRenamed("v", "a"), "a")

    dealt = condense._band(ranked, 40, grouped)
    assert dealt.groupBy("grp").count().agg({"count": "max"}).first()[0] <= 40
    assert len(tried) == 1
