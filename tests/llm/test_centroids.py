"""op11: exact k-means rounds over a vantage-point tree, against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.centroids import assign, build_tree, centroid_clusters, with_inertia


def brute(rows, k, rounds, width, scale=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)
    centres = [p for _, p in named[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(nearest(p)[1], []).append(p)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    return [(i, nearest(p)[1], nearest(p)[0]) for i, p in kept], centres


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16, 40])
def test_tree_search_equals_a_scan_with_ties(k):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-2, 3, (k, 3))  # a coarse grid: many equal centroids and equal distances
    points = rng.integers(-3, 4, (2000, 3))
    cluster, distance = assign(build_tree(centroids), points)
    away = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()


def test_search_opens_few_nodes_when_centroids_are_apart():
    centroids = np.array([[1000 * i, 0] for i in range(64)])
    tree = build_tree(centroids)
    points = centroids + 1
    opened = 0

    class Counted(list):
        def __getitem__(self, i):
            nonlocal opened
            opened += 1
            return list.__getitem__(self, i)

    for p in points[:8]:
        tree.members = Counted(tree.members)
        assign(tree, p[None])
    assert opened < 8 * 40


def test_rounds_equal_plain_integers(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    odd = [(9000001, None), (9000002, [0.5] * 63), (9000003, [None] + [0.5] * 63), (9000004, [float("nan")] * 64),
           (9000005, [float("inf")] + [0.0] * 63), (9000006, [0.0] * 64), (None, [0.25] * 64), (9000008, []),
           (9000006, [0.0] * 64), (9000009, [-1e-9] * 64)]
    rows = vectors.union(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    rows = rows.withColumns({c: F.lit(1) for c in ("cluster", "distance", "point", "name", "part", "total")})
    labelled, centres = centroid_clusters(rows.repartition(7))
    want, want_centres = brute([(r["vec_id"], r["embedding"]) for r in rows.collect()], 16, 3, 64)
    assert centres.tolist() == want_centres
    got = with_inertia(labelled, centres).collect()
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_centres[r["cluster"]])).encode()).hexdigest()


def test_few_none_and_too_large(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, -0.25]), (2, [0.5, -0.25])], "vec_id long, embedding array<double>")
    labelled, centres = centroid_clusters(few, width=2)
    assert len(centres) == 3 and labelled.count() == 3 and labelled.agg(F.sum("distance")).first()[0] == 0
    none = few.filter("vec_id < 0")
    labelled, centres = centroid_clusters(none, width=2)
    assert with_inertia(labelled, centres).collect() == []
    with pytest.raises(Exception, match="would not fit"):
        centroid_clusters(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), width=2)
