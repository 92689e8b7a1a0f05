"""Numeric kernels against brute-force NumPy on small inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.quantiles import grouped_median
from tessera.operators import cover, neighbors, reduce
from tessera.plans import fixtures as fx
from conftest import SF_SMALL


def test_grouped_median_refinement_path(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 4, 6000)
    v = np.round(rng.normal(0, 10, 6000), 3)
    v[::97] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r["g"]: r["m"] for r in grouped_median(df, ["g"], "v", "m", window_limit=40, accuracy=200, grid=50).collect()}
    want = pdf.dropna().groupby("g")["v"].median().to_dict()
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_grouped_median_null_keys_and_even(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 4.0), (None, 9.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in grouped_median(df, ["k"], "v", "m").collect()}
    assert got == {None: 3.0, "a": 5.0}


def test_grouped_median_of_two_is_rounded_once(spark):
    from tessera.functions.quantiles import grouped_median

    big, inf = 1.7e308, float("inf")
    rows = [("a", 361.3), ("a", 2815.57), ("b", big), ("b", big / 2), ("c", 5e-324), ("d", inf)]
    got = {r["k"]: r["median"] for r in grouped_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": (361.3 + 2815.57) / 2, "b": big * 0.75, "c": 5e-324, "d": inf}


def _brute_knn(p, c, k, metric="euclidean", exclude=None):
    out = {}
    for i, (pid, x) in enumerate(p):
        ds = []
        for cid, y in c:
            if exclude is not None and cid == pid:
                continue
            d = np.abs(np.subtract(x, y)).sum() if metric == "manhattan" else float(((np.subtract(x, y)) ** 2).sum())
            ds.append((d, cid))
        ds.sort()
        out[pid] = [cid for _, cid in ds[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_matches_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    blob = np.vstack([rng.normal(0, 0.05, (120, 2)), rng.normal(1, 0.3, (60, 2)), rng.uniform(-2, 3, (20, 2))])
    blob = np.round(blob, 4)
    pdf = pd.DataFrame({"id": np.arange(len(blob)), "x": blob[:, 0], "y": blob[:, 1]})
    df = spark.createDataFrame(pdf)
    res = neighbors.knn(df, df, 4, ("x", "y"), "id", (), metric, exclude_self=True).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["probe_id"], r["rank"])):
        got.setdefault(r["probe_id"], []).append(r["match_id"])
    pts = [(int(i), (x, y)) for i, x, y in pdf.itertuples(index=False)]
    want = _brute_knn(pts, pts, 4, metric, exclude=True)
    assert got == want


def _greedy_cover(points, eps):
    uncovered = np.ones(len(points), bool)
    centres = []
    for i in range(len(points)):
        if uncovered[i]:
            centres.append(i)
            d2 = ((points - points[i]) ** 2).sum(axis=1)
            uncovered[d2 <= eps * eps] = False
    return centres


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.sampled_from([0.1, 0.25, 0.5]))
def test_cover_equals_sequential_scan(spark, seed, eps):
    rng = np.random.default_rng(seed)
    n = 60
    pts = np.round(rng.uniform(0, 1, (n, 3)), 3)
    ids = rng.permutation(n) * 3 + 1
    pdf = pd.DataFrame({"cluster": rng.integers(0, 2, n), "id": ids, "x": pts[:, 0], "y": pts[:, 1], "z": pts[:, 2]})
    df = spark.createDataFrame(pdf)
    got = cover.epsilon_cover(df, eps, ("x", "y", "z"), "id", ("cluster",)).collect()
    for cl in (0, 1):
        sub = pdf[pdf.cluster == cl].sort_values("id")
        want = sub.id.to_numpy()[_greedy_cover(sub[["x", "y", "z"]].to_numpy(), eps)].tolist()
        mine = [r["id"] for r in sorted((r for r in got if r["cluster"] == cl), key=lambda r: r["center_rank"])]
        assert mine == want


def test_cover_exact_epsilon_and_duplicates(spark):
    # points at distance exactly 0.5 (binary fraction) are covered; duplicates collapse
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.5, 0.0, 0.0), (0, 3, 1.0, 0.0, 0.0), (0, 4, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cluster int, id long, x double, y double, z double")
    got = sorted((r["center_rank"], r["id"]) for r in cover.epsilon_cover(df, 0.5, ("x", "y", "z")).collect())
    assert got == [(1, 1), (2, 3)]


@pytest.mark.parametrize(("tile", "held"), [(4096, 4), (3, 1)])
def test_cover_does_not_depend_on_tiles(spark, tile, held):
    rng = np.random.default_rng(9)
    pts = np.round(rng.normal(size=(120, 3)), 2)
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "cluster int, id long, x double, y double, z double")
    got = cover.epsilon_cover(df, 0.6, ("x", "y", "z"), tile=tile, held=held).orderBy("center_rank").collect()
    assert [r["id"] for r in got] == _greedy_cover(pts, 0.6)


@pytest.mark.parametrize("shape", ["line", "ball"])
def test_cover_of_a_sorted_line_and_a_dense_ball_in_few_rounds(spark, monkeypatch, shape):
    rng = np.random.default_rng(1)
    n = 5000
    pts = np.zeros((n, 3))
    if shape == "line":
        pts[:, 0] = np.arange(n) * 0.4
    else:
        pts = rng.uniform(0, 0.3, (n, 3))
    rounds = []
    monkeypatch.setattr(cover, "release", lambda *tables: rounds.append(len(tables)))
    df = spark.createDataFrame(pd.DataFrame({"cluster": 0, "id": np.arange(n), "x": pts[:, 0], "y": pts[:, 1], "z": pts[:, 2]}))
    got = cover.epsilon_cover(df, 1.0, ("x", "y", "z")).orderBy("center_rank").collect()
    assert [r["id"] for r in got] == _greedy_cover(pts, 1.0)
    assert rounds.count(1) <= 4


def test_repeated_ids_are_points_of_their_own(spark):
    rows = [(0, 1, 0.0, True, False), (0, 1, 10.0, True, False), (0, 2, 20.0, True, False), (0, 7, 0.5, False, True), (0, 8, 11.0, False, True), (0, 7, 21.0, False, True)]
    df = spark.createDataFrame(rows, "cluster int, id long, x double, in_on boolean, in_not boolean").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    centres, matches = cover.cover_and_match(df, 1.0, ("x", "y", "z"), "id", "cluster")
    assert sorted((r["center_rank"], r["id"]) for r in centres.collect()) == [(1, 1), (2, 1), (3, 2)]
    assert sorted((r["center_rank"], r["match_id"], r["dist"]) for r in matches.collect())[2] == (3, 7, 1.0) and matches.count() == 3
    sel = cover.selection(matches, df.select("cluster").distinct())
    assert sorted((r["rank"], r["id"]) for r in sel.collect()) == [(1, 7), (2, 8)]


def test_cover_sizes_golden(spark):
    # golden counts from the fixture notes (sf0.01, eps 0.2), by cluster 1..9
    f2 = fx.points(spark, "/root/testdata/sf0.01")
    centres, _ = cover.cover_and_match(f2, 0.2, ("x", "y", "z"), "id", "cluster")
    got = {r["cluster"]: r["n"] for r in centres.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert [got.get(c, 0) for c in range(1, 10)] == [7, 8, 9, 8, 7, 4, 4, 4, 7]


def test_pca_matches_numpy(spark):
    f2 = fx.points(spark, SF_SMALL)
    pdf = f2.select("id", "vec").toPandas().sort_values("id")
    x = np.vstack(pdf.vec.to_numpy())
    model = reduce.fit_pca(f2, 2, "vec")
    got = model.transform(f2.select("id", "vec"), "vec").select("id", "emb_x", "emb_y").toPandas().sort_values("id")
    xc = x - x.mean(axis=0)
    vals, vecs = np.linalg.eigh(np.cov(xc, rowvar=False))
    comps = vecs[:, np.argsort(vals)[::-1][:2]].T
    for r in range(2):
        if comps[r, np.argmax(np.abs(comps[r]))] < 0:
            comps[r] = -comps[r]
    want = xc @ comps.T
    assert np.allclose(got[["emb_x", "emb_y"]].to_numpy(), want, atol=1e-9)


def test_long_pca_equals_dense_pca(spark):
    rng = np.random.default_rng(4)
    n, levels = 150, 40
    x = np.zeros((n, levels + 2))
    x[:, 0], x[:, 1] = rng.normal(size=n) * 3, rng.normal(size=n)
    x[np.arange(n), 2 + np.minimum(rng.geometric(0.15, n), levels) - 1] = 1.0
    x[5] = 0.0  # a row without an entry
    dense = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>")
    long = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id long, feature_idx int, value double")
    got, axes = reduce.pca_long(long, dense, oversample=6)
    want = reduce.fit_pca(dense, 2, "vec").transform(dense, "vec")
    a, b = (t.select("id", "emb_x", "emb_y").toPandas().sort_values("id")[["emb_x", "emb_y"]].to_numpy() for t in (got, want))
    assert np.allclose(a, b, atol=1e-6)
    assert axes.count() == (x != 0).any(axis=0).sum()


def test_kmeans_rows_sit_at_nearest_centre(spark):
    from tessera.operators.cluster import kmeans_labels

    f2 = fx.points(spark, SF_SMALL).select("id", F.col("x").alias("emb_x"), F.col("y").alias("emb_y"))
    lab, centres, _ = kmeans_labels(f2, k=4, n_init=2)
    pdf = lab.toPandas()
    c = np.array(centres)
    d = ((pdf[["emb_x", "emb_y"]].to_numpy()[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == pdf.cluster.to_numpy()).mean() > 0.99
    blobs = spark.createDataFrame([(i, float(10 * (i % 3) + 0.01 * i), float(i % 3)) for i in range(60)], "id long, emb_x double, emb_y double")
    found, middle, cost = kmeans_labels(blobs, k=3)
    assert {tuple(sorted(r["ids"])) for r in found.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()} == {tuple(range(j, 60, 3)) for j in range(3)}
    assert cost == pytest.approx(sum(((0.01 * (np.arange(j, 60, 3) - np.arange(j, 60, 3).mean())) ** 2).sum() for j in range(3)))
    odd = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, None, 1.0)], "id long, emb_x double, emb_y double")
    few, places, cost = kmeans_labels(odd, k=8)
    assert len(places) == 2 and cost == 0.0 and [r["cluster"] is None for r in few.orderBy("id").collect()] == [False, False, False, True]
    assert kmeans_labels(odd.limit(0), k=2)[0].count() == 0
    lab2, _, _ = kmeans_labels(f2.repartition(5), k=4, n_init=2)
    assert sorted(map(tuple, lab2.select("id", "cluster").collect())) == sorted(map(tuple, lab.select("id", "cluster").collect()))


def _prim_total(X, ms):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    core = np.sort(D + np.diag([np.inf] * n), axis=1)[:, ms - 1]
    M = np.maximum(np.maximum(core[:, None], core[None]), D)
    np.fill_diagonal(M, np.inf)
    in_t = np.zeros(n, bool)
    in_t[0] = True
    best, tot = M[0].copy(), 0.0
    for _ in range(n - 1):
        b = np.where(in_t, np.inf, best)
        j = int(np.argmin(b))
        tot += b[j]
        in_t[j] = True
        best = np.minimum(best, M[j])
    return tot


def test_mst_and_clusters_of_two_blobs(spark):
    from tessera.operators import density

    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal([0, 0], 0.3, (80, 2)), rng.normal([4, 0], 0.6, (70, 2)), rng.uniform(-3, 7, (20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, emb_x double, emb_y double")
    res = density.hdbscan(df, min_cluster_size=15, min_samples=3, method="eom", epsilon=0.0)
    tree = res.tree.toPandas()
    assert len(tree) == len(X) - 1
    assert tree.w.sum() == pytest.approx(_prim_total(X, 3), rel=1e-9)
    lab = res.labels.toPandas().sort_values("id").cluster.to_numpy()
    sizes = np.bincount(lab[lab >= 0])
    assert len(sizes) == 2 and sizes.min() >= 15
    # blobs recovered: most of each blob shares one label
    assert np.bincount(lab[:80] + 1).max() >= 70 and np.bincount(lab[80:150] + 1).max() >= 55


def test_sweep_grid_has_162_rows(spark):
    from tessera.plans import sweep

    g = sweep.sweep_grid(spark)
    assert g.count() == 162 and g.distinct().count() == 162


def test_layout_keeps_neighbours_far_better_than_pca(spark):
    from tessera.operators import layout

    f2 = fx.points(spark, SF_SMALL).select("id", "vec")
    out = layout.umap_embed(f2, "vec", "id", n_neighbors=15, n_epochs=15).toPandas().sort_values("id")
    X = np.vstack(out.vec.to_numpy())
    centred = X - X.mean(0)
    pca = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T

    def nearest(Y, k=10):
        d = ((Y[:, None] - Y[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, 1)[:, :k]

    true = nearest(X)
    kept = lambda Y: np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true, nearest(Y), strict=True)])
    assert kept(out[["emb_x", "emb_y"]].to_numpy()) > 2 * kept(pca)


def test_layout_is_the_same_for_the_same_seed(spark):
    from tessera.operators import layout

    f2 = fx.points(spark, SF_SMALL).select("id", "vec")
    one = layout.umap_embed(f2, "vec", "id", n_epochs=2).toPandas().sort_values("id")
    two = layout.umap_embed(f2.repartition(5), "vec", "id", n_epochs=2).toPandas().sort_values("id")
    assert np.allclose(one[["emb_x", "emb_y"]].to_numpy(), two[["emb_x", "emb_y"]].to_numpy())


def test_median_of_tied_values_is_quick_and_exact(spark):
    import time

    rows = [("a", 5.0)] * 1800 + [("a", float(i)) for i in range(200)] + [("b", float(i * i % 977)) for i in range(2001)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    start = time.time()
    got = {r["g"]: r["m"] for r in grouped_median(df, ["g"], "v", "m", window_limit=100, grid=20).collect()}
    for g in ("a", "b", None):
        assert got[g] == float(np.median([v for k, v in rows if k == g]))
    assert time.time() - start < 60


def test_silhouette_of_all_rows_in_blocks(spark):
    from tessera.operators import evaluate

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(5, 1, (60, 2)), [[50.0, 50.0]]])
    c = np.array([0] * 80 + [1] * 60 + [2])
    df = spark.createDataFrame([(i, int(c[i]), float(x[i, 0]), float(x[i, 1])) for i in range(len(x))], "id long, cluster int, emb_x double, emb_y double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        own = (c == c[i]).sum()
        a = d[i, c == c[i]].sum() / max(1, own - 1)
        b = min(d[i, c == k].mean() for k in set(c.tolist()) - {int(c[i])})
        want.append((b - a) / max(a, b) if own > 1 else 0.0)
    for block in (16, 2048):
        score, used = evaluate.silhouette(df, block=block)
        assert used == len(x) and abs(score - np.mean(want)) < 1e-9


def test_silhouette_blocks_are_few_and_even_and_nothing_is_broadcast(spark, monkeypatch):
    from tessera.operators import evaluate

    rng = np.random.default_rng(9)
    n, k = 6000, 30
    c = rng.integers(0, k, n)
    x = rng.normal(size=(n, 2)) + c[:, None] / 3
    df = spark.createDataFrame([(7, int(c[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "id long, cluster int, emb_x double, emb_y double")
    written, plans = [], []
    real_cut, real_first = evaluate.cut, type(df).first

    def cut(df):
        out = real_cut(df)
        if "block" in out.columns:
            written.extend(len(r["c"]) // 8 for r in out.collect())
        return out

    def first(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real_first(df)

    monkeypatch.setattr(evaluate, "cut", cut)
    monkeypatch.setattr(type(df), "first", first)
    score, used = evaluate.silhouette(df)
    assert used == n
    # all rows have one id: a hash of it put them into one block
    assert len(written) == 8 and sum(written) == n and max(written) <= n / 8 + 64
    assert plans and not any("Broadcast" in p for p in plans)
    sums = np.array([[np.sqrt(((x[i] - x[c == j]) ** 2).sum(1)).sum() for j in range(k)] for i in range(n)])
    count = np.bincount(c, minlength=k)
    a = sums[np.arange(n), c] / (count[c] - 1)
    mean = sums / count
    mean[np.arange(n), c] = np.inf
    b = mean.min(1)
    assert abs(score - ((b - a) / np.maximum(a, b)).mean()) < 1e-9


def test_knn_graph_in_blocks_equals_brute_force(spark):
    from tessera.operators.layout import knn_graph

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    x[100:120] = x[0]  # ties go to the smaller id
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)], "id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(j) for i in range(200) for r, j in enumerate(np.lexsort((np.arange(200), d[i]))[:5])}
    for rows in (4096, 20):
        assert {(r["u"], r["rank"]): r["v"] for r in knn_graph(df, 5, block_rows=rows).collect()} == want
    assert knn_graph(df.limit(3), 5).count() == 6


def test_knn_graph_blocks_keep_the_shuffle_in_proportion(spark):
    from tessera.operators.layout import block_count, knn_graph

    # every block is sent to all others: their number may not grow with the rows
    assert block_count(10_000) == block_count(100_000) == 8 and block_count(600_000) == 10
    assert block_count(0) == block_count(1) == 1 and block_count(100, 7) == 15
    # copies at distance 0 in many tiles, ties by id
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 3)), 60, axis=0)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r["u"], r["rank"]): r["v"] for r in knn_graph(df, 3).collect()}
    assert all([got[i, r] for r in (1, 2, 3)] == [j for j in range(i // 60 * 60, i // 60 * 60 + 4) if j != i][:3] for i in range(len(x)))


def test_fuzzy_graph_computes_the_neighbours_once(spark):
    from tessera.operators.layout import fuzzy_graph

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(u, r, (u + r) % 9, 0.5 * r) for u in range(9) for r in (1, 2, 3)]
    knn = spark.createDataFrame(rows, "u long, rank int, v long, dist double").mapInArrow(count, "u long, rank int, v long, dist double")
    assert fuzzy_graph(knn, 4).count() == 27 and seen.value == 27


def test_layout_epochs_equal_brute_force(spark):
    from tessera.operators import layout
    from tessera.operators.reduce import fit_pca

    rng = np.random.default_rng(8)
    ids = [3 * i - 7 for i in range(14)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, rng.normal(size=(14, 4)))], "id long, vec array<double>")
    edges = [(min(u, v), max(u, v), 0.2 + 0.05 * k) for k, (u, v) in enumerate({(ids[i], ids[(i * 5 + 3) % 14]) for i in range(14)}) if u != v]
    weights = spark.createDataFrame(edges, "u long, v long, weight double")
    start = {r["id"]: np.array([r["emb_x"], r["emb_y"]]) for r in fit_pca(df, 2, "vec").transform(df, "vec").collect()}
    ext = max(np.abs(x).max() for x in start.values())
    pos = {i: x * (10.0 / ext) for i, x in start.items()}
    both = edges + [(v, u, w) for u, v, w in edges]
    total = {i: sum(w for u, _, w in both if u == i) for i in ids}
    a, b = layout.find_ab(0.1)
    for ep in range(3):
        alpha, moved = 1.0 - ep / 3, {i: x.copy() for i, x in pos.items()}
        draws = spark.createDataFrame([(u, v, i) for u, v, _ in both for i in range(5)], "u long, v long, i int").selectExpr("u", "v", "i", f"cast(pmod(xxhash64(u, v, i, {ep}, 42), 14) as int) as at").collect()
        drawn = {(r["u"], r["v"], r["i"]): ids[r["at"]] for r in draws}
        for u, v, w in both:
            share, d = w / total[u], pos[u] - pos[v]
            d2 = float(d @ d)
            moved[u] += 2 * alpha * share * np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * d, -4, 4)
            for i in range(5):
                d = pos[u] - pos[drawn[u, v, i]]
                d2 = float(d @ d)
                if d2 > 0:
                    moved[u] += alpha * share * np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * d, -4, 4)
        pos = moved
    got = {r["id"]: (r["emb_x"], r["emb_y"]) for r in layout.layout_epochs(df, weights, "vec", n_epochs=3).collect()}
    assert all(np.allclose(got[i], pos[i], atol=1e-9) for i in ids)


def test_layout_sends_no_positions_through_the_driver(spark):
    """An epoch joins nothing: the positions go from block to block, never as a broadcast."""
    from tessera.operators import layout

    f2 = spark.range(40).selectExpr("id", "array(sin(id), cos(id * 2), id / 40) as vec")
    weights = spark.range(39).selectExpr("id as u", "id + 1 as v", "0.5D as weight")
    plans, cut = [], layout.cut
    layout.cut = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1]
    try:
        layout.layout_epochs(f2, weights, "vec", n_epochs=3).count()
    finally:
        layout.cut = cut
    assert len(plans) >= 5 and not any("Join" in p for p in plans[-3:])


def test_ball_pairs_are_written_in_runs_that_pack(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 0.22, size=(4000, 3)), 6)
    df = spark.createDataFrame([(1000 + 7 * i, *map(float, x[i])) for i in range(len(x))], "id long, x double, y double, z double")
    found = neighbors.ball_pairs(df, 0.1)
    out = str(tmp_path / "pairs")
    found.select("id_a", "id_b", F.round(F.sqrt("d2"), 6).alias("dist")).coalesce(2).write.parquet(out)
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    d2 = (x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2 + (x[:, None, 2] - x[None, :, 2]) ** 2
    a, b = np.nonzero(np.triu(d2 <= 0.1 * 0.1, 1))
    got = spark.read.parquet(out).toPandas()
    assert len(got) == len(a) and set(zip(got.id_a, got.id_b)) == set(zip((1000 + 7 * a).tolist(), (1000 + 7 * b).tolist()))
    assert size < 6 * len(a)  # a double alone has 8 bytes


def test_ball_pairs_in_small_chunks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 400
    x = np.concatenate([rng.integers(-6, 6, size=(250, 2)) / 10, rng.normal(0, 0.1, size=(100, 2)), np.tile([[0.05, 0.05]], (50, 1))])
    ids = [None if i == 3 else f"k{i % 390:03d}" for i in range(n)]  # ids that come twice, one without
    first = [None if i % 50 == 0 else int(v) for i, v in enumerate(rng.integers(0, 5, n))]
    part = [None if i % 97 == 0 else "ab"[i % 2] for i in range(n)]
    pts = [(ids[i], part[i], first[i], float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    odd = [("n1", "a", 1, None, 0.0), ("n2", "a", 1, float("nan"), 0.0), ("n3", "a", 1, float("inf"), 0.0)]
    df = spark.createDataFrame(pts + odd, "id string, part string, first int, x double, y double")

    def key(p):
        return (p[2] is not None, p[2] or 0, p[0] is not None, p[0] or "")

    want = []
    for i, p in enumerate(pts):
        for q in pts[:i]:
            d2 = (p[3] - q[3]) * (p[3] - q[3]) + (p[4] - q[4]) * (p[4] - q[4])
            if d2 <= 0.1 * 0.1 and p[1] is not None and p[1] == q[1] and key(p) != key(q):
                low, high = sorted((p, q), key=key)
                want.append((p[1], str(low[0]), str(high[0]), d2))
    for chunk, met, pairs in ((7, 20, 50), (4096, 1 << 16, 1 << 21)):
        monkeypatch.setattr(neighbors, "CHUNK", chunk)
        monkeypatch.setattr(neighbors, "MET", met)
        monkeypatch.setattr(neighbors, "PAIRS", pairs)
        got = neighbors.ball_pairs(df, 0.1, ("x", "y"), "id", ("part",), ("first",))
        assert got.columns == ["part", "id_a", "id_b", "d2"]
        assert sorted((r["part"], str(r["id_a"]), str(r["id_b"]), r["d2"]) for r in got.collect()) == sorted(want)
    assert neighbors.ball_pairs(df.where("x > 100 AND y > 1"), 0.1, ("x", "y")).count() == 0
