"""Neighbour graph and layout (J5, M4a-M4d).

k-NN graph in many dimensions (J5, M4a) — exact, by block pairs: rows are
dealt to blocks of a bounded size by a hash of the id, every pair of blocks
meets in one task, and the packed k-lists of a block are merged a few at a
time.  Every block is sent to every other, so blocks are few and large: BLOCKS
of them while these hold BLOCK_ROWS rows at most, which keeps the shuffle in
proportion to the rows.  Pruning by distances to pivots does not help in dozens of dimensions
(every cell then needs every point); blocks keep the work even and each
task's memory at two blocks and one distance tile.

Fuzzy graph (M4b, M4c): per point, rho = nearest positive distance and
sigma from a bisection of sum(exp(-(d - rho)+ / sigma)) = log2(k) (an
Arrow-batched pandas UDF over each point's k distances), directed weights
exp(-(d - rho)+ / sigma), then the fuzzy union a + b - ab over both edge
directions (a full outer join of the directed edge table with its mirror).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut, release
from pyspark.sql import types as T

#: Most rows of a block, blocks of a smaller table and their least rows, queries and rows of a distance tile, k-lists
#: merged at once, pairs measured at once.
BLOCK_ROWS, BLOCKS, LEAST_ROWS, TILE, FAN, PAIRS = 65536, 8, 512, 1024, 8, 1 << 16
#: Most points of a layout block, blocks of a smaller layout, edges that are moved at once.
LAYOUT_ROWS, LAYOUT_BLOCKS, EDGES = 1 << 18, 12, 1 << 18


def _stack(series: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _smallest(row: np.ndarray, dist: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row 0..n-1 the k smallest (dist, id) in order, as (n, k) tables padded with inf and -1."""
    order = np.lexsort((ids, dist, row))
    row, dist, ids = row[order], dist[order], ids[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    out_d, out_i = np.full((n, k), np.inf), np.full((n, k), -1, dtype=np.int64)
    out_d[row[keep], rank[keep]] = dist[keep]
    out_i[row[keep], rank[keep]] = ids[keep]
    return out_d, out_i


def _tile_knn(qi: np.ndarray, q: np.ndarray, ids: np.ndarray, xs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact k nearest of ``xs`` for each query (rows with the query's id excluded), ties by id."""
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), -1, dtype=np.int64)
    sq = np.einsum("ij,ij->i", xs, xs)
    for a in range(0, len(q), TILE):
        part, part_id = q[a : a + TILE], qi[a : a + TILE]
        norm = np.einsum("ij,ij->i", part, part)
        for b in range(0, len(xs), TILE):
            # the dot-product form only selects; its rounding error is the margin, and what it selects is measured anew
            near = norm[:, None] + sq[None, b : b + TILE] - 2.0 * part @ xs[b : b + TILE].T
            near[part_id[:, None] == ids[None, b : b + TILE]] = np.inf
            kth = min(k, near.shape[1]) - 1
            last = best_d[a : a + TILE, k - 1] ** 2
            if not np.isfinite(last).all():  # some list is not full yet
                last = np.minimum(last, np.partition(near, kth, axis=1)[:, kth])
            limit = last + 1e-12 * (norm + sq[b : b + TILE].max()) + 1e-300
            row, col = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
            if not len(row):
                continue
            dist = np.empty(len(row))
            for c in range(0, len(row), PAIRS):
                apart = part[row[c : c + PAIRS]] - xs[b + col[c : c + PAIRS]]
                dist[c : c + PAIRS] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            old_row, old = np.nonzero(best_i[a : a + TILE] >= 0)
            row, dist = np.concatenate([row, old_row]), np.concatenate([dist, best_d[a : a + TILE][old_row, old]])
            found = np.concatenate([ids[b + col], best_i[a : a + TILE][old_row, old]])
            best_d[a : a + TILE], best_i[a : a + TILE] = _smallest(row, dist, found, len(part), k)
    return best_d, best_i


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of so many rows: BLOCKS (fewer for few rows) until these hold ``block_rows`` each, then more."""
    return max(1, -(-rows // block_rows), min(BLOCKS, -(-rows // LEAST_ROWS)))


def knn_graph(df: DataFrame, k: int = 15, vec_col: str = "vec", id_col: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest other points in Euclidean space: ``(u, rank, v, dist)``; ids are unique longs."""
    pts = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    blocks = block_count(pts.count(), block_rows)

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        xs = np.asarray(table.column("vec").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "xs": pa.array([xs[order].tobytes()], pa.binary())})

    dealt = pts.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = cut(dealt.groupBy("block").applyInArrow(pack, "block long, ids binary, xs binary"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = packed.withColumn("other", every)
    right = packed.select((F.col("block") + 0).alias("other"), F.col("ids").alias("ids"), F.col("xs").alias("xs")).withColumn("block", every)

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(table.column("ids")[0].as_py(), np.int64)
        return ids, np.frombuffer(table.column("xs")[0].as_py()).reshape(len(ids), -1)

    def lists(block: int, other: int, ids: np.ndarray, dist: np.ndarray, near: np.ndarray) -> pa.Table:
        return pa.table({"block": pa.array([block], pa.int64()), "other": pa.array([other], pa.int64()), "u": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([near.tobytes()], pa.binary()), "dist": pa.array([dist.tobytes()], pa.binary())})

    schema = "block long, other long, u binary, v binary, dist binary"

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(["block", "other", "u", "v", "dist"], [pa.int64(), pa.int64(), *[pa.binary()] * 3], strict=True)})
        ids, xs = read(mine)
        return lists(key[0].as_py(), key[1].as_py(), ids, *_tile_knn(ids, xs, *read(theirs), k))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table.column("u")[0].as_py(), np.int64)
        near = np.hstack([np.frombuffer(x.as_py(), np.int64).reshape(len(ids), k) for x in table.column("v")])
        dist = np.hstack([np.frombuffer(x.as_py()).reshape(len(ids), k) for x in table.column("dist")])
        row, col = np.nonzero(near >= 0)
        return lists(key[0].as_py(), key[1].as_py(), ids, *_smallest(row, dist[row, col], near[row, col], len(ids), k))

    found = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInArrow(meet, schema)
    width = blocks
    while width > 1:
        width = -(-width // FAN)
        found = found.withColumn("other", F.floor(F.col("other") / FAN).cast("long")).groupBy("block", "other").applyInArrow(merge, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column("u")[r].as_py(), np.int64)
                near = np.frombuffer(batch.column("v")[r].as_py(), np.int64).reshape(len(ids), k)
                dist = np.frombuffer(batch.column("dist")[r].as_py()).reshape(len(ids), k)
                row, rank = np.nonzero(near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((rank + 1).astype(np.int32)), pa.array(near[row, rank]), pa.array(dist[row, rank])], names=["u", "rank", "v", "dist"])

    return found.select("u", "v", "dist").mapInArrow(spread, "u long, rank int, v long, dist double")


def _sigmas(dist: np.ndarray, rho: np.ndarray, k: int, n_iter: int = 64, tol: float = 1e-5) -> np.ndarray:
    """Per row the sigma with sum_j exp(-(d_j - rho)+ / sigma) = log2(k) over the k - 1 others (nan: none), all rows at once."""
    target = math.log2(k)
    apart = dist - rho[:, None]
    lo, hi, mid = np.zeros(len(dist)), np.full(len(dist), np.inf), np.ones(len(dist))
    open_ = np.arange(len(dist))
    for _ in range(n_iter):
        x = apart[open_]
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.nansum(np.where(x > 0, np.exp(-x / mid[open_, None]), np.where(np.isnan(x), np.nan, 1.0)), axis=1)
        far = np.abs(total - target) >= tol
        open_, total = open_[far], total[far]
        if not len(open_):
            break
        much = total > target
        hi[open_[much]] = mid[open_[much]]
        lo[open_[~much]] = mid[open_[~much]]
        mid[open_] = np.where(np.isinf(hi[open_]), mid[open_] * 2, (lo[open_] + hi[open_]) / 2)
    return mid


# The guards of the smooth-k-distance step.
MIN_K_DIST_SCALE = 1e-3
SMOOTH_K_TOLERANCE = 1e-5


def fuzzy_graph(knn: DataFrame, k: int) -> DataFrame:
    """M4b + M4c from a k-NN table ``(u, rank, v, dist)`` that excludes self.

    The neighbourhood of size k counts the point itself (distance 0) plus
    its k - 1 nearest others.  Output: ``(u, v, weight)`` of the symmetric
    fuzzy union, u < v.
    """
    nb = cut(knn.where(F.col("rank") <= k - 1))  # read three times
    per = nb.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "dist"))).alias("nb"))  # <= k items
    per = per.select("u", F.col("nb.dist").alias("ds"))

    # the floor of a point that coincides with all its neighbours: the mean distance of the whole graph, self included
    whole = per.agg(F.sum(F.aggregate("ds", F.lit(0.0), lambda a, x: a + x)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    mean_all = float(whole["s"]) / (whole["n"] * k) if whole["n"] else 0.0

    @F.pandas_udf("struct<rho double, sigma double>")
    def smooth(ds: pd.Series) -> pd.DataFrame:
        width = max((len(x) for x in ds), default=0)
        dist = np.full((len(ds), width), np.nan)
        for i, x in enumerate(ds):
            dist[i, : len(x)] = x
        positive = np.where(dist > 0, dist, np.inf)
        least = positive.min(axis=1, initial=np.inf)  # distances are in order: the nearest that is not 0
        rho = np.where(np.isfinite(least), least, 0.0)
        mean = np.nansum(dist, axis=1) / (1 + (~np.isnan(dist)).sum(axis=1))  # the self distance is in the mean
        floor = MIN_K_DIST_SCALE * np.where(rho > 0, mean, mean_all)
        return pd.DataFrame({"rho": rho, "sigma": np.maximum(_sigmas(dist, rho, k, tol=SMOOTH_K_TOLERANCE), floor)})

    rs = per.select("u", smooth("ds").alias("s")).select("u", "s.rho", "s.sigma")
    directed = nb.join(rs, "u").select(
        "u", "v", F.exp(-F.greatest(F.col("dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w"))
    a = directed.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"),
                        F.when(F.col("u") < F.col("v"), F.col("w")).alias("w_ab"),
                        F.when(F.col("u") > F.col("v"), F.col("w")).alias("w_ba"))
    pair = a.groupBy("a", "b").agg(F.max("w_ab").alias("x"), F.max("w_ba").alias("y"))
    x = F.coalesce("x", F.lit(0.0))
    y = F.coalesce("y", F.lit(0.0))
    return pair.select(F.col("a").alias("u"), F.col("b").alias("v"), (x + y - x * y).alias("weight"))


def find_ab(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """Curve 1 / (1 + a x^(2b)) closest (least squares) to the target membership
    1 for x < min_dist, exp(-(x - min_dist) / spread) beyond; grid + refinement."""
    x = np.linspace(0, spread * 3, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    xs = np.maximum(x, 1e-12)

    def err(a, b):
        return float(((1.0 / (1.0 + a * xs ** (2 * b)) - y) ** 2).sum())

    best = min(((err(a, b), a, b) for a in np.linspace(0.05, 5, 100) for b in np.linspace(0.2, 2.5, 100)))
    _, a, b = best
    step_a, step_b = 0.05, 0.023
    for _ in range(60):
        cands = [(err(a + da, b + db), a + da, b + db) for da in (-step_a, 0, step_a) for db in (-step_b, 0, step_b)
                 if a + da > 0 and b + db > 0]
        e, na, nb = min(cands)
        if (na, nb) == (a, b):
            step_a, step_b = step_a / 2, step_b / 2
        a, b = na, nb
    return float(a), float(b)


def hash_on(seed: np.ndarray, value: int) -> np.ndarray:
    """The 64-bit hashes that ``F.xxhash64`` gives when an int column of this value follows those hashed to ``seed``."""
    mask = (1 << 64) - 1
    one, two, three, five = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    x = (seed + np.uint64(five + 4)) ^ np.uint64((value & 0xFFFFFFFF) * one & mask)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * np.uint64(two) + np.uint64(three)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(two)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(three)
    return x ^ (x >> np.uint64(32))


def layout_epochs(df: DataFrame, weights: DataFrame, vec_col: str = "features", id_col: str = "id",
                  min_dist: float = 0.1, seed: int = 42, n_epochs: int = 200, negative: int = 5,
                  cut_every: int = 1) -> DataFrame:
    """M4d: 2-D layout by weighted gradient epochs on DataFrames.

    Start: the centred PCA projection scaled to a [-10, 10] box.  Each epoch
    moves every point along its (symmetric) edges: attraction along every edge
    scaled by its weight; repulsion from ``negative`` points per edge drawn by
    hashing (edge, epoch, i) to a dense point index; gradients clipped to
    [-4, 4]; step size 1 - epoch/n_epochs.
    Forces keep the published proportion, two pulls (each edge moves both its
    ends, in both directions) to ``negative`` full pushes, and a point moves by
    the mean over its edges' weights, which keeps a full-batch step stable.
    A deterministic variant of the sampled SGD of the original method: results
    are judged by neighbourhood preservation, not equality.
    The edges are dealt to blocks by the hash of their first end and kept there
    (on the executors' disks) for all epochs; an epoch sends only the positions,
    to every block, and nothing through the driver.
    Lineage is cut every ``cut_every`` epochs (written table).
    """
    from tessera.operators.encode import dense_index
    from tessera.operators.reduce import fit_pca

    spark = df.sparkSession
    a, b = find_ab(min_dist)
    pca = fit_pca(df, 2, vec_col)
    start = pca.transform(df.select(F.col(id_col).alias("id"), F.col(vec_col)), vec_col).select("id", "emb_x", "emb_y")
    ext = start.agg(F.max(F.greatest(F.abs("emb_x"), F.abs("emb_y")))).first()[0] or 1.0
    pos = start.select("id", (F.col("emb_x") * (10.0 / ext)).alias("px"), (F.col("emb_y") * (10.0 / ext)).alias("py"))
    pos = dense_index(pos.withColumn("_all", F.lit(0)), "_all", ["id"], "idx").drop("_all").transform(cut)
    n = pos.count()
    blocks = max(1, -(-n // LAYOUT_ROWS), min(LAYOUT_BLOCKS, -(-n // LEAST_ROWS)))
    # names of blocks that Spark deals to one partition each
    dealt = spark.range(64 * blocks).groupBy(F.pmod(F.hash("id"), F.lit(blocks)).alias("p")).agg(F.min("id").alias("name"))
    names = [r["name"] for r in dealt.collect()]
    names += [-i for i in range(1, blocks - len(names) + 1)]
    block_of = lambda c: F.element_at(F.array(*[F.lit(x).cast("long") for x in names]), (F.pmod(F.xxhash64(c), F.lit(blocks)) + 1).cast("int"))
    e = weights.select("u", "v", F.col("weight").alias("w"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    e = e.join(e.groupBy("u").agg(F.sum("w").alias("all")), "u").select("u", "v", (F.col("w") / F.col("all")).alias("w"))
    ends = pos.select("id", "idx")
    e = (e.join(ends.select(F.col("id").alias("u"), F.col("idx").alias("iu")), "u")
          .join(ends.select(F.col("id").alias("v"), F.col("idx").alias("iv")), "v")
          .select(block_of("u").alias("block"), "u", "v", "iu", "iv", "w", F.xxhash64("u", "v").alias("drawn")))

    def pack_edges(key: tuple, points: pa.Table, edges: pa.Table) -> pa.Table:
        ids, slot = np.unique(points.column("id").to_numpy(), return_inverse=True)
        edges = edges.sort_by([(c, "ascending") for c in ("u", "v", "iu", "iv")])
        parts = {"rows": points.column("idx").to_numpy(), "slot": slot, "e_slot": np.searchsorted(ids, edges.column("u").to_numpy()),
                 "iu": edges.column("iu").to_numpy(), "iv": edges.column("iv").to_numpy(), "w": edges.column("w").to_numpy(), "drawn": edges.column("drawn").to_numpy()}
        packed = [pa.array([(x.astype(np.float64) if c == "w" else x.astype(np.int64)).tobytes()], pa.binary()) for c, x in parts.items()]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *packed], names=["block", *parts])

    def pack_points(table: pa.Table) -> pa.Table:
        packed = [pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("idx", "px", "py")]
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), *packed], names=["block", "idx", "x", "y"])

    def step(ep: int):
        alpha = 1.0 - ep / n_epochs

        def move(key: tuple, kept: pa.Table, sent: pa.Table) -> pa.Table:
            if not kept.num_rows or not sent.num_rows:
                return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 3], names=["block", "idx", "x", "y"])
            part = {c: np.frombuffer(kept.column(c)[0].as_py(), np.float64 if c == "w" else np.int64) for c in kept.column_names if c != "block"}
            px, py = np.zeros(n), np.zeros(n)
            for idx, x, y in zip(sent.column("idx"), sent.column("x"), sent.column("y"), strict=True):
                at = np.frombuffer(idx.as_py(), np.int64)
                px[at], py[at] = np.frombuffer(x.as_py()), np.frombuffer(y.as_py())
            size = int(part["slot"].max()) + 1
            gx, gy = np.zeros(size), np.zeros(size)
            for at in range(0, len(part["w"]), EDGES):
                slot, iu, iv, w, drawn = (part[c][at : at + EDGES] for c in ("e_slot", "iu", "iv", "w", "drawn"))
                ux, uy = px[iu], py[iu]
                for i in range(-1, negative):  # -1: the edge itself
                    other = iv if i < 0 else hash_on(hash_on(hash_on(drawn.view(np.uint64), i), ep), seed).view(np.int64) % n
                    dx, dy = ux - px[other], uy - py[other]
                    d2 = dx * dx + dy * dy
                    apart = np.where(d2 > 0, d2, 1.0)
                    if i < 0:
                        force, scale = (-2.0 * a * b) * apart ** (b - 1.0) / (1.0 + a * apart**b), 2.0 * alpha * w
                    else:
                        force, scale = (2.0 * b) / ((0.001 + apart) * (1.0 + a * apart**b)), alpha * w
                    force = np.where(d2 > 0, force, 0.0)
                    gx += np.bincount(slot, scale * np.clip(force * dx, -4.0, 4.0), size)
                    gy += np.bincount(slot, scale * np.clip(force * dy, -4.0, 4.0), size)
            rows, slot = part["rows"], part["slot"]
            moved = [rows, px[rows] + gx[slot], py[rows] + gy[slot]]
            return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in moved]], names=["block", "idx", "x", "y"])

        return move

    schema = "block long, idx binary, x binary, y binary"
    homes = pos.withColumn("block", block_of("id"))
    kept = cut(homes.select("block", "id", "idx").groupBy("block").cogroup(e.groupBy("block")).applyInArrow(
        pack_edges, "block long, rows binary, slot binary, e_slot binary, iu binary, iv binary, w binary, drawn binary"))
    kept = kept.repartition(blocks, "block").persist(StorageLevel.DISK_ONLY)
    now = last = cut(homes.groupBy("block").applyInArrow(pack_points, schema))
    everywhere = F.explode(F.array(*[F.lit(x).cast("long") for x in names])).alias("to")
    for ep in range(n_epochs):
        sent = now.select(everywhere, "idx", "x", "y")
        now = kept.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(step(ep), schema)
        if (ep + 1) % cut_every == 0 or ep == n_epochs - 1:
            written = cut(now)
            release(last)
            now = last = written
    kept.unpersist()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                parts = [np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("idx", np.int64), ("x", np.float64), ("y", np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["idx", "emb_x", "emb_y"])

    placed = ends.join(now.select("idx", "x", "y").mapInArrow(spread, "idx long, emb_x double, emb_y double"), "idx").drop("idx")
    return (df.select(F.col(id_col).alias("id"), *[c for c in df.columns if c != id_col])
              .join(placed, "id").withColumnRenamed("id", id_col))


def umap_embed(df: DataFrame, vec_col: str = "features", id_col: str = "id", n_neighbors: int = 15,
               min_dist: float = 0.1, seed: int = 42, n_epochs: int = 200) -> DataFrame:
    """M4: exact k-NN graph -> fuzzy graph -> layout epochs."""
    g = knn_graph(df, n_neighbors - 1, vec_col, id_col)
    w = fuzzy_graph(g, n_neighbors).transform(cut)
    return layout_epochs(df, w, vec_col, id_col, min_dist=min_dist, seed=seed, n_epochs=n_epochs)
