"""Clustering on the 2-D embedding.

K-means runs all its starts together: one scan of the points chooses the next
seed of every start, and one scan moves every start's centres.  Tasks fold
their rows to one partial sum per start and cluster; only starts x k rows
reach the driver.  Seeds follow the k-means++ rule: a point is drawn with a
probability in proportion to its squared distance from the start's seeds, by
the largest of log(u) / distance over all points with u from a hash of the
point, so a seed does not depend on how rows are dealt to tasks.  The start
with the lowest cost wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import sq_dist
from tessera.functions.persist import cut, release

#: Points that a task measures at once.
ROWS = 8192


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(centres)))
    for i in range(points.shape[1]):
        out += (points[:, i][:, None] - centres[:, i][None, :]) ** 2
    return out


def _chunks(batches: Iterator[pa.RecordBatch], coords: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield np.column_stack([part.column(c).to_numpy() for c in coords]), part.column("h").to_numpy().view(np.uint64)


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes, other ones for each salt."""
    x = hashes + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def _next_seeds(points: DataFrame, coords: Sequence[str], seeds: list[np.ndarray], salt: int) -> dict[int, list[float]]:
    """For every start the point drawn next; a start whose seeds hold all points has none."""
    place = ", ".join(f"{c} double" for c in coords)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [(-np.inf, None)] * len(seeds)
        for x, h in _chunks(batches, coords):
            for s, chosen in enumerate(seeds):
                weight = _squared(x, chosen).min(axis=1) if len(chosen) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(weight > 0, np.log(_uniform(h, salt * len(seeds) + s)) / weight, -np.inf)
                i = int(key.argmax())
                if key[i] > best[s][0]:
                    best[s] = (float(key[i]), x[i])
        rows = [(s, k, *map(float, p)) for s, (k, p) in enumerate(best) if p is not None]
        names = ["start", "key", *coords]
        kinds = [pa.int32(), pa.float64(), *[pa.float64()] * len(coords)]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    drawn = points.mapInArrow(draw, f"start int, key double, {place}")
    rows = drawn.groupBy("start").agg(F.max(F.struct("key", *coords)).alias("m")).collect()
    return {r["start"]: [r["m"][c] for c in coords] for r in rows}


def _move(points: DataFrame, coords: Sequence[str], starts: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One Lloyd step of all ``starts``: their centres' means, and the cost of the centres given; empty ones stay."""
    sums = ", ".join(f"s{i} double" for i in range(len(coords)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros((len(c), len(coords) + 2)) for s, c in starts.items()}
        for x, _ in _chunks(batches, coords):
            for s, centres in starts.items():
                away = _squared(x, centres)
                near = away.argmin(axis=1)
                each = np.column_stack([np.ones(len(x)), away[np.arange(len(x)), near], x])
                for j in range(each.shape[1]):
                    total[s][:, j] += np.bincount(near, weights=each[:, j], minlength=len(centres))
        start = np.repeat(list(total), [len(t) for t in total.values()])
        cluster = np.concatenate([np.arange(len(t)) for t in total.values()])
        table = np.concatenate(list(total.values()))
        yield pa.RecordBatch.from_arrays([pa.array(start, pa.int32()), pa.array(cluster, pa.int32()), *[pa.array(table[:, j]) for j in range(table.shape[1])]],
                                         names=["start", "cluster", "n", "cost", *[f"s{i}" for i in range(len(coords))]])

    folded = points.mapInArrow(fold, f"start int, cluster int, n double, cost double, {sums}")
    rows = folded.groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *[f"s{i}" for i in range(len(coords))])]).collect()
    moved, cost = {s: c.copy() for s, c in starts.items()}, dict.fromkeys(starts, 0.0)
    for r in rows:
        cost[r["start"]] += r["cost"]
        if r["n"]:
            moved[r["start"]][r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(len(coords))]
    return moved, cost


def distances_to(centres: Sequence[Sequence[float]], coords: Sequence[str]) -> Column:
    """The squared distances of a row to the k centres, as an array."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    return F.transform(table, lambda c: sq_dist([F.col(x).cast("double") for x in coords], [c[i] for i in range(len(coords))]))


def kmeans_labels(
    df: DataFrame,
    k: int = 8,
    coords: Sequence[str] = ("emb_x", "emb_y"),
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 300,
    out: str = "cluster",
    tol: float = 1e-4,
) -> tuple[DataFrame, list[list[float]], float]:
    """M5: (df + integer ``out`` label, centres, cost) of the best of ``n_init`` starts.

    A start ends when its centres move by less than ``tol`` times the mean
    variance of the coordinates in sum of squares, or after ``max_iter``
    steps.  Points at fewer than k places have one cluster per place.  Rows
    with a null or NaN coordinate move no centre and get a null label.
    """
    coords = list(coords)
    usable = ~F.exists(F.array(*[F.col(c).cast("double") for c in coords]), lambda x: x.isNull() | F.isnan(x))
    points = cut(df.where(usable).select(*[F.col(c).cast("double").alias(c) for c in coords]).withColumn("h", F.xxhash64(F.lit(seed), *coords)))
    spread = points.agg(*[F.coalesce(F.var_pop(c), F.lit(0.0)).alias(c) for c in coords]).first()
    enough = tol * float(np.mean([spread[c] for c in coords]))
    seeds = [np.zeros((0, len(coords))) for _ in range(n_init)]
    for step in range(k):
        drawn = _next_seeds(points, coords, seeds, step)
        if not drawn:
            break
        seeds = [np.vstack([c, drawn[s]]) if s in drawn else c for s, c in enumerate(seeds)]
    going = {s: c for s, c in enumerate(seeds) if len(c)}
    done: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(max_iter):
        if not going:
            break
        moved, cost = _move(points, coords, going)
        for s, centres in list(going.items()):
            if ((moved[s] - centres) ** 2).sum() <= enough:
                del going[s]
            else:
                going[s] = moved[s]
            done[s] = (cost[s], moved[s])
    if not done:
        return df.withColumn(out, F.lit(None).cast("int")), [], 0.0
    final, cost = _move(points, coords, {s: c for s, (_, c) in done.items()})
    best = min(cost, key=lambda s: (cost[s], s))
    centres = done[best][1]
    release(points)
    away = distances_to(centres, coords)
    label = F.when(usable, (F.array_position(away, F.array_min(away)) - 1).cast("int"))
    return df.withColumn(out, label), [list(map(float, c)) for c in centres], float(cost[best])


def cluster_data(df: DataFrame, method: str = "kmeans", **kw) -> DataFrame:
    """M5/M6/M10 dispatcher on the 2-D embedding columns."""
    if method == "kmeans":
        return kmeans_labels(df, **kw)[0]
    if method == "hdbscan":
        from tessera.operators.density import hdbscan_labels

        return hdbscan_labels(df, **kw)
    raise ValueError(f"no clusterer named {method!r}; there are kmeans and hdbscan")
