"""Exact integer k-means rounds, each vector finding its centroid in a vantage-point tree.

Components are scaled and floored to integers, so every distance, sum and mean is exact and the result does not depend
on how rows are dealt to tasks.  Each round the driver builds a vantage-point tree over the k centroids (k x width
integers, whatever the input's size) and ships it to the tasks.  A vector opens the nodes of the tree in the order of
their least possible distance and stops when no open node can hold a centroid as near as the best one found; nodes
that could tie are opened too, since the smaller number wins.  Tasks fold their rows to one partial sum per cluster and
component before anything is exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import pick

#: Integers of larger size would let squared distances leave 64 bits; such vectors are refused, not rounded.
LARGEST = 1 << 27
#: A node with at most so many centroids is a leaf.
LEAF = 2
#: Vectors that a task assigns at once.
ROWS = 8192


@dataclass
class Tree:
    """Nodes of a vantage-point tree over centroids: ``members`` are the centroids compared when a node is opened.

    An inner node compares its vantage point alone; ``near`` holds the centroids within ``radius`` of it (inclusive),
    ``far`` the others, none of them nearer to it than ``gap``.
    """

    centroids: np.ndarray
    members: list[list[int]]
    near: list[int]
    far: list[int]
    radius: list[float]
    gap: list[float]


def build_tree(centroids: np.ndarray) -> Tree:
    """A vantage-point tree over the rows of ``centroids`` (integers); equal centroids are allowed."""
    tree = Tree(centroids, [], [], [], [], [])

    def add(rows: list[int]) -> int:
        node = len(tree.members)
        tree.members.append(rows if len(rows) <= LEAF else rows[:1])
        tree.near.append(-1)
        tree.far.append(-1)
        tree.radius.append(0.0)
        tree.gap.append(0.0)
        if len(rows) > LEAF:
            rest = np.array(rows[1:])
            away = np.sqrt(((centroids[rest] - centroids[rows[0]]) ** 2).sum(axis=1).astype(np.float64))
            order = np.argsort(away, kind="stable")
            half = len(order) // 2
            inside, outside = order[:half], order[half:]
            tree.radius[node], tree.gap[node] = float(away[inside].max()), float(away[outside].min())
            tree.near[node] = add([int(c) for c in rest[inside]])
            tree.far[node] = add([int(c) for c in rest[outside]])
        return node

    if len(centroids):
        add(list(range(len(centroids))))
    return tree


def assign(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid (ties: the smaller number), by best-first search.

    All vectors search at once, each with its own open nodes: in a step every vector still searching opens the node
    with its least bound, and vectors that opened the same node are compared with its centroids together.
    """
    n, nodes = len(vectors), len(tree.members)
    best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
    cluster = np.full(n, len(tree.centroids), dtype=np.int32)
    bound = np.full((n, nodes), np.inf)
    bound[:, 0] = 0.0
    searching = np.arange(n)
    while len(searching):
        node = bound[searching].argmin(axis=1)
        least = bound[searching, node]
        # rounding is far below this margin, so a centroid at exactly the best distance is never pruned
        reach = np.sqrt(best[searching].astype(np.float64)) * (1 + 1e-9) + 1e-6
        going = least <= reach
        searching, node, least = searching[going], node[going], least[going]
        bound[searching, node] = np.inf
        for v in np.unique(node):
            here = node == v
            rows, low = searching[here], least[here]
            for c in tree.members[v]:
                away = vectors[rows] - tree.centroids[c]
                squared = np.einsum("ij,ij->i", away, away)
                better = (squared < best[rows]) | ((squared == best[rows]) & (c < cluster[rows]))
                best[rows[better]] = squared[better]
                cluster[rows[better]] = c
            if tree.near[v] >= 0:
                length = np.sqrt(squared.astype(np.float64))
                bound[rows, tree.near[v]] = np.maximum(low, length - tree.radius[v])
                bound[rows, tree.far[v]] = np.maximum(low, tree.gap[v] - length)
    return cluster, best


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column("point").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def integer_points(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(vec_id, point): floor(scale * x) of vectors with ``width`` components, none of them null, infinite or NaN."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col)
    usable = F.col("vector").isNotNull() & (F.size("vector") == width) & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("point", lambda x: F.abs(x) < LARGEST)
    point = F.when(small, F.transform("point", lambda x: x.cast("int"))).otherwise(
        F.raise_error(F.lit(f"a scaled component is {LARGEST} or more: its distances would not fit a long")))
    kept = rows.filter(F.coalesce(usable, F.lit(False))).select("vec_id", scaled.alias("point"))
    return kept.select("vec_id", point.alias("point"))


def first_centroids(points: DataFrame, k: int) -> np.ndarray:
    """The k points with the smallest sha256 of ``1:<vec_id>`` (ties: by components), in that order."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.withColumn("name", name).orderBy("name", "point").limit(k).collect()
    return np.array([r["point"] for r in rows], dtype=np.int64)


def _partial_sums(points: DataFrame, tree: Tree) -> DataFrame:
    """(cluster, part, total): per task and cluster the sum of each component, and the count as part -1."""
    k, width = tree.centroids.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), dtype=np.int64)
        for _, block in _blocks(batches, width):
            cluster, _distance = assign(tree, block)
            for c in np.unique(cluster):
                own = block[cluster == c]
                sums[c, :width] += own.sum(axis=0)
                sums[c, width] += len(own)
        used = np.flatnonzero(sums[:, width])
        part = np.append(np.arange(width), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1), pa.int32()), pa.array(np.tile(part, len(used)), pa.int32()), pa.array(sums[used].ravel())],
            names=["cluster", "part", "total"])

    return points.select("point").mapInArrow(fold, "cluster int, part int, total long")


def _next_centroids(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Non-empty centroids replaced by floor(sum / count) of their points; k x (width + 1) sums reach the driver."""
    sums = _partial_sums(points, build_tree(centroids)).groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    total = {(r["cluster"], r["part"]): r["total"] for r in sums}
    moved = centroids.copy()
    for c in range(len(centroids)):
        if (c, -1) in total:
            moved[c] = [total[c, p] // total[c, -1] for p in range(centroids.shape[1])]
    return moved


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector after ``rounds`` rounds, and the final integer centroids.

    Only vectors with exactly ``width`` components, none null, NaN or infinite, take part; the others have no row.  Each
    component x becomes floor(scale * x).  Repeated rows and ids count as often as they stand there; a null id is
    hashed as an empty text.  With fewer than k usable vectors each is a centroid, with none the result is empty.
    Distances are squared, ties go to the smaller centroid number, empty centroids stay.  Other columns of ``vectors``
    play no part.  A scaled component of 2^27 or more ends the job with an error, as its distances need not fit a long.
    """
    points = cut(integer_points(vectors, id_col, vector_col, width, scale))
    id_type = points.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(points, k)
    if not len(centroids):
        return points.selectExpr("vec_id", "cast(null as int) cluster", "cast(null as long) distance"), centroids
    for _ in range(rounds):
        centroids = _next_centroids(points, centroids)
    tree = build_tree(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, width):
            cluster, distance = assign(tree, block)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    return cut(points.mapInArrow(label, f"vec_id {id_type}, cluster int, distance long")), centroids


def with_inertia(labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``labelled`` with its cluster's and the whole inertia and the digest of its centroid (k rows are broadcast)."""
    per = {r["cluster"]: int(r["s"]) for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest())
            for c, row in enumerate(centroids) if c in per]
    small = labelled.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
