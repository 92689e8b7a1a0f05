"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged.

Equal vectors are one node (with as many of its smallest ids as an answer can need), nodes are dealt to shards by a
hash, and each shard's hierarchical graph is stored as flat neighbour arrays.  Every query searches every shard, and
the nearest rows over all shards remain.  Found rows are scored on the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import mix64, pick

#: Vectors of a shard (on average), links of a node (twice as many on the lowest layer), beam widths.
SHARD_ROWS, LINKS, BUILD_BEAM, SEARCH_BEAM = 2048, 12, 48, 96
#: Queries that search a shard at once.
BLOCK_QUERIES = 2048
BATCH = 256


def squared(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    apart = vectors[ids] - queries[rows]
    return np.einsum("ij,ij->i", apart, apart)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: ids and squared distances of the nearest found, in order (-1: none)."""
    count = len(queries)
    every = np.arange(count)[:, None]
    seen = np.zeros((count, len(vectors) + 1), dtype=bool)  # the last column takes the -1 of missing links
    seen[:, -1] = True
    ids = np.full((count, max(width, entry.shape[1])), -1, dtype=np.int64)
    far = np.full(ids.shape, np.inf)
    ids[:, : entry.shape[1]] = entry
    row, column = np.nonzero(ids >= 0)
    far[row, column] = squared(vectors, ids[row, column], queries, row)
    seen[row, ids[row, column]] = True
    done = ids < 0
    while True:
        open_far = np.where(done, np.inf, far)
        take = np.argpartition(open_far, min(step, ids.shape[1]) - 1, axis=1)[:, :step]
        live = np.isfinite(np.take_along_axis(open_far, take, 1))
        if not live.any():
            break
        np.put_along_axis(done, take, True, 1)
        near = links[np.take_along_axis(ids, take, 1)]
        near[~live] = -1
        near = np.sort(near.reshape(count, -1), axis=1)
        fresh = ~seen[every, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(fresh)
        found = near[row, column]
        seen[row, found] = True
        more = np.full(near.shape, np.inf)
        more[row, column] = squared(vectors, found, queries, row)
        ids, far, done = np.hstack([ids, np.where(fresh, near, -1)]), np.hstack([far, more]), np.hstack([done, ~fresh])
        best = np.argpartition(far, width - 1, axis=1)[:, :width]
        ids, far, done = (np.take_along_axis(x, best, 1) for x in (ids, far, done))
    order = np.lexsort((ids, far), axis=1)
    return np.take_along_axis(ids, order, 1)[:, :width], np.take_along_axis(far, order, 1)[:, :width]


def diverse(vectors: np.ndarray, candidates: np.ndarray, far: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (by distance) those no nearer to a kept one than to the node, then the nearest others."""
    out = np.full((len(candidates), links), -1, dtype=np.int64)
    step = max(1, (2 << 20) // max(1, candidates.shape[1] ** 2))
    for a in range(0, len(candidates), step):
        c, d = candidates[a : a + step], far[a : a + step]
        v = vectors[c]
        norm = np.einsum("bij,bij->bi", v, v)
        pair = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        kept = np.zeros(c.shape, dtype=bool)
        for j in range(c.shape[1]):
            kept[:, j] = (c[:, j] >= 0) & (kept.sum(1) < links) & ~(kept & (pair[:, j] < d[:, j, None])).any(1)
        order = np.lexsort((d, ~kept, c < 0), axis=1)[:, :links]
        out[a : a + step, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


class Graph:
    """A hierarchical graph over the rows of ``vectors``; ``layers[k]`` holds each node's links on layer k."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    @classmethod
    def build(cls, vectors: np.ndarray, keys: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """``keys`` decide the order and layer of the nodes, so that a rebuilt shard is the same."""
        n = len(vectors)
        draw = (mix64(keys.astype(np.uint64) ^ np.uint64(0x5DEECE66D)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(np.int64), 6)
        order = np.lexsort((mix64(keys.astype(np.uint64)), -level))  # high layers first: the entry never changes
        layers = [np.full((n, links * (1 if k else 2)), -1, dtype=np.int64) for k in range(int(level.max()) + 1)]
        graph = cls(vectors, layers, int(order[0]))
        done = 0
        while done < n:
            batch = order[done : done + min(BATCH, max(16, done))]
            entry = np.full((len(batch), 1), graph.entry, dtype=np.int64)
            for k in reversed(range(len(layers))):
                here = level[batch] >= k
                ids, far = beam_search(vectors, layers[k], vectors[batch], entry, beam if here.any() else 4) if done else (np.full((len(batch), 1), -1), np.full((len(batch), 1), np.inf))
                if done:
                    entry = ids[:, :8]
                if here.any():
                    graph._link(k, batch[here], ids[here], far[here])
            done += len(batch)
        return graph

    def _link(self, k: int, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        """Links new nodes on layer k to what the search found and to each other."""
        table, v = self.layers[k], self.vectors
        norm = np.einsum("ij,ij->i", v[nodes], v[nodes])
        mates = np.maximum(norm[:, None] + norm[None] - 2 * v[nodes] @ v[nodes].T, 0)
        np.fill_diagonal(mates, np.inf)
        mate_ids = np.where(np.isfinite(mates), nodes[None], -1)
        ids, far = self._nearest(np.hstack([ids, mate_ids]), np.hstack([far, mates]), 2 * table.shape[1])
        chosen = diverse(v, ids, far, table.shape[1] if k else table.shape[1] // 2)
        table[nodes, : chosen.shape[1]] = chosen
        row, column = np.nonzero(chosen >= 0)
        target, source = chosen[row, column], nodes[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        hubs, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(hubs), count.max() if len(hubs) else 0), -1, dtype=np.int64)
        more[np.repeat(np.arange(len(hubs)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.sort(np.hstack([table[hubs], more]), axis=1)[:, ::-1].copy()
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        apart = np.full(both.shape, np.inf)
        row, column = np.nonzero(both >= 0)
        apart[row, column] = squared(v, both[row, column], v[hubs], row)
        ids, far = self._nearest(both, apart, 3 * table.shape[1])
        table[hubs] = diverse(v, ids, far, table.shape[1])

    @staticmethod
    def _nearest(ids: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, far), axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def search(self, queries: np.ndarray, width: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for k in reversed(range(1, len(self.layers))):
            entry = beam_search(self.vectors, self.layers[k], queries, entry, 8)[0]
        return beam_search(self.vectors, self.layers[0], queries, entry, width)


def usable(vector: str = "vector"):
    """Whether a vector has components, all finite, and not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0)


def build_shards(rows: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """One row per shard: its vectors, ids and flat neighbour arrays.  ``rows``: vec_id and vector.  Written."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    # an answer of k rows without the query's own needs k + 1 ids of equal vectors at most
    nodes = cut(rows.distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    keyed = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("dim", F.size("vector"))

    def build(table: pa.Table) -> pa.Table:
        members = table.column("ids").combine_chunks()
        first = np.array([x[0] for x in members.to_pylist()], dtype=np.int64)
        order = np.argsort(first, kind="stable")
        table = table.take(pa.array(order))
        members = table.column("ids").combine_chunks()
        vectors = np.asarray(table.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
        graph = Graph.build(vectors, first[order])
        sizes = np.array([len(x) for x in members], dtype=np.int32)
        ids = np.asarray(members.flatten(), dtype=np.int64)
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([vectors.shape[1]], pa.int32()), "entry": pa.array([graph.entry], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "widths": pa.array([[x.shape[1] for x in graph.layers]], pa.list_(pa.int32())), "neighbours": pa.array([[x.astype(np.int32).tobytes() for x in graph.layers]], pa.list_(pa.binary())),
        })

    return cut(keyed.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, entry int, vectors binary, ids binary, sizes binary, widths array<int>, neighbours array<binary>"))


def nearest_rows(embeddings: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, width: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of ``embeddings`` found for each row of ``queries``: query_id, rank, vec_id, score.

    The score is the Euclidean distance; ties go to the smaller id, and a row with the query's id is no candidate.
    Vectors that are null, empty, zero or hold null or non-finite components take no part on either side, nor do rows
    without an id; vectors of another length are no candidates.  Repeated rows count once.  Fewer candidates than k
    are all returned; empty tables give no rows.
    """
    shape = lambda df: pick(df, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).filter(usable() & F.col("vec_id").isNotNull())
    graphs = build_shards(shape(embeddings), k, shard_rows)
    asked = cut(shape(queries).distinct())
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    where = graphs.select((F.col("shard") + 0).alias("to_shard"), (F.col("dim") + 0).alias("dim"))
    # a query block and a shard meet under one key; neither outgrows its bound
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vector")).join(where, "dim")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key: tuple, ask: pa.Table, have: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not ask.num_rows or not have.num_rows:
            return none
        g = have.to_pylist()[0]
        vectors = np.frombuffer(g["vectors"]).reshape(-1, g["dim"])
        layers = [np.frombuffer(x, dtype=np.int32).reshape(-1, w).astype(np.int64) for x, w in zip(g["neighbours"], g["widths"], strict=True)]
        graph = Graph(vectors, layers, g["entry"])
        sizes = np.frombuffer(g["sizes"], dtype=np.int32).astype(np.int64)
        ids, first = np.frombuffer(g["ids"], dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
        asked_ids = np.asarray(ask.column("vec_id"), dtype=np.int64)
        points = np.asarray(ask.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(len(asked_ids), -1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(asked_ids), BATCH):
            nodes, _ = graph.search(points[a : a + BATCH], max(width, k + 1))
            row, column = np.nonzero(nodes >= 0)
            node = nodes[row, column]
            score = np.sqrt(squared(vectors, node, points[a : a + BATCH], row))
            times = sizes[node]
            row, score = np.repeat(row, times) + a, np.repeat(score, times)
            found = ids[np.repeat(first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            other = found != asked_ids[row]
            row, score, found = row[other], score[other], found[other]
            order = np.lexsort((found, score, row))
            row, score, found = row[order], score[order], found[order]
            start = np.searchsorted(row, row)
            top = np.arange(len(row)) - start < k
            out.append((asked_ids[row[top]], found[top], score[top]))
        return pa.table({"query_id": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = asked.groupBy("to_shard", "dim", "block").cogroup(copies.groupBy("shard", "dim", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
