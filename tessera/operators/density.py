"""Density clustering on the 2-D embedding (M6a-M6h).

core distance (M6a)     distance to the ``min_samples``-th other point: the
                        counted-tree k-NN join of ``neighbors.knn``.
mutual reachability     max(core_u, core_v, d(u, v)) on neighbour pairs (M6b).
metric (M6h)            euclidean and manhattan directly; cosine as
                        Euclidean on unit vectors (same order), reported as
                        1 - cos = d^2 / 2.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut, release
from tessera.operators import tree
from tessera.operators.condense import LIMIT, condensed_tree, label_points, select_clusters
from tessera.operators.neighbors import knn

XY = ("emb_x", "emb_y")
#: Leaves' worth of points in one cell of the first step of the spanning tree.
CELL = 8
L1 = ("manhattan", "l1", "cityblock")


def metric_space(df: DataFrame, coords: Sequence[str], metric: str) -> tuple[DataFrame, tuple[str, ...], str]:
    """Coordinates in which the tree search runs, and its metric."""
    if metric in ("euclidean", "l2"):
        return df, tuple(coords), "euclidean"
    if metric in ("manhattan", "l1", "cityblock"):
        return df, tuple(coords), "manhattan"
    if metric == "cosine":
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in coords[1:]), F.col(coords[0]) * F.col(coords[0])))
        # the origin has no direction: it stays at the origin, at distance 1/2 from every other point
        unit = {f"__u_{c}": F.when(norm > 0, F.col(c) / norm).otherwise(F.lit(0.0)) for c in coords}
        return df.withColumns(unit), tuple(unit), "euclidean"
    raise ValueError(f"Unknown metric: {metric}")


def neighbour_pairs(df: DataFrame, k: int, coords: Sequence[str] = XY, id_col: str = "id",
                    metric: str = "euclidean") -> DataFrame:
    """``(u, rank, v, dist)``: the k nearest other points of every point."""
    pts, cs, grid_metric = metric_space(df.select(id_col, *coords), coords, metric)
    cosine = metric == "cosine"
    res = knn(pts.select(id_col, *cs), pts.select(id_col, *cs), k, cs, id_col, (), grid_metric, exclude_self=True, squared=cosine)
    # half the squared distance as measured, to the last digit what the spanning tree weighs: a root squared again breaks ties
    return res.select(F.col("probe_id").alias("u"), "rank", F.col("match_id").alias("v"),
                      (F.col("dist") / F.lit(2.0) if cosine else F.col("dist")).alias("dist"))


def core_distances(df: DataFrame, min_samples: int = 3, coords: Sequence[str] = XY, id_col: str = "id",
                   metric: str = "euclidean") -> DataFrame:
    """``(id, core_dist)``."""
    nb = neighbour_pairs(df, min_samples, coords, id_col, metric)
    return nb.where(F.col("rank") == min_samples).select(F.col("u").alias(id_col), F.col("dist").alias("core_dist"))


def mutual_reachability(df: DataFrame, min_samples: int = 3, coords: Sequence[str] = XY, id_col: str = "id",
                        metric: str = "euclidean") -> DataFrame:
    """M6b on the neighbour pairs: ``(u, v, dist, mreach)``."""
    nb = cut(neighbour_pairs(df, min_samples, coords, id_col, metric))
    core = nb.where(F.col("rank") == min_samples).select(F.col("u").alias("_id"), F.col("dist").alias("_core"))
    j = (nb.join(core.withColumnRenamed("_id", "u").withColumnRenamed("_core", "core_u"), "u")
           .join(core.withColumnRenamed("_id", "v").withColumnRenamed("_core", "core_v"), "v"))
    return j.select("u", "v", "dist", F.greatest("core_u", "core_v", "dist").alias("mreach"))


# --------------------------------------------------------------------------- spanning tree

def _reported(gap, metric: str):
    """Grid distance in reported units: 1 - cos = d^2 / 2 on unit vectors."""
    return gap * gap / F.lit(2.0) if metric == "cosine" else gap


def _leaving_edges(metric: str, coords: Sequence[str]):
    """The lightest edge from each component of the left points to a right point of another component."""

    def lightest(p: pa.Table, c: pa.Table) -> pa.Table:
        pid, cid, pcomp, ccomp = (t.column(x).to_numpy() for x in ("id", "comp") for t in (p, c))
        weight = tree.distances(tree.matrix(p, coords), tree.matrix(c, coords), "manhattan" if metric in L1 else "euclidean")
        if metric == "cosine":
            weight = weight / 2.0
        elif metric not in L1:
            weight = np.sqrt(weight)
        weight = np.maximum(weight, p.column("core").to_numpy()[:, None])
        weight = np.maximum(weight, c.column("core").to_numpy()[None, :])
        weight[pcomp[:, None] == ccomp[None, :]] = np.inf
        least = weight.min(axis=1, initial=np.inf)
        row, col = np.nonzero((weight == least[:, None]) & np.isfinite(weight))
        lo, hi = np.minimum(pid[row], cid[col]), np.maximum(pid[row], cid[col])
        order = np.lexsort((hi, lo, weight[row, col], pcomp[row]))
        comp = pcomp[row][order]
        first = order[np.concatenate([[True], comp[1:] != comp[:-1]])] if len(order) else order
        return pa.table({"comp": pcomp[row[first]], "w": weight[row[first], col[first]], "lo": lo[first], "hi": hi[first]})

    return lightest


_EDGES = "comp long, w double, lo long, hi long"


def _best_foreign_edges(cur: DataFrame, coords: Sequence[str], level: int, metric: str) -> DataFrame:
    """Per component: the lightest mutual-reachability edge leaving it, first in the order (w, smaller id, larger id).

    ``cur(id, comp, core, leaf, coords...)``.  Edges inside the leaves bound every component that shares a leaf with
    another one; then the rows of a leaf descend the tree together.  A pair of nodes is left out when both hold one
    and the same component, or when their gap or least core distance is above the component's bound; a node that
    holds another component lowers the bound of a component still without one.
    """
    grid = "manhattan" if metric in L1 else "euclidean"
    coords = list(coords)
    lightest = _leaving_edges(metric, coords)

    def inside(key: tuple, rows: pa.Table) -> pa.Table:
        comps = rows.column("comp").to_numpy()
        return lightest(rows, rows if (comps != comps[0]).any() else rows.slice(0, 0))

    own = cut(cur.groupBy("leaf").applyInArrow(inside, _EDGES))
    bound = own.groupBy("comp").agg(F.min("w").alias("reach"))
    state = cut(cur.join(bound, "comp", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
                .withColumn("scale", tree.scale_of(F.col("reach"))))
    again = cut if level else (lambda df: df)
    summary = lambda prefix: [F.min("core").alias(f"{prefix}core"), F.max("core").alias(f"{prefix}most"),
                              F.min("comp").alias(f"{prefix}first"), F.max("comp").alias(f"{prefix}last")]
    groups = again(state.groupBy("leaf", "scale").agg(F.max("reach").alias("reach"), *tree.box("g_", coords), *summary("g_")))
    leaves = again(state.groupBy(F.col("leaf").alias("b")).agg(F.count(F.lit(1)).alias("n"), *tree.box("n_", coords), *summary("n_")))
    kept = ["leaf", "scale", "reach", "g_core", "g_most", "g_first", "g_last", *[f"g_{e}_{c}" for c in coords for e in ("lo", "hi")]]
    single = F.col("g_first") == F.col("g_last")
    pairs = None
    for at in range(level, -1, -1):
        nodes = leaves if not at else leaves.groupBy(F.floor(F.col("b") / tree.FANOUT**at).alias("b")).agg(
            F.sum("n").alias("n"), *tree.merged_box("n_", coords), F.min("n_core").alias("n_core"), F.max("n_most").alias("n_most"),
            F.min("n_first").alias("n_first"), F.max("n_last").alias("n_last"))
        if pairs is None:  # at most TOP nodes
            met = groups.withColumn("one", F.lit(1)).join(nodes.withColumn("one", F.lit(1)), "one")
        else:
            children = pairs.drop("n", "low").withColumn("b", F.explode(F.sequence(F.col("b") * tree.FANOUT, F.col("b") * tree.FANOUT + tree.FANOUT - 1)))
            met = children.join(nodes, "b")
        same = single & (F.col("n_first") == F.col("n_last")) & (F.col("g_first") == F.col("n_first"))
        low = F.greatest(_reported(tree.nearest_gap("g_", "n_", coords, grid), metric), "g_core", "n_core")
        met = met.where(~same).withColumn("low", low).where(F.col("low") <= F.col("reach") * tree.MARGIN)
        # a single component without a bound yet: some pair of points of these two nodes is an edge of at most this weight
        top = F.greatest(_reported(tree.farthest_gap("g_", "n_", coords, grid), metric), "g_most", "n_most")
        met = again(met.withColumn("top", F.when(single, top).otherwise(F.lit(float("inf")))))
        tight = met.where(F.isnan("reach") | (F.col("reach") == float("inf"))).groupBy("g_first").agg(F.min("top").alias("tight"))
        pairs = (met.join(tight, "g_first", "left").withColumn("reach", F.least("reach", F.coalesce("tight", F.lit(float("inf")))))
                 .where(F.col("low") <= F.col("reach") * tree.MARGIN).select(*kept, "b", "n", "low"))
    key = ["leaf", "scale"]
    open_pairs = cut(tree.dealt(pairs.where(F.col("b") != F.col("leaf")), key, "n", "low"))
    others = state.select(F.col("leaf").alias("b"), F.col("id").alias("c_id"), F.col("comp").alias("c_comp"), F.col("core").alias("c_core"),
                          *[F.col(c).alias(f"c_{c}") for c in coords])
    gap = _reported(tree.point_gap("c_", "g_", coords, grid), metric)
    halo = (open_pairs.drop("n", "low").join(others, "b")
            .where(F.greatest(gap, "c_core", "g_core") <= F.col("reach") * tree.MARGIN)
            .where(~(single & (F.col("c_comp") == F.col("g_first"))))
            .select(*[F.col(c).alias(f"h_{c}") for c in [*key, "batch"]],
                    *[F.col(f"c_{c}").alias(c) for c in ("id", "comp", "core", *coords)]))
    asked = state.select(*key, "id", "comp", "core", *coords).join(open_pairs.select(*key, "batch").distinct(), key)

    def across(key: tuple, p: pa.Table, c: pa.Table) -> pa.Table:
        return lightest(p, c)

    met = asked.groupBy(*key, "batch").cogroup(halo.groupBy(*[f"h_{c}" for c in [*key, "batch"]])).applyInArrow(across, _EDGES)
    best = cut(own.unionByName(met).groupBy("comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")))
    release(own, state, groups, leaves, open_pairs)
    return best


def _cell_tree(ids: np.ndarray, x: np.ndarray, core: np.ndarray, metric: str) -> list[tuple[float, int, int]]:
    """(w, row, row) of the spanning tree of one cell (Prim, one row of distances at a time), not sorted."""
    n = len(ids)
    least, via, outside = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    at, edges = 0, []
    while True:
        outside[at] = False
        weight = tree.distances(x[at : at + 1], x, "manhattan" if metric in L1 else "euclidean")[0]
        weight = weight / 2.0 if metric == "cosine" else weight if metric in L1 else np.sqrt(weight)
        weight = np.maximum(np.maximum(weight, core[at]), core)
        # of two equal edges to the same point the one from the smaller id comes first
        better = outside & ((weight < least) | ((weight == least) & np.isfinite(weight) & (ids[at] < ids[via])))
        least[better], via[better] = weight[better], at
        least[at] = np.inf
        low = least.min()
        if np.isfinite(low):
            tied = np.nonzero(least == low)[0]
            if len(tied) > 1:
                ends = ids[tied], ids[via[tied]]
                tied = tied[np.lexsort((np.maximum(*ends), np.minimum(*ends)))]
            at = tied[0]
            edges.append((float(low), int(via[at]), int(at)))
        elif outside.any():  # at no finite distance from the others
            at = np.argmax(outside)
        else:
            return edges


def _sure_edges(coords: Sequence[str], metric: str):
    """Edges of a cell's spanning tree that belong to the whole one, and the component of each point under them.

    Edges of the cell are taken in order.  One that joins A and B is the lightest edge inside the cell that leaves A,
    and B; if it is lighter than any edge from A, or from B, to the outside can be, it is in the whole tree.
    Out: (u, v, w) of an edge, or a point u with its component (``comp``, the smallest id).
    """

    def run(table: pa.Table) -> pa.Table:
        ids, core, gap = (table.column(c).to_numpy() for c in ("id", "core", "gap"))
        beyond = gap / tree.MARGIN
        beyond = np.maximum(beyond * beyond / 2.0 / tree.MARGIN if metric == "cosine" else beyond, core)
        order = []
        for w, a, b in _cell_tree(ids, tree.matrix(table, coords), core, metric):
            lo, hi = sorted((int(ids[a]), int(ids[b])))
            order.append((w, lo, hi, a, b))
        order.sort()
        whole, sure, bound = list(range(len(ids))), list(range(len(ids))), beyond.tolist()
        out = []

        def root(parent: list[int], i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for w, lo, hi, a, b in order:
            x, y = root(whole, a), root(whole, b)
            if w < bound[x] or w < bound[y]:
                out.append((lo, hi, w))
                p, q = root(sure, a), root(sure, b)
                p, q = (p, q) if ids[p] < ids[q] else (q, p)
                sure[q] = p  # the smallest id is the root
            whole[y] = x
            bound[x] = min(bound[x], bound[y])
        u, v, weight = list(zip(*out)) or [[]] * 3
        comp = [int(ids[root(sure, i)]) for i in range(len(ids))]
        none = [None] * len(ids)
        return pa.table([pa.array([*u, *ids.tolist()], pa.int64()), pa.array([*v, *none], pa.int64()),
                         pa.array([*weight, *none], pa.float64()), pa.array([None] * len(out) + comp, pa.int64())], names=["u", "v", "w", "comp"])

    return run


def _edges_in_cells(base: DataFrame, coords: Sequence[str], metric: str, n: int, rows: int) -> DataFrame:
    """Spanning-tree edges found inside boxes that tile the plane, of about ``rows`` points: see ``_sure_edges``.

    Strips between quantiles of the first coordinate are cut at quantiles of the second within each strip.  What lies
    outside a box is at least as far from a point as the nearest side (``gap``).  A box that holds far more points
    than meant, as copies cannot be cut apart, is left to the rounds.
    """
    x, *more = coords[:2]
    parts = max(1, -(-n // rows))
    strips = max(1, math.isqrt(parts)) if more else parts
    shares = lambda k: [i / k for i in range(1, k)]
    dealt = base.withColumn("strip", F.lit(0)).withColumn("gap", F.lit(float("inf")))
    below = lambda marks, c: F.size(F.filter(marks, lambda m: m <= F.col(c)))

    def cut_at(df: DataFrame, marks, c: str, place: str) -> DataFrame:
        """``place`` of each row between ``marks``, and its distance to the sides."""
        df = df.withColumn(place, below(marks, c))
        left = F.when(F.col(place) > 0, F.col(c) - F.get(marks, F.col(place) - 1))
        return df.withColumn("gap", F.least("gap", left, F.get(marks, F.col(place)) - F.col(c)))

    if strips > 1:
        marks = base.agg(F.percentile_approx(x, shares(strips), 2000)).first()[0]
        dealt = cut_at(dealt, F.array(*[F.lit(float(m)) for m in marks]), x, "strip")
    key = ["strip"]
    pieces = -(-parts // strips)
    if more and pieces > 1:
        sides = dealt.groupBy("strip").agg(F.percentile_approx(more[0], shares(pieces), 2000).alias("sides"))
        dealt = cut_at(dealt.join(F.broadcast(sides), "strip"), F.col("sides"), more[0], "piece").drop("sides")
        key.append("piece")
    dealt = cut(dealt)
    fit = dealt.groupBy(*key).count().where(F.col("count") <= 4 * rows).drop("count")
    return dealt.join(fit, key).select(*key, "id", "core", "gap", *coords).groupBy(*key).applyInArrow(
        _sure_edges(coords, metric), "u long, v long, w double, comp long")


def _merge_components(cur: DataFrame, best: DataFrame) -> DataFrame:
    """Relabel points after a Borůvka round.

    Each component hooks onto the component at the other end of its chosen
    edge.  With a total edge order the hooks form trees plus 2-cycles (two
    components choosing the same edge); the smaller id of a 2-cycle becomes
    the root.  Pointer jumping (P = P o P) then finds every root in
    few joins.
    """
    ends = best.select("comp", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))
    cl = cur.select(F.col("id").alias("lo"), F.col("comp").alias("c_lo"))
    ch = cur.select(F.col("id").alias("hi"), F.col("comp").alias("c_hi"))
    hook = (ends.join(cl, "lo").join(ch, "hi")
                .select("comp", F.when(F.col("c_lo") == F.col("comp"), F.col("c_hi")).otherwise(F.col("c_lo")).alias("p")))
    back = hook.select(F.col("comp").alias("p"), F.col("p").alias("pp"))
    par = (hook.join(back, "p", "left")
               .select("comp", F.when((F.col("pp") == F.col("comp")) & (F.col("comp") < F.col("p")), F.col("comp"))
                       .otherwise(F.col("p")).alias("p"))).transform(cut)
    while True:  # pointers halve their distance to the root each time, three times a pass
        nxt = par
        for _ in range(3):
            nxt = (nxt.alias("a").join(par.alias("b"), F.col("a.p") == F.col("b.comp"), "left")
                      .select(F.col("a.comp").alias("comp"), F.coalesce(F.col("b.p"), F.col("a.p")).alias("p"),
                              (F.coalesce(F.col("b.p"), F.col("a.p")) != F.col("a.p")).alias("moved")))
        nxt = nxt.transform(cut)
        moved = not nxt.where("moved").isEmpty()
        par = nxt.select("comp", "p")
        if not moved:
            break
    return (cur.join(par, "comp", "left")
               .select("id", F.coalesce("p", "comp").alias("comp"), *[c for c in cur.columns if c not in ("id", "comp")]))


def mst_edges(df: DataFrame, min_samples: int = 3, coords: Sequence[str] = XY, id_col: str = "id",
              metric: str = "euclidean", capacity: int = tree.CAPACITY) -> DataFrame:
    """Minimum spanning tree of the mutual-reachability graph (Borůvka).

    ``(u, v, w)`` with u < v, n - 1 rows for n points with unique long ids.
    Edges that one cell of the plane can vouch for come first
    (``_edges_in_cells``).  Then each round every component takes its
    lightest leaving edge (descent of the counted tree with component
    summaries), the chosen edges join components, and points take their new
    component label.  At most log2(n) rounds.  Edge order (weight, min id,
    max id) makes the tree unique.
    ``capacity`` bounds the rows of a leaf and changes no result.
    """
    df = cut(df.select(id_col, *coords))
    pts, cs, _ = metric_space(df, coords, metric)
    core = cut(core_distances(df, min_samples, coords, id_col, metric).where(F.col(id_col).isNotNull())
               .select(F.col(id_col).cast("long").alias("id"), F.col("core_dist").alias("core")))
    base = cut(pts.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in cs]).join(core, "id"))
    n = base.count()
    unique = n == core.count()  # an id that repeats meets itself in the join
    if not unique:  # copies are one point; an id at several places is left to the rounds
        base = cut(base.distinct())
        n = base.count()
        unique = n == base.select("id").distinct().count()
    found: list[DataFrame] = []
    left = n
    labelled = base.withColumn("comp", F.col("id"))
    if n and unique:
        cells = cut(_edges_in_cells(base, cs, metric, n, CELL * capacity))
        edges = cells.where("comp is null").select("u", "v", "w")
        found.append(edges)
        left -= edges.count()
        labelled = cut(base.join(cells.where("comp is not null").select(F.col("u").alias("id"), "comp"), "id", "left")
                       .withColumn("comp", F.coalesce("comp", "id"))) if left > 1 else base
    if left > 1:
        placed, _ = tree.with_leaves(labelled.withColumn("part", F.lit(0)), cs, "part", ["id"], capacity)
        level = tree.top_level(-(-n // capacity))
        cur = cut(placed.select("id", "comp", "core", "leaf", *cs))
    while left > 1:  # every round at least halves the components
        best = _best_foreign_edges(cur, cs, level, metric)
        edges = cut(best.select(F.col("e.lo").alias("u"), F.col("e.hi").alias("v"), F.col("e.w").alias("w")).distinct())
        joined = edges.count()
        if not joined:
            break
        found.append(edges)
        left -= joined
        nxt = cut(_merge_components(cur, best)) if left > 1 else None
        release(cur, best)
        cur = nxt
    out = found[0] if found else df.sparkSession.createDataFrame([], "u long, v long, w double")
    for t in found[1:]:
        out = out.unionByName(t)
    return out


# --------------------------------------------------------------------------- clusters (M6)

@dataclass
class DensityResult:
    labels: DataFrame  # id, emb coords, cluster
    tree: DataFrame  # u, v, w
    clusters: DataFrame  # condensed clusters, see condense.Condensed, with the selected cluster that holds each (owner)
    relative_validity: float


def hdbscan(df: DataFrame, min_cluster_size: int = 500, min_samples: int = 3, method: str = "eom",
            epsilon: float = 0.01, metric: str = "euclidean", coords: Sequence[str] = XY, id_col: str = "id",
            limit: int = LIMIT) -> DensityResult:
    """M6: labels 0.. (numbered by smallest member id), noise -1."""
    whole = df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    keyed = df.select(F.col(id_col).alias("__id"), *coords)
    keyed = keyed.withColumn("id", F.col("__id") if whole else F.monotonically_increasing_id()).transform(cut)
    pts = keyed.select("id", *coords)
    edges = cut(mst_edges(pts, min_samples, coords, "id", metric))
    condensed = condensed_tree(edges, pts, min_cluster_size, limit)
    owners = select_clusters(condensed, method, epsilon)
    labels = label_points(condensed, owners, pts)
    from tessera.operators.evaluate import relative_validity

    rv = relative_validity(edges, labels.select("id", "cluster"))
    if not whole:  # ids of any type: the search ran on a written long key
        labels = labels.join(keyed.select("id", "__id"), "id").drop("id").withColumnRenamed("__id", "id")
    return DensityResult(labels.withColumnRenamed("id", id_col), edges, condensed.nodes.join(owners, "node"), rv)


def hdbscan_labels(df: DataFrame, **kw) -> DataFrame:
    return hdbscan(df, **kw).labels
