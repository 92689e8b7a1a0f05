"""Geometric joins on low-dimensional points.

All of them are equi-joins on grid cells or tree nodes, never a cross join:

* ``ball_pairs``: cell side = ε.  A point within ε of another lies in one of
  the 3^d cells around it.  Every two such cells meet once, a bounded chunk of
  the one with a bounded batch of the other's points; the exact closed-ball
  pairs leave in runs ordered by distance, which columnar files pack well.
* ``knn``: on the counted tree of ``tree.py``.  Every probe first meets the
  candidates of its own leaf; that list bounds how far better ones can be.
  Probes of a leaf with about the same reach descend the tree together, down
  to the leaves whose boxes the reach touches, meet the candidates there that
  lie within it, and the short lists are merged by a ranked window.  How much
  a probe meets depends on the counts around it, not on the extent of the
  data or on one far point.  Of candidates at one location only the k + 1
  smallest ids take part, as no other can be in a list.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import l1_dist, sq_dist
from tessera.functions.persist import cut, release
from tessera.operators import tree


#: Points of a cell that meet others at once, others that they meet in one group, distances measured at once, pairs
#: ordered at once, rows handed on at once, distances measured in one partition.
CHUNK, MET, TILE, PAIRS, ROWS, WORK = 4096, 1 << 16, 1 << 18, 1 << 20, 1 << 16, 1 << 27


def _dist_expr(a: Sequence[Column], b: Sequence[Column], metric: str) -> Column:
    """Comparable distance: squared L2 for euclidean, L1 for manhattan."""
    if metric == "manhattan":
        return l1_dist(a, b)
    return sq_dist(a, b)


def _true_dist(c: Column, metric: str) -> Column:
    return c if metric == "manhattan" else F.sqrt(c)


def _order(keys: list[list[pa.Array]]) -> list[np.ndarray]:
    """Integers of the same order as several rows of key columns, nulls first, for both sides of each column."""
    joined, size = None, len(keys[0][0])
    for both in keys:
        every = pa.concat_arrays(both)
        if len(keys) == 1 and pa.types.is_integer(every.type) and not every.null_count:
            joined = every.to_numpy().astype(np.int64)
            break
        rank = pc.rank(every, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)  # NaN is last
        rank[every.is_null().to_numpy(zero_copy_only=False)] = 0
        joined = rank if joined is None else np.unique(joined * (rank.max(initial=0) + 1) + rank, return_inverse=True)[1]
    return [joined[:size], joined[size:]]


def _close(x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` at a squared distance of ``limit`` at most, and that distance, tile by tile."""
    rows, cols, dist = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    step = max(1, TILE // max(len(x), 1))
    for b in range(0, len(y), step):
        d2 = None
        for i in range(x.shape[1]):
            apart = y[b : b + step, i, None] - x[None, :, i]
            apart *= apart
            d2 = apart if d2 is None else np.add(d2, apart, out=d2)
        flat = np.flatnonzero(d2.ravel() <= limit)
        col, row = np.divmod(flat, len(x))
        rows.append(row)
        cols.append(col + b)
        dist.append(d2.ravel()[flat])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def ball_pairs(
    points: DataFrame,
    eps: float,
    coords: Sequence[str] = ("x", "y", "z"),
    id_col: str = "id",
    part_cols: Sequence[str] = (),
    order_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs within closed Euclidean distance ``eps`` in the same partition.

    Returns ``(part..., id_a, id_b, d2)`` once per unordered pair with
    ``(order_a, id_a) < (order_b, id_b)`` (``order_cols`` default: the id).

    A cell's points are dealt to chunks of about CHUNK; a chunk meets the points of its own cell and of the cells
    around it that come later, about MET in a group, so no group grows with a dense cell and each pair of points is
    measured once (twice within a cell).  The result has its own size, which grows with the square of the points: rows
    leave in runs of about PAIRS ordered by ``d2``, with the ids of few cells in a run, so that written columns of
    distances and ids take a dictionary and runs instead of eight bytes a value.
    """
    d = len(coords)
    part_cols = list(part_cols)
    order_cols = [c for c in (order_cols or []) if c != id_col]
    xs, cell = [f"x{i}" for i in range(d)], [f"g{i}" for i in range(d)]
    keys = [*[f"o{i}" for i in range(len(order_cols))], "id"]
    usable = F.lit(True)
    for c in part_cols:
        usable &= F.col(c).isNotNull()
    for c in coords:
        usable &= F.abs(F.col(c).cast("double")) < float("inf")  # NaN is above it
    side = eps * tree.MARGIN  # rounding never puts two cells between points at exactly ε
    pts = cut(points.where(usable).select(
        (F.struct(*part_cols) if part_cols else F.lit(0)).alias("part"), F.col(id_col).alias("id"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], *[F.col(c).cast("double").alias(x) for c, x in zip(coords, xs, strict=True)],
        *[F.floor(F.col(c).cast("double") / F.lit(side)).cast("long").alias(g) for c, g in zip(coords, cell, strict=True)]))
    cells = cut(pts.groupBy("part", *cell).agg(F.count(F.lit(1)).alias("n")).withColumn("no", F.monotonically_increasing_id()))
    later = [o for o in itertools.product((-1, 0, 1), repeat=d) if o >= (0,) * d]  # the cell itself comes first
    around = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(o).alias(g) for o, g in zip(off, cell, strict=True)]) for k, off in enumerate(later)])
    before = Window.partitionBy("no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    met = (cells.select("part", "no", F.ceil(F.col("n") / CHUNK).alias("chunks"), F.col("n").alias("mine"), F.explode(around).alias("at"), *cell)
           .select("part", "no", "chunks", "mine", "at.k", *[(F.col(g) + F.col(f"at.{g}")).alias(g) for g in cell])
           .join(cells.select("part", *cell, "n"), ["part", *cell])
           .withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / MET))
           .withColumn("batches", F.ceil(F.col("n") / MET)))
    met = cut(met)
    load = met.agg(F.sum(F.col("mine").cast("double") * F.col("n")), F.sum(F.col("n") * F.col("chunks"))).first()
    partitions = max(3 * points.sparkSession.sparkContext.defaultParallelism, math.ceil((load[0] or 0) / WORK), math.ceil((load[1] or 0) / PAIRS))
    homes = met.groupBy("no").agg(F.max(F.col("first") + F.col("batches")).alias("batches"))
    homes = cells.join(homes, "no").select("part", *cell, "no", F.ceil(F.col("n") / CHUNK).alias("chunks"), "batches")
    dealt = pts.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    shape = ["no", "chunk", "batch", "side", *(["part"] if part_cols else []), *keys, *xs]
    mine = (dealt.join(homes, ["part", *cell]).withColumn("chunk", F.pmod("deal", "chunks"))
            .withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1))).withColumn("side", F.lit(0)))
    theirs = (dealt.join(met, ["part", *cell]).withColumn("batch", F.col("first") + F.pmod("deal", "batches"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
              .withColumn("side", F.when(F.col("k") == 0, F.lit(1)).otherwise(F.lit(2))))
    group = ["no", "chunk", "batch"]
    tiles = mine.select(*shape).unionByName(theirs.select(*shape)).repartition(partitions, *group).sortWithinPartitions(*group, "side")
    limit = eps * eps
    named = [*(["part"] if part_cols else []), "id_a", "id_b", "d2"]

    def ordered(found: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        """The pairs found so far in the order of d2; the unordered ones are let go column by column."""
        columns = [list(c) for c in zip(*found, strict=True)]
        found.clear()
        by_d2 = pa.array(np.argsort(np.concatenate(columns[-1])))
        table = pa.table([pa.concat_arrays(columns.pop(0)).take(by_d2) for _ in named], names=named)
        yield from table.to_batches(max_chunksize=ROWS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, parts, found, count = None, [], [], 0
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy() for c in (*group, "side")])
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]) if len(at) else np.zeros(0, int)
            for first, last in zip(starts, np.append(starts[1:], len(at)), strict=True):
                rows = batch.slice(first, last - first)
                if tuple(at[first, :3]) != home:
                    home, parts = tuple(at[first, :3]), []
                if at[first, 3] == 0:  # the chunk of the group comes before those that it meets
                    parts.append(rows)
                    continue
                if not parts:
                    continue  # no point was dealt to that chunk
                if len(parts) > 1:
                    parts = [pa.Table.from_batches(parts).combine_chunks().to_batches()[0]]
                own = parts[0]
                x, y = (np.column_stack([t.column(c).to_numpy() for c in xs]) for t in (own, rows))
                reach = np.flatnonzero(((np.maximum(x.min(axis=0) - y, 0) + np.maximum(y - x.max(axis=0), 0)) ** 2).sum(axis=1) <= limit * tree.MARGIN)
                mine, others = _order([[own.column(c), rows.column(c)] for c in keys])
                ids = pa.concat_arrays([own.column("id"), rows.column("id")])
                step = max(1, PAIRS // len(x))
                for a in range(0, len(reach), step):
                    some = reach[a : a + step]
                    row, col, d2 = _close(x, y[some], limit)
                    col = some[col]
                    apart = mine[row] - others[col]
                    keep = np.flatnonzero(apart < 0 if at[first, 3] == 1 else apart != 0)
                    row, col, d2, swap = row[keep], col[keep] + len(x), d2[keep], apart[keep] > 0
                    if not len(row):
                        continue
                    found.append([*([own.column("part").take(pa.array(row))] if part_cols else []),
                                  ids.take(pa.array(np.where(swap, col, row))), ids.take(pa.array(np.where(swap, row, col))), pa.array(d2)])
                    count += len(row)
                    if count >= PAIRS:
                        yield from ordered(found)
                        count = 0
        if found:
            yield from ordered(found)

    id_type = pts.schema["id"].dataType.simpleString()
    part_type = f"part {pts.schema['part'].dataType.simpleString()}, " if part_cols else ""
    out = tiles.mapInArrow(meet, f"{part_type}id_a {id_type}, id_b {id_type}, d2 double")
    return out.select(*[F.col(f"part.{c}").alias(c) for c in part_cols], "id_a", "id_b", "d2")


def grid_scale(probes: DataFrame, candidates: DataFrame, coords: Sequence[str]) -> tuple[float, float]:
    """(initial cell side, data extent) from one aggregate over both inputs."""
    both = probes.select(*coords).unionByName(candidates.select(*coords))
    aggs = []
    for c in coords:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    row = both.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    n = row["n"] or 0
    spans = [max((row[f"hi_{c}"] or 0.0) - (row[f"lo_{c}"] or 0.0), 0.0) for c in coords]
    extent = max(spans + [1e-12])
    positive = [s for s in spans if s > 0] or [extent]
    vol = math.prod(positive)
    h0 = (vol / max(n, 1)) ** (1.0 / len(positive)) if vol > 0 else extent
    return max(min(h0, extent), extent * 1e-9), extent


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least finite values of each row, in order; ties by column."""
    kept = np.isfinite(near)
    if near.shape[1] > k:
        kept &= near <= np.partition(near, k - 1, axis=1)[:, k - 1][:, None]
    row, col = np.nonzero(kept)
    order = np.lexsort((col, near[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _meet(k: int, metric: str, coords: Sequence[str], exclude_self: bool):
    """The k best candidates of every probe of a group, and how far a better one could be."""

    def lists(probes: pa.Table, cands: pa.Table, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p_code, c_code = tree.codes(probes.column("id"), cands.column("id"))
        by_id = np.argsort(c_code, kind="stable")
        p, c = tree.matrix(probes, coords), tree.matrix(cands, coords)[by_id]
        rows, cols, far = [], [], []
        step = max(1, (1 << 21) // max(len(c), 1))
        for start in range(0, len(p), step):
            near = tree.distances(p[start : start + step], c, metric)
            if exclude_self:
                near[p_code[start : start + step][:, None] == c_code[by_id][None, :]] = np.inf
            if reach is not None:
                near[near > reach[start : start + step][:, None]] = np.inf
            row, col = _best(near, k)
            rows.append(row + start)
            cols.append(by_id[col])
            far.append(near[row, col])
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)]), np.concatenate(far or [np.zeros(0)])

    return lists


def knn(
    probes: DataFrame,
    candidates: DataFrame,
    k: int = 1,
    coords: Sequence[str] = ("x", "y", "z"),
    id_col: str = "id",
    part_cols: Sequence[str] = (),
    metric: str = "euclidean",
    exclude_self: bool = False,
    capacity: int = tree.CAPACITY,
    squared: bool = False,
) -> DataFrame:
    """The k nearest candidates of every probe (same partition).

    Returns ``(probe_id, part..., rank, match_id, dist)`` with rank 1..k,
    ordered by (distance, id); probes without any candidate are absent, and
    so are rows with a null or NaN coordinate.  ``exclude_self`` drops the
    candidates with the probe's own id.  Probes that repeat an id each have
    their own rows.  ``capacity`` bounds the rows of a leaf and changes no
    result.  ``squared`` gives the squared Euclidean distance, as measured.
    """
    part_cols = list(part_cols)
    part = F.struct(*part_cols) if part_cols else F.lit(0)
    usable = ~F.exists(F.array(*[F.col(c).cast("double") for c in coords]), lambda x: x.isNull() | F.isnan(x))
    # -0.0 and 0.0 are one location
    shape = [part.alias("part"), F.col(id_col).alias("id"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in coords]]
    asking = probes.where(usable).select(*shape, F.lit(0).alias("kind"))
    place = Window.partitionBy("part", *coords).orderBy("id")
    offered = (candidates.where(usable).select(*shape, F.lit(1).alias("kind")).withColumn("_at", F.row_number().over(place))
               .where(F.col("_at") <= k + 1).drop("_at"))
    both = cut(asking.unionByName(offered))  # read twice there
    placed, n = tree.with_leaves(both, list(coords), "part", ["kind", "id"], capacity)
    release(both)
    level = tree.top_level(-(-n // capacity))
    again = cut if level else (lambda df: df)  # read once for each level
    need = k + 1 if exclude_self else k
    coords = list(coords)
    part_type = placed.schema["part"].dataType.simpleString()
    id_type = placed.schema["id"].dataType.simpleString()
    lists = _meet(k, metric, coords, exclude_self)

    def own_leaf(key: tuple, rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        p, c = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))
        row, col, far = lists(p, c, None)
        count = np.bincount(row, minlength=p.num_rows)
        ends = np.concatenate([[0], np.cumsum(count)])
        last = np.full(p.num_rows, np.inf)
        full = count == k
        last[full] = far[ends[1:][full] - 1]
        found = pa.StructArray.from_arrays([pa.array(far), c.column("id").combine_chunks().take(pa.array(col))], ["d", "id"])
        best = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)
        return pa.table([*(p.column(x) for x in ("part", "leaf", "row", "id", *coords)), pa.array(last), best],
                        names=["part", "leaf", "row", "id", *coords, "last", "best"])

    point = ", ".join(f"{c} double" for c in coords)
    local = cut(placed.groupBy("part", "leaf").applyInArrow(
        own_leaf, f"part {part_type}, leaf long, row long, id {id_type}, {point}, last double, best array<struct<d:double,id:{id_type}>>"))
    reach = F.col("last") if metric == "manhattan" else F.sqrt("last")
    local_groups = local.withColumn("scale", tree.scale_of(reach))
    key = ["part", "leaf", "scale"]
    groups = again(local_groups.groupBy(*key).agg(F.max(reach).alias("reach"), *tree.box("g_", coords)))
    leaves = again(placed.where("kind = 1").groupBy("part", F.col("leaf").alias("b")).agg(F.count(F.lit(1)).alias("n"), *tree.box("n_", coords)))
    bounded = Window.partitionBy(*key)
    pairs = None
    for at in range(level, -1, -1):
        up = F.floor(F.col("b") / tree.FANOUT**at) if at else F.col("b")
        nodes = leaves.groupBy("part", up.alias("b")).agg(F.sum("n").alias("n"), *tree.merged_box("n_", coords)) if at else leaves
        if pairs is None:  # at most TOP nodes
            met = groups.join(nodes, "part")
        else:
            children = pairs.drop("n", "gap").withColumn("b", F.explode(F.sequence(F.col("b") * tree.FANOUT, F.col("b") * tree.FANOUT + tree.FANOUT - 1)))
            met = children.join(nodes, ["part", "b"])
        enough = F.when(F.col("n") >= need, tree.farthest_gap("g_", "n_", coords, metric)).otherwise(F.lit(float("inf")))
        met = (met.withColumn("gap", tree.nearest_gap("g_", "n_", coords, metric))
                  .withColumn("reach", F.least("reach", F.min(enough).over(bounded)))
                  .where(F.col("gap") <= F.col("reach") * tree.MARGIN))
        pairs = met.select(*key, "reach", "gap", "b", "n", *[f"g_{e}_{c}" for c in coords for e in ("lo", "hi")])
    open_pairs = cut(tree.dealt(pairs.where(F.col("b") != F.col("leaf")), key, "n", "gap"))
    # candidates of those leaves that lie within reach of the group's box
    cands = placed.where("kind = 1").select("part", F.col("leaf").alias("b"), F.col("id").alias("c_id"), *[F.col(c).alias(f"c_{c}") for c in coords])
    halo = (open_pairs.drop("n", "gap").join(cands, ["part", "b"])
            .where(tree.point_gap("c_", "g_", coords, metric) <= F.col("reach") * tree.MARGIN)
            .select(*[F.col(c).alias(f"h_{c}") for c in [*key, "batch"]], F.col("c_id").alias("id"), *[F.col(f"c_{c}").alias(c) for c in coords]))
    asked = local_groups.select(*key, "row", "id", "last", *coords).join(open_pairs.select(*key, "batch").distinct(), key)

    def meet_halo(key: tuple, p: pa.Table, c: pa.Table) -> pa.Table:
        row, col, far = lists(p, c, p.column("last").to_numpy()) if p.num_rows and c.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([p.column("row").combine_chunks().take(pa.array(row, pa.int64())), pa.array(far, pa.float64()),
                         c.column("id").combine_chunks().take(pa.array(col, pa.int64()))], names=["row", "d", "match_id"])

    hits = cut(asked.groupBy(*key, "batch").cogroup(halo.groupBy(*[f"h_{c}" for c in [*key, "batch"]])).applyInArrow(meet_halo, f"row long, d double, match_id {id_type}"))
    own = local.select("row", F.explode("best").alias("m")).select("row", "m.d", F.col("m.id").alias("match_id"))
    ranks = Window.partitionBy("row").orderBy("d", "match_id")
    ranked = own.unionByName(hits).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    out = ranked.join(local.select("row", "part", F.col("id").alias("probe_id")), "row")
    release(groups, leaves, open_pairs)
    return out.select("probe_id", *[F.col(f"part.{c}").alias(c) for c in part_cols], F.col("rank").cast("int").alias("rank"), "match_id",
                      (F.col("d") if squared else _true_dist(F.col("d"), metric)).alias("dist"))
