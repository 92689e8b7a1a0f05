"""ε-cover and matched selection.

The modelled cover scans points in order; an uncovered point becomes a
centre and covers every point within distance ≤ ε.  Its result is the
lexicographically-first maximal independent set of the ε-graph under that
order.  No pair table is made.  Points are dealt to cells whose diagonal is
ε, so the first undecided point of a cell, once a centre, decides the whole
cell: a round needs only the first few undecided points of each cell.  Tiles
of TILE neighbouring cells scan theirs in order; a point waits only for an
earlier undecided one that could still cover it and is not in the scan (in
another tile, or behind the first few of a cell).  New centres then cover
the points of the cells around them.  A chain of points along one tile takes
one round, and so does a dense ball.

Order: an explicit column (default the id), because Spark rows have no
inherent order.  Points are told apart by a row key, never by their id.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.functions.numeric import sq_dist
from tessera.functions.persist import cut, release
from tessera.functions.ranks import numbered
from tessera.operators import tree
from tessera.operators.encode import dense_index
from tessera.operators.neighbors import knn
from tessera.operators.summarize import drop_noise

XYZ = ("emb_x", "emb_y", "emb_z")
#: Cells of a tile, and undecided points of a cell that a round looks at.
TILE, HELD = 4096, 4


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cells around one of side ε / √d that a ball of radius ε around one of its points can touch."""
    reach = math.ceil(math.sqrt(d))
    return list(itertools.product(range(-reach, reach + 1), repeat=d))


def _scan(cells: Sequence[str], coords: Sequence[str], eps: float, held: int):
    """Centres among a tile's first undecided points, in order; points whose fate is open are left out."""
    offsets = _offsets(len(cells))
    d = len(coords)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("row")
        rows, places, limits = (t.column(c).to_pylist() for c in ("row", "at", "bound"))
        where = list(zip(*(t.column(c).to_pylist() for c in cells)))
        points = list(zip(*(t.column(c).to_pylist() for c in coords)))
        present = set(where)
        around: dict[tuple, list[tuple]] = {}
        centres: dict[tuple, list[tuple]] = {}
        open_points: dict[tuple, list[tuple]] = {}
        behind: set[tuple] = set()  # cells with undecided points that this scan has not seen, all before the next rows
        chosen = []

        def close(p, q):
            total = 0.0
            for i in range(d):
                gap = p[i] - q[i]
                total += gap * gap
            return total <= eps * eps

        for i, cell in enumerate(where):
            if places[i] > held:
                behind.add(cell)
                continue
            if cell not in around:
                near = (tuple(a + b for a, b in zip(cell, o)) for o in offsets)
                around[cell] = [c for c in near if c in present]
            p = points[i]
            if any(close(p, q) for c in around[cell] for q in centres.get(c, ())):
                continue
            waits = (limits[i] is not None and limits[i] < rows[i]) or any(
                c in behind or any(close(p, q) for q in open_points.get(c, ())) for c in around[cell])
            if waits:
                open_points.setdefault(cell, []).append(p)
            else:
                centres.setdefault(cell, []).append(p)
                chosen.append(i)
        return t.select(["part", *cells, "row", *coords]).take(pa.array(chosen, pa.int64()))

    return run


def epsilon_cover(
    points: DataFrame,
    eps: float,
    coords: Sequence[str] = XYZ,
    id_col: str = "id",
    part_cols: Sequence[str] = ("cluster",),
    order_col: str | None = None,
    tile: int = TILE,
    held: int = HELD,
) -> DataFrame:
    """Centres per partition: ``(part..., center_rank, id, coords...)``.

    ``center_rank`` (1-based) follows the scan order ``(order_col, id)``.
    Rows that repeat an id are points of their own; rows with a null or NaN
    coordinate take no part.  ``tile`` and ``held`` bound what a task scans
    and change no result.
    """
    coords, part_cols = list(coords), list(part_cols)
    order = [c for c in (order_col,) if c and c != id_col]
    usable = ~F.exists(F.array(*[F.col(c).cast("double") for c in coords]), lambda x: x.isNull() | F.isnan(x))
    part = F.struct(*part_cols) if part_cols else F.lit(0)
    shape = [part.alias("part"), F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in coords], *[F.col(c).alias("__order") for c in order]]
    rows, _ = numbered(points.where(usable).select(*shape), ["part", *(["__order"] if order else []), "id"], out="row")
    cells = [f"cell{i}" for i in range(len(coords))]
    if eps > 0:
        side = eps / math.sqrt(len(coords))
        rows = rows.withColumns({k: F.floor(F.col(c) / F.lit(side)).cast("long") for k, c in zip(cells, coords)})
    else:  # only coincident points cover each other: each place is a cell far from all others
        rows = rows.withColumns({k: F.xxhash64(F.col(c) + F.lit(0.0)).bitwiseAND(F.lit((1 << 40) - 1)) * 8 for k, c in zip(cells, coords)})
    found = rows.select("part", *cells).distinct()
    placed, n_cells = tree.with_leaves(found.select("part", *[F.col(c).cast("double").alias(c) for c in cells]), cells, "part", [], tile)
    tiles = cut(placed.select("part", *[F.col(c).cast("long").alias(c) for c in cells], F.col("leaf").alias("tile")))
    key = ["part", *cells]
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in _offsets(len(coords))])

    def spread(df: DataFrame) -> DataFrame:
        """Each row once for every cell around its own."""
        names = [c for c in df.columns if c not in cells]
        return df.withColumn("_o", F.explode(offsets)).select(*names, *[(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(cells)])

    border = None
    if n_cells > tile:  # neighbouring cells of other tiles
        mine = tiles.select(*key, *[F.col(c).alias(f"my_{c}") for c in cells], F.col("tile").alias("my_tile"))
        border = cut(spread(mine).join(tiles, key).where("tile <> my_tile").select(*key, *[f"my_{c}" for c in cells]))
    left = cut(rows.select(*key, "row", *coords).join(tiles, key))
    schema = f"part {left.schema['part'].dataType.simpleString()}, " + ", ".join([f"{c} long" for c in cells] + ["row long"] + [f"{c} double" for c in coords])
    scan = _scan(cells, coords, float(eps), held)
    centres: list[DataFrame] = []
    while not left.isEmpty():  # the first undecided point of each partition is decided in every round
        seen = left.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("row"))).where(F.col("at") <= held + 1)
        if border is None:
            seen = seen.withColumn("bound", F.lit(None).cast("long"))
        else:
            firsts = left.groupBy(*key).agg(F.min("row").alias("first"))
            bounds = border.join(firsts, key).groupBy("part", *[f"my_{c}" for c in cells]).agg(F.min("first").alias("bound"))
            seen = seen.join(bounds.select("part", *[F.col(f"my_{c}").alias(c) for c in cells], "bound"), key, "left")
        new = cut(seen.groupBy("part", "tile").applyInArrow(scan, schema))
        centres.append(new)
        reach = spread(new.select(*key, *[F.col(c).alias(f"q_{c}") for c in coords]))
        same = [left[c] == reach[c] for c in key]
        near = sq_dist([F.col(c) for c in coords], [F.col(f"q_{c}") for c in coords]) <= F.lit(float(eps) * float(eps))
        rest = cut(left.join(reach, [*same, near], "left_anti"))
        release(left)
        left = rest
    release(tiles, border)
    if not centres:
        return rows.limit(0).select(*[F.col(f"part.{c}").alias(c) for c in part_cols], F.lit(1).alias("center_rank"), "id", *coords)
    every = centres[0]
    for c in centres[1:]:
        every = every.unionByName(c)
    ranked = dense_index(every.select("part", "row"), "part", ["row"], "_r")
    return ranked.join(rows.select("row", "id", *coords), "row").select(
        *[F.col(f"part.{c}").alias(c) for c in part_cols], (F.col("_r") + 1).cast("int").alias("center_rank"), "id", *coords)


def status_sets(df: DataFrame, id_map: DataFrame | None, id_col: str = "id") -> DataFrame:
    """``df`` with boolean ``in_on`` / ``in_not`` from the id map (left join)."""
    if id_map is None:
        return df.withColumn("in_on", F.lit(False)).withColumn("in_not", F.lit(False))
    m = id_map.select(F.col("id").alias(id_col), F.col("in_on").alias("_on"), F.col("in_not").alias("_not"))
    base = df.drop("in_on", "in_not")
    return base.join(m, id_col, "left").withColumn("in_on", F.coalesce("_on", F.lit(False))) \
               .withColumn("in_not", F.coalesce("_not", F.lit(False))).drop("_on", "_not")


def cover_and_match(
    df: DataFrame,
    eps: float,
    coords: Sequence[str] = XYZ,
    id_col: str = "id",
    cluster_col: str = "cluster",
    use_cluster_scope: bool = False,
    order_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """G2 + G3 core: centres of each non-noise cluster's ``in_on`` points and
    their nearest ``in_not`` candidate.

    ``df`` carries ``id, cluster, coords, in_on, in_not``.  Candidates come
    from the same cluster (``use_cluster_scope``) or from all rows, noise
    included (J4).  Ties go to the smallest candidate id.

    Returns (centres ``(cluster, center_rank, id, coords)``,
    matches ``(cluster, center_rank, center_id, match_id, dist)``).
    """
    for c in [id_col, cluster_col, *coords]:
        if c not in df.columns:
            raise ValueError(f"the selection needs column {c!r}")  # P15
    on = df.where(F.col("in_on") & (F.col(cluster_col) != -1))
    cand = df.where(F.col("in_not"))
    if use_cluster_scope:
        cand = cand.where(F.col(cluster_col) != -1)
        # a cluster without candidates gets no centres (the modelled loop skips it)
        on = on.join(cand.select(cluster_col).distinct(), cluster_col, "left_semi")
    elif cand.isEmpty():
        on = on.limit(0)
    on = on.select(F.col(cluster_col).alias("cluster"), F.col(id_col).alias("id"), *coords,
                   *([order_col] if order_col and order_col != id_col else []))
    centres = cut(epsilon_cover(on, eps, coords, "id", ("cluster",), order_col))
    # a centre is known by its own number, as ids may repeat
    id_type = cand.schema[id_col].dataType
    name = "long" if id_type.typeName() in ("long", "integer", "short", "byte") else "string"
    numbers = cut(centres.withColumn("number", F.monotonically_increasing_id().cast(name)))
    part = ("cluster",) if use_cluster_scope else ()
    cands = cand.select(F.col(id_col).cast(name).alias("id"), F.col(cluster_col).alias("cluster"), *coords)
    m = knn(numbers.select(F.col("number").alias("id"), "cluster", *coords), cands, 1, coords, "id", part)
    matches = numbers.select("number", "cluster", "center_rank", F.col("id").alias("center_id")).join(
        m.select(F.col("probe_id").alias("number"), F.col("match_id").cast(id_type).alias("match_id"), "dist"), "number").select(
        "cluster", "center_rank", "center_id", "match_id", "dist")
    return centres, cut(matches)


def selection(matches: DataFrame, clusters: DataFrame) -> DataFrame:
    """Unique matched ids per cluster in first-seen centre order.

    ``(cluster, rank, id)``; a cluster without selection (noise, no ``on``
    points, no candidates) has one row with NULL rank and id.
    """
    first = matches.groupBy("cluster", "match_id").agg(F.min("center_rank").alias("first_rank"))
    ranked = dense_index(first, "cluster", ["first_rank", "match_id"], "_r")
    sel = ranked.select("cluster", (F.col("_r") + 1).cast("int").alias("rank"), F.col("match_id").alias("id"))
    empty = clusters.join(sel.select("cluster").distinct(), "cluster", "left_anti").select(
        "cluster", F.lit(None).cast("int").alias("rank"), F.lit(None).cast(sel.schema["id"].dataType).alias("id"))
    return sel.unionByName(empty)


def flatten_selection(sel: DataFrame) -> DataFrame:
    """Each selected id once, ordered by its first (cluster, rank): ``(id, sel_order)``."""
    first = (sel.where(F.col("id").isNotNull())
                .groupBy("id").agg(F.min(F.struct("cluster", "rank")).alias("k"))
                .select("id", F.col("k.cluster").alias("_c"), F.col("k.rank").alias("_r"), F.lit(0).alias("_all")))
    idx = dense_index(first, "_all", ["_c", "_r"], "_o")
    return idx.select("id", (F.col("_o") + 1).cast("int").alias("sel_order"))


def cover_sizes(df: DataFrame, centres: DataFrame, cluster_col: str = "cluster",
                use_cluster_scope: bool = False) -> DataFrame:
    """Per cluster: on-points, candidates in scope and centres (zeros kept)."""
    per = df.groupBy(F.col(cluster_col).alias("cluster")).agg(
        F.count_if(F.col("in_on")).alias("n_on"),
        F.count_if(F.col("in_not")).alias("_local"))
    if use_cluster_scope:
        n_cand = F.col("_local")
    else:
        n_cand = F.lit(df.where(F.col("in_not")).count())  # one scalar
    cnt = centres.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_centers"))
    return per.join(cnt, "cluster", "left").select(
        "cluster", F.col("n_on").cast("long").alias("n_on"), n_cand.cast("long").alias("n_candidates"),
        F.coalesce("n_centers", F.lit(0)).cast("long").alias("n_centers"))


def selected_rows(df: DataFrame, sel: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """The rows of ``df`` that were selected, with their place: ``(id, sel_order, columns...)``."""
    flat = flatten_selection(sel).withColumnRenamed("id", id_col)
    return flat.join(df.select(id_col, *[c for c in columns if c != id_col]), id_col)


def scatter_table(df: DataFrame, dims: Sequence[str], id_col: str = "id", cluster_col: str = "cluster") -> DataFrame | None:
    """The numeric ones of ``dims`` that the table has, with the cluster and the id as text (``label``).

    A scatter matrix needs two dimensions: with fewer there is a warning and no table.  No id column is an error.
    """
    if id_col not in df.columns:
        raise ValueError(f"a scatter table needs the id column {id_col!r}")
    types = {f.name: f.dataType for f in df.schema.fields}
    kept = [c for c in dims if c in types and (isinstance(types[c], NumericType))]
    if len(kept) < 2:
        warnings.warn(f"a scatter matrix needs two numeric columns, there are {kept}", stacklevel=2)
        return None
    return drop_noise(df, cluster_col).select(F.col(id_col).cast("string").alias("label"), cluster_col, *kept)


def plot_layers(df: DataFrame, centres: DataFrame, matches: DataFrame, coords: Sequence[str] = XYZ, id_col: str = "id",
                cluster_col: str = "cluster") -> dict[str, DataFrame]:
    """What a plot of the cover draws, as tables.

    ``points``: the rows outside noise; ``centers``: every centre; ``segments``: a centre, its match and their
    distance; ``halos``: every centre with its cluster's number of centres.  What to draw of them is the reader's choice.
    A match whose id several rows share has a segment to each of them.
    """
    coords = list(coords)
    short = [c.removeprefix("emb_") for c in coords]
    c = centres.select("cluster", "center_rank", *[F.col(a).alias(f"c{b}") for a, b in zip(coords, short)])
    q = df.select(F.col(id_col).alias("match_id"), *[F.col(a).alias(f"m{b}") for a, b in zip(coords, short)])
    sizes = centres.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_centers"))
    return {
        "points": drop_noise(df, cluster_col).select(id_col, cluster_col, *coords),
        "centers": centres.select("cluster", "center_rank", "id", *coords),
        "segments": matches.join(c, ["cluster", "center_rank"]).join(q, "match_id").select(
            "cluster", "center_rank", "center_id", "match_id", *[f"c{b}" for b in short], *[f"m{b}" for b in short], "dist"),
        "halos": centres.join(sizes, "cluster").select("cluster", "center_rank", "id", *coords, "n_centers"),
    }
