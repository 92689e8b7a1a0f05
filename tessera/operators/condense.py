"""Condensed cluster tree and cluster selection on DataFrames (M6d-M6g).

Single linkage joins the spanning tree's edges in one total order, their rank.  With minimum cluster size m the
condensed tree needs only three kinds of event, and each is found without the whole dendrogram:

core   a component that reaches m points for the first time, by joining two smaller ones.  It is named by the rank
       of that edge and is a leaf cluster; all its points leave it there.
fall   a component below m points that joins one of m or more: its points leave the cluster which that one is part of
       at this rank.
split  two components of m or more points join: seen from above, a cluster splits into two.

Cores and falls: edges are taken in bands of ranks.  In a band only small components grow; what is large already is
the end of an edge and never connects anything, so the groups of a band stay small although one cluster may hold most
points.  Each group replays its edges; what remains small goes on as one vertex.  Splits: the tree over the cores is
replayed in bands the same way, every edge a node with two children.  The cluster that a point left is the highest
ancestor of its core with a smaller rank, found by doubling pointers.

Selection is a sum up the tree and a choice down the tree, band after band and group by group.  No group holds more
than ``limit`` edges; nothing but counts and one quantile of ranks reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut, release
from tessera.functions.ranks import numbered
from tessera.operators.graph import connected_components

#: Edges that one group replays.
LIMIT = 200_000
_SHARES = (0.5, 0.25, 0.1, 0.03, 0.01, 0.001, 1e-4, 1e-5, 1e-6)


@dataclass
class Condensed:
    """``nodes``: one row per cluster of the condensed tree; ``points``: the cluster that each point left last.

    nodes (node, parent, leaf, w, birth_w, size, stability, best, band, grp): leaf clusters are named -1 - core, others
    by the rank of the edge at which they split; ``w`` is the weight at which a cluster ends (seen from above) and
    ``birth_w`` the weight at which it begins (null for the root).  points (id, node); node is null without clusters.
    """

    nodes: DataFrame
    points: DataFrame
    bands: int


def _components(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, grp): components of the vertices of ``edges`` (vertex columns v) under ``pairs`` (a, b)."""
    return connected_components(edges, pairs).select("v", F.col("comp").alias("grp"))


def _band(edges: DataFrame, limit: int, grouped) -> DataFrame:
    """The edges of the next band with ``grp``: as many in rank order as keep every group within ``limit`` edges."""
    total = edges.count()
    if total <= limit:
        return edges.withColumn("grp", F.lit(0).cast("long"))
    marks = edges.agg(F.percentile_approx("rank", list(_SHARES), 100000).alias("q")).first()["q"]
    for share, mark in zip(_SHARES, marks):
        band = edges.where(F.col("rank") <= mark)
        dealt = cut(grouped(band))
        most = dealt.groupBy("grp").count().agg(F.max("count")).first()[0]
        if most is not None and (most <= limit or share * total <= limit or share == _SHARES[-1]):
            return dealt
        release(dealt)
    raise AssertionError("unreachable")


class _Forest:
    """Union-find over arbitrary names."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root


def _replay_small(m: int):
    """Replays a group of edges with at least one small end each.

    Out: kind 0, a small component (a) that falls onto core b at the rank; kind 1, an edge between the cores a and b;
    kind 2, a small component a that is now part of the small component b of ``size`` points.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["a", "b", "a_big", "b_big", "rank", "size_a", "size_b"]).sort_by("rank").to_pydict()
        forest, size, core, members = _Forest(), {}, {}, {}
        out: list[tuple] = []

        def enter(x: int, big: bool, points: int | None):
            name = (x, big)
            if name not in forest.parent:
                forest.find(name)
                size[name], core[name], members[name] = points or 0, x if big else None, [] if big else [x]
            return forest.find(name)

        for a, b, a_big, b_big, rank, size_a, size_b in zip(*rows.values()):
            x, y = enter(a, a_big, size_a), enter(b, b_big, size_b)
            if core[x] is not None and core[y] is not None:
                out.append((1, core[x], core[y], rank, 0))
                forest.parent[y] = x
                continue
            if core[x] is None and core[y] is None:
                small = members[x] + members[y] if len(members[x]) >= len(members[y]) else members[y] + members[x]
                size[x] += size[y]
                forest.parent[y] = x
                if size[x] >= m:
                    core[x] = rank
                    out += [(0, s, rank, rank, 0) for s in small]
                    members[x] = []
                else:
                    members[x] = small
                continue
            large, small = (x, y) if core[x] is not None else (y, x)
            out += [(0, s, core[large], rank, 0) for s in members[small]]
            members[small] = []
            forest.parent[small] = large
        for name, held in members.items():
            if held and forest.find(name) == name and core[name] is None:
                into = min(held)
                out += [(2, s, into, -1, size[name]) for s in held]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["kind", "a", "b", "rank", "size"])

    return run


def _cores_and_falls(edges: DataFrame, ids: DataFrame, m: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, core, rank) of every point that falls, and (a, b, rank) of the edges between cores."""
    member = ids.select("id", F.col("id").alias("sup"))
    sizes = None  # points of a small component; one each at first
    rest = cut(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(False).alias("a_big"), F.lit(False).alias("b_big"), "rank"))
    falls: list[DataFrame] = []
    joins: list[DataFrame] = []

    def grouped(band: DataFrame) -> DataFrame:
        ends = band.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("a_big").alias("big")),
                                             F.struct(F.col("b").alias("v"), F.col("b_big").alias("big")))).alias("e"))
        comps = _components(ends.where("not e.big").select("e.v").distinct(), band.where("not a_big and not b_big").select("a", "b"))
        return band.withColumn("v", F.when(F.col("a_big"), F.col("b")).otherwise(F.col("a"))).join(comps, "v").drop("v")

    while not rest.isEmpty():
        band = _band(rest, limit, grouped)
        if sizes is None:
            sized = band.withColumns({"size_a": F.lit(1).cast("long"), "size_b": F.lit(1).cast("long")})
        else:
            side = lambda c: sizes.select(F.col("sup").alias(c), F.lit(False).alias(f"{c}_big"), F.col("size").alias(f"size_{c}"))
            sized = band.join(side("a"), ["a", "a_big"], "left").join(side("b"), ["b", "b_big"], "left")
            sized = sized.withColumns({c: F.coalesce(c, F.lit(1)).cast("long") for c in ("size_a", "size_b")})
        out = cut(sized.groupBy("grp").applyInArrow(_replay_small(m), "kind int, a long, b long, rank long, size long"))
        fell = out.where("kind = 0").select(F.col("a").alias("sup"), F.col("b").alias("core"), "rank")
        falls.append(cut(member.join(fell, "sup").select("id", "core", "rank")))
        joins.append(out.where("kind = 1").select("a", "b", "rank"))
        grown = out.where("kind = 2").select(F.col("a").alias("sup"), F.col("b").alias("into"), "size")
        later = rest.join(band.select("rank"), "rank", "left_anti")
        moved = out.where("kind <> 1").select(F.col("a").alias("old"), F.col("b").alias("new"), (F.col("kind") == 0).alias("now"))
        for c in ("a", "b"):
            here = moved.select(F.col("old").alias(c), F.lit(False).alias(f"{c}_big"), F.col("new").alias(f"new_{c}"), F.col("now").alias(f"now_{c}"))
            later = later.join(here, [c, f"{c}_big"], "left")
        later = cut(later.select(*[F.coalesce(f"new_{c}", c).alias(c) for c in ("a", "b")],
                                 *[F.coalesce(f"now_{c}", f"{c}_big").alias(f"{c}_big") for c in ("a", "b")], "rank"))
        joins.append(later.where("a_big and b_big").select("a", "b", "rank"))
        rest = later.where("not (a_big and b_big)")
        kept = member.join(fell.select("sup"), "sup", "left_anti").join(grown.select("sup", "into"), "sup", "left")
        member = cut(kept.select("id", F.coalesce("into", "sup").alias("sup")))
        grown = grown.groupBy(F.col("into").alias("sup")).agg(F.first("size").alias("size"))
        if sizes is not None:
            still = sizes.join(moved.select(F.col("old").alias("sup")), "sup", "left_anti")
            grown = grown.unionByName(still)
        sizes = cut(grown)
    all_falls, all_joins = falls[0], joins[0]
    for f in falls[1:]:
        all_falls = all_falls.unionByName(f)
    for j in joins[1:]:
        all_joins = all_joins.unionByName(j)
    return all_falls, all_joins


def _replay_splits(table: pa.Table) -> pa.Table:
    """Nodes of a group of edges between large components: (node, c1, c2), and where each component went (top)."""
    rows = table.select(["a", "b", "rank", "top_a", "top_b", "grp"]).sort_by("rank").to_pydict()
    forest, top = _Forest(), {}
    out: list[tuple] = []
    for a, b, rank, top_a, top_b, _ in zip(*rows.values()):
        for x, t in ((a, top_a), (b, top_b)):
            if x not in forest.parent:
                top[forest.find(x)] = t
        x, y = forest.find(a), forest.find(b)
        out.append((0, rank, top[x], top[y]))
        forest.parent[y] = x
        top[x] = rank
    for x in list(forest.parent):
        root = forest.find(x)
        out.append((1, x, root, top[root]))
    columns = list(zip(*out))
    grp = pa.array([rows["grp"][0]] * len(out), pa.int64())
    return pa.table([grp, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["grp", "kind", "x", "y", "z"])


def _split_tree(cores: DataFrame, joins: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(node, c1, c2, band, grp) of every split, children by name; and the number of bands."""
    top = None  # large components that are not a single core any more: (v, into, top)
    rest = cut(joins.select("a", "b", "rank"))
    found: list[DataFrame] = []

    def grouped(band: DataFrame) -> DataFrame:
        vertices = band.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        comps = _components(vertices, band.select("a", "b"))
        return band.join(comps.withColumnRenamed("v", "a"), "a")

    while not rest.isEmpty():
        band = _band(rest, limit, grouped)
        if top is None:
            named = band.withColumns({"top_a": -1 - F.col("a"), "top_b": -1 - F.col("b")})
        else:
            side = lambda c: top.select(F.col("v").alias(c), F.col("top").alias(f"top_{c}"))
            named = band.join(side("a"), "a", "left").join(side("b"), "b", "left")
            named = named.withColumns({f"top_{c}": F.coalesce(f"top_{c}", -1 - F.col(c)) for c in ("a", "b")})
        out = cut(named.groupBy("grp").applyInArrow(_replay_splits, "grp long, kind int, x long, y long, z long"))
        found.append(out.where("kind = 0").select(F.col("x").alias("node"), F.col("y").alias("c1"), F.col("z").alias("c2"),
                                                  F.lit(len(found)).alias("band"), "grp"))
        went = out.where("kind = 1").select(F.col("x").alias("old"), F.col("y").alias("new"), F.col("z").alias("top"))
        later = rest.join(band.select("rank"), "rank", "left_anti")
        for c in ("a", "b"):
            later = later.join(went.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")), c, "left")
        rest = cut(later.select(*[F.coalesce(f"new_{c}", c).alias(c) for c in ("a", "b")], "rank"))
        now = went.groupBy(F.col("new").alias("v")).agg(F.first("top").alias("top"))
        if top is not None:
            now = now.unionByName(top.join(went.select(F.col("old").alias("v")), "v", "left_anti"))
        top = cut(now)
    splits = found[0] if found else cores.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in ("node", "c1", "c2")], F.lit(0).alias("band"), F.lit(0).cast("long").alias("grp"))
    for f in found[1:]:
        splits = splits.unionByName(f)
    return cut(splits), len(found)


def _left_cluster(falls: DataFrame, parents: DataFrame) -> DataFrame:
    """(core, rank, node): the highest ancestor of a core that ends before the rank; pointers double, so few joins."""
    jumps = []
    jump = parents.select("node", "parent")
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jump = cut(jump.join(onward, "parent").select("node", F.col("next").alias("parent")))
    found = falls.select("core", "rank", (-1 - F.col("core")).alias("node"))
    for jump in reversed(jumps):
        step = found.join(jump, "node", "left")
        found = step.select("core", "rank", F.when(F.col("parent") < F.col("rank"), F.col("parent")).otherwise(F.col("node")).alias("node"))
    return found


def _sum_up():
    """Sizes, stabilities and best sums of a group's splits, children before parents."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("node").to_pydict()
        size, best, rows = {}, {}, []
        for node, c1, c2, w, birth_w, cnt, lam, s1, b1, s2, b2 in zip(*(t[c] for c in ("node", "c1", "c2", "w", "birth_w", "cnt", "lam", "s1", "b1", "s2", "b2"))):
            below = [(size[c], best[c]) if c in size else (s, b) for c, s, b in ((c1, s1, b1), (c2, s2, b2))]
            inside = below[0][0] + below[1][0]
            size[node] = cnt + inside
            ends = 1.0 / w if w > 0 else np.inf
            starts = 0.0 if birth_w is None else 1.0 / birth_w if birth_w > 0 else np.inf
            stability = lam + ends * inside - size[node] * starts
            stability = 0.0 if np.isnan(stability) else stability
            under = below[0][1] + below[1][1]
            chosen = not under > stability
            best[node] = stability if chosen else under
            rows.append((node, size[node], stability, best[node], chosen))
        columns = list(zip(*rows))
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                         pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.bool_())], names=["node", "size", "stability", "best", "chosen"])

    return run


def condensed_tree(tree: DataFrame, points: DataFrame, min_cluster_size: int, limit: int = LIMIT) -> Condensed:
    """M6d: the condensed tree of the spanning tree ``tree(u, v, w)`` over ``points(id)``.

    ``limit`` bounds the edges that one group replays; results do not depend on it.  Coincident points join at weight
    0, where lambda is infinite; a cluster whose stability is undefined there counts as 0.  Fewer than
    ``min_cluster_size`` points have no cluster.
    """
    m = int(min_cluster_size)
    ranked, _ = numbered(tree.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"), ["w", "u", "v"], out="rank")
    edges = cut(ranked)
    ids = points.select(F.col("id").cast("long").alias("id")).distinct()
    if edges.isEmpty():
        none = ids.select("id", F.lit(None).cast("long").alias("node"))
        empty = edges.limit(0).selectExpr("rank node", "rank parent", "true leaf", "w", "w birth_w", "rank size", "w stability", "w best", "true chosen", "0 band", "rank grp")
        return Condensed(empty, none, 0)
    falls, joins = _cores_and_falls(edges, ids, m, limit)
    cores = cut(falls.select("core").distinct())
    splits, bands = _split_tree(cores, joins, limit)
    weights = edges.select(F.col("rank").alias("node"), "w")
    parents = cut(splits.select(F.explode(F.array("c1", "c2")).alias("node"), F.col("node").alias("parent"))
                  .join(weights.select(F.col("node").alias("parent"), F.col("w").alias("birth_w")), "parent"))
    left = cut(_left_cluster(falls.groupBy("core", "rank").agg(F.lit(0)), parents))
    placed = cut(falls.join(left, ["core", "rank"]).select("id", "node", "rank"))
    lam = F.when(F.col("w") > 0, 1.0 / F.col("w")).otherwise(F.lit(float("inf")))
    own = cut(placed.groupBy("node", "rank").agg(F.count(F.lit(1)).alias("n")).join(weights.withColumnRenamed("node", "rank"), "rank")
              .groupBy("node").agg(F.sum("n").alias("cnt"), F.sum(lam * F.col("n")).alias("lam")))

    # leaf clusters: all their points left by falls
    starts = F.when(F.col("birth_w").isNull(), F.lit(0.0)).when(F.col("birth_w") > 0, 1.0 / F.col("birth_w")).otherwise(F.lit(float("inf")))
    stability = F.nanvl(F.col("lam") - F.col("cnt") * starts, F.lit(0.0))
    leaves = (cores.select((-1 - F.col("core")).alias("node"), F.col("core").alias("at")).join(own, "node")
              .join(weights.withColumnRenamed("node", "at"), "at").join(parents, "node", "left")
              .select("node", "parent", F.lit(True).alias("leaf"), "w", "birth_w", F.col("cnt").cast("long").alias("size"),
                      stability.alias("stability"), stability.alias("best"), F.lit(True).alias("chosen"),
                      F.lit(-1).alias("band"), F.lit(0).cast("long").alias("grp")))
    nodes = cut(leaves)
    inner = cut(splits.join(weights, "node").join(parents, "node", "left").join(own, "node", "left")
                .fillna(0, ["cnt"]).fillna(0.0, ["lam"]))
    value = nodes.select("node", "size", "best")
    for band in range(bands):
        side = lambda c, i: value.select(F.col("node").alias(c), F.col("size").alias(f"s{i}"), F.col("best").alias(f"b{i}"))
        here = inner.where(F.col("band") == band)
        done = (here.join(side("c1", 1), "c1", "left").join(side("c2", 2), "c2", "left").groupBy("grp")
                .applyInArrow(_sum_up(), "node long, size long, stability double, best double, chosen boolean"))
        summed = cut(done.join(here.select("node", "parent", "w", "birth_w", "band", "grp"), "node").select(
            "node", "parent", F.lit(False).alias("leaf"), "w", "birth_w", "size", "stability", "best", "chosen", "band", "grp"))
        nodes = nodes.unionByName(summed)
        value = nodes.select("node", "size", "best")
    missing = ids.join(placed.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("node"))
    return Condensed(nodes, placed.select("id", "node").unionByName(missing), bands)


def _choose_down(epsilon: float):
    """Per cluster of a group, parents first: the cluster to which points that left it belong (null: none).

    ``c``: the topmost chosen cluster above or at it; ``up``: where a chosen cluster that begins below epsilon grows to.
    """

    def run(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: (t["leaf"][i], -t["node"][i]))
        state, rows = {}, []
        for i in order:
            node, parent, birth = t["node"][i], t["parent"][i], t["birth_w"][i]
            if parent is None:
                state[node] = (None, None, None, None, True)
            else:
                c, c_birth, c_up, up, top = state[parent] if parent in state else (t["p_c"][i], t["p_c_birth"][i], t["p_c_up"][i], t["p_up"][i], t["p_parent"][i] is None)
                p_birth = t["p_birth"][i]
                mine = node if top else parent if p_birth > epsilon else up
                if c is None and t["chosen"][i]:
                    c, c_birth, c_up = node, birth, mine
                state[node] = (c, c_birth, c_up, mine, False)
            c, c_birth, c_up, up, top = state[node]
            if not epsilon or c is not None and c_birth >= epsilon:
                owner = c
            elif c is not None:
                owner = c_up
            elif top or t["w"][i] >= epsilon:
                owner = None
            else:
                owner = node if birth > epsilon else up
            rows.append((node, c, c_birth, c_up, up, owner))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "c", "c_birth", "c_up", "up", "owner"])

    return run


def select_clusters(tree: Condensed, method: str = "eom", epsilon: float = 0.0) -> DataFrame:
    """M6e, M6f: ``(node, owner)`` of every cluster; owner: the selected cluster that holds it (null: none).

    ``eom`` keeps a cluster unless its parts are more stable together, ``leaf`` keeps the leaf clusters; a kept cluster
    that begins below ``epsilon`` grows to the lowest cluster above it that begins beyond, or to the topmost below the
    root.  The root is never kept.
    """
    if method not in ("eom", "leaf"):
        raise ValueError("a selection method is 'eom' or 'leaf'")
    nodes = tree.nodes if method == "eom" else tree.nodes.withColumn("chosen", F.col("leaf"))
    above = nodes.select(F.col("node").alias("parent"), F.col("birth_w").alias("p_birth"), F.col("parent").alias("p_parent"))
    nodes = cut(nodes.join(above, "parent", "left").withColumn("chosen", F.col("chosen") & F.col("parent").isNotNull()))
    schema = "node long, c long, c_birth double, c_up long, up long, owner long"
    state = None
    for band in [*reversed(range(tree.bands)), -1]:
        here = nodes.where(F.col("band") == band)
        if band < 0:  # leaf clusters: any grouping will do
            here = here.withColumn("grp", F.pmod(F.xxhash64("node"), F.lit(1024)))
        if state is None:
            known = here.withColumns({"p_c": F.lit(None).cast("long"), "p_c_birth": F.lit(None).cast("double"), "p_c_up": F.lit(None).cast("long"), "p_up": F.lit(None).cast("long")})
        else:
            known = here.join(state.select(F.col("node").alias("parent"), F.col("c").alias("p_c"), F.col("c_birth").alias("p_c_birth"),
                                           F.col("c_up").alias("p_c_up"), F.col("up").alias("p_up")), "parent", "left")
        done = cut(known.groupBy("grp").applyInArrow(_choose_down(float(epsilon or 0.0)), schema))
        state = done if state is None else state.unionByName(done)
    return state.select("node", "owner")


def label_points(tree: Condensed, owners: DataFrame, points: DataFrame) -> DataFrame:
    """M6g: ``points`` with ``cluster``: that of the selected cluster above the one the point left, else -1.

    Labels are numbered 0.. by the smallest member id (partition-independent).
    """
    owned = cut(tree.points.join(owners, "node", "left").select("id", "owner"))
    first = owned.where("owner is not null").groupBy("owner").agg(F.min("id").alias("least"))
    named, _ = numbered(first, ["least"], out="cluster")
    labelled = owned.join(named.select("owner", F.col("cluster").cast("int").alias("cluster")), "owner", "left")
    return cut(labelled.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster")).join(points, "id"))
