"""Graph steps on DataFrames: connected components (used by the spanning
tree and the dendrogram cut).

Large stars and small stars in turn: every edge runs from a vertex to a
smaller one; a large star passes an edge on from its lower end to the least
neighbour of that end, a small star joins all lower neighbours of a vertex to
the least of them.  Both keep the components and the number of edges, and the
edges end as one star around each component's smallest id.  Each round reads
only written inputs, so the plan stays one round deep and a lost executor
costs at most one round.  Cliques and stars take one round; a path whose ids
rise along it takes log2(n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut, release


def connected_components(vertices: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``vertices(v)``, ``edges(a, b)`` -> ``(v, comp)``, comp = smallest id of the component.

    Without ``vertices`` the ends of edges between two ids are the vertices.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        # each vertex and its least lower neighbour; a lower end counts itself
        ends = e.select("v", "u").unionByName(e.select(F.col("u").alias("v"), "u"))
        label = cut(ends.groupBy("v").agg(F.min("u").alias("comp"), F.max("u").alias("most")))
        if label.where("comp < most").isEmpty():  # one edge a vertex, and none from the lower end of another: stars
            break
        least = label.select(F.col("v").alias("u"), "comp")
        large = e.join(least, "u").select("v", F.col("comp").alias("u"))
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        nxt = cut(small.select("x.v", "x.u").where("v <> u").distinct())
        release(e, label)
        e = nxt
    release(e)
    label = label.select("v", "comp")
    if vertices is None:
        return label
    return vertices.select("v").distinct().join(label, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))
