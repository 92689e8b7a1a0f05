"""A counted tree over low-dimensional points, and searches that descend it as joins.

Points are put in the order of a Hilbert curve over their coordinates' quantiles and cut into leaves of CAPACITY rows,
so a leaf's size never depends on how the points lie: one far point or one dense spot changes the boxes of a few leaves
and nothing else.  A node of level l is FANOUT ** l leaves in a row with their bounding box and counts.

Searches run group against tree.  A group is a bounded set of searching rows of one leaf with about the same reach; it
meets the nodes of one level, keeps those whose box its reach can touch, and goes on with their children.  Every step
is an equi-join; what a leaf or group hands to a task is bounded (``batch`` deals long lists over several tasks).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tessera.functions.persist import cut
from tessera.functions.ranks import numbered

#: Rows of a leaf, children of a node, nodes that a group meets unasked at the top, rows met in one task.
CAPACITY, FANOUT, TOP, BATCH = 512, 8, 64, 4096
#: Quantiles of a coordinate that even out the curve.
QUANTILES = 256
#: Distances are compared with this margin, far above rounding: a bound never drops a row at exactly its distance.
MARGIN = 1 + 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below 2 ** bits), by Skilling's transposition."""
    x = cells.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in reversed(range(bits)):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def with_leaves(points: DataFrame, coords: Sequence[str], part: str, order: Sequence[str], capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``points`` with ``row`` (0 .. n - 1 along the curve, part after part) and ``leaf`` = row div capacity; and n.

    A leaf that holds rows of several parts is one leaf for each.  Coordinates are doubles, none null or NaN.
    """
    d = len(coords)
    bits = min(62 // d, 26)
    share = [i / QUANTILES for i in range(QUANTILES + 1)]
    marks = points.agg(*[F.percentile_approx(c, share, 2000).alias(c) for c in coords]).first()
    edges = {c: np.unique(np.array(marks[c] or [0.0], dtype=np.float64)) for c in coords}
    schema = StructType([*points.schema.fields]).add("__place", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, d), dtype=np.int64)
            for i, c in enumerate(coords):
                even = np.interp(batch.column(c).to_numpy(zero_copy_only=False), edges[c], np.linspace(0, 1, len(edges[c])))
                cells[:, i] = np.minimum(even * (1 << bits), (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, bits))], names=[*batch.schema.names, "__place"])

    ranked, n = numbered(points.mapInArrow(place, schema), [part, "__place", *coords, *order], out="row")
    return ranked.drop("__place").withColumn("leaf", F.floor(F.col("row") / capacity)), n


def top_level(leaves: int) -> int:
    """The lowest level with at most TOP nodes."""
    level = 0
    while -(-leaves // FANOUT**level) > TOP:
        level += 1
    return level


def box(prefix: str, coords: Sequence[str], source: str = "") -> list[Column]:
    """Aggregates: least and largest value of each coordinate."""
    return [f(f"{source}{c}").alias(f"{prefix}{end}_{c}") for c in coords for f, end in ((F.min, "lo"), (F.max, "hi"))]


def merged_box(prefix: str, coords: Sequence[str]) -> list[Column]:
    """Aggregates: the box of boxes."""
    return [f(f"{prefix}{end}_{c}").alias(f"{prefix}{end}_{c}") for c in coords for f, end in ((F.min, "lo"), (F.max, "hi"))]


def _length(gaps: list[Column], metric: str) -> Column:
    if metric == "manhattan":
        return sum(gaps[1:], gaps[0])
    squares = [g * g for g in gaps]
    return F.sqrt(sum(squares[1:], squares[0]))


def nearest_gap(a: str, b: str, coords: Sequence[str], metric: str) -> Column:
    """Least distance between a point of box ``a`` and one of box ``b``."""
    zero = F.lit(0.0)
    return _length([F.greatest(F.col(f"{b}lo_{c}") - F.col(f"{a}hi_{c}"), F.col(f"{a}lo_{c}") - F.col(f"{b}hi_{c}"), zero) for c in coords], metric)


def farthest_gap(a: str, b: str, coords: Sequence[str], metric: str) -> Column:
    """Largest distance between a point of box ``a`` and one of box ``b``."""
    return _length([F.greatest(F.col(f"{b}hi_{c}") - F.col(f"{a}lo_{c}"), F.col(f"{a}hi_{c}") - F.col(f"{b}lo_{c}")) for c in coords], metric)


def point_gap(prefix: str, a: str, coords: Sequence[str], metric: str) -> Column:
    """Least distance between the point in columns ``prefix`` + coordinate and box ``a``."""
    zero = F.lit(0.0)
    return _length([F.greatest(F.col(f"{prefix}{c}") - F.col(f"{a}hi_{c}"), F.col(f"{a}lo_{c}") - F.col(f"{prefix}{c}"), zero) for c in coords], metric)


def scale_of(reach: Column) -> Column:
    """Rows of one leaf with reaches within a factor of two search together (no bound at all: 9999)."""
    return (F.when(reach.isNull() | (reach == float("inf")), F.lit(9999))
            .when(reach <= 0, F.lit(-9999)).otherwise(F.floor(F.log2(reach)))).cast("int")


def dealt(pairs: DataFrame, keys: Sequence[str], weight: str, first: str) -> DataFrame:
    """``pairs`` with ``batch``: of each key's list so many rows in the order of ``first`` that ``weight`` sums to BATCH."""
    so_far = F.sum(weight).over(Window.partitionBy(*keys).orderBy(first, "b").rowsBetween(Window.unboundedPreceding, -1))
    return pairs.withColumn("batch", F.floor(F.coalesce(so_far, F.lit(0)) / BATCH).cast("long"))


def distances(p: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """All distances of the rows of ``p`` and ``c``: squared for euclidean, summed in the order of the coordinates."""
    out = np.zeros((len(p), len(c)))
    for i in range(p.shape[1]):
        gap = p[:, i][:, None] - c[:, i][None, :]
        out += np.abs(gap) if metric == "manhattan" else gap * gap
    return out


def matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in columns]) if table.num_rows else np.zeros((0, len(columns)))


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Integers of the same order as the values of several columns of one type."""
    every = pa.concat_arrays([x for c in columns for x in c.chunks]) if any(c.num_chunks for c in columns) else None
    if every is None:
        return [np.zeros(0, dtype=np.int64) for _ in columns]
    if pa.types.is_integer(every.type):
        joined = every.to_numpy().astype(np.int64)
    else:
        joined = pa.compute.rank(every, tiebreaker="dense").to_numpy().astype(np.int64)
    return np.split(joined, np.cumsum([len(c) for c in columns])[:-1])
