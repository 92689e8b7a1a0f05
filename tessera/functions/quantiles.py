"""Exact grouped median with bounded memory.

``F.median`` is exact but keeps every distinct value of a group in one
aggregation buffer.  Here the values become ``(group, value, count)`` first,
so a tied value is one row however often it occurs.  Groups with more than
``window_limit`` distinct values narrow a window around the median's ranks
with sketched quantiles; each round reads and writes only the rows inside
the windows.  A window that holds one value is the answer.  The windows
that remain hold at most ``window_limit`` distinct values and are read
whole; the two middle values are interpolated as ``lo + (hi - lo) * 0.5``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL = NULL (group keys may be null)."""
    ren = right.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        term = left[k].eqNullSafe(ren[f"__k_{i}"])
        cond = term if cond is None else (cond & term)
    return left.join(ren, cond, how).drop(*[f"__k_{i}" for i in range(len(keys))])


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "median",
    *,
    window_limit: int = 100_000,
    accuracy: int = 10_000,
    grid: int = 1000,
) -> DataFrame:
    """Exact interpolated median of ``value`` per ``keys`` (nulls skipped).

    Returns one row per group that has at least one non-null value:
    ``keys + [out]``.  Matches ``percentile(value, 0.5)`` / DuckDB ``median``.
    """
    keys = list(keys)
    if not keys:
        res = grouped_median(df.withColumn("__g", F.lit(0)), ["__g"], value, out, window_limit=window_limit, accuracy=accuracy, grid=grid)
        return res.drop("__g")
    inner = [f"_k{i}" for i in range(len(keys))]
    values = df.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.col(value).cast("double").alias("_v"))
    counted = cut(values.where(F.col("_v").isNotNull()).groupBy(*inner, "_v").agg(F.count(F.lit(1)).alias("_c")))
    # per group: rows, distinct values, and the median's ranks in what is left of it
    n = F.sum("_c")
    state = counted.groupBy(*inner).agg(F.count(F.lit(1)).alias("_d"), n.alias("_n"))
    state = cut(state.select(*inner, "_d", "_n", F.floor((F.col("_n") - 1) / 2).cast("long").alias("_r1"), F.ceil((F.col("_n") - 1) / 2).cast("long").alias("_r2")))
    settled: list[DataFrame] = []
    left = counted
    while True:
        small = state.where(F.col("_d") <= window_limit)
        settled.append(null_safe_join(left, small.select(*inner, "_r1", "_r2"), inner))
        big = state.where(F.col("_d") > window_limit)
        if big.isEmpty():
            break
        rows = null_safe_join(left, big, inner)
        fractions = [i / grid for i in range(grid + 1)]
        sketch = rows.groupBy(*inner).agg(F.percentile_approx("_v", fractions, accuracy).alias("_q"))
        # ranks count rows, the sketch counts distinct values: the sum of counts between its marks places the median
        marks = cut(sketch.select(*inner, F.array_distinct("_q").alias("_q")))
        slot = F.size(F.filter("_q", lambda q: q <= F.col("_v")))
        sums = null_safe_join(rows, marks, inner).withColumn("_s", slot).groupBy(*inner, "_s", "_r1", "_r2").agg(F.sum("_c").alias("_m"), F.count(F.lit(1)).alias("_w"))
        per = sums.groupBy(*inner, "_r1", "_r2").agg(F.array_sort(F.collect_list(F.struct("_s", "_m", "_w"))).alias("_h"))
        # the slots that hold the two ranks; at most grid + 2 of them per group
        before = lambda r: F.aggregate("_h", F.struct(F.lit(0).cast("long").alias("b"), F.lit(-1).alias("s"), F.lit(0).cast("long").alias("o")), lambda a, x: F.when((a["s"] < 0) & (a["b"] + x["_m"] > F.col(r)), F.struct((a["b"] + x["_m"]).alias("b"), x["_s"].alias("s"), a["b"].alias("o"))).otherwise(F.struct((a["b"] + x["_m"]).alias("b"), a["s"].alias("s"), a["o"].alias("o"))))
        found = per.withColumn("_a", before("_r1")).withColumn("_b", before("_r2"))
        window = cut(found.select(*inner, F.col("_a.s").alias("_lo"), F.col("_b.s").alias("_hi"), (F.col("_r1") - F.col("_a.o")).alias("_r1"), (F.col("_r2") - F.col("_a.o")).alias("_r2")))
        kept = null_safe_join(null_safe_join(left, marks, inner).withColumn("_s", slot), window, inner).where(F.col("_s").between(F.col("_lo"), F.col("_hi")))
        left = cut(kept.select(*inner, "_v", "_c"))
        sizes = left.groupBy(*inner).agg(F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_n"))
        state = cut(null_safe_join(sizes, window.select(*inner, "_r1", "_r2"), inner))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    final = rows.groupBy(*inner, "_r1", "_r2").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_w"))
    pick = lambda r: F.aggregate("_w", F.struct(F.lit(0).cast("long").alias("b"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["b"] + x["_c"]).alias("b"), F.when(a["v"].isNull() & (a["b"] + x["_c"] > F.col(r)), x["_v"]).otherwise(a["v"]).alias("v")))["v"]
    done = final.withColumn("_lo", pick("_r1")).withColumn("_hi", pick("_r2"))
    # halves are exact, so this is (lo + hi) / 2 rounded once, without its overflow
    median = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * F.lit(0.5) + F.col("_hi") * F.lit(0.5))
    return done.select(*[F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)], median.alias(out))
