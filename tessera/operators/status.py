"""Status coordinate and sampling.

``status_coordinate`` attaches the third coordinate from the id map by a
left join on the key (the map has one row per id, so no row multiplies);
Catalyst broadcasts the map when its size statistics allow, otherwise it is
a shuffle join.  Jitter is a pure function of (id, seed), so a recomputed
partition after a lost executor yields identical values.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import gaussian_from_key


def status_coordinate(
    df: DataFrame,
    id_map: DataFrame | None,
    id_col: str = "id",
    default: float = 0.0,
    jitter_sd: float = 0.0,
    seed: int = 42,
    out: str = "emb_z",
) -> DataFrame:
    """P9 (+P10): ``out`` = default; 1 for ids in the ``on`` set; 0 for ids in
    the ``not`` set (the ``not`` set wins on overlap); plus N(0, sd) jitter.

    ``id_map``: ``(id, in_on, in_not)``.  A missing id column or map gives
    the default for all rows, with a warning.
    """
    if id_col not in df.columns or id_map is None:
        if id_col not in df.columns:
            warnings.warn(f"without a column {id_col!r} no row can be looked up: {out} is {default} everywhere", stacklevel=2)
        z = F.lit(float(default))
        res = df
    else:
        m = id_map.select(F.col("id").alias(id_col), F.col("in_on").alias("__on"), F.col("in_not").alias("__not"))
        res = df.join(m, id_col, "left")
        z = (F.when(F.coalesce("__not", F.lit(False)), F.lit(0.0))
              .when(F.coalesce("__on", F.lit(False)), F.lit(1.0))
              .otherwise(F.lit(float(default))))
    if jitter_sd:
        key = F.col(id_col) if id_col in df.columns else F.monotonically_increasing_id()
        z = z + F.lit(float(jitter_sd)) * gaussian_from_key(key, seed)
    res = res.withColumn(out, z)
    return res.drop("__on", "__not")


def exact_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """O1: exactly ``min(n, rows)`` rows, uniform without replacement, seeded.

    Rows are ranked by ``md5(id || '-' || seed)`` (ties by id); the first n
    are kept.  The choice depends only on the keys, not on partitioning.
    Counts by the first four digits of the key (65,537 rows at most) give the
    digits at which the sample ends: rows below them are kept by a filter,
    and only the rows that share them are ordered.
    """
    key = F.coalesce(F.md5(F.concat(F.col(id_col).cast("string"), F.lit("-"), F.lit(str(seed)))), F.lit(""))
    digits = F.substring(key, 1, 4)
    counts = df.groupBy(digits.alias("d")).count().collect()  # bounded by the number of four-digit heads
    if sum(r["count"] for r in counts) <= n:
        return df
    below, border = 0, None
    for r in sorted(counts, key=lambda r: r["d"]):
        if below + r["count"] > n:
            border = r["d"]
            break
        below += r["count"]
    edge = df.where(digits == border).orderBy(key, F.col(id_col)).limit(n - below)
    return df.where(digits < border).unionByName(edge)
