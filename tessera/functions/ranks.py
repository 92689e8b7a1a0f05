"""Global ranks without a single task: range exchange, sort, and one count per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut


def numbered(df: DataFrame, order: list[Column | str], out: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with its rank from 0 by ``order`` as a long column, and the row count.

    No task sees more than its range.  A written partition and place make the order final; the driver sees one count
    for each partition.  Rows that tie in ``order`` get different ranks in any order among themselves, fixed once
    written.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written first: the range exchange reads its input twice, and the salt, which spreads equal rows over ranges, is fixed
    salted = cut(df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())))
    ranged = salted.repartitionByRange(parts, *order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    placed = cut(ranged.withColumn("__place", F.monotonically_increasing_id()))
    place = F.col("__place")
    counts = placed.groupBy(F.shiftright(place, 33).alias("p")).count().collect()
    base, total = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        base[p] = total
        total += n
    if not base:
        return placed.withColumn(out, place).drop("__place"), 0
    offsets = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    rank = offsets[F.shiftright(place, 33)] + place.bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(out, rank.cast("long")).drop("__place"), total
