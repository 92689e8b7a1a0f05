"""Sharding: a keyed permutation of global row numbers deals rows to shards.

Every row gets its global rank; a balanced Feistel network over the smallest power of four that holds all ranks,
with cycle walking, permutes the ranks 0..n-1.  The permuted number alone gives ``shard = p mod shards`` and
``slot = p div shards``: shard sizes differ by one at most, slots have no gaps, and both directions can be computed
for any row without a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered
from tessera.llm.common import mix64, pick

ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0..n-1, reproducible from (n, seed)."""

    n: int
    seed: int

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, right: np.ndarray, k: int) -> np.ndarray:
        key = np.uint64(((self.seed + 1) * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64))
        return mix64(right + key) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return (left << half) | right

    def _walk(self, rows: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(rows, dtype=np.uint64), back)
        outside = np.flatnonzero(out >= np.uint64(self.n))
        while outside.size:
            out[outside] = self._once(out[outside], back)
            outside = outside[out[outside] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Row numbers to their places."""
        return self._walk(rows, False)

    def row(self, places: np.ndarray) -> np.ndarray:
        """Places to the row numbers that hold them."""
        return self._walk(places, True)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, row_number, shard, slot.

    The global row number ranks rows by id (nulls first), then text checksum and size; rows equal in all three are
    interchangeable.  A null text has 0 bytes and checksum 0; size is bytes plus 8.  Repeated rows each get a place.
    An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = pick(docs, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    ranked, n = numbered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    order = Permutation(n, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = order.place(batch.column("row_number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=[*batch.schema.names, "shard", "slot"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(deal, f"{kind}, shard int, slot long")
