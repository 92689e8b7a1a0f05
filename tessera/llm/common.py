"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.functions.ranks import numbered

#: White space: a word is any run without these bytes.
SPACE_BYTES = bytes([9, 10, 11, 12, 13, 32])

#: Bytes of text that a task turns into NumPy arrays at once.
BLOCK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark alone (any store it knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names: extra or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets (nulls have no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], size: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about BLOCK_BYTES of the text column (or one longer document)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(size or "text")).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_byte_codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Two primes below 2^31, so that products of residues fit 64 bits, and for each a base; together about 62 bits.
_FIELDS = ((2147483647, 1103515245), (2147483629, 1812433253))
_powers: dict[tuple[int, int], np.ndarray] = {}
#: Codes that are multiplied at once; between these, only 32-bit residues are held.
_CHUNK = 1 << 17


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, kept for later calls unless very many."""
    have = _powers.get((prime, base))
    if have is None or len(have) < n:
        have = np.ones(max(n, BLOCK_BYTES + (1 << 16)), dtype=np.uint32)
        done = 1
        while done < len(have):
            more = min(done, len(have) - done, _CHUNK)
            have[done : done + more] = have[:more].astype(np.uint64) * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += more
        if len(have) <= 2 * BLOCK_BYTES:
            _powers[prime, base] = have
    return have[:n]


class Hashes:
    """Hashes of any slice of a row of 64-bit codes: equal slices have equal hashes wherever they stand.

    Polynomials modulo two primes: unlike modulo 2^64, no sequence of words makes them equal whatever the base.
    """

    def __init__(self, codes: np.ndarray):
        self.fields = []
        for prime, base in _FIELDS:
            p, step = np.uint64(prime), powers(prime, base, len(codes))
            sums = np.zeros(len(codes) + 1, dtype=np.uint32)
            last = np.uint64(0)
            for start in range(0, len(codes), _CHUNK):
                part = slice(start, start + _CHUNK)
                terms = codes[part] % p * step[part] % p  # below 2^31: 2^17 of them fit 64 bits
                terms[0] += last
                total = np.cumsum(terms) % p
                sums[start + 1 : start + 1 + len(total)] = total
                last = total[-1]
            self.fields.append((p, sums, powers(prime, pow(base, -1, prime), len(codes) + 1)))

    def of(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        """One hash per slice; the slice's length counts."""
        first, second = ((sums[stop].astype(np.uint64) + p - sums[start]) * back[start] % p for p, sums, back in self.fields)
        return mix64(((first << np.uint64(32)) | second) + mix64((stop - start).astype(np.uint64) + np.uint64(salt * 0x100000001)))


def byte_hashes(raw: np.ndarray) -> Hashes:
    return Hashes(_byte_codes[raw])


_space = np.zeros(256, dtype=bool)
_space[list(SPACE_BYTES)] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the texts in ``raw``, and the n + 1 places where each text's words begin."""
    word = ~_space[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]  # a word never crosses two texts
    start[edges] = word[edges]
    end[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents under a long key that orders as their ids do: (doc, text, copies) and (doc, doc_id) per input row.

    Unique ids that are longs are the key themselves; then there is no second table.  Otherwise rows with the same id and text are one document
    (``copies`` of them), and keys rank the documents by id (nulls first), then by hashes of the text.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    whole = texts.schema["doc_id"].dataType.typeName() == "long"
    odd = texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if whole and odd.isEmpty():
        return texts.select(F.col("doc_id").alias("doc"), "text", F.lit(1).cast("long").alias("copies")), None
    marked = texts.select("doc_id", "text", F.xxhash64("text").alias("h"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    groups = marked.groupBy("doc_id", "h", "m").agg(F.count("*").alias("copies"))
    ranked, _ = numbered(groups, [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("m")], out="doc")
    same = marked["doc_id"].eqNullSafe(ranked["doc_id"]) & (marked["h"] == ranked["h"]) & (marked["m"] == ranked["m"])
    joined = cut(marked.join(ranked, same).select("doc", marked["doc_id"], "text", "copies"))
    return joined.groupBy("doc").agg(F.first("text").alias("text"), F.first("copies").alias("copies")), joined.select("doc", "doc_id")


def by_id(done: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Results per ``doc`` as one row per input row, under ``doc_id``."""
    if ids is None:
        return done.withColumnRenamed("doc", "doc_id")
    return ids.join(done, "doc").drop("doc")
