"""Packing by power-of-two decomposition.

A document's token ids (with the end id) are cut into pieces whose lengths are powers of two, at most the sequence
length: whole sequences first, then the binary digits of the rest from large to small.  Pieces of equal length form
a bucket and each piece is a sequence of its bucket, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered
from tessera.llm.common import blocks, pick

#: Fixed value: how a byte-level BPE file splits text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The file's vocabulary as ranked byte strings, if its ids alone define the merges; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    added = {x["content"] for x in spec.get("added_tokens", [])}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in pairs]
    in_order = all(x < y for x, y in zip(merged, merged[1:]))
    return ranks if in_order and len(ranks) == 256 + len(merged) else None


class Encoder:
    """Token ids of whole texts as the ``tokenizers`` library gives them for a file, as little-endian 32-bit bytes.

    For a byte-level BPE file whose ids are its merge ranks, the ids come from ``tiktoken`` over that same file's
    vocabulary, which is several times as fast; texts that hold an added token's string, and all texts of other
    files, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = byte_ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            ids = None
            if self.fast is not None and not any(x in text for x in self.added):
                try:
                    ids = self.fast.encode_to_numpy(text, disallowed_special=())
                except ValueError:  # its pattern gives up on very long runs of blanks
                    ids = None
            if ids is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            yield np.asarray(ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_lengths(n: int, sequence: int) -> list[int]:
    """Whole sequences, then the binary digits of the rest, largest first."""
    rest = n % sequence
    return [sequence] * (n // sequence) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked).

    ``tokenizer``: path of a byte-level BPE file of the ``tokenizers`` library, the same on all machines.
    ``sequence`` is a power of two.  Sequence ids run from 0 over the buckets, the longest pieces first, then by
    document and start.  A null or empty text is the end id alone.  Repeated rows are packed each; an empty table
    gives no rows.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc, coded in zip(ids, encode.encode_all([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                coded += end
                total, start = len(coded) // 4, 0
                for length in piece_lengths(total, sequence):
                    part = coded[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), total, part if with_ids else None))
                    start += length
            columns = list(zip(*rows, strict=True))
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    picked = pick(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    made = picked.mapInArrow(pieces, schema)
    ranked, _ = numbered(made, [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")], out="sequence_id")
    return ranked.withColumn("offset", F.lit(0).cast("long"))


def token_ids(piece: bytes) -> np.ndarray:
    """The ids of a piece's ``ids`` column."""
    return np.frombuffer(piece, dtype="<u4")
