"""Token counts of whole texts by a sentencepiece model.

Ordinary documents are encoded at once.  A huge one is encoded in overlapping chunks with offsets: the tokens of two
neighbours are spliced at a boundary that both have inside the overlap and that is proven stable; where the overlap
holds none, it is widened until one is found or the rest of the document is one chunk.

Proof of stability: if no piece of the model holds a space sign behind another sign, no merge can ever join the
characters on both sides of "other sign, space".  Such a place is a token boundary in every encoding of every text
around it, and the tokens on each side depend on that side alone.  The model's pieces are checked when it is loaded;
a model that breaks the rule has its documents encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import blocks, pick

SPACE = "▁"
#: Documents above so many characters are encoded in chunks of that many bytes, which overlap by OVERLAP at first.
CHUNK, OVERLAP = 1 << 16, 512

_models: dict[str, Model] = {}


class Model:
    """A sentencepiece model and what is proven about its pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()))
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        # white space may only count as itself: the normaliser must keep runs of spaces and line ends
        kept = self.processor.decode(self.processor.encode("a  b\n\n c")) == "a  b\n\n c"
        self.stable = kept and not any(inner.search(p) for p in pieces)

    def ends(self, text: bytes) -> np.ndarray:
        """The end of each token in bytes."""
        return np.fromiter((p.end for p in self.processor.encode(text.decode(), return_type="proto").pieces), dtype=np.int64)

    def count(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, x in enumerate(texts) if not self.stable or len(x) <= chunk]
        for i, ids in zip(short, self.processor.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            out[i] = self.spliced(texts[i], chunk, overlap)
        return out

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """The token count of a huge text, from chunks of ``chunk`` bytes."""
        raw = text.encode()
        total, start, left = 0, 0, 0  # left: the place in the current chunk from which its tokens count
        while True:
            stop = whole(raw, min(len(raw), start + chunk))
            ends = self.ends(raw[start:stop]) + start
            first = int(np.searchsorted(ends, left, side="right")) if left else 0
            if stop == len(raw):
                return total + len(ends) - first
            wide, follow = overlap, None
            while follow is None and wide < 2 * (stop - left):
                follow = self.boundary(raw, ends, max(stop - wide, left + 1), stop)
                wide *= 2
            if follow is None:  # no stable boundary in this chunk: the same start, a longer chunk
                chunk *= 2
                continue
            total += int(np.searchsorted(ends, follow, side="right")) - first
            start, left = whole(raw, max(start, follow - overlap)), follow

    @staticmethod
    def boundary(raw: bytes, ends: np.ndarray, after: int, stop: int) -> int | None:
        """The last token end in [after, stop) that lies between another character and a space."""
        for place in ends[(ends >= after) & (ends < stop)][::-1].tolist():
            if raw[place] == 0x20 and raw[place - 1] != 0x20 and raw[place - 3 : place] != SPACE.encode():
                return place
        return None


def whole(raw: bytes, place: int) -> int:
    """The start of the character that holds byte ``place``."""
    while 0 < place < len(raw) and raw[place] & 0xC0 == 0x80:
        place -= 1
    return place


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the library's for the whole text, without begin or end tokens.  A null or empty text has 0 of both.
    Repeated rows are counted each; an empty table gives no rows; other columns play no part.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model(model_path)
        for batch in blocks(batches):
            text = batch.column("text")
            n = pa.array(counter.count([x or "" for x in text.to_pylist()], chunk, overlap), type=pa.int64())
            size = pa.compute.binary_length(text).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pa.compute.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = pick(docs, doc_id=id_col, text=text_col)
    return picked.mapInArrow(count, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
