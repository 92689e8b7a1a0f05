"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a document with at most k edits shares at least m - q + 1 - k q character
q-grams with it, on diagonals (place in the document minus place in the item) that differ by k at most.  Shared
q-grams are therefore counted in overlapping diagonal bands of twice the budget's width; a band that reaches the
bound is a region, and a banded alignment decides it.

Texts are compared in lower case, with every run of characters other than letters and digits as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, mix64, pick

Q = 9
#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of benchmark text that one pass over the documents holds (8 bytes a character and more in each task).
PASS_CHARS = 4 << 20
#: Bits of the table that most q-grams of a document fail.
SIEVE = 22

_plain: list[np.ndarray] = []


def plain_table() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    if not _plain:
        table = np.ones(0x110000, dtype=bool)
        table[:0x10000] = [chr(c).isalnum() for c in range(0x10000)]
        _plain.append(table)
    return _plain[0]


def normal_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared form, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have a longer small form: leave those texts' letters single
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = plain_table()[np.minimum(codes, 0x10FFFF)]
    first = plain.copy()
    first[1:] |= plain[:-1]  # the first sign behind a word stays, as its space
    at = np.flatnonzero(first)
    return np.where(plain[at], codes[at], 32).astype(np.uint32), at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    n = len(codes) - q + 1
    wide = codes.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[j : j + n]
    return mix64(h)


@dataclass
class Item:
    item_id: int
    codes: np.ndarray
    budget: int

    @property
    def least(self) -> int:
        """Shared q-grams that an occurrence within the budget has at least."""
        return len(self.codes) - Q + 1 - self.budget * Q


def make_item(item_id: int, text: str, rate: float) -> Item | None:
    codes, _ = normal_codes(text)
    while len(codes) and codes[-1] == 32:
        codes = codes[:-1]
    if not len(codes):
        return None
    # the budget never exceeds what the lemma can prove with one shared q-gram
    return Item(item_id, codes, max(0, min(int(rate * len(codes)), (len(codes) - Q) // Q)))


def best_alignment(item: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` within ``text``, if within the budget.

    One row of the edit table at a time, each over the whole (narrow) region; free ends in the text.
    """
    n = len(text)
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, dtype=np.int64), steps.copy()
    wide = np.int64(n + 2)
    for i, c in enumerate(item, 1):
        # cost and start in one number: ties go to the later start, which makes the region tight
        best = np.empty(n + 1, dtype=np.int64)
        best[0] = i * wide + n
        diagonal = (cost[:-1] + (text != c)) * wide + (n - start[:-1])
        down = (cost[1:] + 1) * wide + (n - start[1:])
        best[1:] = np.minimum(diagonal, down)
        best = np.minimum.accumulate(best - steps * wide) + steps * wide
        cost, start = best // wide, n - best % wide
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Matcher:
    """Finds a fixed set of items in texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.short = [i for i, x in enumerate(items) if len(x.codes) < Q]
        hashes, owner, place = [], [], []
        for i, item in enumerate(items):
            h = gram_hashes(item.codes, Q)
            hashes.append(h)
            owner.append(np.full(len(h), i, dtype=np.int64))
            place.append(np.arange(len(h), dtype=np.int64))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)
        self.sieve = np.zeros(1 << SIEVE, dtype=bool)
        self.sieve[(self.grams >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
        self.width = np.array([x.budget + 1 for x in items], dtype=np.int64)
        self.least = np.array([x.least for x in items], dtype=np.int64)
        self.size = np.array([len(x.codes) for x in items], dtype=np.int64)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each region of ``text`` that an item occurs in; places in characters."""
        codes, at = normal_codes(text)
        found: list[tuple[int, int, int, int]] = []
        h = gram_hashes(codes, Q)
        passed = np.flatnonzero(self.sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)])
        if passed.size and self.grams.size:
            slot = np.minimum(np.searchsorted(self.grams, h[passed]), len(self.grams) - 1)
            same = self.grams[slot] == h[passed]
            passed, slot = passed[same], slot[same]
            for i, low, high in self.regions(passed, slot):
                item = self.items[i]
                a = max(0, low - item.budget)
                b = min(len(codes), high + len(item.codes) + item.budget)
                best = best_alignment(item.codes, codes[a:b], item.budget)
                if best and best[2] > best[1]:
                    found.append((i, a + best[1], a + best[2], best[0]))
        for i in self.short:
            whole = codes.tobytes()
            want = self.items[i].codes.tobytes()
            place = whole.find(want)
            while place >= 0:
                if place % 4 == 0:
                    found.append((i, place // 4, place // 4 + len(want) // 4, 0))
                place = whole.find(want, place + 1)
        # of overlapping regions of an item the one with the fewest edits stays
        kept: list[tuple[int, int, int, int]] = []
        for i, a, b, edits in sorted(set(found), key=lambda x: (x[0], x[3], x[1])):
            if not any(k[0] == i and k[1] < b and a < k[2] for k in kept):
                kept.append((i, a, b, edits))
        return [(i, int(at[a]), int(at[b - 1]) + 1, edits) for i, a, b, edits in sorted(kept, key=lambda x: (x[1], x[0]))]

    def regions(self, passed: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest and highest diagonal) of the bands whose shared q-grams reach the item's bound."""
        times = self.count[slot]
        entry = np.repeat(self.first[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner = self.owner[entry]
        diagonal = np.repeat(passed, times) - self.place[entry]
        # an item with fewer hits than its bound anywhere in the text is out
        total = np.bincount(owner, minlength=len(self.items))
        live = total[owner] >= self.least[owner]
        owner, diagonal = owner[live], diagonal[live]
        if not owner.size:
            return
        band = np.floor_divide(diagonal, self.width[owner])
        # each diagonal lies in two overlapping bands: its own and the one before
        low = band.min() - 1
        span = band.max() - low + 2
        keys, counts = np.unique(np.concatenate([owner * span + band - low, owner * span + band - low - 1]), return_counts=True)
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            i, b = key // span, key % span + low
            if n >= self.least[i]:
                yield i, int(b * self.width[i]), int((b + 2) * self.width[i] - 1)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """One row per region of a document in which a benchmark item occurs: doc_id, item_id, start, end, edits.

    Places are characters of the original text.  Only whole items count, within ``rate`` edits a character (less for
    items so short that the lemma would prove nothing).  Items that are null or hold no letter or digit match nothing;
    a null or empty document has no rows; repeated documents or items give rows each.  A benchmark of more than
    ``pass_chars`` characters is dealt to several passes by a hash.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    items = pick(benchmark, item_id="item_id", text="text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // pass_chars))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, start long, end long, edits int"
    out = None
    for part in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == part).collect()
        made = [x for x in (make_item(r["item_id"], r["text"], rate) for r in rows) if x]

        def match(batches: Iterator[pa.RecordBatch], made: list[Item] = made) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(made)
            for batch in blocks(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(d, matcher.items[i].item_id, a, b, e) for d, text in zip(ids, batch.column("text").to_pylist(), strict=True) if text for i, a, b, e in matcher.find(text)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        found = texts.mapInArrow(match, schema)
        out = found if out is None else out.unionByName(found)
    return out
