"""Removal of repeated word sequences by recompression.

Rounds name runs of equal words and then pairs of symbols, each name a function of what it stands for, so that equal
word sequences get equal symbols everywhere in the corpus but near their ends.  With every symbol goes the stretch of
words that decided it.  A window's anchor is the first of its highest symbols that were decided inside the window; it
depends on the window's words alone, so equal windows have equal anchors at equal offsets.

Runs of windows with one anchor are records.  Records meet by the anchor's name: equal contexts repeat whole, and
where one anchor has several contexts, the windows of each context's first record are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import Hashes, blocks, by_id, byte_hashes, keyed_documents, mix64, text_bytes, word_bounds

#: Rounds of pair naming.  More of them make anchors rarer by chance and records shorter; results do not depend on it.
ROUNDS = 3


def named(*parts: np.ndarray | int) -> np.ndarray:
    """The name of a sequence of symbols."""
    out = np.uint64(0x9E3779B97F4A7C15)
    for x in parts:
        out = mix64((out ^ (x if isinstance(x, np.ndarray) else np.uint64(x))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(parts)))
    return out


def symbol_levels(codes: np.ndarray, doc: np.ndarray, first: np.ndarray, width: int, rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(from, to, name, place) of the symbols of each level that were decided within ``width`` words.

    [from, to) are the words that decide the symbol, place is its first word.  What lies beyond a document's end
    decides nothing: symbols that would need it reach one word over the end, which no window contains.
    """
    n = len(codes)
    place = np.arange(n)
    low, high, name = place.copy(), place + 1, codes
    yield low, high, name, place
    # runs of equal words, known by the words before and after them
    start = np.ones(n, dtype=bool)
    start[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(start)
    length = np.diff(np.append(begin, n))
    name = np.where(length > 1, named(name[begin], length.astype(np.uint64)), name[begin])
    place, low, high = begin, begin - 1, begin + length + 1
    doc = doc[begin]
    yield fitting(low, high, name, place, width)
    for k in range(rounds):
        if len(name) < 2:
            return
        left = mix64(name ^ mix64(np.full(1, k + 1, np.uint64))) >> np.uint64(63) == 0
        same = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & same
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair[:-1]
        # a left symbol that stays alone was decided by the next, a right one by the one before
        before = np.append(doc[0] - 1, np.where(same, low[:-1], first[doc[1:]] - 1))
        before[0] = first[doc[0]] - 1
        after = np.append(np.where(same, high[1:], first[doc[:-1] + 1] + 1), first[doc[-1] + 1] + 1)
        follow = np.append(name[1:], np.uint64(0))
        low = np.where(~left & ~second, np.minimum(low, before), low)
        high = np.where(left, np.maximum(high, after), high)
        name = np.where(pair, named(name, follow, k), name)
        stay = ~second
        low, high, name, place, doc = low[stay], high[stay], name[stay], place[stay], doc[stay]
        level = fitting(low, high, name, place, width)
        if not len(level[0]):
            return
        yield level


def fitting(low: np.ndarray, high: np.ndarray, name: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    fit = high - low <= width
    return low[fit], high[fit], name[fit], place[fit]


def lowest(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The place of the smallest of values[start:stop] (the first, in a tie) for each non-empty slice."""
    table = [np.arange(len(values))]
    most = int((stop - start).max(initial=1))
    while 2 << (len(table) - 1) <= most:
        step, x = 1 << (len(table) - 1), table[-1]
        left, right = x[: len(x) - step], x[step:]
        table.append(np.where(values[right] < values[left], right, left))
    depth = np.zeros(most + 1, dtype=np.int64)
    for k in range(1, len(table)):
        depth[1 << k :] = k
    k = depth[stop - start]
    out = np.empty(len(start), dtype=np.int64)
    for j, x in enumerate(table):
        at = np.flatnonzero(k == j)
        left, right = x[start[at]], x[stop[at] - (1 << j)]
        out[at] = np.where(values[right] < values[left], right, left)
    return out


def window_records(codes: np.ndarray, first: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(name, context, sides, doc, start, windows) of each run of windows with one anchor; start is a word of the document.

    ``sides`` packs a hash of the words before the anchor and one of those behind it, each as many as one side of any
    window of the record at least holds when the other side holds fewer.
    """
    count = np.diff(first)
    windows = np.maximum(count - width + 1, 0)
    total = int(windows.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    owner = np.repeat(np.arange(len(count)), windows)
    s = first[:-1][owner] + np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    doc = np.repeat(np.arange(len(count)), count)
    anchor, name = np.zeros(total, np.int64), np.zeros(total, np.uint64)
    open_ = np.arange(total)
    levels = list(symbol_levels(codes, doc, first, width, rounds))
    for k in reversed(range(len(levels))):
        low, high, symbol, place = levels[k]
        start, stop = np.searchsorted(low, s[open_]), np.searchsorted(high, s[open_] + width, side="right")
        inside = stop > start
        hit = open_[inside]
        if len(hit):
            at = lowest(mix64(symbol + np.uint64(k)), start[inside], stop[inside])
            anchor[hit] = place[at] * (rounds + 2) + k
            name[hit] = named(symbol[at], k)
        open_ = open_[~inside]
        if not len(open_):
            break
    new = np.ones(total, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, total))
    start, doc = s[begin], owner[begin]
    place = anchor[begin] // (rounds + 2)
    every = Hashes(codes)
    context = named(every.of(start, start + run + width - 1), (place - start).astype(np.uint64))
    # a window with fewer than half words before the anchor's first word has at least the other half from it on
    half = width // 2
    before = every.of(np.maximum(place - half, first[doc]), place)
    behind = every.of(place, np.minimum(place + width - half, first[doc + 1]))
    sides = (before >> np.uint64(64 - SIDE) << np.uint64(SIDE) | behind >> np.uint64(64 - SIDE)).astype(np.int64)
    return name[begin], context, sides, doc, start - first[doc], run


def first_of(keys: list[np.ndarray], order: np.ndarray, before: tuple | None) -> np.ndarray:
    """For rows in ``order``, whether each differs from the row before it (``before`` stands before the first)."""
    new = np.zeros(len(order), dtype=bool)
    for j, key in enumerate(keys):
        x = key[order]
        new[1:] |= x[1:] != x[:-1]
        new[:1] |= before is None or x[:1] != before[j]
    return new


#: A mark: hashes that meet, document, first window, and (in ``tail``) the number of windows with the sides' hashes
#: below it; a negative tail is a repeat already found, of so many windows.
MARK = "a long, b long, doc long, start long, tail long"
SIDE = 16


def marks(a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(start), pa.array(tail)], names=["a", "b", "doc", "start", "tail"])


def met_in_block(a: np.ndarray, b: np.ndarray, sides: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Open marks for the first of equal (a, b) in this block; the later ones are repeats already."""
    order = np.lexsort((start, doc, b, a))
    new = first_of([a, b], order, None)
    keep, gone = order[new], order[~new]
    yield marks(a[keep], b[keep], doc[keep], start[keep], windows[keep] << (2 * SIDE) | sides[keep])
    gone = gone[np.lexsort((start[gone], doc[gone]))]
    d, s, w = doc[gone], start[gone], windows[gone]
    fresh = np.ones(len(gone), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + w[:-1])
    at = np.flatnonzero(fresh)
    merged = np.add.reduceat(w, at) if len(at) else w
    spread = mix64(d[at].astype(np.uint64))  # repeats need no meeting: any partition will do
    yield marks(spread, spread, d[at], s[at], -merged)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def met_by_side(name: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that another of the same name equals on one side; groups at either end may go on: all."""
    keep = (name == name[0]) | (name == name[-1])
    for shift in (0, SIDE):
        key = mix64(name + mix64((tail >> shift & ((1 << SIDE) - 1)).astype(np.uint64)))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        keep |= times[back] > 1
    return keep


def meet(rows: DataFrame, contexts: bool) -> DataFrame:
    """Marks in the order of (a, b, doc, start): all but the first of equal (a, b) become repeats.

    With ``contexts``, the first row of each b is left open if its a has several that agree on one side.  Tasks stream
    over their sorted rows and hold one Arrow batch.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        waiting: tuple | None = None  # the last first row, until its a is known to go on
        for batch in batches:
            found = pa.compute.less(batch.column("tail"), 0)
            done, live = batch.filter(found), batch.filter(pa.compute.invert(found))
            if done.num_rows:
                yield done
            if not live.num_rows:
                continue
            a, b = unsigned(live.column("a")), unsigned(live.column("b"))
            doc, start, tail = (live.column(c).to_numpy() for c in ("doc", "start", "tail"))
            new = first_of([a, b], np.arange(len(a)), last)
            last = (a[-1:], b[-1:])
            gone = np.flatnonzero(~new)
            if len(gone):
                yield marks(a[gone], b[gone], doc[gone], start[gone], -(tail[gone] >> (2 * SIDE)))
            head = np.flatnonzero(new)
            if not contexts or not len(head):
                continue
            columns = [x[head] for x in (a, b, doc, start, tail)]
            shared = np.zeros(len(head), dtype=bool)
            if waiting is not None:
                columns = [np.concatenate([w, c]) for w, c in zip(waiting[0], columns, strict=True)]
                shared = np.append(waiting[1], shared)
            same = columns[0][1:] == columns[0][:-1]
            shared[1:] |= same
            shared[:-1] |= same
            out = np.flatnonzero((shared & met_by_side(columns[0], columns[4]))[:-1])
            yield marks(*[c[out] for c in columns])
            waiting = ([c[-1:] for c in columns], shared[-1:])
        if waiting is not None and waiting[1][0]:
            yield marks(*waiting[0])

    return rows.repartition("a").sortWithinPartitions("a", "b", "doc", "start").mapInArrow(stream, MARK)


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes, word starts and ends, where each text's words begin, and the words' codes."""
    raw, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_bounds(raw, offsets)
    return raw, starts, ends, first, byte_hashes(raw).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def spread(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and windows of the entries of a column of lists of (start, windows); nulls have none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), flat.field("start").to_numpy(), flat.field("windows").to_numpy()


def remove_repeats(docs: DataFrame, width: int = 20, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, text (kept words, one space between), removed (spans).

    A word goes if a window of ``width`` words covers it whose word sequence also starts earlier: in a document with a
    smaller id, or earlier in the same.  ``removed`` lists the maximal spans of removed words as (start, end).  Words
    are runs without ASCII white space, unchanged.  A null text has no words.  Rows with the same id and text are one
    document; rows that share an id but not the text are ordered by hashes of the text; null ids come first.
    """
    texts, ids = keyed_documents(docs, id_col, text_col)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            _, _, _, first, codes = words_of(batch)
            name, context, sides, owner, start, windows = window_records(codes, first, width, rounds)
            yield from met_in_block(name, context, sides, batch.column("doc").to_numpy()[owner], start, windows)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            _, _, _, first, codes = words_of(batch)
            row, start, windows = spread(batch.column("open"))
            row, start = np.repeat(row, windows), np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            at = first[:-1][row] + start
            other = mix64(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            yield from met_in_block(Hashes(codes).of(at, at + width), Hashes(other).of(at, at + width), np.zeros(len(row), np.int64), batch.column("doc").to_numpy()[row], start, np.ones(len(row), np.int64))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw, starts, ends, first, _ = words_of(batch)
            row, start, windows = spread(batch.column("gone"))
            change = np.zeros(len(starts) + 1, dtype=np.int64)
            begin = first[:-1][row] + start
            np.add.at(change, begin, 1)
            np.add.at(change, begin + windows + width - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            whole = raw.tobytes()
            texts, spans, count, removed = [], [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                lost = gone[a:b]
                count.append(b - a)
                removed.append(int(lost.sum()))
                stay = np.flatnonzero(~lost) + a
                texts.append(b" ".join([whole[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, kind)], names=["doc", "n_words", "n_removed", "text", "removed"])

    met = cut(meet(texts.select("doc", "text").mapInArrow(records, MARK), True).select("doc", "start", "tail"))
    repeats = lambda rows: rows.filter("tail < 0").select("doc", "start", (-F.col("tail")).alias("windows"))
    lists = lambda rows, name: rows.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias(name))
    open_ = texts.join(lists(met.filter("tail > 0").select("doc", "start", F.shiftright("tail", 2 * SIDE).alias("windows")), "open"), "doc").select("doc", "text", "open")
    late = meet(open_.mapInArrow(compared, MARK), False)
    gone = lists(repeats(met).unionByName(repeats(late)), "gone")
    done = texts.join(gone, "doc", "left").select("doc", "text", "gone").mapInArrow(kept, "doc long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>")
    return by_id(done, ids)
