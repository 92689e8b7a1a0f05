"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of N bytes has an anchor that its bytes alone decide: the place of the least hash of Q bytes in its first
half.  Only suffixes at anchors are sorted, so equal strings meet through suffixes that share at least the anchor's
core of N/2 + 1 bytes; anchors whose core stands nowhere else are left out by their hash.

The suffixes at the others are sorted twice: by the bytes that follow, and by the bytes that lead up to the core's end,
read backwards.  A task sorts its suffixes into a run, cuts it at splitters and sends each range front-coded: common
prefix length and rest.  A range merges its runs with a loser tree that carries common prefix lengths and so compares
no known prefix again.  Neighbours in the first order give how far a suffix is repeated to the right, in the second
how far to the left, and near neighbours which strings of N bytes around the anchor are repeated.  Where neighbours
leave open which (left and right parts that repeat, but not seen together), the strings themselves are compared.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import blocks, by_id, byte_hashes, keyed_documents, mix64, text_bytes

Q = 16
#: Suffixes that a task sorts at once, suffixes of a range (on average), sampled suffixes a range, neighbours looked at.
RUN, RANGE, SAMPLED, NEAR = 40_000, 40_000, 32, 8
#: Stands behind a suffix; no UTF-8 text holds it.
STOP = b"\xff"


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place (in ``raw``) of each anchor of a string of ``length`` bytes, in order."""
    spots = length // 2
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = byte_hashes(raw)
    n = len(raw) - Q + 1
    at = np.arange(n)
    bits = np.uint64(max(21, int(n).bit_length()))
    # the place in the low bits: the least is then the first of equal hashes, and says where it stands
    least = every.of(at, at + Q) >> bits << bits | at.astype(np.uint64)
    have = 1
    while have * 2 <= spots:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < spots:
        least = np.minimum(least[: len(least) - (spots - have)], least[spots - have :])
    size = np.diff(offsets)
    strings = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), strings)
    start = offsets[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(strings) - strings, strings)
    place = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    return doc[new], place[new]


#: ``sides`` holds the bytes left and right of the place, and above them 1 where the context stood twice in its block.
#: A negative one marks a repeated stretch of ``doc``, from ``place`` to ``context``.
ANCHOR = "core long, context long, doc long, place long, sides long"


def anchor_rows(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """The anchors of a batch; of equal contexts one goes on, and the others' stretches are repeats already."""
    raw, offsets = text_bytes(batch.column("text"))
    doc, place = anchors(raw, offsets, length)
    if not len(doc):
        return
    spots = length // 2
    left = np.minimum(place - offsets[doc], spots - 1)
    right = np.minimum(offsets[doc + 1] - place, length)
    every = byte_hashes(raw)
    core = every.of(place, place + length - spots + 1).view(np.int64)
    context = mix64(every.of(place - left, place + right) ^ mix64(left.astype(np.uint64) + np.uint64(77))).view(np.int64)
    key, inside = batch.column("doc").to_numpy()[doc], place - offsets[doc]
    sides = left << 20 | right
    order = np.lexsort((context, core))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (core[order][1:] != core[order][:-1]) | (context[order][1:] != context[order][:-1])
    again = np.append(~new[1:], False)
    keep, gone = order[new], order[~new]
    yield rows_of(core[keep], context[keep], key[keep], inside[keep], sides[keep] | again[new].astype(np.int64) << 40)
    gone = gone[np.lexsort((inside[gone], doc[gone]))]
    d, a, b = key[gone], inside[gone] - left[gone], inside[gone] + right[gone]
    fresh = np.ones(len(gone), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(gone)) - 1 if len(first) else first
    spread = mix64(d[first].astype(np.uint64)).view(np.int64)
    yield rows_of(spread, b[last], d[first], a[first], np.full(len(first), -1))


def rows_of(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["core", "context", "doc", "place", "sides"])


def meet(rows: DataFrame) -> DataFrame:
    """Rows sorted by (core, context) become: the stretches of contexts that stand twice, and the first row of each
    context of a core that has several.  Tasks stream and hold one Arrow batch."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row; whether its context, or a row of its own, stood before it
        ahead: list[np.ndarray] | None = None  # the last first row, and whether its core had one before

        def settle(c: list[np.ndarray], stop: int) -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            core, context, doc, place, sides, before = c
            same = (core[1:] == core[:-1]) & (context[1:] == context[:-1])
            twice = before | (sides >> 40 > 0)
            twice[1:] |= same
            twice[:-1] |= same
            left, right = sides >> 20 & 0xFFFFF, sides & 0xFFFFF
            gone = np.flatnonzero(twice[:stop])
            if len(gone):
                yield rows_of(core[gone], (place + right)[gone], doc[gone], (place - left)[gone], np.full(len(gone), -1))
            head = np.append(~before[:1], ~same)
            at = np.flatnonzero(head[:stop])
            if not len(at):
                return
            heads = [core[at], context[at], doc[at], place[at], sides[at] & 0xFFFFFFFFFF | twice[at].astype(np.int64) << 40]
            several = np.zeros(len(at), bool)
            if ahead is not None:
                heads = [np.concatenate(x) for x in zip(ahead[:5], heads, strict=True)]
                several = np.append(ahead[5], several)
            kin = heads[0][1:] == heads[0][:-1]
            several[1:] |= kin
            several[:-1] |= kin
            out = np.flatnonzero(several[:-1])
            if len(out):
                yield rows_of(*[x[out] for x in heads])
            ahead = [x[-1:] for x in heads] + [several[-1:]]

        for batch in batches:
            found = pa.compute.less(batch.column("sides"), 0)
            done, live = batch.filter(found), batch.filter(pa.compute.invert(found))
            if done.num_rows:
                yield done
            if not live.num_rows:
                continue
            fresh = [x.to_numpy() for x in live.columns] + [np.zeros(live.num_rows, bool)]
            c = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            yield from settle(c, len(c[0]) - 1)
            same = len(c[0]) > 1 and c[0][-1] == c[0][-2] and c[1][-1] == c[1][-2]
            held = [x[-1:] for x in c[:5]] + [np.array([same or bool(len(c[0]) == 1 and c[5][0])])]
        if held is not None:
            yield from settle(held, 1)
        if ahead is not None and ahead[5][0]:
            yield rows_of(*ahead[:5])

    return rows.repartition("core").sortWithinPartitions("core", "context", "doc", "place").mapInArrow(stream, ANCHOR)


def common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of x and y, of which ``known`` bytes need no comparison."""
    most, step = min(len(x), len(y)), 16
    while known < most:
        end = min(most, known + step)
        if x[known:end] == y[known:end]:
            known, step = end, step * 2
        elif step == 1 or end - known == 1:
            return known
        else:
            step = (end - known) // 2 or 1
            most = end
    return known


class Merge:
    """A loser tree over front-coded sorted runs.

    ``known[r]`` is the common prefix of run r's current string with the last string that won at its node's path.  Of
    two strings the one that shares more with the last winner is smaller; only those that share as much are compared,
    and from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, int]]]):
        self.runs = runs
        self.count = 1 << max(0, len(runs) - 1).bit_length()
        self.text: list[bytes | None] = [None] * self.count
        self.known = [0] * self.count
        self.ref = [0] * self.count
        for r in range(len(runs)):
            self._read(r)
            self.known[r] = 0
        self.loser = [0] * self.count
        self.winner = self._play(1)

    def _read(self, r: int) -> None:
        got = next(self.runs[r], None)
        self.known[r], self.text[r], self.ref[r] = got if got else (0, None, 0)

    def _meet(self, x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two runs."""
        a, b = self.text[x], self.text[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        p, q = self.known[x], self.known[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        p = common(a, b, p)
        if a[p : p + 1] <= b[p : p + 1]:
            self.known[y] = p
            return x, y
        self.known[x] = p
        return y, x

    def _play(self, node: int) -> int:
        if node >= self.count:
            return node - self.count
        win, self.loser[node] = self._meet(self._play(2 * node), self._play(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        while self.text[self.winner] is not None:
            r = self.winner
            yield self.known[r], self.text[r], self.ref[r]
            self._read(r)
            node = (r + self.count) // 2
            while node:
                r, self.loser[node] = self._meet(r, self.loser[node])
                node //= 2
            self.winner = r


PIECE = "part int, prefix binary, size binary, rest binary, doc binary, place binary"


def front_coded(part: int, strings: list[bytes], doc: np.ndarray, place: np.ndarray) -> tuple:
    prefix = [0] + [common(x, y, 0) for x, y in zip(strings, strings[1:])]
    rest = b"".join([x[p:] for x, p in zip(strings, prefix, strict=True)])
    return part, np.array(prefix, np.int32).tobytes(), np.array([len(x) for x in strings], np.int32).tobytes(), rest, doc.tobytes(), place.tobytes()


def decoded(prefix: bytes, size: bytes, rest: bytes, first: int) -> Iterator[tuple[int, bytes, int]]:
    at, last = 0, b""
    for i, (p, n) in enumerate(zip(np.frombuffer(prefix, np.int32).tolist(), np.frombuffer(size, np.int32).tolist(), strict=True)):
        last = last[:p] + rest[at : at + n - p]
        at += n - p
        yield p, last, first + i


def ahead_string(left: bytes, right: bytes, core: int) -> bytes:
    return right + STOP + left[::-1]


def back_string(left: bytes, right: bytes, core: int) -> bytes:
    return (left + right[:core])[::-1] + STOP + right[core:]


def contexts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(document, place, bytes before, bytes from the place on) of the listed places of each text."""
    spots = length // 2
    for doc, text, places in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
        raw = text.encode()
        for p in places:
            yield doc, p, raw[max(0, p - spots + 1) : p], raw[p : p + length]


NEIGHBOUR = "doc long, place long, reach int, low int, high int, part int, last boolean, before binary, after binary"


def neighbours(left: list[bytes], right: list[bytes], length: int, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted contexts: the furthest reach to a neighbour, and the least and most bytes before the anchor of the
    strings seen to stand at a near neighbour too (least above most: none)."""
    n, core = len(left), length - length // 2 + 1
    reach, low, high = np.zeros(n, np.int64), np.full(n, length, np.int64), np.full(n, -1, np.int64)
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    step = 4096
    for a in range(0, n, step):
        b = min(n, a + step + NEAR)
        wide_l, wide_r = max(1, sizes_l[a:b].max()), sizes_r[a:b].max()
        table_l = np.frombuffer(b"".join([x[::-1].ljust(wide_l, STOP) for x in left[a:b]]), np.uint8).reshape(b - a, -1)
        table_r = np.frombuffer(b"".join([x.ljust(wide_r, STOP) for x in right[a:b]]), np.uint8).reshape(b - a, -1)
        for shift in range(1, min(NEAR, b - a - 1) + 1):
            stop = min(step, b - a - shift)
            x = np.arange(stop)
            if shift > 1:  # only contexts of one core can share a string
                x = x[(table_r[x, :core] == table_r[x + shift, :core]).all(1)] if wide_r >= core else x[:0]
            y = x + shift
            if not len(x):
                break
            r = shared(table_r[x], table_r[y], np.minimum(sizes_r[a + x], sizes_r[a + y]))
            v = shared(table_l[x], table_l[y], np.minimum(sizes_l[a + x], sizes_l[a + y]))
            v = np.where(r >= core, v, 0)
            far = v if backward else r
            hit = (r >= core) & (r + v >= length)
            for side in (a + x, a + y):
                np.maximum.at(reach, side, np.where(r >= core, far, 0))
                np.minimum.at(low, side[hit], (length - r)[hit])
                np.maximum.at(high, side[hit], v[hit])
    return reach, low, high


def shared(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of the rows of two byte tables, at most ``most``."""
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return np.minimum(first, most)


def sorted_neighbours(open_texts: DataFrame, length: int, backward: bool, ranges: int, sample: list[tuple[bytes, int, int]]) -> DataFrame:
    """Reach, least and most (see ``neighbours``) of every open place in the order of its suffix, or of its prefix.

    ``open_texts``: doc, text, places.  Runs are sorted in tasks, cut at splitters from ``sample`` (whole strings with
    document and place, so that strings of one long common part are cut too), front-coded, and merged range by range;
    the ends of neighbouring ranges are compared afterwards.
    """
    core = length - length // 2 + 1
    string = back_string if backward else ahead_string
    keys = sorted(sample)
    splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []

        def run() -> pa.RecordBatch:
            held.sort()
            strings = [x[0] for x in held]
            doc, place = (np.array([x[i] for x in held], dtype=np.int64) for i in (1, 2))
            cuts = [0, *(bisect.bisect_left(held, x) for x in splitters), len(strings)]
            rows = [front_coded(i, strings[a:b], doc[a:b], place[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["part", "prefix", "size", "rest", "doc", "place"])

        for batch in batches:
            for piece in blocks(iter([batch])):
                for doc, place, left, right in contexts(piece, length):
                    held.append((string(left, right, core), doc, place))
                    if len(held) >= RUN:
                        yield run()
        if held:
            yield run()

    def merge(table: pa.Table) -> pa.Table:
        pieces = table.to_pylist()
        doc = np.concatenate([np.frombuffer(p["doc"], np.int64) for p in pieces])
        place = np.concatenate([np.frombuffer(p["place"], np.int64) for p in pieces])
        firsts = np.cumsum([0] + [len(p["doc"]) // 8 for p in pieces])
        strings, refs = [], []
        for _, text, ref in Merge([decoded(p["prefix"], p["size"], p["rest"], int(f)) for p, f in zip(pieces, firsts, strict=False)]):
            strings.append(text)
            refs.append(ref)
        left, right = parted(strings, core, backward)
        reach, low, high = neighbours(left, right, length, backward)
        doc, place = doc[refs], place[refs]
        n, part = len(refs), pieces[0]["part"]
        edge = np.arange(min(NEAR, n))
        rows = np.concatenate([np.arange(n), edge, n - 1 - edge[::-1]])
        kind = [None] * n + [False] * len(edge) + [True] * len(edge)
        return pa.table({"doc": doc[rows], "place": place[rows], "reach": reach[rows].astype(np.int32), "low": low[rows].astype(np.int32), "high": high[rows].astype(np.int32), "part": pa.array([None if k is None else part for k in kind], pa.int32()), "last": pa.array(kind, pa.bool_()), "before": pa.array([left[i] if k is not None else None for i, k in zip(rows, kind, strict=True)], pa.binary()), "after": pa.array([right[i] if k is not None else None for i, k in zip(rows, kind, strict=True)], pa.binary())})

    pieces = open_texts.select("doc", "text", "places").mapInArrow(runs, PIECE)
    merged = cut(pieces.groupBy("part").applyInArrow(merge, NEIGHBOUR))
    edges = merged.filter("part is not null")
    # ranges in use, one row each: a range's end meets the start of the next that holds anything
    used = sorted(r["part"] for r in edges.select("part").distinct().collect())
    after = F.create_map(*[F.lit(x) for pair in zip(used[1:], used, strict=False) for x in pair]) if len(used) > 1 else F.lit(None)
    border = F.when(F.col("last"), F.col("part")).otherwise(after[F.col("part")] if len(used) > 1 else F.lit(None)).cast("int")

    def across(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: string(x["before"], x["after"], core))
        reach, low, high = neighbours([x["before"] for x in rows], [x["after"] for x in rows], length, backward)
        return pa.table({"doc": [x["doc"] for x in rows], "place": [x["place"] for x in rows], "reach": pa.array(reach, pa.int32()), "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32())})

    met = edges.withColumn("border", border).filter("border is not null").groupBy("border").applyInArrow(across, "doc long, place long, reach int, low int, high int")
    inner = merged.filter("part is null").select("doc", "place", "reach", "low", "high")
    return inner.unionByName(met)


def parted(strings: list[bytes], core: int, backward: bool) -> tuple[list[bytes], list[bytes]]:
    """The bytes before and from the place on, from the sorted strings."""
    pairs = [x.split(STOP) for x in strings]
    if backward:
        return [a[core:][::-1] for a, _ in pairs], [a[:core][::-1] + b for a, b in pairs]
    return [b[::-1] for _, b in pairs], [a for a, _ in pairs]


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, kept (the remaining bytes), removed (spans of bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same document too;
    strings lie in one document and are judged on the input.  ``removed`` lists the maximal removed runs as (start,
    end).  A null text has no bytes.  Repeated rows are documents of their own, and so repeats of each other.
    """
    if length < 4 * Q:
        raise ValueError(f"strings must have at least {4 * Q} bytes")
    texts, ids = keyed_documents(docs, id_col, text_col)
    long = texts.filter(F.octet_length("text") >= length).select("doc", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield from anchor_rows(batch, length)

    met = cut(meet(long.mapInArrow(find, ANCHOR)))
    open_ = met.filter("sides >= 0").select("core", "context", "doc", "place", F.shiftright("sides", 40).alias("twice"))
    known = met.filter("sides < 0").select("doc", F.col("place").alias("start"), F.col("context").alias("end"))
    total = open_.count()
    if total:
        known = known.unionByName(open_stretches(long, open_, total, length))
    copies = texts.filter("copies > 1").select("doc", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")).filter(F.col("end") >= length)
    known = known.unionByName(copies) if ids is not None else known
    gone = known.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in blocks(batches):
            kept, spans, removed, sizes = [], [], [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                raw = (text or "").encode()
                runs: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in parts or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edge = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join([raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)]))
                spans.append([{"start": a, "end": b} for a, b in runs])
                removed.append(sum(b - a for a, b in runs))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc", "n_bytes", "n_removed", "kept", "removed"])

    done = texts.join(gone, "doc", "left").select("doc", "text", "gone").mapInArrow(keep, "doc long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>")
    return by_id(done, ids)


def open_stretches(long: DataFrame, open_: DataFrame, total: int, length: int) -> DataFrame:
    """(doc, start, end) of the repeated stretches around open places: contexts that stand once, in cores of several."""
    core = length - length // 2 + 1
    ranges = max(1, -(-total // RANGE))
    listed = open_.groupBy("doc").agg(F.collect_list("place").alias("places"))
    open_texts = cut(long.join(listed, "doc").select("doc", "text", "places"))
    # splitters: a bounded number of suffixes for each range
    few = open_.orderBy(F.xxhash64("context", "doc", "place")).limit(ranges * SAMPLED).groupBy("doc").agg(F.collect_list("place").alias("few"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = [(ahead_string(a, b, core), back_string(a, b, core), doc, place) for doc, place, a, b in contexts(batch, length)]
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["ahead", "back", "doc", "place"])

    sample = open_texts.select("doc", "text").join(few, "doc").withColumnRenamed("few", "places").mapInArrow(strings, "ahead binary, back binary, doc long, place long").collect() if ranges > 1 else []
    right = sorted_neighbours(open_texts, length, False, ranges, [(bytes(r["ahead"]), r["doc"], r["place"]) for r in sample]).withColumnRenamed("reach", "r").withColumn("v", F.lit(0))
    left = sorted_neighbours(open_texts, length, True, ranges, [(bytes(r["back"]), r["doc"], r["place"]) for r in sample]).withColumnRenamed("reach", "v").withColumn("r", F.lit(0))
    best = right.unionByName(left).groupBy("doc", "place").agg(F.max("r").alias("r"), F.max("v").alias("v"), F.min("low").alias("low"), F.max("high").alias("high"))
    rated = cut(best.filter(F.col("r") + F.col("v") >= length).join(open_.select("core", "doc", "place", "twice"), ["doc", "place"]))
    seen = rated.filter("high >= low").select("doc", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))
    # both ends seen with one neighbour or other: all is known; else the strings between them are compared
    unsure = ((F.col("low") > length - F.col("r")) | (F.col("high") < F.col("v"))) & (F.col("twice") == 0)
    cores = rated.filter(unsure).select("core").distinct()
    asked = rated.join(cores, "core").groupBy("doc").agg(F.collect_list(F.struct("place", (length - F.col("r")).alias("from"), F.col("v").alias("to"))).alias("asked"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw, offsets = text_bytes(batch.column("text"))
            every = byte_hashes(raw)
            other = byte_hashes(raw ^ np.uint8(0x55))
            for doc, at, asks in zip(batch.column("doc").to_pylist(), offsets[:-1].tolist(), batch.column("asked").to_pylist(), strict=True):
                start = np.unique(np.concatenate([np.arange(x["place"] - x["to"], x["place"] - x["from"] + 1) for x in asks]))
                yield pa.RecordBatch.from_arrays([pa.array(every.of(at + start, at + start + length).view(np.int64)), pa.array(other.of(at + start, at + start + length).view(np.int64)), pa.array(np.full(len(start), doc)), pa.array(start)], names=["a", "b", "doc", "start"])

    rows = open_texts.select("doc", "text").join(asked, "doc").mapInArrow(windows, "a long, b long, doc long, start long")
    rows = cut(rows)
    twice = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    settled = rows.join(twice, ["a", "b"], "left_semi").select("doc", "start", (F.col("start") + length).alias("end"))
    return cut(seen.unionByName(settled))
