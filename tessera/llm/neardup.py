"""Near duplicates from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the K smallest of them.  Equal sets
are one class.  Inverted lists of the classes' smallest retained values give pairs and their overlaps; the sketch of
the union estimates the similarity of those that overlap enough, and the full sets decide.

Lists longer than LIST are never paired off.  A class with one of its smallest values in such a list looks up all its
retained values: short lists pair, and each long one links its members to one centre.  Classes with popular retained
values then meet exactly: every two of different components that share one of the rarest values of their full sets, as
many as two linked sets must share one of, are candidates too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut, release
from tessera.llm.common import Hashes, blocks, byte_hashes, mix64, pick, text_bytes, word_bounds
from tessera.operators.graph import connected_components

#: Retained values, those looked up at first, and the longest list that is paired off.
K, FIRST, LIST = 128, 16, 32
#: Values that a pair shares in short lists, at least: of the first ones, of all retained ones.
SHARED, SHARED_ALL = 2, 4
#: Probability that the union sketch of a pair at the threshold falls below the least count that goes to the full sets.
MISS = 1e-12
#: Classes that meet over their whole sets: those with half or more of their retained values in long lists.
POPULAR = f"degree * 2 >= least(n, {K})"
#: Rows of a list of popular values that one task joins with the whole list.
BLOCK = 1024

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_TOP = np.uint64(1 << 63)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and the n + 1 offsets of the sets."""
    low = _lower[raw]
    starts, ends, first = word_bounds(low, offsets)
    codes = byte_hashes(low).of(starts, ends)
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), made)
    begin = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    stop = begin + np.minimum(words, count[doc])
    value = Hashes(codes).of(begin, stop, salt=1) if len(codes) else np.zeros(0, np.uint64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order."""
    return (values ^ _TOP).view(np.int64)


def digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values * np.uint64(odd) + np.uint64(odd)))]) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return tuple((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """The columns of ``docs`` but the text, and n, h1, h2 and the K smallest hashes (in order) of each row's set."""

    rest = [f for f in docs.schema.fields if f.name != "text"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values, at = shingle_sets(*text_bytes(batch.column("text")), words)
            n = np.diff(at)
            h1, h2 = digests(values, at)
            ordered = signed(values)
            sketch = [ordered[a : min(a + K, b)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(sketch, pa.list_(pa.int64()))], names=[*(f.name for f in rest), "n", "h1", "h2", "sketch"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rest]
    return docs.mapInArrow(make, ", ".join([*kinds, "n long, h1 long, h2 long, sketch array<long>"]))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """n, h1, h2 and the whole set (sorted 64-bit values as bytes) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values, at = shingle_sets(*text_bytes(batch.column("text")), words)
            h1, h2 = digests(values, at)
            whole = [signed(values[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at), pa.int64()), pa.array(h1), pa.array(h2), pa.array(whole, pa.binary())], names=["n", "h1", "h2", "members"])

    return docs.mapInArrow(make, "n long, h1 long, h2 long, members binary")


def value_lists(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``values`` (value and more) of lists that two or more share: those of at most LIST rows, and the longer ones."""
    sizes = values.groupBy("value").agg(F.count("*").alias("listed")).filter("listed > 1")
    listed = cut(values.join(sizes, "value"))
    short, long = listed.filter(F.col("listed") <= LIST), listed.filter(F.col("listed") > LIST)
    short._cut_path = listed._cut_path  # released with the short lists
    return short, long


def paired(short: DataFrame, similarity: int, least: int, looked: int) -> DataFrame:
    """Pairs a < b that share ``least`` short lists (sets of less than twice the ``looked`` up values: one) and whose
    sizes allow the similarity."""
    groups = short.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("rid", "n"))).alias("m"))
    left = groups.select("m", F.posexplode("m").alias("i", "x"))
    pairs = left.select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(LIST))).alias("y"))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    allowed = pairs.filter((small * 100 >= large * similarity) & (F.col("x.rid") != F.col("y.rid")))
    counted = allowed.groupBy(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).agg(F.count("*").alias("shared"), F.min(small).alias("small"))
    return counted.filter(F.col("shared") >= F.when(F.col("small") < 2 * looked, 1).otherwise(least)).select("a", "b")


def least_shared(k: int, t: float) -> int:
    """The largest m for which fewer than m of k values of the union are in both sets with probability MISS at most."""
    tail = 0.0
    for m in range(k + 1):
        tail += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        if tail > MISS:
            return m
    return k


def union_estimate(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Of the k smallest values of the union, how many are in both; and k."""
    union, times = np.unique(np.concatenate([x, y]), return_counts=True)
    k = len(union) if len(x) < K and len(y) < K else min(K, len(union))
    return int((times[:k] == 2).sum()), k


def likely(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose union sketch allows the similarity, with ``sure`` where the sketches are whole sets that have it."""
    least = [least_shared(k, similarity / 100) for k in range(K + 1)]
    side = lambda i: classes.select(F.col("rid").alias(i), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("sa"), batch.column("sb")
            ax, ay = xs.offsets.to_numpy(), ys.offsets.to_numpy()
            vx, vy = xs.values.to_numpy(), ys.values.to_numpy()
            keep, sure = [], []
            for i in range(batch.num_rows):
                x, y = vx[ax[i] : ax[i + 1]], vy[ay[i] : ay[i + 1]]
                both, k = union_estimate(x, y)
                whole = len(x) < K and len(y) < K
                sure.append(whole and 100 * both >= similarity * k)
                keep.append(sure[-1] if whole else both >= least[k])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sure, pa.bool_())], names=["a", "b", "sure"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(rate, "a long, b long, sure boolean")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    side = lambda i: sets.select(F.col("rid").alias(i), F.col("members").alias(f"m{i}"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(decide, "a long, b long")


def set_values(sets: DataFrame) -> DataFrame:
    """(rid, value): the members of each set (rid, members), written."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                whole = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("members")]
                rid = np.repeat(some.column("rid").to_numpy(), [len(x) for x in whole])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate(whole))], names=["rid", "value"])

    return cut(sets.select("rid", "members").mapInArrow(explode, "rid long, value long"))


def rare_first(sets: DataFrame, values: DataFrame, similarity: int) -> DataFrame:
    """(value, rid, n, comp, place): of each set (rid, n, comp) the ``values`` that others hold too, if they are
    among the first n - ceil(similarity n) + 1 in the order of rarity.  Two linked sets share one of these values."""
    times = values.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")
    ordered = values.join(times, "value").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("common"))
    # values that no other set holds come first
    alone = F.col("n") - F.size("common")
    prefix = F.expr(f"n - (n * {similarity} + 99) div 100 + 1")
    known = ordered.join(sets.select("rid", "n", "comp"), "rid").withColumn("alone", alone).withColumn("part", (prefix - alone).cast("int")).filter("part > 0")
    return known.select("rid", "n", "comp", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("part"))).alias("i", "x")).select("x.value", "rid", "n", "comp", (F.col("alone") + F.col("i")).alias("place"))


def across(sets: DataFrame, similarity: int) -> DataFrame:
    """Every pair a < b of the sets (rid, n, comp, members) of different components that can have the similarity.

    No list is too long: one of more than BLOCK rows is dealt over several tasks.
    """
    values = set_values(sets)
    prefix = cut(rare_first(sets, values, similarity))
    release(values)
    lists = prefix.groupBy("value").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
    dealt = cut(prefix.join(lists.select("value", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "value"))
    x = dealt.select("value", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}_x") for c in ("rid", "n", "comp", "place")])
    y = dealt.select("value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_y") for c in ("rid", "n", "comp", "place")])
    # at the first value that two linked sets share, enough are left of both
    fit = F.least(F.expr("n_x - place_x"), F.expr("n_y - place_y")) * (100 + similarity) >= F.expr("n_x + n_y") * similarity
    met = x.join(y, ["value", "part"]).filter("rid_x < rid_y and comp_x <> comp_y").filter(fit)
    pairs = cut(met.select(F.col("rid_x").alias("a"), F.col("rid_y").alias("b")).distinct())
    release(prefix, dealt)
    return pairs


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Words are runs without ASCII white space, A-Z in lower case.  A text of fewer words than ``words`` is one shingle;
    a null text or one without words has the empty set, is linked with nothing and is its own component.  Two sets are
    linked when 100 |x and y| >= ``similarity`` |x or y|.  Equal texts are linked.  Rows that repeat an id are told
    apart; ``kept`` marks the rows whose id is the component's.  A null id never names a component that holds another
    id.  With ``key_col``, that column follows as ``key``, and ``chosen`` marks one row of each component.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    wanted = texts if key_col is None else pick(docs, doc_id=id_col, text=text_col, key=key_col)
    rows = cut(sketches(wanted, words).withColumn("rid", F.monotonically_increasing_id()))
    groups = cut(rows.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("rid").alias("rid"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("rid").alias("row"))).alias("first")))
    classes = cut(rows.join(groups.select("rid"), "rid", "left_semi").select("rid", "n", "sketch"))
    sketched, rows = rows, cut(rows.drop("sketch"))  # from here on only the classes' sketches are read
    release(sketched)

    # the smallest values of every class
    few = classes.select("rid", "n", F.explode(F.slice("sketch", 1, FIRST)).alias("value"))
    short, long = value_lists(few)
    pairs = paired(short, similarity, SHARED, FIRST)

    # classes with a popular one among those: all their values
    poor = cut(long.select("rid").distinct().join(classes, "rid").select("rid", "n", "sketch"))
    more, longer = value_lists(poor.select("rid", "n", F.explode("sketch").alias("value")))
    # at most K values a class; three of them, the rarest, the median and the most frequent, find the class a centre
    listing = F.sort_array(F.collect_list(F.struct("listed", "value")))
    graded = cut(longer.groupBy("rid").agg(listing.alias("held")).withColumn("degree", F.size("held")))
    places = F.array_distinct(F.array(F.lit(0), F.floor((F.col("degree") - 1) / 2).cast("int"), F.col("degree") - 1))
    chosen = cut(graded.select("rid", "degree", F.explode(F.transform(places, lambda i: F.col("held")[i]["value"])).alias("value")))
    centre = chosen.groupBy("value").agg(F.max(F.struct("degree", (-F.col("rid")).alias("minus"))).alias("top")).select("value", (-F.col("top.minus")).alias("centre"))
    star_pairs = chosen.join(centre, "value").filter("centre <> rid").select(F.least("centre", "rid").alias("a"), F.greatest("centre", "rid").alias("b"))
    candidates = cut(pairs.unionByName(paired(more, similarity, SHARED_ALL, K)).unionByName(star_pairs).distinct())
    release(short, more, chosen)
    links = linked(candidates, classes, texts, rows, words, similarity)
    release(candidates)
    inside = connected_components(None, links)

    # stars only join most of a group at small cost: classes that share popular values meet over their whole sets
    popular = cut(poor.join(graded.select("rid", "degree"), "rid").filter(POPULAR).join(inside.withColumnRenamed("v", "rid"), "rid", "left").select("rid", "n", F.coalesce("comp", "rid").alias("comp")))
    release(poor, graded)
    whole = read_sets(popular.select("rid"), texts, rows, words)
    met = across(popular.join(whole, "rid"), similarity)
    late = linked(met, classes, texts, rows, words, similarity, whole)
    release(met, whole, classes)
    # a late link joins two components: only these are put together, not the members of all components again
    name = lambda i: popular.select(F.col("rid").alias(i), F.col("comp").alias(f"c{i}"))
    over = connected_components(None, late.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    release(late, popular)

    labelled = groups.join(inside.withColumnRenamed("v", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    labelled = labelled.join(over.select(F.col("v").alias("comp"), F.col("comp").alias("joined")), "comp", "left").withColumn("comp", F.coalesce("joined", "comp"))
    smallest = labelled.groupBy("comp").agg(F.min("first").alias("best"))
    named = labelled.join(smallest, "comp").select("h1", "h2", "n", "best")
    out = rows.join(named, ["h1", "h2", "n"], "left")
    empty = F.col("n") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "kept"]
    if key_col is not None:
        columns += ["key", (empty | (F.col("rid") == F.col("best.row"))).alias("chosen")]
    return out.select(*columns)


def linked(candidates: DataFrame, classes: DataFrame, texts: DataFrame, rows: DataFrame, words: int, similarity: int, whole: DataFrame | None = None) -> DataFrame:
    """The candidate pairs (a, b) that have the similarity: by their sketches where these are whole, else by full sets
    (``whole``, if these are at hand)."""
    probable = cut(likely(candidates, classes, similarity))
    open_pairs = probable.filter("not sure").select("a", "b")
    sets = whole
    if whole is None:
        sets = read_sets(open_pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), texts, rows, words)
    links = cut(probable.filter("sure").select("a", "b").unionByName(confirmed(open_pairs, sets, similarity)))
    release(probable)
    if whole is None:
        release(sets)
    return links


def read_sets(wanted: DataFrame, texts: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(rid, members): the full sets of the wanted classes."""
    named = cut(rows.select("rid", "doc_id", "n", "h1", "h2").join(wanted, "rid", "left_semi"))
    some = texts.join(named.select("doc_id").distinct(), texts["doc_id"].eqNullSafe(named["doc_id"]), "left_semi")
    # a class has one (n, h1, h2): grouped by these too, the sets stay where the join has put them
    sets = cut(full_sets(some, words).join(named.drop("doc_id"), ["n", "h1", "h2"]).groupBy("n", "h1", "h2", "rid").agg(F.first("members").alias("members")).select("rid", "members"))
    release(named)
    return sets
