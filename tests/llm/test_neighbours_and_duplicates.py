import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.hnsw import Graph, nearest_rows
from tessera.llm.neardup import near_duplicates
from tests.llm.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def components(rows, words, similarity):
    """Brute force: all pairs of full shingle sets."""
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((doc, frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()))
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and min(len(x), len(y)) * 100 >= similarity * max(len(x), len(y)) and 100 * len(x & y) >= similarity * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {doc: (len(s), root(doc)) for doc, s in sets}


def labels(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("words", "similarity"), [(3, 85), (5, 80)])
def test_components(corpus, corpus_rows, words, similarity):
    assert labels(near_duplicates(corpus, words, similarity)) == components(corpus_rows, words, similarity)


def chains(count, seed):
    """Copies of one text with edits, chains of copies of copies, and texts around a passage that all share."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"v{i}" for i in range(4000)])
    base = list(rng.choice(vocabulary, 300))
    passage = list(rng.choice(vocabulary, 60))
    rows, last = [], base
    for i in range(count):
        words = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 14)):
            words[at] = f"e{i}_{at}"
        rows.append((10 * i, " ".join(words)))
        last = list(last)
        for at in rng.integers(0, 300, 3):
            last[at] = f"c{i}_{at}"
        rows.append((10 * i + 1, " ".join(last)))
        rows.append((10 * i + 2, " ".join([*rng.choice(vocabulary, 40), *passage, *rng.choice(vocabulary, 20)])))
    return rows


def test_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 8)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rows = chains(70, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert labels(near_duplicates(docs, 3, 85)) == components(rows, 3, 85)


def templates(count, seed):
    """Documents of eight slots with five variants each, and for every tenth a copy with one word changed."""
    rng = np.random.default_rng(seed)
    slots = [[[f"s{i}v{j}w{k}" for k in range(30)] for j in range(5)] for i in range(8)]
    rows = []
    for i in range(count):
        words = [w for slot in slots for w in slot[rng.integers(5)]]
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            words[rng.integers(len(words))] = f"e{i}"
            rows.append((2 * i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_copies_among_popular_parts(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "LIST", 8)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = templates(400, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert labels(near_duplicates(docs, 3, 85)) == components(rows, 3, 85)


def test_a_popular_passage_alone_makes_no_pairs(spark):
    rng = np.random.default_rng(2)
    passage = rng.integers(-(2**62), 2**62, 840)
    sets = [np.unique(np.concatenate([passage, rng.integers(-(2**62), 2**62, 160)])) for _ in range(100)]
    sets.append(np.unique(np.concatenate([sets[7][5:], [1, 2]])))
    rows = [(i, len(x), i, x.astype(np.int64).tobytes()) for i, x in enumerate(sets)]
    pairs = neardup.across(spark.createDataFrame(rows, "rid long, n long, comp long, members binary"), 85)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(7, 100)]


def test_edits_of_the_smallest_values(spark):
    words = [f"w{i}" for i in range(1000)]
    raw = " ".join(words).encode()
    values = [neardup.shingle_sets(np.frombuffer(" ".join(words[i : i + 3]).encode(), np.uint8), np.array([0, len(" ".join(words[i : i + 3]))]), 3)[0][0] for i in range(998)]
    assert set(values) == set(neardup.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 3)[0])
    edited = list(words)
    for at in np.argsort(values)[:12]:
        edited[at + 1] = f"e{at}"
    rows = [(1, " ".join(words)), (2, " ".join(edited))]
    assert set(components(rows, 3, 85).values()) == {(998, 1)}
    assert labels(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == components(rows, 3, 85)


def test_components_by_stars(spark, monkeypatch):
    from tessera.operators import graph

    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(1) or cut(df))
    rng = np.random.default_rng(3)
    clique = [(a, b) for a in range(8) for b in range(a)]
    for edges, most in ((clique, 4), ([(20, i) for i in range(40)], 4), ([(i, i + 1) for i in range(33)], 14), (rng.integers(0, 60, (40, 2)).tolist(), 14), ([(5, 5)], 2)):
        written.clear()
        found = graph.connected_components(spark.range(70).selectExpr("id v"), spark.createDataFrame(edges, "a long, b long"))
        true = list(range(70))
        for a, b in edges:
            low, high = sorted((true[a], true[b]))
            true = [low if c == high else c for c in true]
        assert sorted((r["v"], r["comp"]) for r in found.collect()) == list(enumerate(true))
        assert len(written) <= most


def test_late_links_use_the_sets_that_were_read(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(400)]
    rows = [(i, " ".join([*passage, *(f"w{x}" for x in rng.integers(0, 10**9, 80))])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" z{i}") for i in range(5)]
    read = []
    monkeypatch.setattr(neardup, "read_sets", lambda *args, old=neardup.read_sets: read.append(1) or old(*args))
    assert labels(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == components(rows, 3, 85)
    assert len(read) == 2


def test_least_shared_is_seldom_missed():
    for k, t in ((16, 0.8), (128, 0.8), (128, 0.85), (40, 0.85)):
        tails = np.cumsum([math.comb(k, m) * t**m * (1 - t) ** (k - m) for m in range(k + 1)])
        least = neardup.least_shared(k, t)
        assert (least == 0 or tails[least - 1] <= 1e-12) and tails[least] > 1e-12


def test_repeated_empty_and_null_rows(spark, empty_docs):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (3, "A  b\nc"), (1, ""), (2, None), (None, "a b c"), (9, "a b")], "doc_id long, text string")
    rows = near_duplicates(docs.withColumn("k", F.lit("x")), 3, 85, key_col="k").collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"], r["chosen"]) for r in rows)
    assert got == [(0, 1, 3, False, False), (1, 0, 1, True, True), (2, 0, 2, True, True), (3, 1, 3, True, True), (5, 1, 3, False, False), (5, 1, 3, False, False), (9, 1, 9, True, True)]
    assert near_duplicates(empty_docs, 3, 85).count() == 0


def nearest(rows, queries, k):
    out = {}
    for q, x in queries:
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), v) for v, y in rows if v != q)
        out[q] = near[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table.collect()]
    queries = [x for x in rows if x[0] % 20 == 0]
    got = {}
    for r in nearest_rows(table, table.filter("vec_id % 20 = 0"), shard_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    true, by_id = nearest(rows, queries, 10), dict(rows)
    recall = np.mean([len({v for _, v in got[q]} & {v for _, v in true[q]}) / 10 for q, _ in queries])
    assert recall >= 0.9
    for q, near in got.items():
        assert near == sorted(near) and len(near) == 10
        assert all(abs(s - np.sqrt(((by_id[q] - by_id[v]) ** 2).sum())) < 1e-9 for s, v in near)


def test_neighbours_of_equal_and_unusable_vectors(spark, empty_docs):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(100, [1.0, 2.5]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (106, []), (107, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("shard", F.lit(2))
    got = nearest_rows(table, table.filter("vec_id in (0, 100, 101, 102, 107)"), shard_rows=16).collect()
    near = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert near == {0: list(range(1, 11)), 100: list(range(10))}
    few = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_rows(few, few.filter("vec_id = 1")).collect()] == [(1, 1, 2, 1.0)]
    none = few.filter("vec_id > 5")
    assert nearest_rows(none, none).count() == 0


def test_graph_is_reproducible():
    rng = np.random.default_rng(1)
    points, keys = rng.normal(size=(500, 8)), np.arange(500)
    one, two = Graph.build(points, keys), Graph.build(points, keys)
    assert all((a == b).all() for a, b in zip(one.layers, two.layers, strict=True))
    ids, far = one.search(points[:50])
    assert (ids[:, 0] == np.arange(50)).mean() > 0.95 and (np.diff(far, axis=1)[:, :10] >= 0).all()


def test_different_words_of_a_doubling_sequence_are_not_linked(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word)]
    assert labels(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == components(rows, 3, 85)
