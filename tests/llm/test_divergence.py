"""op12: stripes and divergences against plain Python integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence
from tessera.llm.divergence import distance, share, source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    rows = [(a or "", b or "", t or "") for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, counts, sources = Counter(), defaultdict(Counter), {r[1] for r in rows if r[0] == lang}
        for a, source, text in rows:
            if a == lang:
                words = TERM.findall(lower(text))
                df.update(set(words))
                counts[source].update(words)
        kept = [t for t in df if df[t] >= least]
        n = {s: sum(counts[s][t] for t in kept) for s in sources}

        def p(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            pairs = [(t, sum(f(p(counts[s][w], n[s]), p(counts[t][w], n[t])) for w in kept)) for t in sources if t != s]
            whole = sum(n.values())
            terms = []
            for w in kept:
                x, y = p(counts[s][w], n[s]), p(sum(counts[t][w] for t in sources), whole)
                if counts[s][w] and x > y:
                    terms.append((w, f(x, y)))
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda z: (-z[1], z[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "source", "text")
    odd = [(None, None, None), (None, "src1", "A a É é É"), ("en", None, ""), ("en", "lonely", "12 34"), ("xx", "one", "alpha beta " * 40),
           ("xx", "two", "Alpha gamma"), ("xx", "two", "Alpha gamma"), ("en", "src0", "the " * 5000), ("", "src1", "é_É-é"), ("yy", "z", "solo")]
    return docs.union(spark.createDataFrame(odd, "lang string, source string, text string"))


@pytest.mark.parametrize("least,top", [(1, 3), (10, 10), (10**6, 10)])
def test_equals_plain_python(spark, mixed, least, top):
    rows = [tuple(r) for r in mixed.collect()]
    clash = mixed.selectExpr("*", "1 as term", "2 as df", "3 as stripe", "4 as n", "5 as value", "6 as bucket")
    assert got(source_divergence(clash.repartition(5), least, top)) == brute(rows, least, top)


def test_small_groups_and_spills_change_nothing(spark, mixed):
    want = brute([tuple(r) for r in mixed.collect()], 2, 4)
    assert got(source_divergence(mixed, 2, 4, spill=5, group=64, cells=100)) == want


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 16)
    for text in ("Word and WORDS " * 30, "x" * 100 + " y " + "z" * 40, " " * 50 + "end", "é" * 33 + "1" + "É" * 9, "a" * 16 + " b", "a" * 32):
        assert [w for part in terms_of(text.encode()) for w in part] == [w.encode() for w in TERM.findall(lower(text))]


def test_shares_are_exact_beyond_64_bits():
    count, total = np.array([9 * 10**12, 2, 10**9 + 7]), np.array([9 * 10**12 + 4, 9 * 10**15, 10**9 + 9])
    want = [1 + 10**9 * int(a) // int(b) for a, b in zip(count, total)]
    assert share(count, total).tolist() == want
    assert distance(np.array([10**9 + 1]), np.array([1])).tolist() == [(10**9) ** 2 // (10**9 + 2)]
