import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import suffixes
from tessera.llm.recompression import remove_repeats, window_records
from tessera.llm.suffixes import Merge, decoded, front_coded, remove_repeated_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(rows, width):
    """Brute force over documents in the order of their ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def repeated_bytes(rows, length):
    """Brute force: every string of ``length`` bytes and how often it starts."""
    times = {}
    raw = {doc: (text or "").encode() for doc, text in rows}
    for text in raw.values():
        for i in range(len(text) - length + 1):
            key = hash(text[i : i + length])
            times[key] = times.get(key, 0) + 1
    out = {}
    for doc, text in raw.items():
        gone = np.zeros(len(text) + 1, dtype=np.int64)
        for i in range(len(text) - length + 1):
            if times[hash(text[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if text else b""
        out[doc] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("width", "rounds"), [(20, 3), (7, 1), (21, 12)])
def test_repeated_words(corpus, corpus_rows, width, rounds):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(corpus, width=width, rounds=rounds).collect()}
    assert got == repeated_words(corpus_rows, width)


def test_repeated_words_with_repeated_and_null_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words), (1, words), (1, "z " + words), (None, words), (2, words)], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()))
    # the null id comes first and keeps its words; rows with the same id and text share a result
    assert rows == [(0, 30, 0), (1, 30, 30), (1, 30, 30), (1, 31, 30), (2, 30, 30)]


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    window = rng.integers(1, 6, 20).astype(np.uint64)
    names = set()
    for _ in range(50):
        left, right = rng.integers(1, 6, rng.integers(0, 30)).astype(np.uint64), rng.integers(1, 6, rng.integers(0, 30)).astype(np.uint64)
        codes = np.concatenate([left, window, right])
        name, _, _, _, start, windows = window_records(codes, np.array([0, len(codes)]), 20, 6)
        names.add(int(name[np.flatnonzero((start <= len(left)) & (len(left) < start + windows))[0]]))
    assert len(names) == 1


def overlapping(count, seed):
    """Documents that share parts of one text at many places, long and short of 400 bytes."""
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    base = noise(1500)
    rows = []
    for i in range(count):
        a = rnd.randrange(0, 900)
        text = noise(rnd.randrange(5, 300)) + base[a : a + rnd.randrange(380, 800)] + noise(rnd.randrange(0, 300)) + base[: rnd.randrange(100, 420)]
        if i % 3 == 0:  # edits
            at = rnd.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((2 * 10**6 + i, text))
    return rows


@pytest.mark.parametrize(("run", "size", "near"), [(40_000, 40_000, 8), (37, 50, 1)])
def test_repeated_bytes(spark, corpus, corpus_rows, monkeypatch, run, size, near):
    monkeypatch.setattr(suffixes, "RUN", run)
    monkeypatch.setattr(suffixes, "RANGE", size)
    monkeypatch.setattr(suffixes, "NEAR", near)
    more = overlapping(60, run)
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in remove_repeated_bytes(docs).collect()}
    assert got == repeated_bytes(corpus_rows + more, 400)


def test_one_passage_in_most_documents_is_cut_into_ranges(spark, monkeypatch):
    used = []

    def spy(df, cut=suffixes.cut):
        done = cut(df)
        if {"reach", "part"} <= set(df.columns):
            used.append(done.select("part").filter("part is not null").distinct().count())
        return done

    monkeypatch.setattr(suffixes, "RANGE", 25)
    monkeypatch.setattr(suffixes, "cut", spy)
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = noise(700)
    rows = [(i, noise(450) + passage + noise(450)) for i in range(150)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeated_bytes(rows, 400)
    assert len(used) == 2 and min(used) >= 12


def test_repeated_rows_are_repeats_of_each_other(spark, empty_docs):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:300]), (None, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in remove_repeated_bytes(docs).collect())
    assert rows == [(0, 0, 0), (1, 500, 500), (1, 500, 500), (2, 300, 0)]
    assert remove_repeated_bytes(empty_docs).count() == 0 and remove_repeats(empty_docs).count() == 0


def test_merge_of_front_coded_runs():
    rnd = random.Random(4)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 40))).encode() for _ in range(500)]
    runs, at = [], 0
    for k in (1, 99, 200, 200):
        part = sorted(strings[at : at + k])
        runs.append(decoded(*front_coded(0, part, np.zeros(k, np.int64), np.zeros(k, np.int64))[1:4], at))
        at += k
    merged = list(Merge(runs))
    assert [x for _, x, _ in merged] == sorted(strings) and sorted(r for _, _, r in merged) == list(range(500))
    texts = [x for _, x, _ in merged]
    for (known, x, _), y in zip(merged[1:], texts, strict=False):
        assert x[:known] == y[:known]


def doubling_words(length=2048):
    """Two words of two letters that every polynomial hash modulo 2^64 takes for equal."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_words_of_a_doubling_sequence_are_not_repeats(spark):
    x, y = doubling_words()
    rows = [(1, " ".join([x] * 20)), (2, " ".join([y] * 20)), (3, " ".join([x, y] * 15))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=20).collect()}
    assert got == repeated_words(rows, 20)
    done = remove_repeated_bytes(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string"), length=400)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in done.collect()}
    assert got == {k: v[:2] for k, v in repeated_bytes([(1, x), (2, y)], 400).items()}
