"""op13: encoding by prefixes and decoding, against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import Codec, decode_ids, encode_texts

WORD = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aabbeinrst '’éÉßΣσςİ́̀ 1２½Ⅷ漢字ا한‍ \u0085\x1c\x00!?.,-_😀"


@pytest.fixture(scope="module")
def own():
    return Codec(WORD)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want, repr(text[:200])
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_random_texts_and_special_tokens(own, library):
    rng = random.Random(13)
    for i in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(40)))
        same(own, library, text + "<|endoftext|>" + text[::-1] + "<|startoftext|" if i % 5 == 0 else text)


def test_every_kind_of_character(own, library):
    step = 37  # every plane and every category is met; a full run over all code points takes minutes
    points = [c for c in range(0, 0x110000, step) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    for start in range(0, len(points), 400):
        same(own, library, " ".join("a" + chr(c) + chr(c) + "b'" + chr(c) for c in points[start : start + 400]))


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 20000, " " * 1000000 + "x", "\n" * 70000, "é" * 30000, "!" * 30000,
                                  "the cat's 12 dogs aren't <|endoftext|>" * 4000, "e" + "́" * 70000 + " x", "'s" * 5000, ""])
def test_very_long_texts(own, library, text):
    same(own, library, text)


def test_pairs_that_stand_side_by_side(own, library):
    """A pair of tokens is compatible exactly if the library gives these two tokens for their joined text."""
    rng = random.Random(7)
    tokens = [i for i in range(49406) if own.tokens[i] is not None and own.tokens[i].isascii()]
    ends = [i for i in tokens if own.tokens[i].endswith("</w>") and own.tokens[i][:-4].isalpha() and own.tokens[i].islower()]
    starts = [i for i in tokens if own.tokens[i].isalpha() and own.tokens[i].islower()]
    met = 0
    for _ in range(6000):
        a, b = rng.choice(starts), rng.choice(ends)
        text = own.tokens[a] + own.tokens[b][:-4]
        got = library.encode(text, add_special_tokens=False).ids
        alone = own.merges.compatible(a, b)
        met += alone
        assert alone == (got == [a, b]), (own.tokens[a], own.tokens[b])
    assert 0 < met < 6000


def test_a_vocabulary_without_word_ends(library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = Codec(path), Tokenizer.from_file(path)
    for text in ("", "Hello  world\n\n it's 2024", "naïve façade — 漢字 😀", "x" * 3000, "def f(a):\n    return a<|endoftext|>"):
        same(own, other, text)


def test_tables(spark, corpus, corpus_rows, library, empty_docs):
    done = decode_ids(encode_texts(corpus.repartition(6), WORD), WORD)
    got = sorted(((r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in done.collect()))
    want = []
    for doc_id, text in corpus_rows:
        w = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(w), w, library.decode(w, skip_special_tokens=False)))
    assert got == sorted(want)
    assert decode_ids(encode_texts(empty_docs, WORD), WORD).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert [r["n_tokens"] for r in encode_texts(twice, WORD).orderBy(F.desc("n_tokens")).collect()] == [2, 2, 0]
    odd = spark.createDataFrame([(1, None, 0), (2, np.array([0, 60000, 4294967295, 5, 49407], "<u4").tobytes(), 5)], "doc_id long, ids binary, n_tokens long")
    assert {r["doc_id"]: r["decoded"] for r in decode_ids(odd, WORD).collect()} == {1: "", 2: library.decode([0, 60000, 5, 49407], skip_special_tokens=False)}
