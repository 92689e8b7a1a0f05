import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm.packing import Encoder, pack_documents, piece_lengths, token_ids
from tessera.llm.sharding import Permutation, shard_documents
from tessera.llm.tokens import Model, count_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_invertible(n):
    order = Permutation(n, 5)
    rows = np.arange(n)
    places = order.place(rows)
    assert sorted(places.tolist()) == rows.tolist()
    assert (order.row(places) == rows).all()
    assert n < 16 or (places != Permutation(n, 6).place(rows)).any()


def test_shards(corpus, corpus_rows):
    rows = shard_documents(corpus, shards=24).collect()
    assert len(rows) == len(corpus_rows)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(24))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {d: (t or "").encode() for d, t in corpus_rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    ranks = {d: i for i, d in enumerate(sorted(texts))}
    order = Permutation(len(rows), 0)
    assert all(r["row_number"] == ranks[r["doc_id"]] for r in rows)
    assert all(order.place(np.array([r["row_number"]]))[0] == r["slot"] * 24 + r["shard"] for r in rows)


def test_shards_do_not_depend_on_partitions(corpus):
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(corpus).collect()}
    assert one == {(r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(corpus.repartition(13)).collect()}


def test_shards_of_repeated_null_and_no_rows(spark, empty_docs):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    rows = shard_documents(docs, shards=4).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 53
    assert shard_documents(empty_docs).count() == 0


def test_packing_round_trip(corpus, corpus_rows):
    from tokenizers import Tokenizer

    rows = pack_documents(corpus, BPE, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and max(r["sequence_id"] for r in rows) == len(rows) - 1
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 for r in rows)
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    got = defaultdict(dict)
    for r in rows:
        got[r["doc_id"]][r["start"]] = r
    direct = Tokenizer.from_file(BPE)
    for doc, text in corpus_rows:
        pieces = [got[doc][k] for k in sorted(got[doc])]
        ids = np.concatenate([token_ids(p["ids"]) for p in pieces])
        assert ids.tolist() == direct.encode(text or "", add_special_tokens=False).ids + [0]
        assert [p["length"] for p in pieces] == piece_lengths(len(ids), 1024)
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in pieces)


def test_encoder_on_special_strings():
    from tokenizers import Tokenizer

    texts = ["", " ", "a <|endoftext|>b c<|endoftext|> d", "it's 'll 9x9  y\n\n z \x1c q", "   x", "日本語 text", "🙂 🙂"]
    direct = Tokenizer.from_file(BPE)
    for text, ids in zip(texts, Encoder(BPE).encode_all(texts), strict=True):
        assert token_ids(ids).tolist() == direct.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_encoder_on_a_million_blanks(blank):
    import public_tokenizers

    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = blank * 1_000_000 + "x"
    (got,) = own.encode_all([text])
    assert token_ids(got).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_nothing(empty_docs):
    assert pack_documents(empty_docs, BPE).count() == 0


def test_token_counts(corpus, corpus_rows):
    from sentencepiece import SentencePieceProcessor

    rows = {r["doc_id"]: r for r in count_tokens(corpus, PIECES, chunk=3000, overlap=64).collect()}
    direct = SentencePieceProcessor(model_file=PIECES)
    for doc, text in corpus_rows:
        n = len(direct.encode(text or ""))
        assert (rows[doc]["n_tokens"], rows[doc]["n_bytes"], rows[doc]["over_limit"]) == (n, len((text or "").encode()), n > 4096)


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 8), (500, 64), (1000, 900)])
def test_spliced_counts_equal_whole(corpus_rows, chunk, overlap):
    model = Model(PIECES)
    texts = [t for _, t in corpus_rows if t and len(t) > chunk][:40] + [" " * 900 + "abc" * 700 + " x" * 40, "ab" * 2000 + " c", "x  y\n" * 500, "▁ a▁ b" * 300, "<s> </s>" * 90]
    assert [model.spliced(t, chunk, overlap) for t in texts] == [len(model.processor.encode(t)) for t in texts]


def test_token_counts_of_nothing(empty_docs):
    assert count_tokens(empty_docs, PIECES).count() == 0
