import pytest

import corpus_pipeline
from tests.llm.test_neighbours_and_duplicates import components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with repeated, null, empty and extra rows and columns."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "one text without an id", "en", "s", 22), (None, "one text without an id", "en", "s", 22), (5, "another text under the id of a document", "en", "s", 39)], rows.schema)
    return rows.unionByName(odd).withColumn("score", F.lit(1)).withColumn("key", F.lit("k")).withColumn("row", F.lit(2))


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_toxicity_stage(spark, docs):
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    toxic, clean = [d for d, y in labels.items() if y], [d for d, y in labels.items() if not y]
    assert sum(d in left for d in clean) >= 0.97 * len(clean) and sum(d in left for d in toxic) <= 0.5 * len(toxic)


def test_near_duplicate_stage(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = [(i, r["doc_id"], r["text"]) for i, r in enumerate(docs.collect())]
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0, r[0]))
    want = components([(rank, r[2]) for rank, r in enumerate(order)], 5, 80)
    best = sorted((order[rank][1], order[rank][2]) for rank, (_, c) in want.items() if rank == c and order[rank][1] is not None)
    got = kept.select("doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None), key=str) == sorted(best, key=str)
    assert sum(r["doc_id"] is None for r in got) == 1


def test_decontamination_stage(spark, docs):
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    assert kept.columns == docs.columns
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = kept.collect()
    assert not any(x in " ".join((r["text"] or "").split()) for r in left for x in items)
    holding = sum(any(x in " ".join((r["text"] or "").split()) for x in items) for r in docs.collect())
    assert holding and len(left) >= docs.count() - holding - 5


def test_secret_stage(spark, docs):
    masked = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.filter("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0
    assert docs.filter("text rlike 'token = \"[0-9a-f]{40}\"'").count() == masked.filter("text like '%token = \"[SECRET]\"%'").count() > 0
    assert masked.filter("n_chars <> length(text)").count() == 0
    same = docs.filter("not text rlike '[0-9]'").select("doc_id", "text").exceptAll(masked.select("doc_id", "text"))
    assert same.count() == 0


def test_whole_pipeline(spark):
    pieces = corpus_pipeline.run(spark, SF)
    rows = pieces.collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows)
    assert 0 < len(total) < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_empty_table(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
