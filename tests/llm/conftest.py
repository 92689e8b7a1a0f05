import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use inside.
CLASHES = ["doc", "rid", "n", "score", "shard", "slot", "size", "key", "row", "place", "value", "fold", "start"]


@pytest.fixture(scope="session")
def corpus(spark):
    """The small documents, with null, empty, blank and very long texts, ties, and columns with clashing names."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [
        (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t "), (10**6 + 3, "the " * 3000), (10**6 + 4, "a b " * 900),
        (10**6 + 5, "x" * 5000), (10**6 + 6, "word"), (10**6 + 7, "é" * 1200 + " end"), (10**6 + 8, "ab" * 700),
        (10**6 + 9, " ".join(f"w{i}" for i in range(12000))), (10**6 + 10, None),
    ]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    return both.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).cache()


@pytest.fixture(scope="session")
def corpus_rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
