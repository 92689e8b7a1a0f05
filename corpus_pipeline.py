"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` in order: toxic documents go; of each group of near duplicates one document stays; documents that hold a
benchmark item go; secrets are masked; the rest is packed.  Each stage reads what the one before has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import read_table
from tessera.llm.decontaminate import find_leaks
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.secrets import redact_secrets, scan_secrets
from tessera.llm.toxicity import score_toxicity
from tessera.session import prepare

KEY = "__row_key"
#: Trained scores and token ids cannot be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def row_key() -> Column:
    """Names a row by id and text, so that a decision never falls on another row with the same id."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    prepare(spark)
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"), whole_rows=True)
    return scored.filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest id.

    Of rows that repeat id and text one stays.
    """
    prepare(spark)
    keyed = docs.withColumn(KEY, row_key())
    chosen = cut(near_duplicates(keyed, words=5, similarity=80, key_col=KEY).filter("chosen").select(F.col("key").alias(KEY)))
    kept = keyed.join(chosen.distinct(), KEY, "left_semi")
    repeated = keyed.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates([KEY])
    return kept.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    prepare(spark)
    keyed = docs.withColumn(KEY, row_key())
    leaks = cut(find_leaks(keyed, read_table(spark, sf_dir, "benchmark"), id_col=KEY).select(F.col("doc_id").alias(KEY)).distinct())
    return keyed.join(leaks, KEY, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their length counted anew."""
    prepare(spark)
    keyed = docs.withColumn(KEY, row_key())
    masked = redact_secrets(keyed, scan_secrets(keyed, id_col=KEY), id_col=KEY).drop(KEY)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    prepare(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the documents of ``sf_dir``; each stage's result is written and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
