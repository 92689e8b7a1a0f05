"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The labelled rows are dealt to folds by a checksum of their id: fold 0 is held out, folds 1 and 2 give the lexicon,
fold 3 trains the trees, fold 4 calibrates them.  Each part is fitted on at most ``fit_rows`` labelled rows (in the
order of a hash of the id); every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.persist import cut
from tessera.llm.common import blocks, pick

#: Bound on the labelled rows that each part of the model is fitted on, and on the lexicon's entries.
FIT_ROWS, LEXICON = 20_000, 5_000
#: A lexicon entry needs this likelihood ratio (G) against the label and this share of toxic documents.
LEAST_G, LEAST_SHARE = 12.0, 0.5
STEMS = range(3, 8)
NEAR = 5
#: Words of the second person in the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer sie ihnen tú ti usted ustedes vosotros tus su sus vos".split())
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters with signs or digits between them, as in masked words, and what these may stand for.
MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$*!+][^\W\d_]*)+")
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "*": ""})
FEATURES = ["hits", "hit_density", "weight_density", "top_weight", "distinct_hits", "near_second_person", "second_person", "capitals", "shouted", "punctuation", "exclamations", "masked", "masked_hits", "digits", "log_words"]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def stems(word: str) -> list[str]:
    return [word[:k] for k in STEMS if k <= len(word)] + [word + "$"]


def learn_lexicon(texts: DataFrame, toxic_docs: int, clean_docs: int, size: int = LEXICON) -> dict[str, float]:
    """Words (marked by ``$``) and word stems that mark toxic documents, with their log odds.

    ``texts``: text and toxic (0 or 1).  Document counts of each entry are summed in Spark; at most ``size`` entries,
    the most significant, reach the driver.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {s for w in set(LETTERS.findall((text or "").lower())) for s in stems(w)}
                (toxic if label else clean).update(found)
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], names=["entry", "t", "n"])

    sums = texts.mapInArrow(counts, "entry string, t long, n long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    t, n, base = F.col("t"), F.col("n"), toxic_docs / max(1, toxic_docs + clean_docs)
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((t + n) * F.lit(share)))).otherwise(0.0)
    sums = sums.withColumn("g", 2 * (part(t, base) + part(n, 1 - base)))
    top = sums.filter((F.col("g") >= LEAST_G) & (t >= LEAST_SHARE * (t + n))).orderBy(F.col("g").desc(), "entry").limit(size)
    return {r["entry"]: math.log((r["t"] + 0.5) / (toxic_docs + 1)) - math.log((r["n"] + 0.5) / (clean_docs + 1)) for r in top.collect()}


class Features:
    """Dense features of a text for a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)
        return found

    def of(self, text: str) -> list[float]:
        low = text.lower()
        words = LETTERS.findall(low)
        known, weight = self.known, self.weight
        weights = [known[w] if w in known else weight(w) for w in words]
        n, chars = max(1, len(words)), max(1, len(text))
        hits = [i for i, w in enumerate(weights) if w > 0]
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if hits and second:
            at = np.asarray(second)
            place = np.searchsorted(at, hits)
            left = np.abs(at[np.maximum(place - 1, 0)] - hits)
            right = np.abs(at[np.minimum(place, len(at) - 1)] - hits)
            near = int((np.minimum(left, right) <= NEAR).sum())
        raw = text.encode("utf-8", "replace")
        capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        signs = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        shouted = raw.count(b"!")
        masked = MASKED.findall(low) if digits or signs else []
        opened = sum(weight(m.translate(UNMASK)) > 0 for m in masked)
        top = max(weights, default=0.0)
        return [len(hits), len(hits) / n, sum(weights) / n, top, len({words[i] for i in hits}), near / n, len(second) / n, capitals / chars, float(capitals > 0.5 * chars), signs / chars, shouted / chars, len(masked) / n, float(opened), digits / chars, math.log1p(len(words))]


def with_features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and one column per feature.

    Without a column ``text``, the text is the field ``text_col`` of the struct ``row``: whole rows reach a task once.
    """
    rest = [f for f in docs.schema.fields if f.name != "text"]
    inside = "text" not in docs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        if inside:
            batches = (pa.RecordBatch.from_arrays([*b.columns, b.column("row").field(text_col)], names=[*b.schema.names, "text"]) for b in batches)
        for batch in blocks(batches):
            rows = np.asarray([features.of(x or "") for x in batch.column("text").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *(pa.array(rows[:, j]) for j in range(len(FEATURES)))], names=[*(f.name for f in rest), *FEATURES])

    return docs.mapInArrow(compute, StructType([*rest, *(StructField(x, DoubleType()) for x in FEATURES)]))


def sample_of(labels: DataFrame, folds: list[int], rows: int) -> DataFrame:
    return labels.filter(F.col("fold").isin(folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score in [0, 1], predicted (1 where score >= 0.5).

    With ``whole_rows``, the input row follows as the struct ``row``.

    ``labels`` holds doc_id and toxic (0 or 1); rows with a null in either are ignored, of repeated ids the largest
    label counts, ids that ``docs`` lacks play no part.  Labels, language, source and id are no inputs of a score.  A
    null text counts as empty and is scored like any other.  Without labels of both kinds in the training folds, all
    scores are the share of toxic labels there (0 without labels).  Repeated rows are scored each; an empty table
    gives no rows.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 0")
    # bounded by fit_rows each: small enough for every executor
    read_rows = cut(sample_of(known, [1, 2], fit_rows))
    fit = cut(sample_of(known, [3], fit_rows).withColumn("part", F.lit(0)).union(sample_of(known, [4], fit_rows).withColumn("part", F.lit(1))))
    counts = {r["toxic"]: r["count"] for r in read_rows.groupBy("toxic").count().collect()}
    held_out = (fold_of(F.col("doc_id")) == 0).alias("held_out")
    lexicon: dict[str, float] = {}
    if counts.get(1) and counts.get(0):
        lexicon = learn_lexicon(texts.join(F.broadcast(read_rows), "doc_id").select("text", "toxic"), counts[1], counts[0])
    rows = cut(with_features(texts.join(F.broadcast(fit), "doc_id"), lexicon))
    kinds = {(r["part"], r["toxic"]): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}
    wide = texts if not whole_rows else docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    everything = with_features(wide, lexicon, text_col)
    row = ["row"] if whole_rows else []
    if not (kinds.get((0, 0)) and kinds.get((0, 1))):
        total = sum(counts.values()) + sum(kinds.values())
        share = (counts.get(1, 0) + sum(v for (_, y), v in kinds.items() if y)) / total if total else 0.0
        return everything.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), *row)
    # part 1 calibrates; should it lack a kind, part 0 does
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxDepth=3, maxIter=20, stepSize=0.2, seed=7).fit(assemble.transform(rows.filter("part = 0")))
    margin = vector_to_array(F.col("probability"))[1]
    both = kinds.get((1, 0)) and kinds.get((1, 1))
    rated = trees.transform(assemble.transform(rows.filter(f"part = {1 if both else 0}"))).select(margin.alias("p"), F.col("toxic").cast("double").alias("toxic"))
    curve = IsotonicRegression(labelCol="toxic", featuresCol="p", predictionCol="score").fit(rated)
    scored = curve.transform(trees.transform(assemble.transform(everything)).withColumn("p", margin))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *row)
