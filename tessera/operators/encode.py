"""Imputation, scaling and one-hot encoding.

``fit_encoder`` makes three aggregate passes whose results are small:
medians (exact, bounded memory), mean / population deviation of the imputed
numerics, and per-value counts of the categoricals (which give both the
mode and the vocabulary).  ``transform`` is then a projection plus, per
categorical column, a join with that column's vocabulary: a broadcast join
when the vocabulary size is checked to be small, a shuffle join otherwise,
so an id-like column with millions of levels never reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import is_numeric_type, to_number
from tessera.functions.persist import cut
from tessera.functions.quantiles import grouped_median
from tessera.functions.ranks import numbered
from tessera.operators.profile import value_counts, value_text


def numeric_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., column, value)`` with every numeric column parsed."""
    types = {f.name: f.dataType for f in df.schema.fields}
    items = [F.struct(F.lit(c).alias("col_name"), to_number(F.col(c), types[c]).alias("value")) for c in cols]
    return df.select(*keys, F.explode(F.array(*items)).alias("kv")).select(*keys, "kv.col_name", "kv.value")


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: ``(column, median)`` of the non-null numeric parse of each column."""
    return grouped_median(numeric_long(df, cols), ["col_name"], "value", "median")


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: ``(column, mode_text, mode_num, mode_count)``; ties go to the smallest value.

    Numeric columns compare as numbers (``mode_num``), text as text
    (``mode_text``).  Two bounded aggregates (max count, then min value among
    the values with that count); no window over a column's distinct values.
    """
    vc = value_counts(df, cols)
    return modes_from_counts(vc, df, cols)


def modes_from_counts(vc: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mode per column from ``value_counts`` output.

    ``mode_text`` is the canonical text of the mode for every column (the
    vocabulary key); ``mode_num`` its number for numeric columns.
    """
    top = vc.groupBy("col_name").agg(F.max("n").alias("mode_count"))
    best = (vc.join(top, "col_name").where(F.col("n") == F.col("mode_count"))
            .groupBy("col_name", "mode_count")
            .agg(F.min("value_num").alias("mode_num"),
                 F.min_by("value", "value_num").alias("_num_text"),
                 F.min("value").alias("_text")))
    return best.select(
        "col_name",
        F.when(F.col("mode_num").isNotNull(), F.col("_num_text")).otherwise(F.col("_text")).alias("mode_text"),
        "mode_num",
        "mode_count",
    )


def scaling_stats(df: DataFrame, cols: Sequence[str], medians: DataFrame) -> DataFrame:
    """A5: ``(column, median, mean, std, scale)`` of the median-imputed values.

    ``std`` is the population deviation; ``scale`` is 1 where it is 0.
    """
    long = numeric_long(df, cols).join(F.broadcast(medians), "col_name", "left")  # medians: one row per column
    imputed = F.coalesce(F.col("value"), F.col("median"))
    stats = long.groupBy("col_name").agg(
        F.first("median").alias("median"),
        F.avg(imputed).alias("mean"),
        F.stddev_pop(imputed).alias("std"),
    )
    return stats.select("col_name", "median", "mean", "std",
                        F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("scale"))


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, level_idx, level, level_num)``; all seen levels, sorted.

    Numeric levels sort as numbers, text as text.  The index is assigned by a
    distributed sort and one count per partition (no single task holds a
    column's levels), re-based per column.
    """
    vc = value_counts(df, cols).select("col_name", "value", "value_num")
    return dense_index(vc, "col_name", ["value_num", "value"], "level_idx").select(
        "col_name", "level_idx", F.col("value").alias("level"), F.col("value_num").alias("level_num"))


def dense_index(df: DataFrame, part: str, order: Sequence[str], out: str) -> DataFrame:
    """0-based rank of each row within ``part`` by ``order`` (rows distinct)."""
    indexed, _ = numbered(df, [part, *order], "_gidx")
    base = indexed.groupBy(part).agg(F.min("_gidx").alias("_base"))
    return indexed.join(base, part).select(*df.columns, (F.col("_gidx") - F.col("_base")).alias(out))


@dataclass
class EncoderModel:
    """Fitted constants (small) plus the vocabulary table (may be large)."""

    numeric: list[str]
    categorical: list[str]
    stats: dict[str, tuple[float | None, float | None, float]] = field(default_factory=dict)  # col -> (median, mean, scale)
    modes: dict[str, tuple[str | None, float | None]] = field(default_factory=dict)
    vocab: DataFrame | None = None
    vocab_sizes: dict[str, int] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(self.vocab_sizes.get(c, 0) for c in self.categorical)

    def feature_names(self) -> DataFrame:
        """M2: ``(feature_idx, feature)``: ``num__c`` then ``cat__c_level``."""
        spark = SparkSession.active()
        rows = [(i, f"num__{c}") for i, c in enumerate(self.numeric)]
        num = spark.createDataFrame(rows, "feature_idx int, feature string") if rows else None
        offs = self.offsets()
        cats = None
        if self.vocab is not None and self.categorical:
            off_df = spark.createDataFrame(list(offs.items()), "col_name string, _off int")
            cats = self.vocab.join(F.broadcast(off_df), "col_name").select(
                (F.col("_off") + F.col("level_idx")).cast("int").alias("feature_idx"),
                F.concat(F.lit("cat__"), F.col("col_name"), F.lit("_"), F.col("level")).alias("feature"))
        if num is None:
            return cats
        return num if cats is None else num.unionByName(cats)

    def offsets(self) -> dict[str, int]:
        off, out = len(self.numeric), {}
        for c in self.categorical:
            out[c] = off
            off += self.vocab_sizes.get(c, 0)
        return out


def fit_encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> EncoderModel:
    """M1 fit: medians, mean/scale, modes and vocabularies."""
    model = EncoderModel(list(numeric), list(categorical))
    if numeric:
        meds = column_medians(df, numeric)
        for r in scaling_stats(df, numeric, meds).collect():  # one row per numeric column
            model.stats[r["col_name"]] = (r["median"], r["mean"], r["scale"])
    if categorical:
        for r in column_modes(df, categorical).collect():  # one row per categorical column
            model.modes[r["col_name"]] = (r["mode_text"], r["mode_num"])
        model.vocab = cut(vocabulary(df, categorical))  # a written table: joins see its size
        model.vocab_sizes = {r["col_name"]: r["k"] for r in
                             model.vocab.groupBy("col_name").agg(F.count(F.lit(1)).alias("k")).collect()}
    elif numeric:
        model.vocab = None
    return model


def _imputed_level(df: DataFrame, model: EncoderModel, c: str):
    """Canonical level text of ``c`` with missing values replaced by the mode."""
    types = {f.name: f.dataType for f in df.schema.fields}
    mt, _ = model.modes.get(c, (None, None))
    return F.coalesce(value_text(F.col(c), types[c]), F.lit(mt))


def transform_long(df: DataFrame, model: EncoderModel, id_col: str = "id") -> DataFrame:
    """M1 apply, long/sparse form: ``(id, feature_idx, value)``.

    Every numeric feature for every row (standardised, imputed), plus the one
    non-zero one-hot entry per categorical column.  A level absent from the
    vocabulary contributes nothing (all zeros).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    if model.numeric:
        items = []
        for i, c in enumerate(model.numeric):
            med, mean, scale = model.stats[c]
            v = (F.coalesce(to_number(F.col(c), types[c]), F.lit(med)) - F.lit(mean)) / F.lit(scale)
            items.append(F.struct(F.lit(i).alias("feature_idx"), v.alias("value")))
        parts.append(df.select(F.col(id_col).alias("id"), F.explode(F.array(*items)).alias("kv"))
                     .select("id", "kv.feature_idx", "kv.value"))
    if model.categorical:
        offs = model.offsets()
        items = []
        for c in model.categorical:
            lvl = _imputed_level(df, model, c)
            items.append(F.struct(F.lit(c).alias("col_name"), lvl.alias("level")))
        long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*items)).alias("kv")).select("id", "kv.col_name", "kv.level")
        voc = model.vocab.select("col_name", "level", "level_idx")
        off_df = df.sparkSession.createDataFrame(list(offs.items()), "col_name string, _off int")
        parts.append(long.join(voc, ["col_name", "level"]).join(F.broadcast(off_df), "col_name")
                     .select("id", (F.col("_off") + F.col("level_idx")).cast("int").alias("feature_idx"),
                             F.lit(1.0).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_hot(ix_col: str, k: int):
    """``array<double>`` of length k with 1.0 at the level index (all zeros if unseen)."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.when(i == F.col(ix_col), F.lit(1.0)).otherwise(F.lit(0.0)))


def transform_dense(df: DataFrame, model: EncoderModel, id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """M1 apply, dense form: ``(id, keep..., features array<double>)``.

    Numerics by expression; each categorical level index by a join with its
    vocabulary (broadcast when the checked size allows), then one
    ``array`` expression builds the row.  For wide vocabularies prefer
    ``transform_long``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cur = df.select(F.col(id_col).alias("__rid"), *[F.col(k) for k in keep if k != id_col],
                    *[F.col(c) for c in sorted(set(model.numeric) | set(model.categorical)) if c not in keep])
    num_cols = []
    for c in model.numeric:
        med, mean, scale = model.stats[c]
        num_cols.append((F.coalesce(to_number(F.col(c), types[c]), F.lit(med)) - F.lit(mean)) / F.lit(scale))
    cat_arrays = []
    for c in model.categorical:
        lvl = _imputed_level(df, model, c)
        voc = model.vocab.where(F.col("col_name") == c).select(F.col("level").alias(f"_lv_{c}"),
                                                           F.col("level_idx").alias(f"_ix_{c}"))
        cur = cur.withColumn(f"_lk_{c}", lvl).join(voc, F.col(f"_lk_{c}") == F.col(f"_lv_{c}"), "left")
        k = model.vocab_sizes.get(c, 0)
        if k:
            cat_arrays.append(_one_hot(f"_ix_{c}", k))
    arrays = ([F.array(*num_cols)] if num_cols else []) + cat_arrays
    feats = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return cur.select(F.col("__rid").alias("id"), *[k for k in keep if k != id_col], feats.alias("features"))
