"""Dimension reduction: covariance and PCA (M3).

Covariance is two distributed passes over the feature arrays: column sums,
then the centred Gram matrix.  Each partition reduces its rows with one
NumPy matrix product inside ``mapInPandas`` and emits only d x d partial
sums, which a grouped sum combines (map-side combine, d^2 rows per task).
The d x d eigen-decomposition runs on the driver; d is the feature width,
independent of the row count.  The projection is a JVM expression
(``aggregate`` over ``zip_with``), no Python per row.

Wide one-hot matrices stay (row, feature, value) tables: ``pca_long`` finds
the axes by randomised subspace rounds, each two joins.  Its tables have one
row per feature with a few columns; only small square matrices of that few
columns reach the driver, no d x d sums and no literal per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.persist import cut, release


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def column_means(df: DataFrame, vec_col: str = "features") -> tuple[int, np.ndarray]:
    """(n, mean vector) of an ``array<double>`` column, one pass."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = 0, None
        for pdf in it:
            x = _stack(pdf[vec_col])
            if x.size == 0:
                continue
            n += x.shape[0]
            s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
        if n:
            yield pd.DataFrame({"i": np.arange(len(s)), "s": s, "n": n})

    sums = (df.select(vec_col).mapInPandas(part, "i long, s double, n long")
              .groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
              .orderBy("i").collect())  # d rows
    if not sums:
        return 0, np.zeros(0)
    d = len(sums)
    # every partition reports n once per index i, so n sums to the row count per i
    n = int(sums[0]["n"])
    return n, np.array([r["s"] for r in sums]) / n if n else np.zeros(d)


def covariance_matrix(df: DataFrame, vec_col: str = "features", ddof: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(covariance d x d, mean d, n): two passes, d^2 partial sums per task."""
    n, mean = column_means(df, vec_col)
    d = len(mean)
    mean_b = df.sparkSession.sparkContext.broadcast(mean)  # d doubles

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        mu = mean_b.value
        for pdf in it:
            x = _stack(pdf[vec_col])
            if x.size == 0:
                continue
            xc = x - mu
            g = xc.T @ xc if g is None else g + xc.T @ xc
        if g is not None:
            ii, jj = np.triu_indices(len(mu))
            yield pd.DataFrame({"i": ii, "j": jj, "g": g[ii, jj]})

    rows = (df.select(vec_col).mapInPandas(part, "i long, j long, g double")
              .groupBy("i", "j").agg(F.sum("g").alias("g")).collect())  # d(d+1)/2 rows
    cov = np.zeros((d, d))
    for r in rows:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["g"]
    cov /= max(n - ddof, 1)
    return cov, mean, n


def covariance_long(df: DataFrame, vec_col: str = "features") -> DataFrame:
    """``(i, j, cov)`` sample covariance in long form (all d x d entries)."""
    cov, _, _ = covariance_matrix(df, vec_col)
    d = cov.shape[0]
    rows = [(i, j, float(cov[i, j])) for i in range(d) for j in range(d)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double")


@dataclass
class PCAModel:
    mean: np.ndarray
    components: np.ndarray  # k x d, rows = principal axes
    explained_variance: np.ndarray

    def transform(self, df: DataFrame, vec_col: str = "features", out: tuple[str, ...] = ("emb_x", "emb_y")) -> DataFrame:
        """Project centred rows on the axes: one JVM expression per output."""
        mu = F.array(*[F.lit(float(v)) for v in self.mean])
        cols = {}
        for name, w in zip(out, self.components):
            wv = F.array(*[F.lit(float(v)) for v in w])
            prod = F.zip_with(F.col(vec_col), F.zip_with(mu, wv, lambda m, q: F.struct(m.alias("m"), q.alias("q"))),
                              lambda x, mq: (x - mq["m"]) * mq["q"])
            cols[name] = F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumns(cols)


def fit_pca(df: DataFrame, k: int = 2, vec_col: str = "features") -> PCAModel:
    """M3: centred PCA; each axis's largest-magnitude loading is positive."""
    cov, mean, _ = covariance_matrix(df, vec_col)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    comps = vecs[:, order].T.copy()
    for r in range(comps.shape[0]):
        if comps[r, np.argmax(np.abs(comps[r]))] < 0:
            comps[r] = -comps[r]
    return PCAModel(mean, comps, vals[order])


def _gram(table: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The sums of products of two lists of columns."""
    row = table.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in left for b in right]).first()
    return np.array([[row[f"{a}_{b}"] or 0.0 for b in right] for a in left])


def _times(columns: list[str], matrix: np.ndarray, out: str) -> list[Column]:
    """The columns times a small matrix."""
    return [sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns[1:], col[1:])), F.col(columns[0]) * F.lit(float(col[0]))).alias(f"{out}{j}")
            for j, col in enumerate(matrix.T)]


def pca_long(long: DataFrame, ids: DataFrame, k: int = 2, oversample: int = 24, tol: float = 1e-9, max_rounds: int = 200,
             seed: int = 42, out: tuple[str, ...] = ("emb_x", "emb_y")) -> tuple[DataFrame, DataFrame]:
    """M3 over ``long(id, feature_idx, value)``: (ids with the k centred scores, (feature_idx, v0 .. v k-1) axes).

    ``ids`` holds every row's id, also of rows without an entry (missing entries are zero).  Rounds multiply a basis of
    k + ``oversample`` columns by the covariance until the k leading axes change by less than ``tol`` of their variance.
    Signs as in ``fit_pca``: the largest loading of an axis is positive (ties: the smallest feature).
    """
    n = ids.count()
    entries = cut(long.select("id", "feature_idx", F.col("value").cast("double").alias("value")))
    means = cut(entries.groupBy("feature_idx").agg((F.sum("value") / F.lit(float(n))).alias("mean")))
    d = means.count()
    width = min(d, k + oversample)
    if not width:
        raise ValueError("the matrix has no entry")
    q, z, y = ([f"{x}{j}" for j in range(width)] for x in "qzy")

    def gaussian(j: int) -> Column:
        u = [(F.pmod(F.xxhash64("feature_idx", F.lit(seed), F.lit(2 * j + i)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52)) for i in range(2)]
        return F.sqrt(-2.0 * F.log(u[0])) * F.cos(F.lit(2.0 * np.pi) * u[1])

    def orthonormal(table: DataFrame, columns: list[str]) -> DataFrame:
        values, vectors = np.linalg.eigh(_gram(table, columns, columns))
        kept = values > max(values.max(), 0.0) * 1e-13
        return table.select("feature_idx", "mean", *_times(columns, vectors[:, kept] / np.sqrt(values[kept]), "q"))

    def multiplied(basis: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
        """The basis and, as ``names``, the covariance (times n) by the basis."""
        shift = basis.agg(*[F.sum(F.col("mean") * F.col(c)).alias(c) for c in columns]).first()
        rows = (entries.join(basis, "feature_idx").groupBy("id")
                .agg(*[(F.sum(F.col("value") * F.col(c)) - F.lit(float(shift[c]))).alias(w) for c, w in zip(columns, y)]))
        back = entries.join(rows, "id").groupBy("feature_idx").agg(*[F.sum(F.col("value") * F.col(w)).alias(m) for w, m in zip(y, names)])
        # rows without an entry have the score -shift, and count only here: centred scores sum to zero over all rows
        return cut(basis.join(back, "feature_idx"))

    basis = cut(orthonormal(cut(means.select("feature_idx", "mean", *[gaussian(j).alias(c) for j, c in enumerate(q)])), q))
    for _ in range(max_rounds):
        here = [c for c in basis.columns if c.startswith("q")]
        names = z[: len(here)]
        step = multiplied(basis, here, names)
        small = _gram(step, here, names)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        lead = vectors[:, ::-1][:, :k]
        top = values[::-1][:k]
        pairs = step.select(*_times(here, lead * top, "a"), *_times(names, lead, "b"))
        wide = range(lead.shape[1])
        off = pairs.agg(*[F.sum((F.col(f"a{j}") - F.col(f"b{j}")) ** 2).alias(f"r{j}") for j in wide]).first()
        done = all((off[f"r{j}"] or 0.0) ** 0.5 <= tol * max(top[j], 1e-300) for j in wide)
        if done:
            release(basis)
            basis = step
            break
        nxt = cut(orthonormal(step.select("feature_idx", "mean", *names), names))
        release(basis, step)
        basis = nxt
        here = [c for c in basis.columns if c.startswith("q")]
        lead = np.eye(len(here))[:, :k]
    v = [f"v{j}" for j in range(min(k, lead.shape[1]))]
    axes = basis.select("feature_idx", "mean", *_times([c for c in basis.columns if c.startswith("q")], lead, "v"))
    signs = axes.agg(*[F.max(F.struct(F.abs(c).alias("size"), (-F.col("feature_idx")).alias("first"), F.col(c).alias("value"))).alias(c) for c in v]).first()
    axes = cut(axes.select("feature_idx", "mean", *[(F.col(c) * F.lit(-1.0 if signs[c]["value"] < 0 else 1.0)).alias(c) for c in v]))
    shift = axes.agg(*[F.sum(F.col("mean") * F.col(c)).alias(c) for c in v]).first()
    scores = entries.join(axes, "feature_idx").groupBy("id").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in v])
    placed = ids.select("id").join(scores, "id", "left").select(
        "id", *[(F.coalesce(c, F.lit(0.0)) - F.lit(float(shift[c]))).alias(o) for c, o in zip(v, out)],
        *[F.lit(0.0).alias(o) for o in out[len(v):]])
    return placed, axes.drop("mean")


def reduce_dimensions(df: DataFrame, method: str = "pca", vec_col: str = "features", seed: int = 42,
                      n_neighbors: int = 15, min_dist: float = 0.1, id_col: str = "id") -> DataFrame:
    """Add ``emb_x, emb_y`` by PCA or the neighbour-graph layout."""
    if method == "pca":
        return fit_pca(df, 2, vec_col).transform(df, vec_col)
    if method == "umap":
        from tessera.operators.layout import umap_embed

        return umap_embed(df, vec_col, id_col, n_neighbors=n_neighbors, min_dist=min_dist, seed=seed)
    raise ValueError("no such reducer; there are pca and umap")
