"""End-to-end jobs (section 3 of the design): the default clustering job and
the selection job, as compositions of the operators.

Every step is a DataFrame; the driver only holds fitted constants.  The
labelled table is keyed by the id column: derived columns are computed on
the same row, never glued back by position.
"""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.persist import cut

from tessera.operators import cluster as kmeans_ops
from tessera.operators import cover, encode, evaluate, profile, reduce, status, summarize
from tessera.session import prepare
from tessera.sources import readers, sinks


@dataclass
class JobParams:
    """The option surface of the modelled command line (2.15)."""

    reducer: str = "pca"
    clusterer: str = "kmeans"
    n_clusters: int = 8
    hdb_min_cluster_size: int = 500
    hdb_min_samples: int = 3
    hdb_cluster_selection_method: str = "eom"
    hdb_cluster_selection_epsilon: float = 0.01
    hdb_metric: str = "euclidean"
    random_state: int = 42
    umap_n_neighbors: int = 15
    umap_min_dist: float = 0.1
    id_column: str = "id"
    drug_z_default: float = 0.0
    z_jitter_sd: float = 0.05
    nominal_unique_threshold: int = 5
    nominal_ratio_threshold: float = 0.00005
    epsilon_cover_enabled: bool = False
    epsilon: float = 0.2
    epsilon_use_cluster_scope: bool = False
    sample_rows: int | None = None  # O1 is off by default: no row cap
    silhouette_sample: int | None = None  # all rows unless a sample is asked for
    preferred_features: list[str] = field(default_factory=list)
    preferred_numeric: list[str] = field(default_factory=list)
    forced_categorical: list[str] = field(default_factory=lambda: list(profile.FORCED_CATEGORICAL))
    experiment: str = "tessera"
    run_name: str | None = None


@dataclass
class JobResult:
    labelled: DataFrame
    numeric: list[str]
    categorical: list[str]
    metrics: dict[str, float]
    selection: DataFrame | None = None
    feature_names: DataFrame | None = None
    features: DataFrame | None = None
    selected_rows: DataFrame | None = None
    layers: dict[str, DataFrame] | None = None


ROW = "__row"
#: Features from which the matrix stays a (row, feature, value) table.
WIDE = 2048


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with a unique long per row, written so that every later read sees the same key."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def ensure_id(df: DataFrame, id_col: str) -> DataFrame:
    """The row key as id where the input has no id column."""
    if id_col in df.columns:
        return df
    warnings.warn(f"no column '{id_col}': the row key serves as id", stacklevel=2)
    return df.withColumn(id_col, F.col(ROW))


def run_default_job(df: DataFrame, params: JobParams | None = None, id_map: DataFrame | None = None) -> JobResult:
    """Table -> roles -> encode -> 2-D -> clusters -> status coordinate (+ selection).

    The labelled table has exactly the input's rows (or the sample's, if one is asked for).
    """
    p = params or JobParams()
    spark = df.sparkSession
    prepare(spark)
    df = ensure_id(with_row_key(df), p.id_column)
    if p.sample_rows:
        df = cut(status.exact_sample(df, p.sample_rows, p.random_state, ROW))
    table = df.drop(ROW)
    roles = profile.resolve_roles(table, p.preferred_features or None, p.preferred_numeric, p.forced_categorical,
                                  p.nominal_unique_threshold, p.nominal_ratio_threshold)
    model = encode.fit_encoder(table, roles.numeric, roles.categorical)
    if p.reducer == "pca" and model.width > WIDE:  # arrays of that length for every row would be mostly zeros
        feats = encode.transform_long(df, model, ROW).transform(cut)
        emb = reduce.pca_long(feats, df.select(F.col(ROW).alias("id")), seed=p.random_state)[0].transform(cut)
    else:
        feats = encode.transform_dense(df, model, ROW).transform(cut)
        emb = reduce.reduce_dimensions(feats, p.reducer, "features", p.random_state, p.umap_n_neighbors,
                                       p.umap_min_dist, "id").select("id", "emb_x", "emb_y").transform(cut)
    metrics: dict[str, float] = {"n_rows": float(emb.count()), "n_features": float(model.width)}
    if p.clusterer == "hdbscan":
        from tessera.operators.density import hdbscan

        res = hdbscan(emb, p.hdb_min_cluster_size, p.hdb_min_samples, p.hdb_cluster_selection_method,
                      p.hdb_cluster_selection_epsilon, p.hdb_metric)
        labelled = res.labels
        metrics["DBCV"] = res.relative_validity
    else:
        labelled = kmeans_ops.cluster_data(emb, p.clusterer, k=p.n_clusters, seed=p.random_state)
    labelled = labelled.select("id", "emb_x", "emb_y", "cluster").transform(cut)
    out = df.join(labelled.withColumnRenamed("id", ROW), ROW)
    out = status.status_coordinate(out, id_map, p.id_column, p.drug_z_default, p.z_jitter_sd, p.random_state).drop(ROW)
    ns = evaluate.noise_stats(labelled).first()
    if ns["n_labels"] > 1:
        if p.clusterer == "kmeans":
            metrics["silhouette_2d"], used = evaluate.silhouette(labelled, sample_size=p.silhouette_sample)
            metrics["silhouette_rows"] = float(used)
        metrics["davies_bouldin_2d"] = evaluate.davies_bouldin(labelled)
    if p.clusterer == "hdbscan":
        metrics.update({"hdbscan_noise_count": ns["n_noise"], "hdbscan_noise_ratio": ns["noise_ratio"],
                        "hdbscan_n_clusters": ns["n_clusters"], "NOISE": ns["noise_ratio"],
                        "COUNT": ns["n_clusters"]})
    selection = rows = layers = None
    if p.epsilon_cover_enabled:
        flagged = cover.status_sets(out, id_map, p.id_column)
        centres, matches = cover.cover_and_match(flagged, p.epsilon, cover.XYZ, p.id_column, "cluster",
                                           p.epsilon_use_cluster_scope)
        selection = cut(cover.selection(matches, out.select("cluster").distinct()))
        rows = cover.selected_rows(out, selection, out.columns, p.id_column)
        layers = cover.plot_layers(out, centres, matches, cover.XYZ, p.id_column)
        scatter = {"scatter_embedding": cover.scatter_table(out, cover.XYZ, p.id_column),
                   "scatter_original": cover.scatter_table(out, roles.numeric, p.id_column)}
        layers |= {name: table for name, table in scatter.items() if table is not None}
    return JobResult(out, roles.numeric, roles.categorical, metrics, selection, model.feature_names(), feats, rows, layers)


def run_folder(spark: SparkSession, data_dir: str, out_dir: str | None = None, params: JobParams | None = None,
               spec_json: str | None = None, id_map_path: str | None = None, fmt: str = "parquet",
               segment_col: str | None = "sexo") -> tuple[JobResult, str]:
    """The whole job from a folder to its outputs: read, check, cluster, explain, and write every table.

    Discovery (S1), the empty guard (S5), the column spec (S6), the id map (S7), the sinks (S8-S12), the run record
    (S13, A17) and the output location (S14).  Returns the result and where its tables were written.
    """
    p = params or JobParams()
    where = sinks.output_location(data_dir, out_dir, p.run_name, p.reducer, p.clusterer)
    df = readers.require_rows(readers.discover_input(spark, data_dir))
    if spec_json is not None:
        spec = readers.ColumnSpec.from_json(spec_json)
        p = replace(p, preferred_features=spec.preferred_features, preferred_numeric=spec.preferred_numeric)
    res = run_default_job(df, p, readers.read_id_map(spark, id_map_path, id_col=p.id_column))
    sinks.write_labelled(res.labelled, where, fmt)
    sinks.write_features(res.features, res.feature_names, where)
    if summarize.has_summary(res.labelled, segment_col=segment_col):  # without a segment column both tables are by cluster
        sinks.write_explanations(*explain(res.labelled, segment_col), where)
    else:
        warnings.warn("no column to summarise: the clusters are not explained", stacklevel=2)
    if res.selection is not None:
        sinks.write_selection(res.selection, where, fmt)
        sinks.write_table(res.selected_rows, where, "selected_rows", fmt, ["sel_order"])
        sinks.write_layers(res.layers, where, fmt)
    from tessera.plans import sweep

    params_text = {k: str(v) for k, v in asdict(p).items()}
    sweep.write_runs(spark, [sweep.run_record(p.experiment, params_text, res.metrics, p.run_name)], f"{where}/runs")
    return res, where


def explain(labelled: DataFrame, segment_col: str | None = "sexo") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three explanation outputs: by (cluster, segment), by cluster, report lines."""
    return (summarize.cluster_summary(labelled, segment_col=segment_col, levels="segment"),
            summarize.cluster_summary(labelled, segment_col=segment_col, levels="overall"),
            summarize.report_lines(labelled, segment_col=segment_col))
