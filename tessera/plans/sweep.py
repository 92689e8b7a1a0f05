"""Parameter sweeps and run records (O1 option, X1-X3, S13).

The modelled sweep launches one process per grid point, and each process
re-embeds, re-builds the spanning tree and re-condenses.  Here the grid is
grouped by the step each parameter affects:

    n_neighbors      -> embedding                 (3 distinct)
    min_samples      -> spanning tree              (3 per embedding: 9)
    min_cluster_size -> condensed tree             (3 per tree: 27)
    method, epsilon  -> selection down the cluster tree (162)

so the expensive distributed steps run once per distinct input.  Every run
yields one record ``(experiment, run_id, run_name, params, metrics)``
appended to a Parquet table partitioned by experiment.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.operators import density, evaluate

# The modelled sweep grid.
MIN_CLUSTER_SIZES = [80, 60, 100]
MIN_SAMPLES = [2, 1, 3]
METHODS = ["eom", "leaf"]
EPSILONS = [0.04, 0.05, 0.06]
N_NEIGHBORS = [50, 60, 40]

RUN_SCHEMA = ("experiment string, run_id string, run_name string, started double, "
              "params map<string,string>, metrics map<string,double>")


def sweep_grid(spark: SparkSession, min_cluster_sizes: Sequence[int] = MIN_CLUSTER_SIZES,
               min_samples: Sequence[int] = MIN_SAMPLES, methods: Sequence[str] = METHODS,
               epsilons: Sequence[float] = EPSILONS, n_neighbors: Sequence[int] = N_NEIGHBORS) -> DataFrame:
    """The Cartesian grid as rows, by successive explodes (no join)."""
    def arr(vals, cast):
        return F.array(*[F.lit(v).cast(cast) for v in vals])

    g = spark.range(1).select(F.explode(arr(min_cluster_sizes, "int")).alias("min_cluster_size"))
    g = g.select("*", F.explode(arr(min_samples, "int")).alias("min_samples"))
    g = g.select("*", F.explode(arr(methods, "string")).alias("method"))
    g = g.select("*", F.explode(arr(epsilons, "double")).alias("epsilon"))
    return g.select("*", F.explode(arr(n_neighbors, "int")).alias("n_neighbors"))


def run_record(experiment: str, params: dict, metrics: dict, run_name: str | None = None) -> tuple:
    return (experiment, uuid.uuid4().hex, run_name, time.time(),
            {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items() if v is not None})


def hdbscan_metrics(labels: DataFrame, tree: DataFrame) -> dict:
    """The metrics the modelled tracking branch records for density runs."""
    ns = evaluate.noise_stats(labels).first()
    dbcv = evaluate.relative_validity(tree, labels.select("id", "cluster"))
    out = {"hdbscan_noise_count": ns["n_noise"], "hdbscan_noise_ratio": ns["noise_ratio"],
           "hdbscan_n_clusters": ns["n_clusters"], "DBCV": dbcv, "NOISE": ns["noise_ratio"],
           "COUNT": ns["n_clusters"]}
    if ns["n_labels"] > 1:
        out["davies_bouldin_2d"] = evaluate.davies_bouldin(labels)
    return out


def run_sweep(embed: Callable[[int], DataFrame], grid: list[dict], experiment: str = "tessera",
              metric: str = "euclidean") -> list[tuple]:
    """Run every grid point, sharing embeddings, trees and condensed trees.

    ``embed(n_neighbors)`` returns ``(id, emb_x, emb_y)``.  Returns run records.
    """
    records = []
    for nn in sorted({g["n_neighbors"] for g in grid}):
        emb = embed(nn).select("id", "emb_x", "emb_y").transform(cut)
        sub = [g for g in grid if g["n_neighbors"] == nn]
        for ms in sorted({g["min_samples"] for g in sub}):
            tree = density.mst_edges(emb, ms, metric=metric).transform(cut)
            sub2 = [g for g in sub if g["min_samples"] == ms]
            for mcs in sorted({g["min_cluster_size"] for g in sub2}):
                condensed = density.condensed_tree(tree, emb, mcs)
                for g in (x for x in sub2 if x["min_cluster_size"] == mcs):
                    owners = density.select_clusters(condensed, g["method"], g["epsilon"])
                    labels = density.label_points(condensed, owners, emb)
                    params = {"reducer": "umap", "clusterer": "hdbscan", "hdb_min_cluster_size": mcs,
                              "hdb_min_samples": ms, "hdb_cluster_selection_method": g["method"],
                              "hdb_cluster_selection_epsilon": g["epsilon"], "hdb_metric": metric,
                              "umap_n_neighbors": nn}
                    records.append(run_record(experiment, params, hdbscan_metrics(labels, tree)))
    return records


def write_runs(spark: SparkSession, records: list[tuple], path: str) -> DataFrame:
    """Append run records to a Parquet table partitioned by experiment."""
    df = spark.createDataFrame(records, RUN_SCHEMA)
    df.write.mode("append").partitionBy("experiment").parquet(path)
    return df
