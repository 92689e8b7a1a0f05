"""End-to-end default job and the dense/long feature forms."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import encode, profile
from tessera.plans import fixtures as fx
from tessera.plans.jobs import JobParams, explain, run_default_job
from tessera.sources.readers import id_map_from_sets
from conftest import SF_SMALL


def test_dense_matches_long(spark):
    f1 = fx.mixed_table(spark, SF_SMALL)
    roles = profile.resolve_roles(f1, ["num_a", "num_text", "num_b", "seg", "flag", "region"], ["num_text"],
                                  ["seg", "flag"])
    model = encode.fit_encoder(f1, roles.numeric, roles.categorical)
    dense = {r["id"]: np.array(r["features"]) for r in encode.transform_dense(f1, model).collect()}
    long = encode.transform_long(f1, model).toPandas()
    for i, grp in long.groupby("id"):
        v = np.zeros(model.width)
        v[grp.feature_idx.to_numpy()] = grp.value.to_numpy()
        assert np.allclose(dense[i], v)


def test_default_job_end_to_end(spark):
    f1 = fx.mixed_table(spark, SF_SMALL).drop("cluster")
    idm = id_map_from_sets(f1.where("id % 5 IN (0, 1)").select("id"), f1.where("id % 5 IN (1, 2, 3)").select("id"))
    res = run_default_job(f1, JobParams(n_clusters=4, epsilon_cover_enabled=True, epsilon=0.5,
                                        preferred_features=["num_a", "num_text", "num_b", "seg", "flag", "region"],
                                        preferred_numeric=["num_text"], forced_categorical=["seg", "flag"]), idm)
    lab = res.labelled
    assert {"emb_x", "emb_y", "cluster", "emb_z"} <= set(lab.columns)
    assert lab.count() == f1.count()
    assert lab.select("cluster").distinct().count() == 4
    assert "silhouette_2d" in res.metrics and "davies_bouldin_2d" in res.metrics
    sel = res.selection.where(F.col("id").isNotNull())
    assert sel.count() > 0
    by_seg, overall, report = explain(lab, segment_col="seg")
    assert overall.count() == 4 and report.count() > 6


def _table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _six_inputs(spark):
    import math

    plain = [(i, float(i % 7), math.sin(i), "ab"[i % 2]) for i in range(60)]
    schema = "id long, a double, b double, c string"
    return {
        "all_numeric": _table(spark, [r[:3] for r in plain], "id long, a double, b double"),
        "string_id": _table(spark, [(f"p{r[0]}", *r[1:]) for r in plain], schema.replace("id long", "id string")),
        "null_id": _table(spark, [(None if r[0] < 5 else r[0], *r[1:]) for r in plain], schema),
        "repeated_id": _table(spark, [(r[0] // 2, *r[1:]) for r in plain], schema),
        "zero_vector": _table(spark, [(r[0], 0.0, 0.0, "a") if r[0] < 3 else r for r in plain], schema),
        "coincident": _table(spark, [(r[0], float(r[0] % 3), 1.0 + r[0] % 3, "a") for r in plain], schema),
    }


def test_rows_in_equal_rows_out(spark):
    for name, df in _six_inputs(spark).items():
        res = run_default_job(df, JobParams(n_clusters=3))
        assert res.labelled.count() == 60, name
        assert res.labelled.select(*df.columns).exceptAll(df).count() == 0, name
        assert res.metrics["n_rows"] == 60 and res.metrics["n_features"] == res.feature_names.count(), name


def test_density_on_string_ids_origin_and_coincident_points(spark):
    from tessera.operators.density import hdbscan

    pts = [(f"p{i}", float(i % 2) * 10, float(i % 2)) for i in range(24)] + [("zero", 0.0, 0.0)]
    df = spark.createDataFrame(pts, "id string, emb_x double, emb_y double")
    for metric in ("euclidean", "cosine"):
        res = hdbscan(df, min_cluster_size=4, min_samples=2, metric=metric)
        labels = {r["id"]: r["cluster"] for r in res.labels.collect()}
        assert set(labels) == {p[0] for p in pts}
        assert np.isfinite(res.relative_validity)


def test_folder_to_outputs(spark, tmp_path):
    from tessera.plans.jobs import run_folder

    src = tmp_path / "in"
    fx.mixed_table(spark, SF_SMALL).drop("cluster").write.partitionBy("region").parquet(str(src))
    spec = '{"preferred_features": ["num_a", "num_b", "seg", "region"], "preferred_numeric": ["num_b"]}'
    res, where = run_folder(spark, str(src), str(tmp_path / "out"), JobParams(n_clusters=3, run_name="one"), spec, segment_col="seg")
    assert where.endswith("/out/one")
    back = spark.read.parquet(f"{where}/labelled")
    assert back.count() == res.labelled.count() and set(back.columns) == set(res.labelled.columns)
    assert spark.read.parquet(f"{where}/features").count() == back.count()
    assert spark.read.parquet(f"{where}/feature_names").count() == res.metrics["n_features"]
    assert spark.read.option("header", "true").csv(f"{where}/summary_overall").count() == 3
    assert spark.read.parquet(f"{where}/runs").filter("experiment = 'tessera'").count() == 1


def test_missing_and_broken_id_maps(spark, tmp_path):
    import pytest

    from tessera.sources.readers import read_id_map

    with pytest.warns(UserWarning):
        assert read_id_map(spark, str(tmp_path / "none.parquet")) is None
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(Exception):
        read_id_map(spark, str(tmp_path / "bad.csv"))


def test_scatter_table_needs_two_numeric_columns(spark):
    import pytest

    from tessera.operators.cover import scatter_table

    df = spark.createDataFrame([(1, 0, 1.0, "a"), (2, -1, 2.0, "b")], "id long, cluster int, v double, t string")
    with pytest.warns(UserWarning):
        assert scatter_table(df, ["v", "t", "nowhere"]) is None
    with pytest.raises(ValueError):
        scatter_table(df.drop("id"), ["v", "v"])
    assert [tuple(r) for r in scatter_table(df.withColumn("w", F.lit(3)), ["v", "t", "w"]).collect()] == [("1", 0, 1.0, 3)]


def test_sweep_runs_the_grid_and_writes_records(spark, tmp_path):
    from tessera.plans import sweep

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(25, 2)), rng.normal(size=(25, 2)) + 9])
    emb = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, emb_x double, emb_y double")
    grid = [{"n_neighbors": 5, "min_samples": 2, "min_cluster_size": 8, "method": m, "epsilon": 0.0} for m in ("eom", "leaf")]
    asked = []
    records = sweep.run_sweep(lambda n: asked.append(n) or emb, grid, "try")
    assert asked == [5] and len(records) == 2
    path = str(tmp_path / "runs")
    sweep.write_runs(spark, records, path)
    back = spark.read.parquet(path).collect()
    assert {r["params"]["hdb_cluster_selection_method"] for r in back} == {"eom", "leaf"} and {r["experiment"] for r in back} == {"try"}
    assert all(r["metrics"]["hdbscan_n_clusters"] >= 2 for r in back)


def test_wide_tables_stay_long(spark, monkeypatch):
    from tessera.plans import jobs

    rows = [(i, float(i % 5), "ab"[i % 2], f"level {i % 9}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, c string, t string")
    params = JobParams(n_clusters=3, preferred_features=["a", "c", "t"], nominal_unique_threshold=2)
    dense = run_default_job(df, params).labelled.select("id", "emb_x", "emb_y").orderBy("id").toPandas()
    monkeypatch.setattr(jobs, "WIDE", 3)
    res = run_default_job(df, params)
    assert {"feature_idx", "value"} <= set(res.features.columns)
    long = res.labelled.select("id", "emb_x", "emb_y").orderBy("id").toPandas()
    assert np.allclose(dense.to_numpy(), long.to_numpy(), atol=1e-6)
