"""Sources, guards, status coordinate and sampling (pytest-only items)."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile, status
from tessera.sources import readers


def test_csv_na_tokens_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,a,b,c\n1,1.5,NA,x\n2,,7,N/A\n3,2,n/a,y\n4,3.25,8,\n5,nan,9,z\n")
    df = readers.read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["a"] == "double" and types["b"] == "bigint" and types["c"] == "string"
    rows = {r["id"]: r for r in df.collect()}
    assert rows[2]["a"] is None and rows[1]["b"] is None and rows[2]["c"] is None and rows[4]["c"] is None


def test_discovery_prefers_parquet(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "x.csv").write_text("id,v\n1,2\n")
    spark.createDataFrame([(7, 8.0)], "id long, v double").write.parquet(str(d / "y.parquet"))
    df = readers.discover_input(spark, str(d))
    assert df.collect()[0]["id"] == 7
    only_csv = tmp_path / "c"
    only_csv.mkdir()
    (only_csv / "x.csv").write_text("id,v\n1,2\n")
    assert readers.discover_input(spark, str(only_csv)).collect()[0]["v"] == 2
    empty = tmp_path / "e"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        readers.discover_input(spark, str(empty))


def test_empty_guard(spark):
    with pytest.raises(ValueError):
        readers.require_rows(spark.range(0))


def test_status_rules_and_jitter(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    idm = readers.id_map_from_sets(spark.createDataFrame([(1,), (3,)], "id long"),
                                   spark.createDataFrame([(3,), (4,)], "id long"))
    z = {r["id"]: r["emb_z"] for r in status.status_coordinate(df, idm, default=0.5).collect()}
    assert z == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}
    j1 = {r["id"]: r["emb_z"] for r in status.status_coordinate(df, idm, jitter_sd=0.05, seed=1).collect()}
    j2 = {r["id"]: r["emb_z"] for r in status.status_coordinate(df.repartition(3), idm, jitter_sd=0.05, seed=1).collect()}
    assert j1 == j2 and any(abs(j1[k] - z[k]) > 0 for k in z)
    with pytest.warns(UserWarning):
        out = status.status_coordinate(df.withColumnRenamed("id", "key"), idm).collect()
    assert all(r["emb_z"] == 0.0 for r in out)


def test_sample_is_exact_and_partition_independent(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    a = sorted(r["k"] for r in status.exact_sample(df, 100, 7, "k").collect())
    b = sorted(r["k"] for r in status.exact_sample(df.repartition(17), 100, 7, "k").collect())
    assert len(a) == 100 and a == b


def test_roles_without_spec_and_fatal(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", 2.5, None), (3, "a", 3.5, None)],
                               "id long, s string, v double, n double")
    r = profile.resolve_roles(df, None)
    assert "n" not in r.numeric and "s" in r.categorical
    with pytest.raises(ValueError):
        profile.resolve_roles(spark.createDataFrame([(None,)], "n double"), None)


def test_csv_cells_with_quotes_line_breaks_and_partition_folders(spark, tmp_path):
    d = tmp_path / "in"
    for part, text in (("k=1", 'id,t\n1,"x ""y"" z, w"\n2,"two\nlines"\n'), ("k=2", "id,t\n3,plain\n")):
        (d / part).mkdir(parents=True)
        (d / part / "a.csv").write_text(text)
    df = readers.discover_input(spark, str(d))
    assert dict(df.dtypes)["id"] == "bigint"
    assert sorted((r["id"], r["t"], r["k"]) for r in df.collect()) == [(1, 'x "y" z, w', 1), (2, "two\nlines", 1), (3, "plain", 2)]


def test_files_with_different_columns(spark, tmp_path):
    d = str(tmp_path / "p")
    spark.createDataFrame([(1, 2.0)], "id long, a double").write.parquet(f"{d}/x.parquet")
    spark.createDataFrame([(2, "t")], "id long, b string").write.parquet(f"{d}/y.parquet")
    got = readers.discover_input(spark, d)
    assert sorted(got.columns) == ["a", "b", "id"] and got.where("a is null and b = 't'").count() == 1
    bad = str(tmp_path / "q")
    spark.createDataFrame([(1, 2.0)], "id long, a double").write.parquet(f"{bad}/x.parquet")
    spark.createDataFrame([(2, "t")], "id long, a string").write.parquet(f"{bad}/y.parquet")
    with pytest.raises(Exception):
        readers.discover_input(spark, bad).collect()
    c = tmp_path / "c"
    c.mkdir()
    (c / "x.csv").write_text("id,a\n1,2\n")
    (c / "y.csv").write_text("id,b\n3,4\n")
    with pytest.raises(Exception):
        readers.discover_input(spark, str(c)).collect()


def test_unknown_suffix(spark, tmp_path):
    (tmp_path / "t.txt").write_text("id,v\n1,2\n")
    assert readers.read_any(spark, str(tmp_path / "t.txt")).collect()[0]["v"] == 2
    spark.createDataFrame([(5, 6)], "id long, v long").write.parquet(str(tmp_path / "table"))
    assert readers.read_any(spark, str(tmp_path / "table")).collect()[0]["v"] == 6
    with pytest.raises(Exception):
        readers.read_any(spark, str(tmp_path / "missing"))


def test_report_text_in_order_and_output_location(spark, tmp_path):
    from tessera.sources import sinks

    rows = [(c, i, f"line {c} {i}" if i else "") for c in (None, *range(40)) for i in range(25)]
    lines = spark.createDataFrame(rows, "cluster int, line_no int, line string").repartition(13)
    path = sinks.write_lines(lines, str(tmp_path), "report.md", ["cluster", "line_no"])
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    assert "".join(open(os.path.join(path, f)).read() for f in parts) == "".join(f"{r[2]}\n" for r in rows)
    assert sinks.output_location("/d/in") == "/d/outputs/outputs-umap-kmeans"
    assert sinks.output_location("in", reducer="pca", clusterer="hdbscan", run_name="r") == "./outputs/outputs-pca-hdbscan/r"
    assert sinks.output_location("in/", "x/") == "x"
    for inside in ("in", "in/results", "./in/x"):
        with pytest.raises(ValueError):
            sinks.output_location("in", inside)


def test_selection_sink_reads_back_in_order(spark, tmp_path):
    from tessera.sources import sinks

    sel = spark.createDataFrame([(c, r, 10 * c + r) for c in range(6) for r in range(1, 9)], "cluster int, rank int, id long")
    assert spark.read.parquet(sinks.write_selection(sel, str(tmp_path))).exceptAll(sel).isEmpty()
    path = sinks.write_table(sel.repartition(9), str(tmp_path), "ordered", "parquet", ["cluster", "rank"])
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    ids = [r["id"] for f in parts for r in spark.read.parquet(os.path.join(path, f)).collect()]
    assert ids == sorted(ids) and len(ids) == 48


def test_two_decimals_equal_exact_formatting(spark):
    import random

    from tessera.functions.numeric import two_decimals

    rng = random.Random(3)
    values = [0.125, 2.675, 0.375, 0.005, -0.001, -0.0, 1.005, 0.995, 99.995, 1e15 + 0.125, 5e-324, 1e17]
    values += [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randrange(-4000, 4000) / 8 for _ in range(200)]
    values += [rng.random() * 10 ** -rng.randrange(12) for _ in range(300)] + [float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert all(r["t"] == f"{r['x']:.2f}" for r in df.select("x", two_decimals(df["x"]).alias("t")).collect())
