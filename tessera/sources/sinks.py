"""Result sinks (S8-S14): distributed writes of every table a job makes.

Each table is a folder of part files below one output location, Parquet by default and CSV on request.  No sink
collects rows or forces one file.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv")


def output_location(data_dir: str, out_dir: str | None = None, run_name: str | None = None, reducer: str = "umap",
                    clusterer: str = "kmeans") -> str:
    """The given location, else ``outputs/outputs-{reducer}-{clusterer}`` beside the input folder.

    A run name adds a folder of its own.  A location inside the input is refused: the next run would read it.
    """
    source = data_dir.rstrip("/") or "/"
    parent = source.rpartition("/")[0] if "/" in source else "."
    base = (out_dir or f"{parent}/outputs/outputs-{reducer}-{clusterer}").rstrip("/")
    plain = base.removeprefix("./")
    if plain == source.removeprefix("./") or plain.startswith(f"{source.removeprefix('./')}/"):
        raise ValueError(f"the output location {base} lies inside the input {data_dir}")
    return f"{base}/{run_name}" if run_name else base


def write_lines(lines: DataFrame, location: str, name: str, order_by: list[str], line_col: str = "line") -> str:
    """A text whose lines are rows: the files in the order of their names, end to end, are the text in order.

    Ranges of ``order_by`` (nulls first) go to files of their own, sorted inside.
    """
    path = f"{location.rstrip('/')}/{name}"
    ordered = lines.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered.select(F.coalesce(F.col(line_col), F.lit("")).alias("value")).write.mode("overwrite").text(path)
    return path


def write_table(df: DataFrame, location: str, name: str, fmt: str = "parquet", order_by: list[str] | None = None) -> str:
    """Write ``df`` as ``location/name``; ``order_by`` range-partitions and sorts, so that files follow the order (O2)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    path = f"{location.rstrip('/')}/{name}"
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_labelled(df: DataFrame, location: str, fmt: str = "parquet", cluster_col: str = "cluster") -> str:
    """The labelled table, its files ordered by cluster."""
    return write_table(df, location, "labelled", fmt, [cluster_col])


def write_features(features: DataFrame, names: DataFrame | None, location: str) -> tuple[str, str | None]:
    """The feature matrix and the feature names."""
    matrix = write_table(features, location, "features")
    return matrix, write_table(names, location, "feature_names") if names is not None else None


def write_explanations(by_segment: DataFrame | None, overall: DataFrame | None, report: DataFrame | None, location: str, fmt: str = "csv") -> list[str]:
    """The summary tables that exist and the report as text; a missing one is skipped with a warning."""
    out = []
    for name, df in (("summary_by_segment", by_segment), ("summary_overall", overall), ("report.md", report)):
        if df is None:
            warnings.warn(f"nothing to write for {name}", stacklevel=2)
        elif df is report:
            out.append(write_lines(df, location, name, ["cluster", "line_no"]))
        else:
            out.append(write_table(df, location, name, fmt))
    return out


def write_selection(selection: DataFrame, location: str, fmt: str = "parquet") -> str:
    """The selected rows."""
    return write_table(selection, location, "selection", fmt)


def write_layers(layers: dict[str, DataFrame], location: str, fmt: str = "parquet") -> list[str]:
    """The tables a plot of the cover is drawn from, one folder each."""
    return [write_table(df, location, f"plot_{name}", fmt) for name, df in layers.items()]
