"""Input side: discovery, Parquet/CSV scans, empty guard, column spec, ID map.

S1  discover_input     every *.parquet under a folder (else every *.csv), read as one table
S2  read_parquet       columnar scan; projection and filters are pushed down by Catalyst
S3  read_csv           header row, quoted cells with quotes and line breaks, NA tokens to NULL, types in one aggregate pass
S4  read_any           Parquet first, then CSV, for an unknown suffix
S5  require_rows       fatal on an empty input
S6  ColumnSpec         requested features and always-numeric features (JSON or arguments)
S7  read_id_map        two id sets as one keyed table (id, in_on, in_not)
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.numeric import NUMBER_PATTERN

# The cell texts a pandas-style CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INTEGER_PATTERN = r"^\s*[+-]?\d{1,18}\s*$"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, e.g. ``read_table(spark, dir, "customer")``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """CSV with header; NA tokens become NULL; numeric columns are typed.

    Quotes inside quoted cells are doubled, and a quoted cell may hold line
    breaks, so a record can span lines and a file is read by one task (a
    large input is a folder of files).  Partition folders become columns.
    Files with different columns are an error when they are read.  The files are read as text once; one aggregate then decides, per column,
    whether every non-missing cell is an integer or a number, and the
    projection casts accordingly (no second ``inferSchema`` scan).
    """
    # enforceSchema off: every file's header is held against the table's
    reader = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=True, enforceSchema=False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(path)
    cols = raw.columns
    cleaned = raw.select(*[
        F.when(F.trim(F.col(c)).isin(NA_TOKENS) | F.col(c).isNull(), F.lit(None)).otherwise(F.col(c)).alias(c)
        for c in cols
    ])
    if not cols:
        return cleaned
    checks = []
    for i, c in enumerate(cols):
        v = F.col(c)
        checks.append(F.bool_and(v.isNull() | v.rlike(INTEGER_PATTERN)).alias(f"i{i}"))
        checks.append(F.bool_and(v.isNull() | F.lower(v).rlike(NUMBER_PATTERN)).alias(f"n{i}"))
        checks.append(F.count(v).alias(f"c{i}"))
    row = cleaned.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        if row[f"c{i}"] == 0:
            out.append(F.col(c).cast("double").alias(c))  # all missing: keep as an empty number column
        elif row[f"i{i}"]:
            out.append(F.trim(F.col(c)).cast("long").alias(c))
        elif row[f"n{i}"]:
            out.append(F.trim(F.col(c)).try_cast("double").alias(c))
        else:
            out.append(F.col(c))
    return cleaned.select(*out)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; an unknown suffix tries Parquet first, then CSV.

    Only what is not Parquet is read as CSV; a missing path or a broken Parquet file is an error.
    """
    low = path.lower()
    if low.endswith(".parquet"):
        return read_parquet(spark, path)
    if low.endswith(".csv"):
        return read_csv(spark, path)
    try:
        return read_parquet(spark, path)
    except Exception as exc:  # noqa: BLE001 - the footer error has no class of its own
        if "is not a Parquet file" not in str(exc):
            raise
        return read_csv(spark, path)


def discover_input(spark: SparkSession, data_dir: str) -> DataFrame:
    """Parquet files in the folder win over CSV files; error if neither.

    All matching files form one table (at scale the input is a folder of
    parts, not one file), so the choice is deterministic.
    """
    # files and partition folders (which become columns) of the folder itself, else tables that are folders in it
    for path, options in ((data_dir, {"pathGlobFilter": "*.parquet"}), (f"{data_dir.rstrip('/')}/*.parquet", {})):
        try:
            # all files' columns; a column that has two types is an error
            df = spark.read.options(mergeSchema=True, **options).parquet(path)
        except AnalysisException:
            continue
        if df.columns:
            return df
    try:
        return read_csv(spark, data_dir, glob="*.csv")
    except AnalysisException as exc:
        raise FileNotFoundError(f"{data_dir} holds neither Parquet nor CSV") from exc


def require_rows(df: DataFrame) -> DataFrame:
    """An empty input is fatal."""
    if df.isEmpty():
        raise ValueError("the input has no rows")
    return df


@dataclass
class ColumnSpec:
    """Which columns to model and which must be numeric."""

    preferred_features: list[str] = field(default_factory=list)
    preferred_numeric: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> ColumnSpec:
        doc = json.loads(text)
        return cls(list(doc.get("preferred_features") or []), list(doc.get("preferred_numeric") or []))

    @classmethod
    def from_file(cls, path: str) -> ColumnSpec:
        with open(path, encoding="utf-8") as fh:
            return cls.from_json(fh.read())


def id_map_from_sets(on_ids: DataFrame | None, not_ids: DataFrame | None, id_col: str = "id") -> DataFrame:
    """Two single-column id tables -> ``(id, in_on, in_not)``, one row per id.

    A missing set is an empty set.  Overlap is allowed (the status rule
    decides).  One shuffle: union then ``groupBy(id)`` with ``bool_or``.
    """
    parts = []
    if on_ids is not None:
        parts.append(on_ids.select(F.col(id_col).alias("id"), F.lit(True).alias("o"), F.lit(False).alias("n")))
    if not_ids is not None:
        parts.append(not_ids.select(F.col(id_col).alias("id"), F.lit(False).alias("o"), F.lit(True).alias("n")))
    if not parts:
        raise ValueError("no id set given")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.where(F.col("id").isNotNull())
            .groupBy("id").agg(F.bool_or("o").alias("in_on"), F.bool_or("n").alias("in_not")))


def read_id_map(spark: SparkSession, path: str | None, set_col: str = "set_name", id_col: str = "id",
                on_name: str = "on_drugs", not_name: str = "not_on_drugs") -> DataFrame | None:
    """A long table ``(id, set_name)``; missing path -> None (callers treat as empty sets)."""
    if path is None:
        return None
    try:
        raw = read_any(spark, path)
    except (AnalysisException, FileNotFoundError) as exc:
        if "PATH_NOT_FOUND" not in str(exc) and not isinstance(exc, FileNotFoundError):
            raise  # a map that is there but unreadable must not turn into "no map"
        warnings.warn(f"no id map at {path}: all rows get the default status", stacklevel=2)
        return None
    return (raw.where(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id"))
            .agg(F.bool_or(F.col(set_col) == on_name).alias("in_on"),
                 F.bool_or(F.col(set_col) == not_name).alias("in_not")))
