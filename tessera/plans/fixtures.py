"""Fixtures F1-F4: inputs derived from the driver tables by expressions that
read identically in Spark and in SQL (see FIXTURES.md).

Each function returns a lazy DataFrame; the SQL text of the same fixture is
kept next to it so the oracle queries can inline it as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import read_table

# ---------------------------------------------------------------- F1 mixed table


def mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with its order totals and region; nulls injected by key."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    # Pre-aggregate orders per customer before the join: the join then moves
    # one row per customer instead of every order.
    o = (read_table(spark, sf_dir, "orders")
         .groupBy("o_custkey")
         .agg(F.sum("o_totalprice").alias("num_b"), F.count("o_orderkey").alias("_n")))
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (c.join(o, c.c_custkey == o.o_custkey, "left")
          .join(n, c.c_nationkey == n.n_nationkey, "left"))
    k = F.col("c_custkey")
    return j.select(
        k.alias("id"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).cast("double").alias("num_a"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string")).alias("num_text"),
        F.col("num_b").cast("double").alias("num_b"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("n_orders"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("flag"),
        F.col("n_regionkey").cast("int").alias("region"),
        (k % 6 - 1).cast("int").alias("cluster"),
    )


F1_SQL = """
f1 AS (
  SELECT c.c_custkey AS id,
         CAST(CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_acctbal END AS DOUBLE) AS num_a,
         CASE WHEN c.c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c.c_nationkey AS VARCHAR) END AS num_text,
         CAST(o.num_b AS DOUBLE) AS num_b,
         CAST(COALESCE(o.n, 0) AS INTEGER) AS n_orders,
         CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_mktsegment END AS seg,
         CAST(CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS flag,
         CAST(n.n_regionkey AS INTEGER) AS region,
         CAST(c.c_custkey % 6 - 1 AS INTEGER) AS cluster
  FROM customer c
  LEFT JOIN (SELECT o_custkey, SUM(o_totalprice) AS num_b, COUNT(o_orderkey) AS n
             FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

# ---------------------------------------------------------------- F2 points


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit vectors with rounded 3-D coordinates, labels and two id sets."""
    e = read_table(spark, sf_dir, "embeddings")
    vec = F.transform("embedding", lambda v: v.cast("double"))
    k = F.col("vec_id")
    return e.select(
        k.alias("id"),
        vec.alias("vec"),
        F.round(vec[0], 6).alias("x"),
        F.round(vec[1], 6).alias("y"),
        F.round(vec[2], 6).alias("z"),
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster"),
        (k % 5).isin(0, 1).alias("in_on"),
        (k % 5).isin(1, 2, 3).alias("in_not"),
        vec[3].alias("orig_a"),
        vec[4].alias("orig_b"),
    )


F2_SQL = """
f2 AS (
  SELECT vec_id AS id,
         CAST(embedding AS DOUBLE[]) AS vec,
         ROUND(CAST(embedding[1] AS DOUBLE), 6) AS x,
         ROUND(CAST(embedding[2] AS DOUBLE), 6) AS y,
         ROUND(CAST(embedding[3] AS DOUBLE), 6) AS z,
         CAST(CASE WHEN label = 0 THEN -1 ELSE label END AS INTEGER) AS cluster,
         (vec_id % 5) IN (0, 1) AS in_on,
         (vec_id % 5) IN (1, 2, 3) AS in_not,
         CAST(embedding[4] AS DOUBLE) AS orig_a,
         CAST(embedding[5] AS DOUBLE) AS orig_b
  FROM embeddings
)"""

# ---------------------------------------------------------------- F3 wide cardinality


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem plus an all-null column and a NaN-bearing column."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "*",
        F.lit(None).cast("double").alias("all_null"),
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("with_nan"),
    )


F3_SQL = """
f3 AS (
  SELECT *, CAST(NULL AS DOUBLE) AS all_null,
         CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS with_nan
  FROM lineitem
)"""

# ---------------------------------------------------------------- F4 natural nulls


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with optional labels; status sets from ``toxic``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("id"),
        "n_chars", "lang", "source",
        F.col("quality").cast("int").alias("quality"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("in_on"),
        F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("in_not"),
    )


F4_SQL = """
f4 AS (
  SELECT d.doc_id AS id, d.n_chars, d.lang, d.source,
         CAST(l.quality AS INTEGER) AS quality,
         COALESCE(l.toxic = 1, FALSE) AS in_on,
         COALESCE(l.toxic = 0, FALSE) AS in_not
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def with_fixtures(body: str, *names: str) -> str:
    """``WITH f1 AS (...), f2 AS (...) <body>`` for the oracle queries."""
    parts = {"f1": F1_SQL, "f2": F2_SQL, "f3": F3_SQL, "f4": F4_SQL}
    ctes = ",".join(parts[n] for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
