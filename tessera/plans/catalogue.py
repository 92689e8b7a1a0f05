"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each paired (where SQL can express it) with an
equivalent DuckDB query over the same driver tables.

Float outputs are rounded to 6 decimals (+0.0 to drop a negative zero) on
both sides; counts are BIGINT, labels INTEGER.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import summarize
from tessera.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tidy_frame(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double col_name (comparison hygiene)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) + 0.0"


# ------------------------------------------------------------------ summaries

F1_NUMERIC = ["num_a", "num_text", "num_b", "n_orders"]
F1_FLAGS = ["flag"]


def _f1_summary_sql(group: str, select_keys: str, where: str = "") -> str:
    cols = []
    for c in F1_NUMERIC:
        v = "TRY_CAST(num_text AS DOUBLE)" if c == "num_text" else f"CAST({c} AS DOUBLE)"
        cols.append(f"{r6(f'AVG({v})')} AS {c}_mean, {r6(f'MEDIAN({v})')} AS {c}_median")
    cols.append(f"{r6('AVG(CASE WHEN flag = 1 THEN 1.0 ELSE 0.0 END)')} AS flag_rate")
    return fx.with_fixtures(
        f"SELECT {select_keys}, CAST(COUNT(*) AS BIGINT) AS count, {', '.join(cols)} "
        f"FROM f1 WHERE cluster <> -1 {where} GROUP BY {group}", "f1")


@register("cluster_summary_by_segment", _f1_summary_sql("cluster, seg", "cluster, seg"))
def q_cluster_summary_by_segment(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(summarize.cluster_summary(f1, F1_NUMERIC, F1_FLAGS, segment_col="seg", levels="segment"))


@register("cluster_summary_overall", _f1_summary_sql("cluster", "cluster"))
def q_cluster_summary_overall(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(summarize.cluster_summary(f1, F1_NUMERIC, F1_FLAGS, segment_col="seg", levels="overall"))


@register("cluster_summary_grouping_sets", _f1_summary_sql(
    "GROUPING SETS ((cluster, seg), (cluster))", "cluster, seg, CAST(GROUPING(seg) AS INTEGER) AS is_overall"))
def q_cluster_summary_grouping_sets(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(summarize.cluster_summary(f1, F1_NUMERIC, F1_FLAGS, segment_col="seg", levels="both"))


def _report_sql() -> str:
    def fmt(x: str) -> str:
        return f"printf('%.2f', {x})"

    def fmt_nan(x: str) -> str:
        return f"COALESCE({fmt(x)}, 'nan')"

    num = [("num_a", "num_a"), ("num_text", "TRY_CAST(num_text AS DOUBLE)"),
           ("num_b", "num_b"), ("n_orders", "CAST(n_orders AS DOUBLE)")]
    med = ", ".join(f"MEDIAN({v}) AS {c}_median" for c, v in num)
    rate = "AVG(CASE WHEN flag = 1 THEN 1.0 ELSE 0.0 END) AS flag_rate"
    overall_line = " || ', ' || ".join(
        ["'n=' || CAST(cnt AS VARCHAR)"]
        + [f"'{c} median=' || {fmt_nan(f'{c}_median')}" for c, _ in num]
        + [f"'flag rate=' || {fmt_nan('flag_rate')}"])
    seg_parts = ["'seg=' || COALESCE(seg, 'nan')", "'n=' || CAST(cnt AS VARCHAR)"] + \
        [f"'{c} median=' || {fmt(f'{c}_median')}" for c, _ in num] + [f"'flag rate=' || {fmt('flag_rate')}"]
    seg_line = "concat_ws(', ', " + ", ".join(seg_parts) + ")"
    header = summarize.REPORT_HEADER
    header_rows = " UNION ALL ".join(
        f"SELECT CAST(NULL AS INTEGER) AS cluster, {i} AS line_no, '{t}' AS line" for i, t in enumerate(header))
    body = f"""
WITH s AS (
  SELECT cluster, seg, CAST(GROUPING(seg) AS INTEGER) AS is_overall, COUNT(*) AS cnt, {med}, {rate}
  FROM f1 WHERE cluster <> -1 GROUP BY GROUPING SETS ((cluster, seg), (cluster))
), segs AS (SELECT * FROM s WHERE is_overall = 0), ov AS (SELECT * FROM s WHERE is_overall = 1)
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(line_no AS INTEGER) AS line_no, line FROM (
  {header_rows}
  UNION ALL SELECT cluster, 0, '## Cluster ' || CAST(cluster AS VARCHAR) FROM ov
  UNION ALL SELECT cluster, 1, 'Overall: ' || {overall_line} FROM ov
  UNION ALL SELECT cluster, CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY seg ASC NULLS LAST) + 1 AS INTEGER),
                   '- ' || {seg_line} FROM segs
  UNION ALL SELECT cluster, CAST(COUNT(*) + 2 AS INTEGER), '' FROM segs GROUP BY cluster
) t"""
    return fx.with_fixtures(body, "f1")


@register("cluster_report_lines", _report_sql())
def q_cluster_report_lines(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return summarize.report_lines(f1, F1_NUMERIC, F1_FLAGS, segment_col="seg")


# ------------------------------------------------------------------ profile and roles

from tessera.operators import encode, profile  # noqa: E402

F3_CANDIDATES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "all_null", "with_nan"]
F3_TEXT = {"l_returnflag", "l_linestatus"}


def _f3_value(c: str) -> str:
    if c == "with_nan":
        return "CASE WHEN isnan(with_nan) THEN NULL ELSE with_nan END"
    return c


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(F3_CANDIDATES):
        kind = "categorical" if c in F3_TEXT else "numeric"
        v = _f3_value(c)
        parts.append(f"SELECT '{c}' AS col_name, '{kind}' AS kind, {i} AS pos, CAST(COUNT({v}) AS BIGINT) AS non_null, "
                     f"CAST(COUNT(DISTINCT {v}) AS BIGINT) AS n_unique FROM f3")
    return "prof AS (" + " UNION ALL ".join(parts) + ")"


def _ratio_sql() -> str:
    return "CASE WHEN non_null > 0 THEN CAST(n_unique AS DOUBLE) / non_null ELSE 1.0 END"


@register("column_profile", fx.with_fixtures(
    f"WITH {_profile_sql()} SELECT col_name, kind, non_null, n_unique, {r6(_ratio_sql())} AS ratio FROM prof", "f3"))
def q_column_profile(spark, sf_dir):
    f3 = fx.wide_table(spark, sf_dir)
    return tidy_frame(profile.column_profile(f3, F3_CANDIDATES + ["l_shipdate"]))


def _roles_sql(t: int, r: float) -> str:
    return fx.with_fixtures(f"""
WITH {_profile_sql()}, p AS (SELECT *, {_ratio_sql()} AS ratio FROM prof)
SELECT col_name,
       CASE WHEN kind = 'categorical' OR n_unique <= {t} OR (ratio <= {r} AND n_unique < non_null)
            THEN 'categorical' ELSE 'numeric' END AS role,
       (kind = 'numeric' AND (n_unique <= {t} OR (ratio <= {r} AND n_unique < non_null))) AS reclassified
FROM p WHERE non_null > 0""", "f3")


@register("nominal_roles", _roles_sql(5, 0.00005))
def q_nominal_roles(spark, sf_dir):
    f3 = fx.wide_table(spark, sf_dir)
    return profile.nominal_roles(profile.column_profile(f3, F3_CANDIDATES), 5, 0.00005)


@register("nominal_roles_doc_thresholds", _roles_sql(20, 0.05))
def q_nominal_roles_doc(spark, sf_dir):
    f3 = fx.wide_table(spark, sf_dir)
    return profile.nominal_roles(profile.column_profile(f3, F3_CANDIDATES), 20, 0.05)


# The requested-feature spec used on F1 (seg and flag play the forced categoricals).
F1_SPEC_FEATURES = ["num_a", "num_text", "num_b", "n_orders", "seg", "flag", "region", "not_there"]
F1_SPEC_NUMERIC = ["num_text", "num_b"]
F1_FORCED_CATS = ["seg", "flag"]


def f1_roles(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f1, profile.resolve_roles(f1, F1_SPEC_FEATURES, F1_SPEC_NUMERIC, F1_FORCED_CATS)


def _role_resolution_sql() -> str:
    feats = [("num_a", "numeric", "num_a"), ("num_text", "numeric", "TRY_CAST(num_text AS DOUBLE)"),
             ("num_b", "numeric", "num_b"), ("n_orders", "numeric", "n_orders"), ("seg", "categorical", "seg"),
             ("flag", "numeric", "flag"), ("region", "numeric", "region")]
    prof = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {i} AS spec_pos, '{k}' AS kind, COUNT({v}) AS nn, COUNT(DISTINCT {v}) AS nu FROM f1"
        for i, (c, k, v) in enumerate(feats))
    pnum = ", ".join(f"'{c}'" for c in F1_SPEC_NUMERIC)
    fcat = ", ".join(f"'{c}'" for c in F1_FORCED_CATS)
    return fx.with_fixtures(f"""
WITH prof AS ({prof}),
auto AS (
  SELECT *, CASE WHEN nn = 0 THEN NULL
                 WHEN col IN ({pnum}) THEN 'numeric'
                 WHEN kind = 'categorical' OR nu <= 5 OR (CAST(nu AS DOUBLE) / nn <= 0.00005 AND nu < nn) THEN 'categorical'
                 ELSE 'numeric' END AS auto_role,
            col IN ({fcat}) AS forced_cat
  FROM prof
),
num AS (
  SELECT col, 0 AS part, ROW_NUMBER() OVER (ORDER BY col) AS k FROM auto WHERE auto_role = 'numeric' AND NOT forced_cat
  UNION ALL
  SELECT col, 1, spec_pos FROM auto
  WHERE NOT forced_cat AND auto_role = 'categorical' AND kind = 'numeric' AND nn > 0
),
cat AS (SELECT col FROM auto WHERE auto_role = 'categorical' OR forced_cat)
SELECT 'numeric' AS role, CAST(ROW_NUMBER() OVER (ORDER BY part, k) - 1 AS INTEGER) AS position, col AS col_name FROM num
UNION ALL
SELECT 'categorical', CAST(ROW_NUMBER() OVER (ORDER BY col) - 1 AS INTEGER), col FROM cat""", "f1")


@register("role_resolution_with_spec", _role_resolution_sql())
def q_role_resolution(spark, sf_dir):
    _, roles = f1_roles(spark, sf_dir)
    return profile.roles_frame(roles)


@register("coerce_numeric", fx.with_fixtures(
    "SELECT id, num_text, TRY_CAST(num_text AS DOUBLE) AS num_text_value FROM f1", "f1"))
def q_coerce_numeric(spark, sf_dir):
    from tessera.functions.numeric import to_number

    f1 = fx.mixed_table(spark, sf_dir)
    return f1.select("id", "num_text", to_number(F.col("num_text"), T.StringType()).alias("num_text_value"))


# ------------------------------------------------------------------ encoding

F1_NUM_ROLE = ["n_orders", "num_a", "num_b", "num_text", "region"]
F1_CAT_ROLE = ["flag", "region", "seg"]


def _f1_numeric_unpivot() -> str:
    exprs = {"n_orders": "CAST(n_orders AS DOUBLE)", "num_a": "num_a", "num_b": "num_b",
             "num_text": "TRY_CAST(num_text AS DOUBLE)", "region": "CAST(region AS DOUBLE)"}
    return " UNION ALL ".join(f"SELECT id, '{c}' AS col_name, {exprs[c]} AS value FROM f1" for c in F1_NUM_ROLE)


@register("impute_median", fx.with_fixtures(
    f"WITH lg AS ({_f1_numeric_unpivot()}) SELECT col_name, {r6('MEDIAN(value)')} AS median FROM lg GROUP BY col_name",
    "f1"))
def q_impute_median(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(encode.column_medians(f1, F1_NUM_ROLE))


def _mode_sql(fixture: str, cols: list[tuple[str, bool]]) -> str:
    parts = []
    for c, is_num in cols:
        num = f"CAST({c} AS DOUBLE)" if is_num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value, {num} AS value_num "
                     f"FROM {fixture} WHERE {c} IS NOT NULL")
    return fx.with_fixtures(f"""
WITH lg AS ({' UNION ALL '.join(parts)}),
vc AS (SELECT col_name, value, value_num, COUNT(*) AS n FROM lg GROUP BY col_name, value, value_num),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col_name ORDER BY n DESC, value_num ASC NULLS LAST, value ASC) AS r FROM vc)
SELECT col_name, value AS mode_text, {r6('value_num')} AS mode_num, CAST(n AS BIGINT) AS mode_count FROM rk WHERE r = 1""",
                            fixture)


@register("impute_mode", _mode_sql("f1", [("flag", True), ("region", True), ("seg", False)]))
def q_impute_mode(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(encode.column_modes(f1, F1_CAT_ROLE))


@register("impute_mode_labels", _mode_sql("f4", [("quality", True), ("lang", False), ("source", False)]))
def q_impute_mode_labels(spark, sf_dir):
    f4 = fx.labelled_documents(spark, sf_dir)
    return tidy_frame(encode.column_modes(f4, ["quality", "lang", "source"]))


def _standardize_sql_cte() -> str:
    return f"""lg AS ({_f1_numeric_unpivot()}),
med AS (SELECT col_name, MEDIAN(value) AS median FROM lg GROUP BY col_name),
st AS (SELECT lg.col_name, ANY_VALUE(med.median) AS median, AVG(COALESCE(value, med.median)) AS mean,
              STDDEV_POP(COALESCE(value, med.median)) AS std
       FROM lg JOIN med ON lg.col_name = med.col_name GROUP BY lg.col_name)"""


@register("standardize", fx.with_fixtures(f"""
WITH {_standardize_sql_cte()}
SELECT col_name, {r6('median')} AS median, {r6('mean')} AS mean, {r6('std')} AS std,
       {r6('CASE WHEN std > 0 THEN std ELSE 1.0 END')} AS scale FROM st""", "f1"))
def q_standardize(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(encode.scaling_stats(f1, F1_NUM_ROLE, encode.column_medians(f1, F1_NUM_ROLE)))


def _vocab_sql_cte() -> str:
    parts = [f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS level, "
             f"{'CAST(' + c + ' AS DOUBLE)' if c != 'seg' else 'CAST(NULL AS DOUBLE)'} AS level_num FROM f1 "
             f"WHERE {c} IS NOT NULL" for c in F1_CAT_ROLE]
    return f"""vl AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})),
voc AS (SELECT col_name, level, level_num,
               CAST(ROW_NUMBER() OVER (PARTITION BY col_name ORDER BY level_num NULLS LAST, level) - 1 AS INTEGER) AS level_idx
        FROM vl)"""


@register("one_hot_long", fx.with_fixtures(f"""
WITH {_vocab_sql_cte()}
SELECT col_name, level_idx, level, {r6('level_num')} AS level_num FROM voc""", "f1"))
def q_one_hot_long(spark, sf_dir):
    f1 = fx.mixed_table(spark, sf_dir)
    return tidy_frame(encode.vocabulary(f1, F1_CAT_ROLE))


def _feature_matrix_sql() -> str:
    n_num = len(F1_NUM_ROLE)
    num_idx = " UNION ALL ".join(f"SELECT '{c}' AS col_name, {i} AS feature_idx" for i, c in enumerate(F1_NUM_ROLE))
    cat_pos = " UNION ALL ".join(f"SELECT '{c}' AS col_name, {i} AS cpos" for i, c in enumerate(F1_CAT_ROLE))
    mode_parts = []
    for c in F1_CAT_ROLE:
        num = f"CAST({c} AS DOUBLE)" if c != "seg" else "CAST(NULL AS DOUBLE)"
        mode_parts.append(f"SELECT id, '{c}' AS col_name, CAST({c} AS VARCHAR) AS level, {num} AS level_num FROM f1")
    return fx.with_fixtures(f"""
WITH {_standardize_sql_cte()}, {_vocab_sql_cte()},
nidx AS ({num_idx}),
sizes AS (SELECT col_name, COUNT(*) AS k FROM voc GROUP BY col_name),
cpos AS ({cat_pos}),
offs AS (SELECT c.col_name, {n_num} + COALESCE(SUM(s2.k), 0) AS off
         FROM cpos c LEFT JOIN cpos c2 ON c2.cpos < c.cpos LEFT JOIN sizes s2 ON s2.col_name = c2.col_name
         GROUP BY c.col_name),
clong AS ({' UNION ALL '.join(mode_parts)}),
cnt AS (SELECT col_name, level, level_num, COUNT(*) AS n FROM clong WHERE level IS NOT NULL GROUP BY ALL),
modes AS (SELECT col_name, level AS mode_level FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY col_name ORDER BY n DESC, level_num NULLS LAST, level) AS r FROM cnt)
          WHERE r = 1),
numf AS (SELECT lg.id, nidx.feature_idx, 'num__' || lg.col_name AS feature,
                (COALESCE(lg.value, st.median) - st.mean) / CASE WHEN st.std > 0 THEN st.std ELSE 1.0 END AS value
         FROM lg JOIN st ON lg.col_name = st.col_name JOIN nidx ON nidx.col_name = lg.col_name),
catf AS (SELECT cl.id, CAST(offs.off + voc.level_idx AS INTEGER) AS feature_idx,
                'cat__' || cl.col_name || '_' || voc.level AS feature, 1.0 AS value
         FROM clong cl JOIN modes m ON m.col_name = cl.col_name
         JOIN voc ON voc.col_name = cl.col_name AND voc.level = COALESCE(cl.level, m.mode_level)
         JOIN offs ON offs.col_name = cl.col_name)
SELECT id, CAST(feature_idx AS INTEGER) AS feature_idx, feature, {r6('value')} AS value FROM numf
UNION ALL SELECT id, feature_idx, feature, {r6('value')} FROM catf""", "f1")


def f1_encoded(spark, sf_dir):
    f1, roles = f1_roles(spark, sf_dir)
    model = encode.fit_encoder(f1, roles.numeric, roles.categorical)
    return f1, roles, model


@register("feature_matrix_long", _feature_matrix_sql())
def q_feature_matrix_long(spark, sf_dir):
    f1, _, model = f1_encoded(spark, sf_dir)
    long = encode.transform_long(f1, model)
    names = model.feature_names()
    return tidy_frame(long.join(F.broadcast(names), "feature_idx")  # names: one row per feature (width-bounded)
                      .select("id", "feature_idx", "feature", "value"))


# ------------------------------------------------------------------ status, membership, sampling

from tessera.operators import cover, neighbors, status  # noqa: E402
from tessera.sources.readers import id_map_from_sets, read_table  # noqa: E402


def f4_id_map(f4: DataFrame) -> DataFrame:
    return id_map_from_sets(f4.where("in_on").select("id"), f4.where("in_not").select("id"))


@register("status_coordinate", fx.with_fixtures(
    f"SELECT id, {r6('CASE WHEN in_not THEN 0.0 WHEN in_on THEN 1.0 ELSE 0.0 END')} AS emb_z FROM f4", "f4"))
def q_status_coordinate(spark, sf_dir):
    f4 = fx.labelled_documents(spark, sf_dir)
    return tidy_frame(status.status_coordinate(f4.select("id"), f4_id_map(f4), "id", 0.0).select("id", "emb_z"))


@register("membership_filter", fx.with_fixtures(
    "SELECT id, lang, source, n_chars FROM f4 WHERE id IN (SELECT id FROM f4 WHERE in_on)", "f4"))
def q_membership_filter(spark, sf_dir):
    f4 = fx.labelled_documents(spark, sf_dir)
    on_ids = f4_id_map(f4).where("in_on").select("id")
    return f4.select("id", "lang", "source", "n_chars").join(on_ids, "id", "left_semi")


def _sample_sql(n: int) -> str:
    return (f"SELECT o_orderkey, o_custkey, {r6('o_totalprice')} AS o_totalprice FROM orders "
            f"ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT {n}")


def _sample(spark, sf_dir, n):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tidy_frame(status.exact_sample(o, n, 42, "o_orderkey"))


@register("exact_sample", _sample_sql(60000))
def q_exact_sample(spark, sf_dir):
    """The modelled row cap (60,000) as an exact seeded sample."""
    return _sample(spark, sf_dir, 60000)


@register("exact_sample_5000", _sample_sql(5000))
def q_exact_sample_5000(spark, sf_dir):
    return _sample(spark, sf_dir, 5000)


# ------------------------------------------------------------------ geometry (F2)

XYZ3 = ("x", "y", "z")
COVER_EPS = 0.2  # the modelled default radius


def _d2(a: str, b: str) -> str:
    return f"({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z)"


@register("ball_pairs", fx.with_fixtures(f"""
SELECT a.id AS id_a, b.id AS id_b, {r6('SQRT(' + _d2('a', 'b') + ')')} AS dist
FROM f2 a JOIN f2 b ON a.id < b.id
WHERE {_d2('a', 'b')} <= CAST('{0.1 * 0.1!r}' AS DOUBLE)""", "f2"))
def q_ball_pairs(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    bp = neighbors.ball_pairs(f2.select("id", *XYZ3), 0.1, XYZ3, "id")
    return tidy_frame(bp.select("id_a", "id_b", F.sqrt("d2").alias("dist")))


def _nearest_sql(scope: bool) -> str:
    cond = "AND q.cluster = p.cluster" if scope else ""
    return fx.with_fixtures(f"""
WITH nn AS (
  SELECT p.id AS probe_id, p.cluster, q.id AS match_id, {_d2('p', 'q')} AS d2,
         ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY {_d2('p', 'q')}, q.id) AS r
  FROM f2 p JOIN f2 q ON q.in_not {cond}
  WHERE p.in_on AND p.cluster <> -1)
SELECT probe_id, cluster, match_id, {r6('SQRT(d2)')} AS dist FROM nn WHERE r = 1""", "f2")


def _nearest(spark, sf_dir, scope: bool):
    f2 = fx.points(spark, sf_dir)
    probes = f2.where("in_on AND cluster <> -1").select("id", "cluster", *XYZ3)
    cands = f2.where("in_not").select("id", "cluster", *XYZ3)
    part = ("cluster",) if scope else ()
    res = neighbors.knn(probes, cands, 1, XYZ3, "id", part)
    if not scope:
        res = res.join(probes.select(F.col("id").alias("probe_id"), "cluster"), "probe_id")
    return tidy_frame(res.select("probe_id", "cluster", "match_id", "dist"))


@register("nearest_in_cluster", _nearest_sql(True))
def q_nearest_in_cluster(spark, sf_dir):
    return _nearest(spark, sf_dir, True)


@register("nearest_global", _nearest_sql(False))
def q_nearest_global(spark, sf_dir):
    return _nearest(spark, sf_dir, False)


def _cover_ctes(eps: float, scope: bool) -> str:
    """Sequential scan of each cluster's on-points in id order (recursive CTE)."""
    if scope:
        filt = "AND cluster IN (SELECT cluster FROM f2 WHERE in_not AND cluster <> -1)"
    else:
        filt = "AND EXISTS (SELECT 1 FROM f2 WHERE in_not)"
    return f"""onp AS (
  SELECT cluster, id, x, y, z, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY id) AS rk
  FROM f2 WHERE in_on AND cluster <> -1 {filt}),
walk AS (
  SELECT cluster, rk, [{{'id': id, 'x': x, 'y': y, 'z': z}}] AS cs FROM onp WHERE rk = 1
  UNION ALL
  SELECT w.cluster, p.rk,
         CASE WHEN len(list_filter(w.cs, lambda c: {_d2('c', 'p')} <= CAST('{eps * eps!r}' AS DOUBLE))) = 0
              THEN list_append(w.cs, {{'id': p.id, 'x': p.x, 'y': p.y, 'z': p.z}}) ELSE w.cs END
  FROM walk w JOIN onp p ON p.cluster = w.cluster AND p.rk = w.rk + 1),
lastrk AS (SELECT cluster, MAX(rk) AS mr FROM onp GROUP BY cluster),
fin AS (SELECT w.cluster, w.cs FROM walk w JOIN lastrk l ON w.cluster = l.cluster AND w.rk = l.mr),
unn AS (SELECT cluster, UNNEST(range(1, len(cs) + 1)) AS center_rank, UNNEST(cs) AS c FROM fin),
cen AS (SELECT cluster, CAST(center_rank AS INTEGER) AS center_rank, c.id AS id, c.x AS x, c.y AS y, c.z AS z FROM unn),
nn AS (
  SELECT c.cluster, c.center_rank, c.id AS center_id, q.id AS match_id, q.x AS mx, q.y AS my, q.z AS mz,
         SQRT({_d2('c', 'q')}) AS dist,
         ROW_NUMBER() OVER (PARTITION BY c.cluster, c.center_rank ORDER BY {_d2('c', 'q')}, q.id) AS r
  FROM cen c JOIN f2 q ON q.in_not {"AND q.cluster = c.cluster" if scope else ""}),
matched AS (SELECT * FROM nn WHERE r = 1),
firsts AS (SELECT cluster, match_id, MIN(center_rank) AS fr FROM matched GROUP BY cluster, match_id),
sel AS (SELECT cluster, CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY fr, match_id) AS INTEGER) AS rank,
               match_id AS id FROM firsts),
flat AS (SELECT id, CAST(ROW_NUMBER() OVER (ORDER BY cluster, rank) AS INTEGER) AS sel_order FROM (
           SELECT id, cluster, rank, ROW_NUMBER() OVER (PARTITION BY id ORDER BY cluster, rank) AS k FROM sel)
         WHERE k = 1)"""


def _cover_sql(select: str, eps: float = COVER_EPS, scope: bool = False) -> str:
    return fx.with_fixtures(f"WITH RECURSIVE {_cover_ctes(eps, scope)}\n{select}", "f2")


def _f2_cover(spark, sf_dir, eps: float = COVER_EPS, scope: bool = False):
    f2 = fx.points(spark, sf_dir)
    centres, matches = cover.cover_and_match(f2, eps, XYZ3, "id", "cluster", use_cluster_scope=scope)
    return f2, centres, matches


@register("epsilon_cover", _cover_sql("SELECT cluster, center_rank, id FROM cen"))
def q_epsilon_cover(spark, sf_dir):
    _, centres, _ = _f2_cover(spark, sf_dir)
    return centres.select("cluster", "center_rank", "id")


@register("epsilon_cover_eps01", _cover_sql("SELECT cluster, center_rank, id FROM cen", 0.1))
def q_epsilon_cover_eps01(spark, sf_dir):
    _, centres, _ = _f2_cover(spark, sf_dir, 0.1)
    return centres.select("cluster", "center_rank", "id")


@register("cover_sizes", _cover_sql("""
SELECT a.cluster, CAST(COUNT(*) FILTER (WHERE a.in_on) AS BIGINT) AS n_on,
       CAST((SELECT COUNT(*) FROM f2 WHERE in_not) AS BIGINT) AS n_candidates,
       CAST(COALESCE(ANY_VALUE(k.n), 0) AS BIGINT) AS n_centers
FROM f2 a LEFT JOIN (SELECT cluster, COUNT(*) AS n FROM cen GROUP BY cluster) k ON a.cluster = k.cluster
GROUP BY a.cluster"""))
def q_cover_sizes(spark, sf_dir):
    f2, centres, _ = _f2_cover(spark, sf_dir)
    return cover.cover_sizes(f2, centres)


_SEL_SQL = """
SELECT cluster, rank, id FROM sel
UNION ALL
SELECT DISTINCT cluster, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT) FROM f2
WHERE cluster NOT IN (SELECT cluster FROM sel)"""


@register("epsilon_selection", _cover_sql(_SEL_SQL))
def q_epsilon_selection(spark, sf_dir):
    f2, _, matches = _f2_cover(spark, sf_dir)
    return cover.selection(matches, f2.select("cluster").distinct())


@register("epsilon_selection_in_cluster", _cover_sql(_SEL_SQL, scope=True))
def q_epsilon_selection_in_cluster(spark, sf_dir):
    f2, _, matches = _f2_cover(spark, sf_dir, scope=True)
    return cover.selection(matches, f2.select("cluster").distinct())


@register("selected_rows", _cover_sql(
    "SELECT f.id, f.sel_order, p.cluster, p.x, p.y, p.z FROM flat f JOIN f2 p ON p.id = f.id"))
def q_selected_rows(spark, sf_dir):
    f2, _, matches = _f2_cover(spark, sf_dir)
    sel = cover.selection(matches, f2.select("cluster").distinct())
    return cover.selected_rows(f2, sel, ["cluster", *XYZ3])


@register("selected_rows_original", _cover_sql(
    f"SELECT f.id, f.sel_order, {r6('p.orig_a')} AS orig_a, {r6('p.orig_b')} AS orig_b FROM flat f JOIN f2 p ON p.id = f.id"))
def q_selected_rows_original(spark, sf_dir):
    f2, _, matches = _f2_cover(spark, sf_dir)
    sel = cover.selection(matches, f2.select("cluster").distinct())
    return tidy_frame(cover.selected_rows(f2, sel, ["orig_a", "orig_b"]))


@register("plot_layer_points", fx.with_fixtures("SELECT id, cluster, x, y, z FROM f2 WHERE cluster <> -1", "f2"))
def q_plot_layer_points(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    from tessera.operators.summarize import drop_noise

    return drop_noise(f2).select("id", "cluster", *XYZ3)


@register("scatter_original", fx.with_fixtures(
    f"SELECT CAST(id AS VARCHAR) AS label, cluster, {r6('orig_a')} AS orig_a, {r6('orig_b')} AS orig_b FROM f2 WHERE cluster <> -1", "f2"))
def q_scatter_original(spark, sf_dir):
    """The original numeric dimensions with the id as text (a missing and an array column are left out)."""
    return tidy_frame(cover.scatter_table(fx.points(spark, sf_dir), ["orig_a", "vec", "nowhere", "orig_b"]))


@register("plot_layer_centers", _cover_sql("SELECT cluster, center_rank, id, x, y, z FROM cen"))
def q_plot_layer_centers(spark, sf_dir):
    return cover.plot_layers(*_f2_cover(spark, sf_dir), XYZ3)["centers"]


@register("plot_layer_segments", _cover_sql(f"""
SELECT m.cluster, m.center_rank, m.center_id, m.match_id, c.x AS cx, c.y AS cy, c.z AS cz,
       m.mx, m.my, m.mz, {r6('m.dist')} AS dist
FROM matched m JOIN cen c ON c.cluster = m.cluster AND c.center_rank = m.center_rank"""))
def q_plot_layer_segments(spark, sf_dir):
    return tidy_frame(cover.plot_layers(*_f2_cover(spark, sf_dir), XYZ3)["segments"])


@register("plot_layer_halos", _cover_sql("""
SELECT cluster, center_rank, id, x, y, z, COUNT(*) OVER (PARTITION BY cluster) AS n_centers FROM cen"""))
def q_plot_layer_halos(spark, sf_dir):
    """Every centre with its cluster's number of centres; what to draw is the reader's choice."""
    return cover.plot_layers(*_f2_cover(spark, sf_dir), XYZ3)["halos"]


# ------------------------------------------------------------------ reduction, k-means, metrics

from tessera.operators import cluster as kmeans_ops  # noqa: E402
from tessera.operators import evaluate, reduce  # noqa: E402


@register("feature_covariance", fx.with_fixtures(f"""
WITH u AS (SELECT id, UNNEST(range(0, len(vec))) AS i, UNNEST(vec) AS v FROM f2)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {r6('COVAR_SAMP(a.v, b.v)')} AS cov
FROM u a JOIN u b ON a.id = b.id GROUP BY a.i, b.i""", "f2"))
def q_feature_covariance(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    return tidy_frame(reduce.covariance_long(f2, "vec"))


@register("pca_2d")
def q_pca_2d(spark, sf_dir):
    """M3 on the 64-d vectors (checked against NumPy in tests)."""
    f2 = fx.points(spark, sf_dir)
    model = reduce.fit_pca(f2, 2, "vec")
    return tidy_frame(model.transform(f2.select("id", "vec"), "vec").select("id", "emb_x", "emb_y"))


@register("kmeans_labels")
def q_kmeans_labels(spark, sf_dir):
    """M5: best of 10 MLlib k-means fits on the 2-D (x, y) points."""
    f2 = fx.points(spark, sf_dir).select("id", F.col("x").alias("emb_x"), F.col("y").alias("emb_y"))
    labelled, _, _ = kmeans_ops.kmeans_labels(f2, k=8, seed=42)
    return labelled.select("id", "cluster")


@register("kmeans_fixed_point", fx.with_fixtures("""
SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_not_nearest, CAST(0 AS BIGINT) AS n_off_mean FROM f2""", "f2"))
def q_kmeans_fixed_point(spark, sf_dir):
    """M5: rows that are not at their nearest centre, and centres away from the mean of their rows (both none)."""
    f2 = fx.points(spark, sf_dir).select("id", F.col("x").alias("emb_x"), F.col("y").alias("emb_y"))
    labelled, centres, _ = kmeans_ops.kmeans_labels(f2, k=8, seed=42, tol=0.0)
    away = kmeans_ops.distances_to(centres, ("emb_x", "emb_y"))
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
    means = labelled.groupBy("cluster").agg(F.avg("emb_x").alias("x"), F.avg("emb_y").alias("y")).withColumn("c", F.element_at(table, F.col("cluster") + 1))
    off = means.where((F.abs(F.col("x") - F.col("c")[0]) > 1e-9) | (F.abs(F.col("y") - F.col("c")[1]) > 1e-9)).count()
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.element_at(away, F.col("cluster") + 1) > F.array_min(away)).alias("n_not_nearest"),
                        F.lit(off).cast("long").alias("n_off_mean"))


@register("noise_stats", fx.with_fixtures(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) FILTER (WHERE cluster = -1) AS BIGINT) AS n_noise,
       {r6('CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE cluster = -1) / COUNT(*) ELSE 0.0 END')} AS noise_ratio,
       CAST(COUNT(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS n_clusters,
       CAST(COUNT(DISTINCT cluster) AS BIGINT) AS n_labels
FROM f2""", "f2"))
def q_noise_stats(spark, sf_dir):
    return tidy_frame(evaluate.noise_stats(fx.points(spark, sf_dir)))


@register("davies_bouldin", fx.with_fixtures(f"""
WITH c AS (SELECT cluster, AVG(x) AS cx, AVG(y) AS cy FROM f2 GROUP BY cluster),
s AS (SELECT f.cluster, AVG(SQRT((f.x - c.cx) * (f.x - c.cx) + (f.y - c.cy) * (f.y - c.cy))) AS s
      FROM f2 f JOIN c ON f.cluster = c.cluster GROUP BY f.cluster),
pr AS (SELECT a.cluster, MAX((sa.s + sb.s) / SQRT((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS r
       FROM c a JOIN c b ON a.cluster <> b.cluster
       JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY a.cluster)
SELECT {r6('AVG(r)')} AS davies_bouldin, CAST(COUNT(*) AS BIGINT) AS n_clusters FROM pr""", "f2"))
def q_davies_bouldin(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    db = evaluate.davies_bouldin(f2, ("x", "y"))
    k = f2.select("cluster").distinct().count()
    return tidy_frame(spark.createDataFrame([(db, k)], "davies_bouldin double, n_clusters long"))


@register("silhouette", fx.with_fixtures(f"""
WITH d AS (SELECT a.id, a.cluster AS ca, b.cluster AS cb,
                  SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
           FROM f2 a JOIN f2 b ON a.id <> b.id),
m AS (SELECT id, ca, cb, AVG(dist) AS md FROM d GROUP BY id, ca, cb),
sz AS (SELECT cluster, COUNT(*) AS n FROM f2 GROUP BY cluster),
ab AS (SELECT id, ca, MAX(CASE WHEN cb = ca THEN md END) AS a, MIN(CASE WHEN cb <> ca THEN md END) AS b
       FROM m GROUP BY id, ca),
s AS (SELECT CASE WHEN sz.n = 1 THEN 0.0 ELSE (b - a) / GREATEST(a, b) END AS s FROM ab JOIN sz ON sz.cluster = ab.ca)
SELECT {r6('AVG(s)')} AS silhouette, CAST(COUNT(*) AS BIGINT) AS n_used FROM s""", "f2"))
def q_silhouette(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    s, n = evaluate.silhouette(f2, ("x", "y"))
    return tidy_frame(spark.createDataFrame([(s, n)], "silhouette double, n_used long"))


def _tree_edges(f2: DataFrame) -> DataFrame:
    """A given spanning path: id -> id + 1, weighted by the (x, y) distance."""
    a = f2.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = f2.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return a.join(b, F.col("v") == F.col("u") + 1).select(
        "u", "v", F.sqrt(sq_dist_cols(("ux", "uy"), ("vx", "vy"))).alias("w"))


def sq_dist_cols(a, b):
    from tessera.functions.numeric import sq_dist

    return sq_dist([F.col(c) for c in a], [F.col(c) for c in b])


@register("relative_validity_of_tree", fx.with_fixtures(f"""
WITH e AS (SELECT a.cluster AS lu, b.cluster AS lv,
                  SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w
           FROM f2 a JOIN f2 b ON b.id = a.id + 1),
g AS (SELECT MAX(w) AS max_w, MIN(CASE WHEN (lu = -1) <> (lv = -1) THEN w END) AS min_out FROM e),
sizes AS (SELECT cluster AS c, COUNT(*) AS size FROM f2 GROUP BY cluster),
k AS (SELECT COUNT(*) AS nc FROM sizes WHERE c <> -1),
corr AS (SELECT 2.0 * CASE WHEN k.nc > 1 THEN g.max_w ELSE COALESCE(g.min_out, g.max_w) END AS cval FROM g, k),
inside AS (SELECT lu AS c, MAX(w) AS dsc FROM e WHERE lu = lv AND lu <> -1 GROUP BY lu),
btw AS (SELECT lu AS c, w FROM e WHERE lu <> lv AND lu <> -1 AND lv <> -1
        UNION ALL SELECT lv, w FROM e WHERE lu <> lv AND lu <> -1 AND lv <> -1),
sep AS (SELECT c, MIN(w) AS dspc FROM btw GROUP BY c),
per AS (SELECT s.size, COALESCE(i.dsc, 0.0) AS dsc, COALESCE(p.dspc, corr.cval) AS dspc
        FROM sizes s CROSS JOIN corr LEFT JOIN inside i ON i.c = s.c LEFT JOIN sep p ON p.c = s.c WHERE s.c <> -1)
SELECT {r6('SUM(size * (dspc - dsc) / GREATEST(dspc, dsc)) / (SELECT SUM(size) FROM sizes)')} AS relative_validity
FROM per""", "f2"))
def q_relative_validity_of_tree(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    score = evaluate.relative_validity(_tree_edges(f2), f2.select("id", "cluster"))
    return tidy_frame(spark.createDataFrame([(score,)], "relative_validity double"))


# ------------------------------------------------------------------ density chain

from tessera.operators import density  # noqa: E402

MIN_SAMPLES = 3  # the modelled default


def _f2_xy(spark, sf_dir):
    return fx.points(spark, sf_dir).select("id", "cluster", F.col("x").alias("emb_x"), F.col("y").alias("emb_y"))


def _knn2_sql() -> str:
    # order by the squared distance like the grid join, ties by id
    return """
d AS (SELECT a.id AS u, b.id AS v, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
      FROM f2 a JOIN f2 b ON a.id <> b.id),
r AS (SELECT u, v, SQRT(d2) AS dist, ROW_NUMBER() OVER (PARTITION BY u ORDER BY d2, v) AS k FROM d)"""


@register("core_distance", fx.with_fixtures(
    f"WITH {_knn2_sql()} SELECT u AS id, {r6('dist')} AS core_dist FROM r WHERE k = {MIN_SAMPLES}", "f2"))
def q_core_distance(spark, sf_dir):
    return tidy_frame(density.core_distances(_f2_xy(spark, sf_dir), MIN_SAMPLES))


@register("mutual_reachability", fx.with_fixtures(f"""
WITH {_knn2_sql()}, core AS (SELECT u AS id, dist AS core FROM r WHERE k = {MIN_SAMPLES})
SELECT r.u, r.v, {r6('r.dist')} AS dist, {r6('GREATEST(cu.core, cv.core, r.dist)')} AS mreach
FROM r JOIN core cu ON cu.id = r.u JOIN core cv ON cv.id = r.v WHERE r.k <= {MIN_SAMPLES}""", "f2"))
def q_mutual_reachability(spark, sf_dir):
    return tidy_frame(density.mutual_reachability(_f2_xy(spark, sf_dir), MIN_SAMPLES))


# ------------------------------------------------------------------ neighbour graph (64-d)

from tessera.operators import layout  # noqa: E402

UMAP_NEIGHBORS = 15  # the modelled default; the neighbourhood counts the point itself


def _knn64_cte() -> str:
    return f"""
d AS (SELECT a.id AS u, b.id AS v, list_distance(a.vec, b.vec) AS dist FROM f2 a JOIN f2 b ON a.id <> b.id),
r AS (SELECT u, v, dist, ROW_NUMBER() OVER (PARTITION BY u ORDER BY dist, v) AS rank FROM d
      QUALIFY rank <= {UMAP_NEIGHBORS - 1})"""


@register("knn_graph", fx.with_fixtures(
    f"WITH {_knn64_cte()} SELECT u, CAST(rank AS INTEGER) AS rank, v, {r6('dist')} AS dist FROM r", "f2"))
def q_knn_graph(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    return tidy_frame(layout.knn_graph(f2.select("id", "vec"), UMAP_NEIGHBORS - 1, "vec", "id"))


@register("fuzzy_graph", fx.with_fixtures(f"""
WITH RECURSIVE {_knn64_cte()},
nb AS (SELECT u, list(dist ORDER BY rank) AS ds FROM r GROUP BY u),
rr AS (SELECT u, ds, COALESCE(list_filter(ds, lambda x: x > 0)[1], 0.0) AS rho FROM nb),
bis AS (
  SELECT u, 0 AS it, CAST(0.0 AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, CAST(1.0 AS DOUBLE) AS mid, FALSE AS done
  FROM rr
  UNION ALL
  SELECT u, it + 1,
         CASE WHEN done OR abs(ps - tgt) < 1e-5 THEN lo WHEN ps > tgt THEN lo ELSE mid END,
         CASE WHEN done OR abs(ps - tgt) < 1e-5 THEN hi WHEN ps > tgt THEN mid ELSE hi END,
         CASE WHEN done OR abs(ps - tgt) < 1e-5 THEN mid
              WHEN ps > tgt THEN (lo + mid) / 2
              WHEN hi = CAST('inf' AS DOUBLE) THEN mid * 2 ELSE (mid + hi) / 2 END,
         done OR abs(ps - tgt) < 1e-5
  FROM (SELECT b.u, b.it, b.lo, b.hi, b.mid, b.done, log2({UMAP_NEIGHBORS}) AS tgt,
               list_sum(list_transform(rr.ds, lambda x: CASE WHEN x - rr.rho > 0 THEN exp(-((x - rr.rho) / b.mid))
                                                       ELSE 1.0 END)) AS ps
        FROM bis b JOIN rr ON rr.u = b.u) s
  WHERE it < 64
),
sig AS (SELECT b.u, rr.rho,
               GREATEST(b.mid, 1e-3 * CASE WHEN rr.rho > 0 THEN list_sum(rr.ds) / {UMAP_NEIGHBORS}
                    ELSE (SELECT SUM(list_sum(ds)) / (COUNT(*) * {UMAP_NEIGHBORS}) FROM rr) END) AS sigma
        FROM bis b JOIN rr ON rr.u = b.u WHERE b.it = 64),
dw AS (SELECT r.u, r.v, exp(-GREATEST(r.dist - s.rho, 0.0) / s.sigma) AS w FROM r JOIN sig s ON s.u = r.u),
pr AS (SELECT LEAST(u, v) AS a, GREATEST(u, v) AS b, MAX(CASE WHEN u < v THEN w END) AS x,
              MAX(CASE WHEN u > v THEN w END) AS y FROM dw GROUP BY 1, 2)
SELECT a AS u, b AS v, {r6('COALESCE(x, 0.0) + COALESCE(y, 0.0) - COALESCE(x, 0.0) * COALESCE(y, 0.0)')} AS weight
FROM pr""", "f2"))
def q_fuzzy_graph(spark, sf_dir):
    f2 = fx.points(spark, sf_dir)
    g = layout.knn_graph(f2.select("id", "vec"), UMAP_NEIGHBORS - 1, "vec", "id")
    return tidy_frame(layout.fuzzy_graph(g, UMAP_NEIGHBORS))


# ------------------------------------------------------------------ spanning tree and density clusters

def _f2_tree(spark, sf_dir, min_samples: int, metric: str) -> DataFrame:
    """The spanning tree over F2, built anew for every query."""
    from tessera.functions.persist import cut

    return cut(density.mst_edges(_f2_xy(spark, sf_dir), min_samples, metric=metric))


# Prim from the smallest id, one point a step: ``open`` holds the points outside with their lightest edge to the tree.
@register("mst_edges", fx.with_fixtures(f"""
WITH RECURSIVE {_knn2_sql()}, core AS (SELECT u AS id, dist AS core FROM r WHERE k = {MIN_SAMPLES}),
pt AS MATERIALIZED (SELECT f2.id, f2.x, f2.y, core.core FROM f2 JOIN core ON core.id = f2.id),
e AS MATERIALIZED (
  SELECT a.id AS p, b.id AS q, {{'w': GREATEST(a.core, b.core, SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))),
                                'lo': LEAST(a.id, b.id), 'hi': GREATEST(a.id, b.id)}} AS k
  FROM pt a JOIN pt b ON a.id <> b.id),
open AS (
  SELECT 0 AS step, q AS id, k FROM e WHERE p = (SELECT MIN(id) FROM pt)
  UNION ALL
  SELECT s.step + 1, s.id, CASE WHEN e.k < s.k THEN e.k ELSE s.k END
  FROM (SELECT *, FIRST_VALUE(id) OVER (ORDER BY k) AS nxt FROM open) s JOIN e ON e.p = s.nxt AND e.q = s.id
  WHERE s.id <> s.nxt)
SELECT k.lo AS u, k.hi AS v, {r6('k.w')} AS w FROM (SELECT step, MIN(k) AS k FROM open GROUP BY step)""", "f2"))
def q_mst_edges(spark, sf_dir):
    """N - 1 edges."""
    return tidy_frame(_f2_tree(spark, sf_dir, MIN_SAMPLES, "euclidean"))


def _density(spark, sf_dir, mcs, ms, method, eps, metric, limit=density.LIMIT):
    pts = _f2_xy(spark, sf_dir).select("id", "emb_x", "emb_y")
    tree = _f2_tree(spark, sf_dir, ms, metric)
    condensed = density.condensed_tree(tree, pts, mcs, limit)
    return density.label_points(condensed, density.select_clusters(condensed, method, eps), pts), tree


@register("density_clusters_eom")
def q_density_eom(spark, sf_dir):
    return _density(spark, sf_dir, 20, MIN_SAMPLES, "eom", 0.0, "euclidean")[0].select("id", "cluster")


@register("density_clusters_leaf")
def q_density_leaf(spark, sf_dir):
    return _density(spark, sf_dir, 20, MIN_SAMPLES, "leaf", 0.0, "euclidean")[0].select("id", "cluster")


@register("density_clusters_epsilon")
def q_density_epsilon(spark, sf_dir):
    """The modelled final configuration: min_cluster_size 60, min_samples 1, eom, epsilon 0.06."""
    return _density(spark, sf_dir, 60, 1, "eom", 0.06, "euclidean")[0].select("id", "cluster")


@register("density_clusters_manhattan")
def q_density_manhattan(spark, sf_dir):
    return _density(spark, sf_dir, 20, MIN_SAMPLES, "eom", 0.0, "manhattan")[0].select("id", "cluster")


@register("density_clusters_cosine")
def q_density_cosine(spark, sf_dir):
    return _density(spark, sf_dir, 20, MIN_SAMPLES, "eom", 0.0, "cosine")[0].select("id", "cluster")


@register("relative_validity")
def q_relative_validity(spark, sf_dir):
    labels, tree = _density(spark, sf_dir, 20, MIN_SAMPLES, "eom", 0.0, "euclidean")
    score = evaluate.relative_validity(tree, labels.select("id", "cluster"))
    return tidy_frame(spark.createDataFrame([(score,)], "relative_validity double"))


# ------------------------------------------------------------------ run records

@register("run_metrics")
def q_run_metrics(spark, sf_dir):
    """One run record (long form) for a density run over F2."""
    from tessera.plans import sweep

    labels, tree = _density(spark, sf_dir, 20, MIN_SAMPLES, "eom", 0.0, "euclidean")
    params = {"clusterer": "hdbscan", "hdb_min_cluster_size": 20, "hdb_min_samples": MIN_SAMPLES,
              "hdb_cluster_selection_method": "eom", "hdb_cluster_selection_epsilon": 0.0}
    rec = sweep.run_record("fixture-f2", params, sweep.hdbscan_metrics(labels, tree), "f2-eom")
    df = spark.createDataFrame([rec], sweep.RUN_SCHEMA)
    return tidy_frame(df.select("experiment", "run_name", F.explode("metrics").alias("metric", "value")))


@register("umap_2d")
def q_umap_2d(spark, sf_dir):
    """M4: exact k-NN graph -> fuzzy graph -> layout epochs (the default number) over the 64-d vectors (rows-only)."""
    f2 = fx.points(spark, sf_dir).select("id", "vec")
    emb = layout.umap_embed(f2, "vec", "id", n_neighbors=UMAP_NEIGHBORS, min_dist=0.1, seed=42)
    return tidy_frame(emb.select("id", "emb_x", "emb_y"))
