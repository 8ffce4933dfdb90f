"""Association screen and feature governance on documents ⟕ labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, clean, govern
from ..session import materialize
from ..spec import ColumnSpec
from .profiling import rounded, sig_wrap
from .records import labelled_documents
from .tables import table

STUDY_SPECS = (
    ColumnSpec(name="lang", kind="categorical"),
    ColumnSpec(name="source", kind="categorical"),
    ColumnSpec(name="source_rare", kind="categorical"),
)
PREDICTORS = ("n_chars", "lang", "source", "toxic", "doc_bucket", "lang_text", "n_chars_sparse", "source_rare")
CONTINUOUS = ("n_chars", "n_chars_sparse")
LEAKAGE = ("toxic",)
MISSINGNESS = {"source_missing": "MNAR", "n_chars_missing": "STRUCTURAL pattern",
               "source_rare_missing": "Unclassifiable"}
REDUNDANCY = [("lang", "lang_text", "lang")]


def study_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed documents ⟕ labels with planted sparse columns and missing flags."""
    d = labelled_documents(spark, sf_dir)
    d = d.select(
        "*",
        (F.col("doc_id") % 7).alias("doc_bucket"),
        F.col("lang").alias("lang_text"),
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n_chars_sparse"),
        F.when(F.col("doc_id") % 10 == 0, F.col("source")).alias("source_rare"),
    )
    typed = clean.apply_schema(d, STUDY_SPECS)
    # every study stage reads this frame several times: cut the join lineage once
    return clean.missing_flags(materialize(typed, "study-frame"), exclude=("doc_id",))


def document_predictor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    return spark.createDataFrame(sorted(kinds.items()), "column string, inferred_type string")


PREDICTOR_TYPES_SQL = """
WITH j AS (
  SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), t AS (
  SELECT count(*) AS k FROM (
    SELECT toxic, count(*) AS n, sum(count(*)) OVER () AS tot FROM j WHERE toxic IS NOT NULL GROUP BY toxic)
  WHERE n >= tot * 0.01
), b AS (
  SELECT count(*) AS k FROM (
    SELECT doc_id % 7 AS v, count(*) AS n, sum(count(*)) OVER () AS tot FROM j GROUP BY 1) WHERE n >= tot * 0.01
)
SELECT * FROM (VALUES ('n_chars', 'continuous'), ('lang', 'categorical_nominal'), ('source', 'categorical_nominal'),
  ('lang_text', 'text'), ('n_chars_sparse', 'continuous'), ('source_rare', 'categorical_nominal')) v("column", inferred_type)
UNION ALL SELECT 'toxic', CASE WHEN k = 2 THEN 'binary' ELSE 'discrete' END FROM t
UNION ALL SELECT 'doc_bucket', CASE WHEN k = 2 THEN 'binary' ELSE 'discrete' END FROM b
"""


def _assoc(spark, sf_dir):
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    return assoc.associations(f, "quality", kinds, leakage_vars=LEAKAGE)


def document_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1–T6, T8 without the p-value columns (checked against SQL)."""
    return rounded(_assoc(spark, sf_dir).drop("p_value", "p_value_note"))


def document_associations_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 in full, with p-values (8 places) and their bands."""
    return rounded(_assoc(spark, sf_dir).withColumn("p_value", F.round("p_value", 8)))


_STUDY_SQL = """
WITH j AS (
  SELECT d.doc_id, d.lang, nullif(d.source, 'src3') AS source,
         CASE WHEN d.doc_id % 9 <> 4 THEN d.n_chars END AS n_chars, l.quality, l.toxic,
         d.doc_id % 7 AS doc_bucket, d.lang AS lang_text,
         CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 9 <> 4 THEN d.n_chars END AS n_chars_sparse,
         CASE WHEN d.doc_id % 10 = 0 THEN nullif(d.source, 'src3') END AS source_rare
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def _num_assoc_sql(col, kind):
    return f"""
SELECT 'quality' AS analysis_col, '{col}' AS predictor_col, 'binary' AS analysis_type, '{kind}' AS predictor_type,
  'predictor_target' AS pair_type, count_if({col} IS NOT NULL AND quality IS NOT NULL) AS n_used,
  count_if(quality IS NULL) AS analysis_excluded_n, count_if({col} IS NULL) AS predictor_missing_n,
  'ok' AS status, CAST(NULL AS VARCHAR) AS note, 'point_biserial' AS test_name,
  corr({col}, quality) AS test_stat, 'r' AS effect_size_name, corr({col}, quality) AS effect_size,
  {'true' if col in LEAKAGE else 'false'} AS leakage_flag
FROM j"""


def _chi_assoc_sql(col, kind):
    return f"""
SELECT 'quality' AS analysis_col, '{col}' AS predictor_col, 'binary' AS analysis_type, '{kind}' AS predictor_type,
  'predictor_target' AS pair_type, (SELECT count_if({col} IS NOT NULL AND quality IS NOT NULL) FROM j) AS n_used,
  (SELECT count_if(quality IS NULL) FROM j) AS analysis_excluded_n, (SELECT count_if({col} IS NULL) FROM j) AS predictor_missing_n,
  'ok' AS status, CAST(NULL AS VARCHAR) AS note, 'chi2' AS test_name, chi2 AS test_stat,
  'cramers_v' AS effect_size_name, sqrt(chi2 / (nn * (least(n_lv_y, n_lv_x) - 1))) AS effect_size,
  {'true' if col in LEAKAGE else 'false'} AS leakage_flag
FROM (
  SELECT sum(CASE WHEN n_lv_y = 2 AND n_lv_x = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE pow(o - e, 2) / e END) AS chi2,
         max(n_all) AS nn, max(n_lv_y) AS n_lv_y, max(n_lv_x) AS n_lv_x
  FROM (
    SELECT g.*, coalesce(c.n, 0) AS o, g.r * g.c * 1.0 / g.n_all AS e,
           count(DISTINCT g.y) OVER () AS n_lv_y, count(DISTINCT g.x) OVER () AS n_lv_x
    FROM (SELECT ys.y, xs.x, ys.r, xs.c, (SELECT sum(n) FROM cells) AS n_all
          FROM (SELECT y, sum(n) AS r FROM cells GROUP BY y) ys, (SELECT x, sum(n) AS c FROM cells GROUP BY x) xs) g
    LEFT JOIN cells c ON c.y = g.y AND c.x = g.x
  )
)"""


def _cells_cte(col):
    return (f"cells AS (SELECT CAST(quality AS VARCHAR) AS y, CAST({col} AS VARCHAR) AS x, count(*) AS n "
            f"FROM j WHERE quality IS NOT NULL AND {col} IS NOT NULL GROUP BY ALL)")


def _skip_sql(col, kind, note):
    return f"""
SELECT 'quality' AS analysis_col, '{col}' AS predictor_col, 'binary' AS analysis_type, '{kind}' AS predictor_type,
  'predictor_target' AS pair_type, count_if({col} IS NOT NULL AND quality IS NOT NULL) AS n_used,
  count_if(quality IS NULL) AS analysis_excluded_n, count_if({col} IS NULL) AS predictor_missing_n,
  'skipped' AS status, '{note}' AS note, CAST(NULL AS VARCHAR) AS test_name, CAST(NULL AS DOUBLE) AS test_stat,
  CAST(NULL AS VARCHAR) AS effect_size_name, CAST(NULL AS DOUBLE) AS effect_size, false AS leakage_flag
FROM j"""


def _assoc_sql():
    parts = [
        _STUDY_SQL + _num_assoc_sql("n_chars", "continuous"),
        _STUDY_SQL + _num_assoc_sql("doc_bucket", "discrete"),
        _STUDY_SQL + _num_assoc_sql("n_chars_sparse", "continuous"),
        _STUDY_SQL + ", " + _cells_cte("lang") + _chi_assoc_sql("lang", "categorical_nominal"),
        _STUDY_SQL + ", " + _cells_cte("source") + _chi_assoc_sql("source", "categorical_nominal"),
        _STUDY_SQL + ", " + _cells_cte("source_rare") + _chi_assoc_sql("source_rare", "categorical_nominal"),
        _STUDY_SQL + ", " + _cells_cte("toxic") + _chi_assoc_sql("toxic", "binary"),
        _STUDY_SQL + _skip_sql("lang_text", "text", "unsupported_predictor_type"),
    ]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) _a{i}" for i, p in enumerate(parts))


DOC_ASSOC_SQL = sig_wrap(_assoc_sql(), ["test_stat", "effect_size"])


def document_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    dec = govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY)
    return rounded(dec.drop("dtype", "position"))


DOC_DECISIONS_SQL = sig_wrap(_STUDY_SQL + """
, m AS (
  SELECT * FROM (VALUES
    ('doc_id', 'unknown', NULL, NULL, false), ('lang', 'categorical_nominal', NULL, NULL, false),
    ('source', 'categorical_nominal', 'MNAR', NULL, false), ('n_chars', 'continuous', 'STRUCTURAL pattern', NULL, false),
    ('quality', 'unknown', NULL, NULL, false), ('toxic', 'binary', NULL, NULL, true),
    ('doc_bucket', 'discrete', NULL, NULL, false), ('lang_text', 'text', NULL, 'lang', false),
    ('n_chars_sparse', 'continuous', NULL, NULL, false), ('source_rare', 'categorical_nominal', 'Unclassifiable', NULL, false)
  ) v(column_name, inferred_type, mt, keep_pref, is_leak)
), s AS (
  SELECT 'doc_id' AS column_name, avg(CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS missing_pct FROM j
  UNION ALL SELECT 'lang', avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'source', avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'n_chars', avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'quality', avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'toxic', avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'doc_bucket', avg(CASE WHEN doc_bucket IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'lang_text', avg(CASE WHEN lang_text IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'n_chars_sparse', avg(CASE WHEN n_chars_sparse IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
  UNION ALL SELECT 'source_rare', avg(CASE WHEN source_rare IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM j
), r AS (
  SELECT s.column_name, s.missing_pct, m.inferred_type, m.mt, m.keep_pref,
    CASE WHEN s.column_name = 'quality' THEN 'target' WHEN m.is_leak THEN 'leakage'
         WHEN m.inferred_type <> 'unknown' THEN 'predictor' WHEN s.column_name = 'row_id' THEN 'id' ELSE 'helper' END AS role
  FROM s JOIN m USING (column_name)
)
SELECT column_name, role, inferred_type, missing_pct,
  CASE WHEN keep_pref IS NOT NULL THEN 'redundant_with_' || keep_pref WHEN role = 'leakage' THEN 'leakage'
       WHEN missing_pct > 60 AND mt IN ('MNAR', 'Unclassifiable') THEN 'extreme_missing' ELSE '' END AS drop_reason,
  CASE WHEN keep_pref IS NOT NULL OR role = 'leakage' OR (missing_pct > 60 AND mt IN ('MNAR', 'Unclassifiable')) THEN 'drop' ELSE 'keep' END AS action,
  CASE WHEN missing_pct = 0 THEN 'no_missing' WHEN mt = 'STRUCTURAL pattern' THEN 'do_not_impute' WHEN mt = 'MNAR' THEN 'flag_only'
       WHEN missing_pct < 20 THEN 'simple_impute'
       WHEN missing_pct <= 60 THEN CASE WHEN inferred_type IN ('categorical_nominal', 'categorical_ordinal') THEN 'simple_impute' ELSE 'advanced_impute' END
       ELSE 'flag_only' END AS missing_action,
  nullif(concat_ws('; ',
    CASE WHEN mt IS NOT NULL THEN 'missingness_type=' || mt END,
    CASE WHEN mt = 'STRUCTURAL pattern' THEN 'Structural; encode Not Applicable / keep missing'
         WHEN mt = 'MNAR' THEN 'MNAR; keep missing flag and avoid heavy imputation' END,
    CASE WHEN missing_pct > 40 AND missing_pct <= 60 THEN 'high_missingness_flag_important' END,
    CASE WHEN role = 'leakage' THEN 'leakage_feature' WHEN missing_pct > 60 AND mt IN ('MNAR', 'Unclassifiable') THEN 'extreme_missingness' END,
    CASE WHEN keep_pref IS NOT NULL THEN 'redundant_with=' || keep_pref END,
    CASE WHEN role = 'id' THEN 'identifier_column' WHEN role = 'helper' THEN 'non_modeling_helper' END), '') AS notes
FROM r
""", ["missing_pct"])


def document_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    return govern.decision_summary(govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY))


def lineitem_price_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 (Pearson, continuous target) and the unsupported-pair / type skip rules."""
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    kinds = {"l_quantity": "continuous", "l_discount": "discrete", "l_returnflag": "categorical_nominal",
             "l_shipdate": "datetime"}
    return rounded(assoc.associations(li, "l_extendedprice", kinds).drop("p_value", "p_value_note"))


LINEITEM_PRICE_SQL = sig_wrap("""
SELECT 'l_extendedprice' AS analysis_col, p AS predictor_col, 'continuous' AS analysis_type, k AS predictor_type,
  'predictor_target' AS pair_type, (SELECT count(*) FROM lineitem) AS n_used, 0::BIGINT AS analysis_excluded_n,
  0::BIGINT AS predictor_missing_n, st AS status, note, tn AS test_name, r AS test_stat, en AS effect_size_name,
  r AS effect_size, false AS leakage_flag
FROM (
  SELECT 'l_quantity' AS p, 'continuous' AS k, 'ok' AS st, NULL AS note, 'pearsonr' AS tn,
         (SELECT corr(l_quantity, l_extendedprice) FROM lineitem) AS r, 'r' AS en
  UNION ALL SELECT 'l_discount', 'discrete', 'ok', NULL, 'pearsonr', (SELECT corr(l_discount, l_extendedprice) FROM lineitem), 'r'
  UNION ALL SELECT 'l_returnflag', 'categorical_nominal', 'skipped', 'unsupported_pair', NULL, NULL, NULL
  UNION ALL SELECT 'l_shipdate', 'datetime', 'skipped', 'unsupported_predictor_type', NULL, NULL, NULL
)
""", ["test_stat", "effect_size"])


DOC_DECISION_SUMMARY_SQL = None  # defined below from the decisions oracle


def _summary_sql():
    return ("SELECT action, drop_reason, count(*) AS n FROM (" + DOC_DECISIONS_SQL + ") d GROUP BY ALL")


DOC_DECISION_SUMMARY_SQL = _summary_sql()


def document_approved_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved predictors with their type, test route and the
    kind pair they form with the target."""
    from ..operators import infer
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    dec = govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY)
    target = govern.resolve_target(dec, f.columns)
    approved = govern.approved_predictors(dec, f.columns)
    f = govern.whitelist(f, target, approved, keep=("doc_id",))  # C10: project to what the screen may use
    rows = [(p, kinds[p], infer.predictor_kind(kinds[p]), target) for p in approved]
    t = spark.createDataFrame(rows, "predictor string, inferred_type string, test_route string, target string")
    return t.withColumn("pair_type", govern.pair_type(F.col("inferred_type"), F.lit("binary")))


APPROVED_SQL = """
SELECT * FROM (VALUES
  ('n_chars', 'continuous', 'numeric', 'quality', 'numberxbinary'),
  ('lang', 'categorical_nominal', 'categorical', 'quality', 'categoryxbinary'),
  ('source', 'categorical_nominal', 'categorical', 'quality', 'categoryxbinary'),
  ('n_chars_sparse', 'continuous', 'numeric', 'quality', 'numberxbinary')
) v(predictor, inferred_type, test_route, target, pair_type)
UNION ALL
SELECT 'doc_bucket', CASE WHEN k = 2 THEN 'binary' ELSE 'discrete' END, 'numeric', 'quality',
       CASE WHEN k = 2 THEN 'binaryxbinary' ELSE 'numberxbinary' END
FROM (SELECT count(*) AS k FROM (SELECT doc_id % 7 AS v, count(*) AS n, sum(count(*)) OVER () AS tot
      FROM documents GROUP BY 1) WHERE n >= tot * 0.01)
"""
