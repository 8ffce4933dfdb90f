"""Studies of parts that other studies use without showing them: metadata, fallbacks, summaries, previews, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import govern, impute, profile
from ..sources import ingest
from .cleaning import _part_of, _party_files
from .modelling import _decisions, scored_metrics
from .profiling import rounded, sig_wrap
from .records import QUALITY_TASK, labelled_documents
from .screening import APPROVED_SQL, DOC_ASSOC_SQL, DOC_DECISIONS_SQL, study_frame
from .tables import table


def document_task_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task's metadata beside its target: rows, positives and negatives as encoded."""
    base = labelled_documents(spark, sf_dir)
    meta = QUALITY_TASK.metadata()
    y, positive, negative = govern.encode_binary(base, QUALITY_TASK.target_column, meta["positive_class"])
    return base.agg(F.count_if(y == 1).alias("n_positive"), F.count_if(y == 0).alias("n_negative"), F.count_if(y.isNull()).alias("n_without")).select(
        *[F.lit(str(v)).alias(k) for k, v in meta.items()], F.lit(str(negative)).alias("negative_class"), "n_positive", "n_negative", "n_without")


TASK_METADATA_SQL = """
SELECT 'document quality' AS task_name, 'target' AS target_col, '1' AS positive_class, 'binary' AS task_type, CAST(min(l.quality) AS VARCHAR) AS negative_class,
  count_if(l.quality = 1) AS n_positive, count_if(l.quality = 0) AS n_negative, count_if(l.quality IS NULL) AS n_without
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def document_profiled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which profile every column of the study goes to once the row key is excluded."""
    f = study_frame(spark, sf_dir)
    cat = profile.column_catalog(f)
    chosen = {"numeric": profile.numeric_columns(f, cat, exclude=("doc_id",)), "categorical": profile.categorical_columns(f, cat, exclude=("doc_id",)),
              "binary": profile.binary_columns(f, cat)}
    rows = [(c["column"], k, c["n_nonnull"]) for c in cat for k, names in chosen.items() if c["column"] in names]
    return spark.createDataFrame(rows, "column string, profile string, n_nonnull long")


def _profiled_sql() -> str:
    from .screening import _STUDY_SQL
    kinds = {"lang": "categorical", "source": "categorical", "n_chars": "numeric", "quality": "numeric", "toxic": "numeric", "doc_bucket": "numeric", "lang_text": "categorical",
             "n_chars_sparse": "numeric", "source_rare": "categorical"}
    parts = "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE '{k}' END AS profile, count({c}) AS n_nonnull FROM j"
                                 for c, k in kinds.items())
    flags = "\nUNION ALL\n".join(f"SELECT '{c}_missing', 'binary', count(*) FROM j HAVING count({c}) < count(*)" for c in kinds)
    return f"{_STUDY_SQL}{parts}\nUNION ALL\n{flags}"


PROFILED_COLUMNS_SQL = _profiled_sql()


def document_frame_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the small tables that describe the model frame, one (table, item, value) row an entry."""
    f, _, dec = _decisions(spark, sf_dir)
    frame, s = impute.build_model_frame(f, dec)

    def rows(name: str, df: DataFrame, item, value) -> DataFrame:
        return df.select(F.lit(name).alias("table"), item.cast("string").alias("item"), value.cast("string").alias("value"))

    out = rows("headline", s["headline"], F.lit("n_rows"), F.col("n_rows")).unionByName(rows("headline", s["headline"], F.lit("n_cols"), F.col("n_cols")))
    out = out.unionByName(rows("class_counts", s["class_counts"], F.coalesce(F.col("target").cast("string"), F.lit("none")), F.col("n")))
    out = out.unionByName(rows("predictors_by_type", s["predictors_by_type"], F.col("inferred_type"), F.array_join("columns", ",")))
    out = out.unionByName(rows("leakage", s["leakage"], F.col("column_name"), F.col("action")))
    return out.unionByName(rows("warnings", s["warnings"], F.col("column_name"), F.col("notes")))


FRAME_TABLES_SQL = f"""
WITH dec AS ({DOC_DECISIONS_SQL}), kept AS (SELECT * FROM dec WHERE role = 'predictor' AND action <> 'drop')
SELECT 'headline' AS "table", 'n_rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM documents
UNION ALL SELECT 'headline', 'n_cols', CAST(count(*) + count_if(notes LIKE '%high_missingness_flag_important%') + 1 AS VARCHAR) FROM kept
UNION ALL SELECT 'class_counts', coalesce(CAST(quality AS VARCHAR), 'none'), CAST(count(*) AS VARCHAR) FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY quality
UNION ALL SELECT 'predictors_by_type', inferred_type, string_agg(column_name, ',' ORDER BY column_name) FROM dec WHERE role = 'predictor' AND action = 'keep' GROUP BY inferred_type
UNION ALL SELECT 'leakage', column_name, action FROM dec WHERE drop_reason = 'leakage'
UNION ALL SELECT 'warnings', column_name, notes FROM dec WHERE notes IS NOT NULL AND notes <> 'identifier_column'
"""


def customer_mode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M3: a text column marked for advanced imputation is filled with its mode, beside a numeric one."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"), (F.col("c_custkey") % 2).alias("odd"))
    rows = [("segment", "predictor", "keep", None, "advanced_impute", None, "categorical_nominal"), ("balance", "predictor", "keep", None, "advanced_impute", None, "continuous"),
            ("odd", "target", "keep", None, "no_missing", None, "binary"), ("c_custkey", "id", "drop", None, "no_missing", None, "unknown")]
    dec = spark.createDataFrame(rows, "column_name string, role string, action string, drop_reason string, missing_action string, notes string, inferred_type string")
    frame, _ = impute.build_model_frame(c, dec, keep=("c_custkey",))
    return rounded(frame)


MODE_FALLBACK_SQL = sig_wrap("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer),
m AS (SELECT segment AS s FROM c WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), b AS (SELECT avg(balance) AS a FROM c)
SELECT c_custkey, coalesce(segment, m.s) AS segment, coalesce(balance, b.a) AS balance, c_custkey % 2 AS target FROM c, m, b
""", ["balance"])


def customer_imputation_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: what holds for every chained imputation: observed cells stay, filled ones lie inside the observed
    range (a forest predicts means of observed values), integers stay integers, nothing is left empty."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("c_nationkey"), F.length("c_name").cast("double").alias("name_len"))
    cols = ["c_acctbal", "c_nationkey"]
    filled = impute.iterative_impute(c, [*cols, "name_len"], n_trees=10, max_iter=3)
    ends = c.agg(*[f(x).alias(f"{n}_{x}") for x in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    both = filled.select("c_custkey", *[F.col(x).alias(f"new_{x}") for x in cols]).join(c.select("c_custkey", *cols), "c_custkey")
    out = both.select("c_custkey", *[F.coalesce(F.col(f"new_{x}") == F.col(x), F.col(x).isNull()).alias(f"{x}_kept") for x in cols],
                      *[F.coalesce(F.col(f"new_{x}").between(ends[f"lo_{x}"], ends[f"hi_{x}"]), F.lit(False)).alias(f"{x}_in_range") for x in cols],
                      F.lit(dict(filled.dtypes)["c_nationkey"] == dict(c.dtypes)["c_nationkey"]).alias("integer_stays"))
    return out


IMPUTATION_INVARIANTS_SQL = """
SELECT c_custkey, TRUE AS c_acctbal_kept, TRUE AS c_nationkey_kept, TRUE AS c_acctbal_in_range, TRUE AS c_nationkey_in_range, TRUE AS integer_stays FROM customer
"""


def party_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview rows themselves: every shown row is a row of its file, aligned to the union header
    (Key and key are one name), at most three a file."""
    shown = ingest.preview(spark, _party_files(spark, sf_dir), n=3)
    names = [c for c in shown.columns if c != "_src_file"]
    by_file = shown.groupBy(_part_of(F.col("_src_file")).alias("part"), "_src_file").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(*names)).alias("rows"))
    keyed = by_file.select("part", "n", F.explode("rows").alias("r")).select("part", "n", "r.*")
    keys = F.coalesce(*[F.col(f"`{c}`") for c in names if c.lower() == "key"]).cast("long")
    keyed = keyed.withColumn("k", keys)
    known = (table(spark, sf_dir, "customer").select(F.lit(0).alias("part"), F.col("c_custkey").alias("k"))
             .unionByName(table(spark, sf_dir, "supplier").select(F.lit(1).alias("part"), F.col("s_suppkey").alias("k"))))
    found = keyed.join(known.withColumn("known", F.lit(True)), ["part", "k"], "left")
    return found.groupBy("part").agg(F.max("n").alias("most_of_a_file"), (F.count(F.lit(1)) == F.count("known")).alias("all_known"),
                                     (F.count(F.lit(1)) == F.count_distinct("k")).alias("none_twice"))


PREVIEW_ROWS_SQL = """
SELECT 0 AS part, least(3, count(*)) AS most_of_a_file, TRUE AS all_known, TRUE AS none_twice FROM customer
UNION ALL SELECT 1, least(3, count(*)), TRUE, TRUE FROM supplier
"""


def scored_metrics_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics row of the scored table as (metric, value) pairs, values as numbers."""
    from ..operators import diagnostics as D
    return rounded(D.metrics_long(scored_metrics(spark, sf_dir)).select("metric", F.col("value").cast("double").alias("value")))


def _metrics_values_sql() -> str:
    from .modelling import SCORED_METRICS_SQL
    names = ("tp", "fp", "tn", "fn", "sensitivity", "specificity", "auc", "brier")
    return f"WITH m AS ({SCORED_METRICS_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM m" for n in names)


METRICS_VALUES_SQL = _metrics_values_sql()


#: Rows of every table of the report bundle, counted from the data.
REPORT_BUNDLE_SQL = f"""
WITH profiled AS ({PROFILED_COLUMNS_SQL}), dec AS ({DOC_DECISIONS_SQL}), tables AS (
  SELECT profile || '_profile' AS "table", count(*) AS n_rows FROM profiled GROUP BY profile
  UNION ALL SELECT 'associations', count(*) FROM ({DOC_ASSOC_SQL})
  UNION ALL SELECT 'feature_decisions', count(*) FROM dec
  UNION ALL SELECT 'decision_summary', count(*) FROM (SELECT DISTINCT action, drop_reason FROM dec)
  UNION ALL SELECT 'missingness', least(20, count_if("column" LIKE '%\\_missing' ESCAPE '\\')) FROM profiled
  UNION ALL SELECT 'overview', 10 + count_if("column" LIKE '%\\_missing' ESCAPE '\\') FROM profiled
  UNION ALL SELECT 'inferential', count(*) FROM ({APPROVED_SQL})
  UNION ALL SELECT 'model_frame', count(*) FROM documents
  UNION ALL SELECT 'model_frame_headline', 1
  UNION ALL SELECT 'model_frame_class_counts', count(*) FROM (SELECT DISTINCT quality FROM documents LEFT JOIN labels USING (doc_id))
  UNION ALL SELECT 'model_frame_predictors_by_type', count(DISTINCT inferred_type) FROM dec WHERE role = 'predictor' AND action = 'keep'
  UNION ALL SELECT 'model_frame_leakage', count(*) FROM dec WHERE drop_reason = 'leakage'
  UNION ALL SELECT 'model_frame_warnings', count(*) FROM dec WHERE notes IS NOT NULL AND notes <> 'identifier_column')
SELECT "table", CAST(n_rows AS BIGINT) AS n_rows FROM tables
"""
