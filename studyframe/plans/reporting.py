"""Report bundle (G10, S6–S10) and the composed cleaning run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, clean, diagnostics as D, govern, impute, infer, profile
from ..spec import ColumnSpec
from ..session import shared_path
from ..sources import sinks
from .profiling import rounded, sig_wrap
from .tables import table
from .cleaning import EVENT_SPECS, _raw_events
from .screening import CONTINUOUS, LEAKAGE, MISSINGNESS, PREDICTORS, REDUNDANCY, study_frame


#: Parameters of the inferential screen, written to the manifest.
SCREEN = {"alpha": 0.05, "min_non_missing": 10, "ci_level": 0.95, "n_boot": 1000, "random_state": 42,
          "clinical_relevance_floor": "moderate", "robust_numeric_fallback": True, "outlier_iqr_multiplier": 1.5}


def document_report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the study's result tables for one task as Parquet, then list what was
    written (table, rows) by reading it back."""
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    dec = govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY)
    cat = profile.column_catalog(f)
    tables = {
        "numeric_profile": profile.numeric_profile(f, profile.numeric_columns(f, cat, exclude=("doc_id",))),
        "categorical_profile": profile.categorical_profile(f, profile.categorical_columns(f, cat)),
        "binary_profile": profile.binary_profile(f, profile.binary_columns(f, cat)),
        "associations": assoc.associations(f, "quality", kinds, LEAKAGE),
        "feature_decisions": dec,
        "decision_summary": govern.decision_summary(dec),
        "missingness": profile.missingness_ranking(f),
        "overview": profile.dataset_overview(f),
        "inferential": infer.screen(f, "quality", kinds, positive_class=1, decisions=dec, **SCREEN),
    }
    frame, summary = impute.build_model_frame(f, dec)
    tables |= {"model_frame": frame} | {f"model_frame_{k}": t for k, t in summary.items()}
    root = shared_path(spark, f"report-{uuid.uuid4().hex}")
    paths = sinks.write_tables(tables, root, "document quality")
    sinks.write_manifest(spark, {"task": "document quality", "target": "quality", "positive_class": 1, "leakage": list(LEAKAGE),
                                 "redundancy": REDUNDANCY, "missingness": MISSINGNESS, "predictor_types": kinds, **SCREEN},
                         root, "document quality")
    back = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
            for name, p in paths.items()]
    out = back[0]
    for b in back[1:]:
        out = out.unionByName(b)
    return out


def events_janitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema → derived → missing flags → duplicates dropped (first event per type)."""
    specs = EVENT_SPECS + (
        ColumnSpec(name="ts_hour", kind="datetime", derive_from=("ts_raw",), datetime_units="hour"),)
    frame, _ = clean.janitor(_raw_events(spark, sf_dir), specs, apply_all=True, id_cols=["event_type"],
                                  order_cols=["event_id"], drop_dupes=True)
    return frame.select("event_id", "event_type", "value_raw", "ts_hour", "value_raw_missing", "ts_raw_missing",
                        "wait_raw_missing")


def _janitor_overview(spark, sf_dir):
    specs = EVENT_SPECS + (
        ColumnSpec(name="ts_hour", kind="datetime", derive_from=("ts_raw",), datetime_units="hour"),)
    frame, _ = clean.janitor(_raw_events(spark, sf_dir), specs, apply_all=True, id_cols=["event_type"], order_cols=["event_id"])
    return frame.select("event_id", "event_type", "value_raw", "ts_hour", "value_raw_missing")


def events_janitor_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17's overview stage over all cleaned events (nothing dropped)."""
    return clean.overview(_janitor_overview(spark, sf_dir), ["event_type"])


EVENTS_OVERVIEW_SQL = """
WITH r AS (
  SELECT event_id, trim(event_type) AS event_type,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value_raw,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 2 THEN 0 ELSE hour(ts) END AS ts_hour
  FROM events
), c AS (
  SELECT count(*) AS n_rows, CAST(count_if(event_type IS NULL) + count_if(value_raw IS NULL) + count_if(ts_hour IS NULL) AS BIGINT) AS null_cells,
    count(DISTINCT coalesce(event_type, chr(1))) AS n_unique FROM r)
SELECT n_rows, 5 AS n_cols, null_cells, round(null_cells * 100.0 / (n_rows * 5), 2) AS null_pct, n_unique, n_rows - n_unique AS n_repeat,
  round(n_unique * 100.0 / n_rows, 2) AS unique_pct, round((n_rows - n_unique) * 100.0 / n_rows, 2) AS repeat_pct FROM c
"""


def document_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: type and position of every documents column, with the row count."""
    return profile.dataset_overview(table(spark, sf_dir, "documents"))


DOCUMENT_OVERVIEW_SQL = """
SELECT column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS dtype,
  (SELECT count(*) FROM documents) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM documents)) AS INTEGER) AS n_cols
FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM documents))
"""


def scored_pr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the precision-recall curve and its baseline, the prevalence."""
    from .modelling import _scored
    return rounded(D.pr_summary(_scored(spark, sf_dir)))


def _pr_summary_sql():
    from .modelling import _SCORED_SQL
    return sig_wrap(_SCORED_SQL + """
, c AS (SELECT p, count_if(y = 1) AS c1, count_if(y = 0) AS c0 FROM s GROUP BY p),
k AS (SELECT p, sum(c1) OVER (ORDER BY p DESC) AS tp, sum(c0) OVER (ORDER BY p DESC) AS fp, sum(c1) OVER () AS n1 FROM c),
q AS (SELECT p AS t, tp * 1.0 / n1 AS recall, tp * 1.0 / (tp + fp) AS prec FROM k UNION ALL SELECT 'inf'::DOUBLE, 0.0, 1.0),
d AS (SELECT recall - lead(recall) OVER (ORDER BY t) AS w, prec + lead(prec) OVER (ORDER BY t) AS h FROM q)
SELECT sum(w * h / 2.0) AS pr_auc, (SELECT avg(CAST(y AS DOUBLE)) FROM s) AS baseline FROM d
""", ["pr_auc", "baseline"])


PR_SUMMARY_SQL = _pr_summary_sql()


EVENTS_JANITOR_SQL = """
WITH r AS (
  SELECT event_id, trim(event_type) AS event_type,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value_raw,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 2 THEN 0 ELSE hour(ts) END AS ts_hour,
    event_id % 11 = 0 OR (event_id % 13 = 0) AS value_raw_missing,
    event_id % 17 = 0 AS ts_raw_missing, event_id % 19 = 0 AS wait_raw_missing,
    row_number() OVER (PARTITION BY lower(trim(event_type)) ORDER BY event_id) AS rn
  FROM events
)
SELECT event_id, event_type, value_raw, ts_hour, value_raw_missing, ts_raw_missing, wait_raw_missing FROM r WHERE rn = 1
"""


def scored_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored-table metrics row as (metric, value) pairs."""
    from .modelling import scored_metrics
    return D.metrics_long(scored_metrics(spark, sf_dir))
