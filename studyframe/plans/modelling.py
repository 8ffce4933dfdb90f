"""Model frame, split, scored-table metrics and the predictive run."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import govern, impute, model
from ..session import discard, materialize, shared_path
from ..sources import registry, sinks
from .cleaning import _customers_with_nulls
from .profiling import rounded, sig_wrap
from .screening import CONTINUOUS, LEAKAGE, MISSINGNESS, PREDICTORS, REDUNDANCY, _STUDY_SQL, study_frame
from .tables import table

# ----------------------------------------------------------------- M2/M3 and the model frame

def customer_simple_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2/M3: median fill of the balance, mode fill of the segment."""
    c = _customers_with_nulls(spark, sf_dir)
    return rounded(impute.simple_impute(c, ["c_acctbal", "c_mktsegment"]).drop("c_name"))


CUSTOMER_IMPUTE_SQL = sig_wrap("""
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
                  nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer),
m AS (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM c),
s AS (SELECT c_mktsegment AS seg FROM c WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1)
SELECT c_custkey, c_nationkey, coalesce(c_acctbal, m.med) AS c_acctbal, coalesce(c_mktsegment, s.seg) AS c_mktsegment
FROM c, m, s
""", ["c_acctbal"])


def customer_iterative_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: chained random-forest imputation (50 trees, up to 10 rounds) of two
    numeric customer columns with planted gaps; integer column floored."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.length("c_name").cast("double").alias("name_len"))
    return impute.iterative_impute(c, ["c_acctbal", "c_nationkey", "name_len"])


def _decisions(spark, sf_dir):
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    return f, kinds, govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY)


def document_model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M4 (single advanced column → mean fill), M6, M7, U2."""
    f, _, dec = _decisions(spark, sf_dir)
    frame, _ = impute.build_model_frame(f, dec)
    return frame


DOC_MODEL_FRAME_SQL = _STUDY_SQL + """
SELECT n_chars, lang, source, doc_bucket,
       CAST(coalesce(n_chars_sparse, floor(avg(n_chars_sparse) OVER ())) AS BIGINT) AS n_chars_sparse,
       n_chars_sparse IS NULL AS n_chars_sparse_missing, quality AS target
FROM j
"""


def document_frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: rows, columns and prevalence of the model frame."""
    f, _, dec = _decisions(spark, sf_dir)
    frame, summary = impute.build_model_frame(f, dec)
    return rounded(summary["headline"])


DOC_FRAME_SUMMARY_SQL = sig_wrap(_STUDY_SQL + """
SELECT count(*) AS n_rows, avg(CAST(quality AS DOUBLE)) AS prevalence, 7 AS n_cols FROM j
""", ["prevalence"])


# ----------------------------------------------------------------- L1, L7, L8

def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left")


def document_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: per class, train and test sizes of the stratified hash split."""
    s = model.stratified_split(_labelled(spark, sf_dir), "quality", ["doc_id"], 0.2, 42)
    return s.groupBy(F.col("quality").alias("label")).agg(
        F.count_if(~F.col("_test")).alias("n_train"), F.count_if(F.col("_test")).alias("n_test"))


DOC_SPLIT_SQL = """
SELECT quality AS label, count(*) - CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n_train,
       CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n_test
FROM documents d JOIN labels l USING (doc_id) GROUP BY quality
"""


def document_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class and fold, row count and the balanced class weight."""
    d = _labelled(spark, sf_dir).where(F.col("quality").isNotNull())
    d = model.fold_column(model.balanced_weights(d, "quality"), "quality", ["doc_id"], 5, 42)
    return rounded(d.groupBy(F.col("quality").alias("label"), "fold").agg(
        F.count(F.lit(1)).alias("n"), F.max("w_balanced").alias("weight")))


DOC_FOLDS_SQL = sig_wrap("""
WITH c AS (SELECT quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY quality),
t AS (SELECT sum(n) AS tot FROM c),
f AS (SELECT * FROM range(5) r(fold))
SELECT quality AS label, CAST(fold AS INTEGER) AS fold,
       CAST(floor((fold + 1) / 5.0 * n + 0.5) - floor(fold / 5.0 * n + 0.5) AS BIGINT) AS n,
       tot * 1.0 / (2 * n) AS weight
FROM c, t, f
""", ["weight"])


# ----------------------------------------------------------------- scored-table metrics

def _scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 997) / 996.0
    y = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return model.scored_from_columns(li.withColumn("_y", y), "_y", p, 0.5)


_SCORED_SQL = """
WITH s AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y,
         ((l_orderkey * 37 + l_linenumber * 101) % 997) / 996.0 AS p
  FROM lineitem
)
"""


def scored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, Brier and operating metrics at 0.5."""
    s = _scored(spark, sf_dir)
    om = D.operating_metrics(s, 0.5)
    return rounded(om.select("*", F.lit(D.roc_auc(s)).alias("auc"), F.lit(D.brier(s)).alias("brier")))


SCORED_METRICS_SQL = sig_wrap(_SCORED_SQL + """
, r AS (SELECT y, rank() OVER (ORDER BY p) AS rmin, count(*) OVER (PARTITION BY p) AS t FROM s),
a AS (SELECT (sum(CASE WHEN y = 1 THEN rmin + (t - 1) / 2.0 END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
             / (count_if(y = 1) * count_if(y = 0)) AS auc FROM r)
SELECT count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 0) AS tn,
       count_if(p < 0.5 AND y = 1) AS fn,
       count_if(p >= 0.5 AND y = 1) * 1.0 / count_if(y = 1) AS sensitivity,
       count_if(p < 0.5 AND y = 0) * 1.0 / count_if(y = 0) AS specificity,
       (SELECT auc FROM a) AS auc, avg(pow(p - y, 2)) AS brier
FROM s
""", ["sensitivity", "specificity", "auc", "brier"])


def scored_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.roc_points(_scored(spark, sf_dir)))


SCORED_ROC_SQL = sig_wrap(_SCORED_SQL + """
, c AS (SELECT p, count_if(y = 1) AS c1, count_if(y = 0) AS c0 FROM s GROUP BY p)
SELECT p AS threshold, sum(c0) OVER (ORDER BY p DESC) * 1.0 / sum(c0) OVER () AS fpr,
       sum(c1) OVER (ORDER BY p DESC) * 1.0 / sum(c1) OVER () AS tpr FROM c
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0
""", ["threshold", "fpr", "tpr"])


def scored_pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.pr_points(_scored(spark, sf_dir)))


SCORED_PR_SQL = sig_wrap(_SCORED_SQL + """
, c AS (SELECT p, count_if(y = 1) AS c1, count_if(y = 0) AS c0 FROM s GROUP BY p)
SELECT p AS threshold, sum(c1) OVER (ORDER BY p DESC) * 1.0 / sum(c1) OVER () AS recall,
       sum(c1) OVER (ORDER BY p DESC) * 1.0 / (sum(c1) OVER (ORDER BY p DESC) + sum(c0) OVER (ORDER BY p DESC)) AS precision
FROM c
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 1.0
""", ["threshold", "recall", "precision"])


def scored_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confusion_matrix(_scored(spark, sf_dir))


SCORED_CONFUSION_SQL = _SCORED_SQL + """
SELECT y, CAST(p >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM s GROUP BY ALL
"""


def scored_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.calibration(_scored(spark, sf_dir)))


def _calibration_sql():
    bins = " + ".join(f"CAST(p > {e!r} AS INTEGER)" for e in D.CALIBRATION_EDGES)
    return sig_wrap(_SCORED_SQL + f"""
SELECT {bins} AS bin, avg(CAST(y AS DOUBLE)) AS prob_true, avg(p) AS prob_pred, count(*) AS n FROM s GROUP BY 1
""", ["prob_true", "prob_pred"])


SCORED_CALIBRATION_SQL = _calibration_sql()


def scored_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.probability_histogram(_scored(spark, sf_dir)))


SCORED_HISTOGRAM_SQL = sig_wrap(_SCORED_SQL + """
, r AS (SELECT y, min(p) AS lo, max(p) AS hi FROM s GROUP BY y),
b AS (SELECT s.y, s.p, r.lo, CASE WHEN r.hi > r.lo THEN (r.hi - r.lo) / 30 ELSE 1.0 END AS w FROM s JOIN r USING (y)),
k AS (SELECT y, lo, w, CAST(least(floor((p - lo) / w), 29) AS INTEGER) AS bin FROM b)
SELECT y, bin, min(lo + bin * w) AS lower, min(lo + (bin + 1) * w) AS upper, count(*) AS n FROM k GROUP BY y, bin
""", ["lower", "upper"])


def scored_threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11/L12 grid: operating metrics at each of the 181 thresholds, plus the chosen ones."""
    s = _scored(spark, sf_dir)
    scan = D.threshold_scan(s)
    yt = D.youden_threshold(scan)
    mt = D.min_sensitivity_threshold(scan, 0.8)
    return rounded(scan.withColumns({"is_youden": F.col("threshold") == F.lit(yt),
                                     "is_min_sensitivity": F.col("threshold") == F.lit(mt)}))


def _scan_sql():
    vals = ", ".join(f"({i}, {t!r})" for i, t in enumerate(D.THRESHOLDS))
    return sig_wrap(_SCORED_SQL + f"""
, g AS (SELECT * FROM (VALUES {vals}) v(i, threshold)),
m AS (
  SELECT CAST(g.i AS INTEGER) AS i, g.threshold,
         count_if(s.p >= g.threshold AND s.y = 1) AS tp, count_if(s.p >= g.threshold AND s.y = 0) AS fp,
         count_if(s.p < g.threshold AND s.y = 0) AS tn, count_if(s.p < g.threshold AND s.y = 1) AS fn
  FROM g, s GROUP BY g.i, g.threshold
), j AS (
  SELECT *, tp * 1.0 / (tp + fn) AS sensitivity, tn * 1.0 / (tn + fp) AS specificity,
         tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp) - 1.0 AS youden_j FROM m
), yb AS (SELECT i FROM j ORDER BY youden_j DESC, i ASC LIMIT 1),
ms AS (SELECT i FROM j WHERE sensitivity >= 0.8 ORDER BY youden_j DESC, i ASC LIMIT 1)
SELECT j.*, j.i = (SELECT i FROM yb) AS is_youden,
       j.threshold = coalesce((SELECT threshold FROM j WHERE i = (SELECT i FROM ms)), 0.5) AS is_min_sensitivity
FROM j
""", ["threshold", "sensitivity", "specificity", "youden_j"])


SCORED_SCAN_SQL = _scan_sql()


# ----------------------------------------------------------------- L20 end to end

def _model_inputs(spark, sf_dir):
    f, _, dec = _decisions(spark, sf_dir)
    frame, _ = impute.build_model_frame(f, dec, keep=("doc_id",))
    preds = [c for c in frame.columns if c not in ("target", "doc_id")]
    return frame, preds


def _logistic_run(spark, sf_dir):
    """The logistic family's full grid; S10: the fitted pipeline goes to the shared folder."""
    frame, preds = _model_inputs(spark, sf_dir)
    res = model.run(frame, "target", preds, positive_class=1, key_cols=("doc_id",), models=("logistic_regression",))
    sinks.save_model(res["model"], shared_path(spark, f"model-{uuid.uuid4().hex}"))
    return res


def document_logistic_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1–L4, L7–L11, L14–L20 for the logistic family (its full grid): the final
    metrics row (rows-only check).  ``model.run`` with all three families is the
    complete search; it is exercised outside the driver check because boosting
    with 100–200 rounds per fit is dominated by per-job overhead on tiny data."""
    return _logistic_run(spark, sf_dir)["metrics"]


#: Parameters of the full search, which name its entry in the registry.
SEARCH = {"positive_class": 1, "key_cols": ["doc_id"], "test_size": 0.2, "cv_folds": 5, "n_boot": 1000, "ci_level": 0.95,
          "threshold_strategy": "youden", "min_sensitivity_target": 0.75, "random_state": 42, "models": list(model.FAMILIES)}
TASK = "document quality"


def _search(spark, sf_dir) -> str:
    """Folder of the three-family search; the first query to ask runs it, later ones read it."""
    frame, preds = _model_inputs(spark, sf_dir)
    frame = materialize(frame, "model-frame")
    key = registry.key_of(frame, SEARCH | {"predictors": preds})
    path = registry.find(spark, TASK, key)
    if path is None:
        result = model.run(frame, "target", preds, **SEARCH)
        path = registry.publish(spark, TASK, key, result, SEARCH | {"target": "target", "predictors": preds})
    discard(frame)
    return path


def document_predictive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final metrics row of the search over all three families."""
    return registry.table(spark, _search(spark, sf_dir), "metrics")


def document_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best CV AUC mean / sd / params per family, ordered by mean AUC."""
    return registry.table(spark, _search(spark, sf_dir), "comparison").orderBy(F.col("best_cv_auc_mean").desc())


def document_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest importances of the selected model by encoded feature."""
    return D.top_features(registry.table(spark, _search(spark, sf_dir), "importance"), 15)


def document_search_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every search: the families and their grid points, folds, rows fitted and
    tested, AUCs in range, the winner's row in the metrics, the gap rule in the manifest."""
    path = _search(spark, sf_dir)
    comparison = registry.table(spark, path, "comparison")
    note, m = registry.table(spark, path, "manifest").first(), registry.table(spark, path, "metrics").first()
    order = [tuple(r) for r in comparison.orderBy(F.col("best_cv_auc_mean").desc()).collect()]  # one row a family
    points = F.create_map(*[F.lit(x).cast("string" if isinstance(x, str) else "long") for kv in json.loads(note["n_points"]).items() for x in kv])
    return comparison.select(
        "model_name", points[F.col("model_name")].alias("n_points"), F.lit(json.loads(note["cv_folds"])).cast("long").alias("cv_folds"),
        F.lit(m["n_train"]).cast("long").alias("n_train"), F.lit(m["n_test"]).cast("long").alias("n_test"),
        F.col("best_cv_auc_mean").between(0.0, 1.0).alias("auc_in_range"), F.lit(m["selected_model"] == order[0][0]).alias("winner_selected"),
        F.lit(json.loads(note["warning"]) == model.gap_warning(order)).alias("gap_rule_holds"),
        F.lit(sum(m[c] for c in ("test_tp", "test_fp", "test_tn", "test_fn")) == m["n_test"]).alias("counts_add_up"))


SEARCH_AUDIT_SQL = """
WITH n AS (SELECT quality, count(*) AS n, CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS t FROM documents d JOIN labels l USING (doc_id)
  WHERE quality IS NOT NULL GROUP BY quality),
t AS (SELECT CAST(sum(n - t) AS BIGINT) AS n_train, CAST(sum(t) AS BIGINT) AS n_test FROM n)
SELECT model_name, CAST(n_points AS BIGINT) AS n_points, CAST(5 AS BIGINT) AS cv_folds, n_train, n_test, TRUE AS auc_in_range, TRUE AS winner_selected,
  TRUE AS gap_rule_holds, TRUE AS counts_add_up
FROM t, (VALUES ('logistic_regression', 6), ('random_forest', 36), ('gradient_boosting', 8)) v(model_name, n_points)
"""


def document_saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled documents scored with the model as saved; ``as_fitted`` compares held-out rows with
    the scores that the fitted model gave in its own run (rows it was trained on have none)."""
    path = _search(spark, sf_dir)
    frame, _ = _model_inputs(spark, sf_dir)
    again = model.score(registry.fitted(path), frame.where(F.col("target").isNotNull()), ["doc_id", F.col("target").cast("int").alias("y")])
    then = registry.table(spark, path, "scored_test").select("doc_id", F.col("p").alias("p_then"), F.col("y").alias("y_then"))
    both = again.join(then, "doc_id", "left")
    near = (F.abs(F.col("p") - F.col("p_then")) <= 1e-12) & (F.col("y") == F.col("y_then"))
    return both.select("doc_id", "y", F.coalesce(near, F.lit(True)).alias("as_fitted"), F.col("p").between(0.0, 1.0).alias("is_probability"),
                       F.lit(then.count()).cast("long").alias("n_held_out"))


SAVED_SCORES_SQL = """
SELECT doc_id, CAST(quality AS INTEGER) AS y, TRUE AS as_fitted, TRUE AS is_probability,
  (SELECT CAST(sum(t) AS BIGINT) FROM (SELECT floor(0.2 * count(*) + 0.5) AS t FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality)) AS n_held_out
FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL
"""


def document_predictive_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictive and diagnostic tables of the task (curves, calibration, thresholds, importances)
    written as Parquet, listed with their rows as read back."""
    path = _search(spark, sf_dir)
    scored = registry.table(spark, path, "scored_test").select("y", "p", "pred")
    importance = registry.table(spark, path, "importance")
    tables = {
        "comparison": registry.table(spark, path, "comparison"), "final_metrics": D.metrics_long(registry.table(spark, path, "metrics").drop("selected_model", "threshold_strategy")),
        "roc": D.roc_points(scored), "precision_recall": D.pr_points(scored), "pr_summary": D.pr_summary(scored), "confusion": D.confusion_matrix(scored),
        "calibration": D.calibration(scored), "probability_histogram": D.probability_histogram(scored), "threshold_scan": D.threshold_scan(scored),
        "importance": importance, "top_features": D.top_features(importance, 15), "manifest": registry.table(spark, path, "manifest"),
    }
    # rows that must be there whatever the scores are
    levels = {"roc": scored.select("p").distinct().count() + 1}
    levels["precision_recall"] = levels["roc"]
    paths = sinks.write_tables(tables, shared_path(spark, f"report-{uuid.uuid4().hex}"), TASK)
    fixed = {"comparison": 3, "final_metrics": 13, "pr_summary": 1, "threshold_scan": 181, "manifest": 1}
    out = None
    for name, p in paths.items():
        n = F.count(F.lit(1))
        ok = n == fixed[name] if name in fixed else n == levels[name] if name in levels else (n >= 1) & (n <= {"confusion": 4, "calibration": 10, "probability_histogram": 60,
                                                                                                                "top_features": 15}.get(name, 10_000))
        row = spark.read.parquet(p).agg(F.when(F.lit(name in fixed), n).alias("n_rows"), ok.alias("rows_as_expected")).select(F.lit(name).alias("table"), "n_rows", "rows_as_expected")
        out = row if out is None else out.unionByName(row)
    return out


PREDICTIVE_BUNDLE_SQL = """
SELECT name AS "table", CAST(n AS BIGINT) AS n_rows, TRUE AS rows_as_expected
FROM (VALUES ('comparison', 3), ('final_metrics', 13), ('roc', NULL), ('precision_recall', NULL), ('pr_summary', 1), ('confusion', NULL), ('calibration', NULL),
  ('probability_histogram', NULL), ('threshold_scan', 181), ('importance', NULL), ('top_features', NULL), ('manifest', 1)) v(name, n)
"""
