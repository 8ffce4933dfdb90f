"""Inferential studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, govern, infer
from .profiling import rounded, sig_wrap
from .screening import CONTINUOUS, LEAKAGE, MISSINGNESS, PREDICTORS, REDUNDANCY, _STUDY_SQL, _assoc_sql, study_frame
from .tables import table


def _events_y(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("value", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("_y"))


def events_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U of purchase values against all other events, and rank-biserial r."""
    vt = infer.class_value_table(_events_y(spark, sf_dir), "_y", ["value"])
    return rounded(infer.mann_whitney(vt))


EVENTS_MW_SQL = sig_wrap("""
WITH e AS (SELECT value + 0.0 AS x, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events WHERE value IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) AS rmin, count(*) OVER (PARTITION BY x) AS t FROM e),
s AS (SELECT sum(CASE WHEN y = 1 THEN rmin + (t - 1) / 2.0 END) AS r1, count_if(y = 1) AS n1, count_if(y = 0) AS n0 FROM r),
tt AS (SELECT CAST(sum(CAST(t AS DOUBLE) * t * t - t) AS DOUBLE) AS ties FROM (SELECT count(*) AS t FROM e GROUP BY x))
SELECT 'value' AS "column", n1, n0, ties, r1 - n1 * (n1 + 1) / 2.0 AS u1,
       2.0 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) - 1.0 AS rank_biserial,
       (SELECT count(DISTINCT x) FROM e) AS n_values
FROM s, tt
""", ["ties", "u1", "rank_biserial"])


def document_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square without continuity correction, expected-cell
    diagnostics and Cramér's V for quality × lang / source / toxic."""
    f = study_frame(spark, sf_dir)
    cols = ["lang", "source", "toxic"]
    cells = assoc.contingency_cells(f, "quality", cols)
    chi = assoc.chi_square(cells, yates=False)
    lt5 = assoc.expected_share_below(cells)
    out = chi.join(lt5, "column").select(
        "column", "n", "chi2",
        F.sqrt(F.col("chi2") / (F.col("n") * (F.least("n_rows_levels", "n_cols_levels") - 1))).alias("cramers_v"),
        F.col("min_expected").alias("expected_cell_min"),
        (F.col("pct_expected_lt5") * 100.0).alias("expected_cell_lt5_pct"),
        ((F.col("min_expected") < 1.0) | (F.col("pct_expected_lt5") * 100.0 > 20.0)).alias("expected_cell_warning"),
    )
    return rounded(out)


def _chi_sql(col):
    return f"""
SELECT '{col}' AS "column", max(n_all) AS n, sum(pow(o - e, 2) / e) AS chi2,
  sqrt(sum(pow(o - e, 2) / e) / (max(n_all) * (least(max(n_lv_y), max(n_lv_x)) - 1))) AS cramers_v,
  min(e) AS expected_cell_min, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) * 100.0 AS expected_cell_lt5_pct,
  (min(e) < 1.0 OR avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) * 100.0 > 20.0) AS expected_cell_warning
FROM (
  SELECT g.*, coalesce(c.n, 0) AS o, g.r * g.c * 1.0 / g.n_all AS e,
         count(DISTINCT g.y) OVER () AS n_lv_y, count(DISTINCT g.x) OVER () AS n_lv_x
  FROM (SELECT ys.y, xs.x, ys.r, xs.c, (SELECT sum(n) FROM cells_{col}) AS n_all
        FROM (SELECT y, sum(n) AS r FROM cells_{col} GROUP BY y) ys, (SELECT x, sum(n) AS c FROM cells_{col} GROUP BY x) xs) g
  LEFT JOIN cells_{col} c ON c.y = g.y AND c.x = g.x
)"""


def _doc_chi_sql():
    from .screening import _STUDY_SQL
    cols = ["lang", "source", "toxic"]
    ctes = ", ".join(f"cells_{c} AS (SELECT CAST(quality AS VARCHAR) AS y, CAST({c} AS VARCHAR) AS x, count(*) AS n "
                     f"FROM j WHERE quality IS NOT NULL AND {c} IS NOT NULL GROUP BY ALL)" for c in cols)
    body = "\nUNION ALL\n".join(f"SELECT * FROM ({_chi_sql(c)}) _c{i}" for i, c in enumerate(cols))
    return _STUDY_SQL + ", " + ctes + "\n" + body


DOC_CHI_SQL = sig_wrap(_doc_chi_sql(), ["chi2", "cramers_v", "expected_cell_min", "expected_cell_lt5_pct"])


def _planted_p(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    p = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(((F.col("doc_id") * 7919) % 1000 + 1) / 1001.0)
    return d.select(F.col("doc_id").cast("string").alias("predictor"), p.alias("p_value"))


def planted_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini–Hochberg over a planted p column (NULL p = not tested)."""
    t = infer.benjamini_hochberg(_planted_p(spark, sf_dir), "p_value")
    return rounded(t.withColumn("fdr_significant", F.coalesce(F.col("p_value_fdr") < 0.05, F.lit(False))))


PLANTED_FDR_SQL = sig_wrap("""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS predictor,
                  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE ((doc_id * 7919) % 1000 + 1) / 1001.0 END AS p_value FROM documents),
v AS (SELECT predictor, p_value, row_number() OVER (ORDER BY p_value, predictor) AS rk, count(*) OVER () AS m
      FROM t WHERE p_value IS NOT NULL),
a AS (SELECT predictor, least(1.0, greatest(0.0, min(p_value * m / rk) OVER (ORDER BY p_value DESC, predictor DESC
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS p_value_fdr FROM v)
SELECT t.predictor, t.p_value, a.p_value_fdr, coalesce(a.p_value_fdr < 0.05, false) AS fdr_significant
FROM t LEFT JOIN a USING (predictor)
""", ["p_value", "p_value_fdr"])


def planted_effect_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect bands, relevance flag and the multi-key sort on planted effects."""
    base = _planted_p(spark, sf_dir)
    eff = ((F.col("predictor").cast("long") * 37) % 100 - 50) / 90.0
    metric = F.element_at(F.array(F.lit("point_biserial_r"), F.lit("rank_biserial_r"), F.lit("cramers_v")),
                          (F.col("predictor").cast("long") % 3 + 1).cast("int"))
    t = base.select("predictor", "p_value", metric.alias("effect_metric"), eff.alias("effect_value"),
                    F.when(F.col("p_value").isNull(), "skipped").otherwise("ok").alias("status"))
    t = infer.apply_fdr_flags(t, 0.05, "moderate")
    t = infer.sort_table(t)
    return rounded(t.select("predictor", "effect_metric", "effect_value", "effect_band", "clinically_relevant",
                            "fdr_significant", "p_value_fdr"))


PLANTED_BANDS_SQL = sig_wrap("""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS predictor,
                  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE ((doc_id * 7919) % 1000 + 1) / 1001.0 END AS p_value,
                  ['point_biserial_r', 'rank_biserial_r', 'cramers_v'][doc_id % 3 + 1] AS effect_metric,
                  ((doc_id * 37) % 100 - 50) / 90.0 AS effect_value FROM documents),
v AS (SELECT predictor, p_value, row_number() OVER (ORDER BY p_value, predictor) AS rk, count(*) OVER () AS m
      FROM t WHERE p_value IS NOT NULL),
a AS (SELECT predictor, least(1.0, greatest(0.0, min(p_value * m / rk) OVER (ORDER BY p_value DESC, predictor DESC
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS p_value_fdr FROM v),
b AS (SELECT t.*, a.p_value_fdr,
        CASE WHEN abs(effect_value) >= 0.5 THEN 'large' WHEN abs(effect_value) >= 0.3 THEN 'moderate'
             WHEN abs(effect_value) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect_band
      FROM t LEFT JOIN a USING (predictor))
SELECT predictor, effect_metric, effect_value, effect_band,
       (p_value IS NOT NULL AND effect_band IN ('large', 'moderate')) AS clinically_relevant,
       coalesce(p_value_fdr < 0.05, false) AS fdr_significant, p_value_fdr
FROM b
""", ["effect_value", "p_value_fdr"])


def document_inferential_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16 end to end on the approved predictors of the labelled documents (bootstrap CIs: rows-only check)."""
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    dec = govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY)
    return infer.screen(f, "quality", kinds, positive_class=1, random_state=42, decisions=dec)


# ----------------------------------------------------------------- the screen against SQL

def _chi2_tail_sql(x: str, k: str) -> str:
    """Upper tail of chi-square by the series of the incomplete gamma function."""
    return (f"CASE WHEN ({x}) <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 3000), "
            f"lambda i: exp(-({x}) / 2 + (({k}) / 2.0 + i) * ln(({x}) / 2) - lgamma(({k}) / 2.0 + i + 1)))) END")


def _r_tail_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: one less the incomplete beta function of r² with 1/2 and (n - 2) / 2, by its series."""
    y, b = f"(({r}) * ({r}))", f"((({n}) - 2) / 2.0)"
    return (f"CASE WHEN {y} = 0 THEN 1.0 WHEN {y} >= 1 THEN 0.0 ELSE 1 - exp(0.5 * ln({y}) + {b} * ln(1 - {y}) - ln(0.5) - (lgamma(0.5) + lgamma({b}) - lgamma(0.5 + {b})))"
            f" * (1 + list_sum(list_transform(range(0, 3000), lambda i: exp(lgamma(1.5) + lgamma(0.5 + {b} + i + 1) - lgamma(2.5 + i) - lgamma(0.5 + {b}) + (i + 1) * ln({y}))))) END")


def _screen(spark, sf_dir):
    f = study_frame(spark, sf_dir)
    kinds = govern.classify_predictors(f, PREDICTORS, CONTINUOUS)
    dec = govern.feature_decisions(f, "quality", kinds, MISSINGNESS, LEAKAGE, REDUNDANCY)
    return infer.screen(f, "quality", kinds, positive_class=1, random_state=42, decisions=dec)


def document_screen_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of the inferential table that is no random draw, and
    whether each interval is in order and inside the range of its measure."""
    t = _screen(spark, sf_dir)
    low = F.when(F.col("effect_metric") == "cramers_v", 0.0).otherwise(-1.0)
    holds = (F.col("ci_low") <= F.col("ci_high")) & (F.col("ci_low") >= low) & (F.col("ci_high") <= 1.0)
    t = t.select("predictor", "test_name", "test_stat", "effect_metric", "effect_value", F.round("p_value", 8).alias("p_value"), F.round("p_value_fdr", 8).alias("p_value_fdr"),
                 "expected_cell_min", "expected_cell_warning", "n", "missing_pct", "status", "skipped_reason", "effect_band", "fdr_significant", "clinically_relevant",
                 F.coalesce(holds, F.lit(False)).alias("interval_holds"))
    return rounded(t)


def _numeric_facts_sql(col: str) -> str:
    return f"""
SELECT '{col}' AS predictor, CASE WHEN robust THEN 'mann_whitney_u' ELSE 'point_biserial' END AS test_name, CASE WHEN robust THEN u1 ELSE r END AS test_stat,
  CASE WHEN robust THEN 'rank_biserial_r' ELSE 'point_biserial_r' END AS effect_metric, CASE WHEN robust THEN 2 * u1 / (k1 * k0) - 1 ELSE r END AS effect_value,
  CASE WHEN robust THEN CASE WHEN z <= 0 THEN 1.0 ELSE {_chi2_tail_sql('z * z', '1')} END ELSE {_r_tail_sql('r', 'n')} END AS p_value,
  CAST(NULL AS DOUBLE) AS expected_cell_min, FALSE AS expected_cell_warning, n, (SELECT count_if({col} IS NULL) * 100.0 / count(*) FROM j) AS missing_pct
FROM (SELECT *, (greatest(u1, k1 * k0 - u1) - k1 * k0 / 2.0 - 0.5) / sqrt(k1 * k0 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))) AS z FROM (
  SELECT any_value(s.n) AS n, any_value(s.r) AS r, any_value(s.k1) * 1.0 AS k1, any_value(s.k0) * 1.0 AS k0,
    sum(CASE WHEN w.y = 1 THEN w.rk END) - any_value(s.k1) * (any_value(s.k1) + 1) / 2.0 AS u1, sum(CAST(w.t AS DOUBLE) * w.t - 1) AS ties,
    any_value(s.k1 >= 3 AND s.k0 >= 3 AND s.n >= 10) AND (abs(any_value(s.sk)) > 1
      OR count_if(s.q3 > s.q1 AND (w.v < s.q1 - 1.5 * (s.q3 - s.q1) OR w.v > s.q3 + 1.5 * (s.q3 - s.q1))) * 1.0 / any_value(s.n) > 0.05) AS robust
  FROM (SELECT v, y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY v) AS t FROM x_{col}) w,
    (SELECT count(*) AS n, count_if(y = 1) AS k1, count_if(y = 0) AS k0, corr(v, y) AS r, skewness(v) AS sk, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
     FROM x_{col}) s))"""


def _categorical_facts_sql(col: str) -> str:
    return f"""
SELECT '{col}' AS predictor, 'chi_square' AS test_name, chi2 AS test_stat, 'cramers_v' AS effect_metric, sqrt(chi2 / (n * (least(ny, nx) - 1))) AS effect_value,
  {_chi2_tail_sql('chi2', '(ny - 1) * (nx - 1)')} AS p_value, emin AS expected_cell_min, emin < 1 OR under > 0.2 AS expected_cell_warning, CAST(n AS BIGINT) AS n,
  (SELECT count_if({col} IS NULL) * 100.0 / count(*) FROM j) AS missing_pct
FROM (SELECT sum(pow(o - e, 2) / e) AS chi2, min(e) AS emin, count_if(e < 5) * 1.0 / count(*) AS under, any_value(n_all) AS n, count(DISTINCT y) AS ny, count(DISTINCT x) AS nx
  FROM (SELECT a.y, b.x, coalesce(c.n, 0) AS o, a.r * b.c * 1.0 / t.n_all AS e, t.n_all
    FROM (SELECT y, sum(n) AS r FROM c_{col} GROUP BY y) a CROSS JOIN (SELECT x, sum(n) AS c FROM c_{col} GROUP BY x) b CROSS JOIN (SELECT sum(n) AS n_all FROM c_{col}) t
    LEFT JOIN c_{col} c ON c.y = a.y AND c.x = b.x))"""


def _screen_facts_sql() -> str:
    numeric, categorical = ("n_chars", "n_chars_sparse", "doc_bucket"), ("lang", "source")
    ctes = [f"x_{c} AS (SELECT CAST({c} AS DOUBLE) AS v, quality AS y FROM j WHERE {c} IS NOT NULL AND quality IS NOT NULL)" for c in numeric]
    ctes += [f"c_{c} AS (SELECT quality AS y, {c} AS x, count(*) AS n FROM j WHERE {c} IS NOT NULL AND quality IS NOT NULL GROUP BY ALL)" for c in categorical]
    parts = [_numeric_facts_sql(c) for c in numeric] + [_categorical_facts_sql(c) for c in categorical]
    union = "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)
    return sig_wrap(_STUDY_SQL + ", " + ",\n".join(ctes) + f""",
facts AS (SELECT * FROM ({union})),
ranked AS (SELECT predictor, p_value, row_number() OVER (ORDER BY p_value, predictor) AS rk, count(*) OVER () AS m FROM facts),
adjusted AS (SELECT predictor, least(1.0, min(p_value * m / rk) OVER (ORDER BY p_value DESC, predictor DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_value_fdr
  FROM ranked),
banded AS (SELECT f.* REPLACE (round(f.p_value, 8) AS p_value), a.p_value_fdr AS fdr, 'ok' AS status, CAST(NULL AS VARCHAR) AS skipped_reason,
  CASE WHEN abs(effect_value) >= 0.5 THEN 'large' WHEN abs(effect_value) >= 0.3 THEN 'moderate' WHEN abs(effect_value) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect_band
  FROM facts f JOIN adjusted a USING (predictor))
SELECT * EXCLUDE (fdr), round(fdr, 8) AS p_value_fdr, fdr < 0.05 AS fdr_significant, effect_band IN ('large', 'moderate') AS clinically_relevant, TRUE AS interval_holds FROM banded
""", ["test_stat", "effect_value", "expected_cell_min", "missing_pct", "p_value", "p_value_fdr"])


SCREEN_FACTS_SQL = _screen_facts_sql()


def _assoc_p_sql() -> str:
    levels = {c: f"(SELECT (count(DISTINCT quality) - 1) * (count(DISTINCT {c}) - 1) FROM s WHERE quality IS NOT NULL AND {c} IS NOT NULL)" for c in ("lang", "source", "source_rare", "toxic")}
    dof = "CASE predictor_col " + " ".join(f"WHEN '{c}' THEN {q}" for c, q in levels.items()) + " END"
    return sig_wrap(f"""
WITH s AS ({_STUDY_SQL} SELECT * FROM j), a AS (SELECT *, {dof} AS dof FROM ({_assoc_sql()})),
p AS (SELECT * EXCLUDE (dof), CASE test_name WHEN 'point_biserial' THEN {_r_tail_sql('test_stat', 'n_used')}
  WHEN 'chi2' THEN greatest(0.0, {_chi2_tail_sql('test_stat', 'dof')}) END AS p FROM a)
SELECT * EXCLUDE (p), round(p, 8) AS p_value, CASE WHEN status <> 'ok' OR p IS NULL THEN 'not_run' WHEN p < 0.001 THEN 'sig_0.001' WHEN p < 0.01 THEN 'sig_0.01'
  WHEN p < 0.05 THEN 'sig_0.05' ELSE 'ns' END AS p_value_note FROM p
""", ["test_stat", "effect_size", "p_value"])


ASSOC_P_SQL = _assoc_p_sql()


def document_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's exact test of two 2x2 tables (toxic texts; long texts), as the screen runs it."""
    f = study_frame(spark, sf_dir).withColumn("long_text", F.when(F.col("n_chars") > 1000, "yes").when(F.col("n_chars").isNotNull(), "no"))
    t = infer.screen(f, "quality", {"toxic": "binary", "long_text": "binary"}, positive_class=1, n_boot=200, random_state=7)
    return rounded(t.select("predictor", "test_name", "test_stat", "effect_value", F.round("p_value", 8).alias("p_value"), F.round("fisher_p_value", 8).alias("fisher_p_value"),
                            "expected_cell_min", "expected_cell_lt5_pct", "n", "status"))


def _fisher_sql(col: str, value: str) -> str:
    mass = ("exp(lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1)"
            " - lgamma(r2 - c1 + k + 1))")
    return f"""
SELECT '{col}' AS predictor, 'fisher_exact' AS test_name, a * d * 1.0 / (b * c) AS test_stat, sqrt(chi2 / n) AS effect_value, round(p, 8) AS p_value, round(p, 8) AS fisher_p_value,
  emin AS expected_cell_min, under * 25.0 AS expected_cell_lt5_pct, n, 'ok' AS status
FROM (SELECT *, least(1.0, list_sum(list_filter(masses, lambda m: m <= seen * (1 + 1e-7)))) AS p FROM (
  SELECT *, list_transform(range(greatest(0, c1 - r2), least(c1, r1) + 1), lambda k: {mass}) AS masses, {mass.replace("(k ", "(a ").replace("- k ", "- a ").replace("+ k ", "+ a ")} AS seen,
    least(r1, r2) * least(c1, n - c1) * 1.0 / n AS emin, (r1 * c1 < 5 * n)::INT + (r1 * (n - c1) < 5 * n)::INT + (r2 * c1 < 5 * n)::INT + (r2 * (n - c1) < 5 * n)::INT AS under,
    n * pow(a * d * 1.0 - b * c, 2) / (r1 * 1.0 * r2 * c1 * (n - c1)) AS chi2
  FROM (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1, a + b + c + d AS n FROM (
    SELECT count_if(y = 0 AND x = 0)::BIGINT AS a, count_if(y = 0 AND x = 1)::BIGINT AS b, count_if(y = 1 AND x = 0)::BIGINT AS c, count_if(y = 1 AND x = 1)::BIGINT AS d
    FROM (SELECT quality AS y, {value} AS x FROM j WHERE quality IS NOT NULL)))))"""


FISHER_SQL = sig_wrap(_STUDY_SQL + _fisher_sql("toxic", "toxic") + "\nUNION ALL" + _fisher_sql("long_text", "CASE WHEN n_chars > 1000 THEN 1 WHEN n_chars IS NOT NULL THEN 0 END"),
                      ["test_stat", "effect_value", "p_value", "fisher_p_value", "expected_cell_min", "expected_cell_lt5_pct"])
