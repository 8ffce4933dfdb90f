"""Duplicate and cohort studies: documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, cohort, dedupe
from ..session import materialize
from ..spec import TaskSpec
from .tables import table


def _docs_with_variants(spark, sf_dir):
    """Planted key variants: some texts lower-cased and padded, some blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    text = (F.when(i % 10 == 3, F.concat(F.lit("  "), F.lower("text"), F.lit(" ")))
            .when(i % 50 == 7, F.lit("   "))
            .otherwise(F.col("text")))
    return d.withColumn("text", text)


def document_dup_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1/K2: later-duplicate and duplicate-group masks over the normalised text."""
    m = dedupe.masks(_docs_with_variants(spark, sf_dir), ["text"], ["doc_id"])
    return m.select("doc_id", F.col("_dup_group").alias("dup_group"), F.col("_dup_later").alias("dup_later"))


_DOC_KEYS_SQL = """
WITH d AS (
  SELECT doc_id, lang, source,
    CASE WHEN doc_id % 10 = 3 THEN '  ' || lower(text) || ' ' WHEN doc_id % 50 = 7 THEN '   ' ELSE text END AS text
  FROM documents
), k AS (SELECT *, nullif(lower(trim(text)), '') AS key FROM d),
m AS (
  SELECT *, CASE WHEN key IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY key) END AS g,
         CASE WHEN key IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY key ORDER BY doc_id) END AS rn
  FROM k
)
"""

DOC_DUP_MASKS_SQL = _DOC_KEYS_SQL + """
SELECT doc_id, g > 1 AS dup_group, (g > 1 AND rn > 1) AS dup_later FROM m
"""


def document_dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: rows of duplicate groups, first included."""
    r = dedupe.report(_docs_with_variants(spark, sf_dir), ["text"], ["doc_id"], include_first=True)
    return r.select("doc_id", "lang", "source")


DOC_DUP_REPORT_SQL = _DOC_KEYS_SQL + "SELECT doc_id, lang, source FROM m WHERE g > 1"


def document_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: rows left after dropping later duplicates, counted by language and source."""
    kept = dedupe.drop_later(_docs_with_variants(spark, sf_dir), ["text"], ["doc_id"])
    return kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


DOC_DEDUPE_SQL = _DOC_KEYS_SQL + """
SELECT lang, source, count(*) AS n FROM m WHERE NOT (g > 1 AND rn > 1) GROUP BY ALL
"""


def conversation_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: unique vs repeat (role, text) encounters."""
    return dedupe.encounter_overview(table(spark, sf_dir, "conversations"), ["role", "text"])


CONV_ENCOUNTERS_SQL = """
WITH a AS (SELECT count(*) AS n FROM conversations),
u AS (SELECT count(*) AS u FROM (SELECT DISTINCT role, text FROM conversations))
SELECT n AS n_rows, u AS n_unique, n - u AS n_repeat,
       round(u * 100.0 / n, 2) AS unique_pct, round((n - u) * 100.0 / n, 2) AS repeat_pct
FROM a, u
"""


# ----------------------------------------------------------------- cohort

QUALITY_TASK = TaskSpec(name="document quality", target_column="quality", positive_class=1,
                        inclusion_criteria={"n_chars": "non-NaN"})
TOXIC_TASK = TaskSpec(name="document toxicity", target_column="toxic", positive_class=1)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels with planted NULLs (n_chars, source); text left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id", "lang",
        F.nullif(F.col("source"), F.lit("src3")).alias("source"),
        F.when(F.col("doc_id") % 9 != 4, F.col("n_chars")).alias("n_chars"),
        "quality", "toxic",
    )


_LABELLED_SQL = """
WITH j AS (
  SELECT d.doc_id, d.lang, nullif(d.source, 'src3') AS source,
         CASE WHEN d.doc_id % 9 <> 4 THEN d.n_chars END AS n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def document_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion reasons, the later criterion overwriting the earlier."""
    flagged = cohort.flag(labelled_documents(spark, sf_dir), QUALITY_TASK)
    return cohort.attrition(flagged)


DOC_ATTRITION_SQL = _LABELLED_SQL + """
SELECT NOT (quality IS NULL OR n_chars IS NULL) AS included_in_cohort,
       CASE WHEN n_chars IS NULL THEN 'no_n_chars' WHEN quality IS NULL THEN 'target_is_NaN' END AS cohort_exclusion_reason,
       count(*) AS n
FROM j GROUP BY ALL
"""


def document_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids, flags, filter, drops, target first."""
    base = materialize(labelled_documents(spark, sf_dir), "labelled-documents")  # read by several passes
    flagged = clean.missing_flags(base, exclude=("quality", "toxic"))
    kept, _, _ = cohort.build(flagged, QUALITY_TASK, all_tasks=[TOXIC_TASK], order_key="doc_id")
    return kept


DOC_COHORT_SQL = _LABELLED_SQL + """
SELECT row_id, quality AS target, doc_id, lang, source, n_chars, source_missing, 'document quality' AS task_name
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_id,
             source IS NULL AS source_missing FROM j)
WHERE quality IS NOT NULL AND n_chars IS NOT NULL
"""


def document_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21/A22 on the cohort: n, prevalence and class shares."""
    kept = document_cohort(spark, sf_dir)
    return cohort.headline(kept, positive=1)


DOC_HEADLINE_SQL = _LABELLED_SQL + """
, k AS (SELECT quality AS target FROM j WHERE quality IS NOT NULL AND n_chars IS NOT NULL)
SELECT count(*) AS n, count_if(target = 1) AS n_positive, count_if(target IS NOT NULL AND target <> 1) AS n_negative,
       round(count_if(target = 1) * 1.0 / count(*), 6) AS prevalence,
       round(count_if(target = 1) * 100.0 / count(*), 2) AS positive_pct,
       round(count_if(target IS NOT NULL AND target <> 1) * 100.0 / count(*), 2) AS negative_pct
FROM k
"""


def document_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.target_counts(document_cohort(spark, sf_dir))


DOC_TARGET_COUNTS_SQL = _LABELLED_SQL + """
SELECT quality AS target, count(*) AS n FROM j WHERE quality IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL
"""
