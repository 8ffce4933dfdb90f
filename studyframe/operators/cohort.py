"""Task cohorts with recorded exclusion reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import TaskSpec
from . import prefix

INCLUDED = "included_in_cohort"
REASON = "cohort_exclusion_reason"


def flag(df: DataFrame, task: TaskSpec) -> DataFrame:
    """Included flag and reason.  A NULL target gives ``target_is_NaN``;
    each ``non-NaN`` criterion then marks its column's NULL rows with ``no_<col>``,
    the later criterion overwriting the earlier reason."""
    if task.target_column not in df.columns:
        raise ValueError(f"target column {task.target_column!r} not in frame")
    excluded = F.col(task.target_column).isNull()
    reason = F.when(excluded, F.lit("target_is_NaN"))
    for var, crit in task.inclusion_criteria.items():
        if crit != "non-NaN":
            raise ValueError(f"unsupported inclusion criterion {crit!r} for {var!r}")
        if var not in df.columns:
            raise ValueError(f"criterion column {var!r} not in frame")
        miss = F.col(var).isNull()
        excluded = excluded | miss
        reason = F.when(miss, F.lit(f"no_{var}")).otherwise(reason)
    return df.withColumns({INCLUDED: ~excluded, REASON: reason})


def attach_target(df: DataFrame, task: TaskSpec) -> DataFrame:
    """Task name and a unified ``target`` column."""
    return df.withColumns({"task_name": F.lit(task.name), "target": F.col(task.target_column)})


def attrition(flagged: DataFrame) -> DataFrame:
    """C4: counts by included flag and reason (NULL reason counted)."""
    return flagged.groupBy(INCLUDED, REASON).agg(F.count(F.lit(1)).alias("n"))


def build(df: DataFrame, task: TaskSpec, all_tasks=(), order_key: str | None = None,
          tiebreak=(), row_ids: bool = True):
    """Returns ``(cohort, attrition, metadata)``.

    ``row_id`` is a consecutive id in ``order_key`` order (G1, no single-task
    window).  After the filter, every task's own target column, the flag and
    reason, and ``_missing`` columns that are all false are dropped; ``row_id``
    and ``target`` come first.
    """
    if row_ids:
        if order_key is None:
            raise ValueError("row ids need an explicit order_key")
        df = prefix.row_index(df, order_key, tiebreak)
    flagged = attach_target(flag(df, task), task)
    att = attrition(flagged)
    kept = flagged.where(F.col(INCLUDED))
    flags = [c for c in kept.columns if c.endswith("_missing")]
    all_false = []
    if flags:
        row = kept.agg(*[F.max(F.col(c).cast("int")).alias(f"m{i}") for i, c in enumerate(flags)]).first()
        all_false = [c for i, c in enumerate(flags) if not row[f"m{i}"]]
    task_targets = {t.target_column for t in list(all_tasks) + [task]}
    drop = [INCLUDED, REASON, *all_false, *task_targets]
    kept = kept.drop(*[c for c in drop if c in kept.columns])
    first = [c for c in ("row_id", "target") if c in kept.columns]
    kept = kept.select(*first, *[c for c in kept.columns if c not in first])
    return kept, att, task.metadata()


def target_counts(df: DataFrame, target: str = "target") -> DataFrame:
    """Class counts of the target."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def headline(df: DataFrame, positive, target: str = "target") -> DataFrame:
    """N, prevalence, positive/negative n and percent in one aggregate."""
    y = F.col(target)
    pos = F.count_if(y == F.lit(positive))
    neg = F.count_if(y.isNotNull() & (y != F.lit(positive)))
    agg = df.agg(F.count(F.lit(1)).alias("n"), pos.alias("n_positive"), neg.alias("n_negative"))
    return agg.select(
        "n", "n_positive", "n_negative",
        F.round(F.try_divide(F.col("n_positive") * 1.0, F.col("n")), 6).alias("prevalence"),
        F.round(F.try_divide(F.col("n_positive") * 100.0, F.col("n")), 2).alias("positive_pct"),
        F.round(F.try_divide(F.col("n_negative") * 100.0, F.col("n")), 2).alias("negative_pct"),
    )
