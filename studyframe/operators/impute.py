"""Imputation and the model frame."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize
from . import profile, ranking, ranks


#: Rows that a task of a forest fit holds, about: MLlib keeps them with a count for each tree.
FIT_ROWS_A_TASK = 50_000


def _is_numeric(t) -> bool:
    return isinstance(t, T.NumericType) and not isinstance(t, T.BooleanType)


def medians(df: DataFrame, cols) -> dict:
    """M2: exact median per numeric column with values (mean of the two middle ones), by narrowing
    brackets: only rows next to the middle are shuffled."""
    got = ranks.quantiles(df, {c: F.col(f"`{c}`") for c in cols}, [0.5])
    return {c: m for c, (m,) in got.items() if m is not None}


def modes(df: DataFrame, cols) -> dict:
    """M3: most frequent value per column, ties → smallest (as text; cast back by the caller).

    Frequent values settle it in two passes; the level counts are made for the other columns only.
    """
    found, open_ = ranks.frequent_modes(df, {c: F.col(f"`{c}`") for c in cols})
    out = {c: value for c, (value, _) in found.items()}
    if open_:
        vc = profile.value_counts(df, open_)
        top = ranking.top_k(vc, "column", [F.col("n").desc(), F.col("value").asc()], 1, salt_cols="value")
        out |= {r["column"]: r["value"] for r in top.collect()}
    return out


def simple_impute(df: DataFrame, cols) -> DataFrame:
    """M2/M3: median for numeric columns, mode for the rest, in one projection."""
    cols = [c for c in cols if c in df.columns]
    num = [c for c in cols if _is_numeric(df.schema[c].dataType)]
    cat = [c for c in cols if c not in num]
    med = medians(df, num)
    mod = modes(df, cat)
    fills = {}
    for c in num:
        if c in med:
            v = med[c]
            t = df.schema[c].dataType
            fills[c] = F.lit(v).cast(t) if not isinstance(t, T.IntegralType) else F.lit(math.floor(v)).cast(t)
    for c in cat:
        if c in mod:
            fills[c] = F.lit(mod[c]).cast(df.schema[c].dataType)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), fills[c]).alias(c, metadata=df.schema[c].metadata)
                       if c in fills else F.col(f"`{c}`") for c in df.columns])


def iterative_impute(df: DataFrame, cols, n_trees: int = 50, max_iter: int = 10, tol: float = 1e-3,
                     seed: int = 0) -> DataFrame:
    """M4: chained random-forest imputation among ``cols`` (numeric); a column without any value stays empty.

    Start from the mean; each round refits one forest per column on the rows
    where it was observed, using the other columns' current values, and
    predicts the missing entries.  Stops when the largest change relative to the
    largest value falls under ``tol``.  Integer columns are floored.  Each column's step
    is written to the shared folder: the next forest reads it instead of replaying the
    last one, and a lost executor costs one step. However the input lies in files, a task of a
    fit gets about ``FIT_ROWS_A_TASK`` rows at most.
    """
    cols = [c for c in cols if c in df.columns and _is_numeric(df.schema[c].dataType)]
    if not cols:
        return df
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    cols = [c for c in cols if means[c] is not None]
    work = df
    for c in cols:
        work = work.withColumn(f"_obs_{c}", F.col(f"`{c}`").isNotNull())
        work = work.withColumn(f"_cur_{c}", F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(means[c])))
    if len(cols) > 1:
        work = materialize(work, "impute-start")
        parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(work.count() / FIT_ROWS_A_TASK))
        for _ in range(max_iter):
            work = work.withColumns({f"_prev_{c}": F.col(f"_cur_{c}") for c in cols})
            before = work
            for c in cols:
                others = [f"_cur_{o}" for o in cols if o != c]
                asm = VectorAssembler(inputCols=others, outputCol="_feat")
                rf = RandomForestRegressor(featuresCol="_feat", labelCol=f"_cur_{c}", numTrees=n_trees,
                                           seed=seed, predictionCol="_pred")
                seen = work.where(F.col(f"_obs_{c}")).select(f"_cur_{c}", *others).repartition(parts)
                model = Pipeline(stages=[asm, rf]).fit(seen)
                pred = model.transform(work).drop("_feat")
                pred = pred.withColumn(f"_cur_{c}", F.when(F.col(f"_obs_{c}"), F.col(f"_cur_{c}"))
                                       .otherwise(F.col("_pred"))).drop("_pred")
                last, work = work, materialize(pred, "impute-step")
                if last is not before:
                    discard(last)
            d = work.agg(F.max(F.greatest(*[F.abs(F.col(f"_cur_{c}") - F.col(f"_prev_{c}")) for c in cols])).alias("d"),
                         F.max(F.greatest(*[F.abs(F.col(f"_cur_{c}")) for c in cols])).alias("m")).first()
            if d["m"] and d["d"] is not None and d["d"] / d["m"] < tol:
                break
    out = []
    for c in df.columns:
        if c in cols:
            t = df.schema[c].dataType
            v = F.col(f"_cur_{c}")
            v = F.floor(v).cast(t) if isinstance(t, T.IntegralType) else v.cast(t)
            out.append(v.alias(c, metadata=df.schema[c].metadata))
        else:
            out.append(F.col(f"`{c}`"))
    return work.select(*out)


def build_model_frame(df: DataFrame, decisions: DataFrame, keep=()):
    """Decisions interpreted as a program.

    Drops leakage columns, simple-imputes kept predictors marked
    ``simple_impute``, iteratively imputes numeric ``advanced_impute`` predictors
    (non-numeric ones fall back to the mode), keeps ``<c>_missing`` flags of
    predictors noted as highly missing, and returns ``(frame, summary)`` where
    the frame is ``keep`` (e.g. a row key) + predictors + flags + ``target``
    in one projection.
    """
    dec = [r.asDict() for r in decisions.collect()]  # one row per column: small
    targets = [d["column_name"] for d in dec if d["role"] == "target"]
    if len(targets) != 1:
        raise ValueError("decisions must name exactly one target column")
    target = targets[0]
    viable = [d["column_name"] for d in dec if d["role"] == "predictor" and d["action"] != "drop"]
    leakage = [d["column_name"] for d in dec if d["drop_reason"] == "leakage"]
    frame = df.drop(*[c for c in leakage if c in df.columns])
    simple = [d["column_name"] for d in dec if d["missing_action"] == "simple_impute" and d["column_name"] in viable]
    advanced = [d["column_name"] for d in dec if d["missing_action"] == "advanced_impute" and d["column_name"] in viable]
    adv_num = [c for c in advanced if c in frame.columns and _is_numeric(frame.schema[c].dataType)]
    adv_other = [c for c in advanced if c not in adv_num]
    frame = simple_impute(frame, simple + adv_other)
    frame = iterative_impute(frame, adv_num)
    flags = [f"{d['column_name']}_missing" for d in dec
             if d["role"] == "predictor" and d["action"] != "drop"
             and "high_missingness_flag_important" in (d["notes"] or "")]
    flags = [c for c in flags if c in frame.columns]
    x_cols = list(dict.fromkeys(viable + flags))
    model_frame = frame.select(*[F.col(f"`{c}`") for c in keep if c in frame.columns and c not in x_cols],
                               *[F.col(f"`{c}`") for c in x_cols if c in frame.columns],
                               F.col(f"`{target}`").alias("target"))
    return model_frame, frame_summary(model_frame, decisions)


def frame_summary(model_frame: DataFrame, decisions: DataFrame) -> dict:
    """M8: headline numbers and small tables describing the model frame."""
    y = F.col("target").cast("double")
    head = model_frame.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(y).alias("prevalence")).withColumn(
        "n_cols", F.lit(len(model_frame.columns)))
    return {
        "headline": head,
        "class_counts": model_frame.groupBy("target").agg(F.count(F.lit(1)).alias("n")),
        "predictors_by_type": decisions.where((F.col("role") == "predictor") & (F.col("action") == "keep"))
        .groupBy("inferred_type").agg(F.sort_array(F.collect_list("column_name")).alias("columns")),
        "leakage": decisions.where(F.col("drop_reason") == "leakage").select("column_name", "notes", "action"),
        "warnings": decisions.where(F.col("notes").isNotNull() & (F.col("notes") != "identifier_column"))
        .select("column_name", "notes"),
    }
