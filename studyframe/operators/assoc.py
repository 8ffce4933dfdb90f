"""Predictor–target association screen.

Two Spark jobs cover any number of predictors: one wide ``agg`` gives pairwise
complete counts, ranges and ``corr`` for every numeric predictor; one long
contingency table ``(column, y, x, n)`` (all categorical predictors unpivoted
together) gives every chi-square.  The chi-square needs no zero cells: an empty
one adds its expected count, and together those are n − Σ_observed e.  In a 2×2 table every |o−e| is equal, so
the Yates form is (d − min(½, d))² · n · Σ1/rᵢ · Σ1/cⱼ from the margins.
P-values are computed on the per-predictor summary rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as S
from .profile import column_catalog

NUMERIC_KINDS = ("continuous", "discrete", "time_to_event")
TABLE_KINDS = ("binary", "categorical_nominal", "categorical_ordinal", "discrete")

ASSOC_SCHEMA = T.StructType([
    T.StructField("analysis_col", T.StringType()), T.StructField("predictor_col", T.StringType()),
    T.StructField("analysis_type", T.StringType()), T.StructField("predictor_type", T.StringType()),
    T.StructField("pair_type", T.StringType()), T.StructField("n_used", T.LongType()),
    T.StructField("analysis_excluded_n", T.LongType()), T.StructField("predictor_missing_n", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("test_name", T.StringType()), T.StructField("test_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("effect_size_name", T.StringType()),
    T.StructField("effect_size", T.DoubleType()), T.StructField("p_value_note", T.StringType()),
    T.StructField("leakage_flag", T.BooleanType()),
])


def target_type(df: DataFrame, target: str, catalog=None) -> str:
    """Binary (boolean or two levels) / continuous (numeric, > 2 levels) / categorical."""
    t = df.schema[target].dataType
    if isinstance(t, T.BooleanType):
        return "binary"
    info = {c["column"]: c for c in (catalog or column_catalog(df, [target]))}[target]
    if info["n_unique"] == 2:
        return "binary"
    if isinstance(t, T.NumericType) and info["n_unique"] > 2:
        return "continuous"
    return "categorical"


def binary_code(df: DataFrame, target: str):
    """Target as 0/1 the way a categorical code would number it: the smaller level is 0."""
    t = df.schema[target].dataType
    y = F.col(target)
    if isinstance(t, T.BooleanType):
        return y.cast("int")
    lv = sorted(r[0] for r in df.where(y.isNotNull()).select(y).distinct().limit(3).collect())
    if len(lv) != 2:
        return F.lit(None).cast("int")
    return F.when(y == F.lit(lv[0]), 0).when(y == F.lit(lv[1]), 1)


def numeric_aggs(cols, y_num):
    """C9 + T1/T2 aggregates: per numeric predictor, over pairwise-complete rows,
    the pair count, x and y ranges (the ≥ 2 distinct values test) and r."""
    aggs = []
    for j, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        both = x.isNotNull() & y_num.isNotNull()
        xc = F.when(both, x)
        aggs += [F.count_if(both).alias(f"xn{j}"), F.min(xc).alias(f"lo{j}"), F.max(xc).alias(f"hi{j}"),
                 F.min(F.when(both, y_num)).alias(f"ylo{j}"), F.max(F.when(both, y_num)).alias(f"yhi{j}"),
                 F.corr(xc, F.when(both, y_num)).alias(f"r{j}")]
    return aggs


def numeric_row(row, j) -> dict:
    return {"n": int(row[f"xn{j}"]), "lo": row[f"lo{j}"], "hi": row[f"hi{j}"], "ylo": row[f"ylo{j}"],
            "yhi": row[f"yhi{j}"], "r": row[f"r{j}"]}


def contingency_cells(df: DataFrame, target: str, cols) -> DataFrame:
    """T3 for all predictors at once: ``(column, y, x, n)`` over pairwise-complete rows."""
    y = F.col(target).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("x")) for c in cols])
    long = (df.select(y.alias("y"), F.explode(cells).alias("_c"))
            .select("_c.column", "y", "_c.x").where(F.col("y").isNotNull() & F.col("x").isNotNull()))
    return long.groupBy("column", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def chi_square(cells: DataFrame, yates: bool = True) -> DataFrame:
    """Per column: n, R, C, chi2 (Yates for 2×2 when ``yates``) and the smallest
    expected count (smallest row margin × smallest column margin / n)."""
    rows_t = cells.groupBy("column", "y").agg(F.sum("n").alias("r"))
    cols_t = cells.groupBy("column", "x").agg(F.sum("n").alias("c"))
    tot = cells.groupBy("column").agg(F.sum("n").alias("n_tot"))
    rsum = rows_t.groupBy("column").agg(F.count(F.lit(1)).alias("R"), F.sum(1.0 / F.col("r")).alias("inv_r"),
                                        F.min("r").alias("r_min"))
    csum = cols_t.groupBy("column").agg(F.count(F.lit(1)).alias("C"), F.sum(1.0 / F.col("c")).alias("inv_c"),
                                        F.min("c").alias("c_min"))
    # in doubles: products of counts outgrow a long; per-predictor sides are one row per predictor
    N = F.col("n_tot").cast("double")
    e = F.col("r").cast("double") * F.col("c").cast("double") / N
    off = F.col("n").cast("double") - F.col("e")
    j = (cells.join(rows_t, ["column", "y"]).join(cols_t, ["column", "x"]).join(F.broadcast(tot), "column")
         .withColumn("e", e))
    obs = j.groupBy("column").agg(
        F.sum(off * off / F.col("e")).alias("seen"), F.sum("e").alias("mass"),
        F.max(F.abs(off)).alias("d"),
        F.count(F.lit(1)).alias("n_obs_cells"))
    out = obs.join(F.broadcast(tot), "column").join(F.broadcast(rsum), "column").join(F.broadcast(csum), "column")
    full = F.col("n_obs_cells") == F.col("R") * F.col("C")
    # an empty cell adds its expected count
    plain = F.col("seen") + F.when(full, F.lit(0.0)).otherwise(F.greatest(N - F.col("mass"), F.lit(0.0)))
    yform = (F.pow(F.col("d") - F.least(F.lit(0.5), F.col("d")), 2) * N * F.col("inv_r") * F.col("inv_c"))
    chi2 = F.when((F.col("R") == 2) & (F.col("C") == 2) & F.lit(yates), yform).otherwise(plain)
    return out.select(
        "column", F.col("n_tot").alias("n"), F.col("R").alias("n_rows_levels"), F.col("C").alias("n_cols_levels"), F.greatest(chi2, F.lit(0.0)).alias("chi2"),
        (F.col("r_min").cast("double") * F.col("c_min").cast("double") / N).alias("min_expected"), "n_obs_cells")


def expected_share_below(cells: DataFrame, threshold: float = 5.0) -> DataFrame:
    """I8: share of all R×C cells whose expected count is below ``threshold``.

    Each column margin c_j is compared with the predictor's row margins (the
    target's levels: a short array per predictor), so no level pairs are built.
    """
    rows_t = cells.groupBy("column", "y").agg(F.sum("n").alias("r"))
    cols_t = cells.groupBy("column", "x").agg(F.sum("n").alias("c"))
    per = rows_t.groupBy("column").agg(F.collect_list("r").alias("rs"), F.sum("r").alias("n_tot"))
    j = cols_t.join(F.broadcast(per), "column")  # one row per predictor
    below = F.size(F.filter("rs", lambda r: r.cast("double") * F.col("c").cast("double") < F.lit(threshold) * F.col("n_tot").cast("double")))
    return j.groupBy("column").agg(
        (F.sum(below) / F.sum(F.size("rs"))).alias("pct_expected_lt5"),
        F.sum(F.size("rs")).alias("n_cells"))


def associations(df: DataFrame, target: str, predictor_types: dict, leakage_vars=()) -> DataFrame:
    """One row per predictor (17 columns, see ``ASSOC_SCHEMA``)."""
    spark = df.sparkSession
    if not isinstance(target, str) or target not in df.columns:
        raise ValueError("target must be one column of the frame")
    leak = set(leakage_vars or ())
    preds = [(c, k) for c, k in predictor_types.items() if c != target and c in df.columns]
    cat = column_catalog(df, [target])
    a_type = target_type(df, target, cat)
    y_num = binary_code(df, target) if a_type == "binary" else F.col(target).cast("double")

    num_cols = [c for c, k in preds if k in NUMERIC_KINDS and a_type in ("binary", "continuous")]
    tab_cols = [c for c, k in preds if k in TABLE_KINDS and a_type in ("binary", "categorical")
                and c not in num_cols]
    y_notnull = F.col(target).isNotNull()
    # one pass: target / predictor missing counts, complete pairs, and for the
    # numeric predictors the ranges and correlations of the complete pairs
    aggs = [F.count_if(~y_notnull).alias("__ymiss")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, (c, _) in enumerate(preds)]
    aggs += [F.count_if(F.col(f"`{c}`").isNotNull() & y_notnull).alias(f"n{i}") for i, (c, _) in enumerate(preds)]
    aggs += numeric_aggs(num_cols, y_num)
    counts = df.agg(*aggs).first()
    ymiss = int(counts["__ymiss"])
    base = {c: (int(counts[f"n{i}"]), int(counts[f"m{i}"])) for i, (c, _) in enumerate(preds)}
    nums = {c: numeric_row(counts, j) for j, c in enumerate(num_cols)}
    chis = {}
    if tab_cols:
        for r in chi_square(contingency_cells(df, target, tab_cols), yates=True).collect():
            chis[r["column"]] = r
    rows = []
    for c, kind in preds:
        n_used, pmiss = base[c]
        row = dict(analysis_col=target, predictor_col=c, analysis_type=a_type, predictor_type=kind,
                   pair_type="predictor_target", n_used=n_used, analysis_excluded_n=ymiss,
                   predictor_missing_n=pmiss, status="skipped", note=None, test_name=None, test_stat=None,
                   p_value=None, effect_size_name=None, effect_size=None,
                   leakage_flag=(target in leak) or (c in leak))
        if n_used < 10:
            row["note"] = "too_few_non_missing"
        elif kind in ("datetime", "text"):
            row["note"] = "unsupported_predictor_type"
        elif c in nums:
            s = nums[c]
            if s["lo"] is None or s["lo"] == s["hi"] or s["ylo"] is None or s["ylo"] == s["yhi"]:
                row["note"] = "too_few_unique"
            else:
                r = s["r"]
                name = "pearsonr" if a_type == "continuous" else "point_biserial"
                row.update(status="ok", test_name=name, test_stat=r, p_value=S.pearson_p(r, s["n"]),
                           effect_size_name="r", effect_size=r)
        elif c in chis:
            t = chis[c]
            R, C = t["n_rows_levels"], t["n_cols_levels"]
            if R < 2 or C < 2:
                row["note"] = "degenerate_contingency"
            else:
                dof = (R - 1) * (C - 1)
                v = math.sqrt(t["chi2"] / (t["n"] * (min(R, C) - 1)))
                row.update(status="ok", test_name="chi2", test_stat=t["chi2"], p_value=S.chi2_sf(t["chi2"], dof),
                           effect_size_name="cramers_v", effect_size=v)
        elif kind in TABLE_KINDS and a_type in ("binary", "categorical"):
            row["note"] = "degenerate_contingency"
        else:
            row["note"] = "unsupported_pair"
        row["p_value_note"] = S.p_value_note(row["p_value"], row["status"])
        rows.append(tuple(row[f.name] for f in ASSOC_SCHEMA.fields))
    return spark.createDataFrame(rows, ASSOC_SCHEMA)
