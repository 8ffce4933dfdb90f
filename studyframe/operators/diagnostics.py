"""Metrics and chart tables of a scored table ``(y int 0/1, p double[, pred int])``
(L11–L17, G2–G9).  Everything is an aggregate over the scored rows; curves use
counts per distinct score and range-bucketed running sums, never a global sort
in one task."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import infer, prefix

# The threshold grid scanned for Youden / minimum-sensitivity
# thresholds (181 points, 0.05 … 0.95) and the calibration bin edges (10 bins).
THRESHOLDS = [float(v) for v in np.linspace(0.05, 0.95, 181)]
CALIBRATION_EDGES = [float(v) for v in np.linspace(0.0, 1.0, 11)[1:-1]]


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p") -> float | None:
    """Exact ROC-AUC = U / (n1·n0) with ties counted one half."""
    vt = infer.class_value_table(scored.select(F.col(p).alias("p"), F.col(y).alias("_y")), "_y", ["p"])
    r = infer.mann_whitney(vt).first()
    if r is None or not r["n1"] or not r["n0"]:
        return None
    return r["u1"] / (r["n1"] * r["n0"])


def score_counts(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, c1, c0) per distinct score."""
    return scored.groupBy(F.col(p).alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("c1"), F.count_if(F.col(y) == 0).alias("c0"))


def _cum_above(scored: DataFrame, y: str, p: str) -> DataFrame:
    """Per distinct score: positives and negatives scored at or above it."""
    sc = score_counts(scored, y, p)
    tot = sc.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).first()
    cum = prefix.prefix_sums(sc, "p", ["c1", "c0"])
    return cum.select(
        "p", "c1", "c0",
        (F.lit(tot["n1"]) - F.col("cum_c1") + F.col("c1")).alias("tp"),
        (F.lit(tot["n0"]) - F.col("cum_c0") + F.col("c0")).alias("fp"),
        F.lit(tot["n1"]).alias("n1"), F.lit(tot["n0"]).alias("n0"))


def roc_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score plus the (0, 0) origin at +inf."""
    c = _cum_above(scored, y, p)
    pts = c.select(F.col("p").alias("threshold"), (F.col("fp") / F.col("n0")).alias("fpr"),
                   (F.col("tp") / F.col("n1")).alias("tpr"))
    origin = scored.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def pr_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, recall, precision) at every distinct score plus (recall 0, precision 1)."""
    c = _cum_above(scored, y, p)
    pts = c.select(F.col("p").alias("threshold"), (F.col("tp") / F.col("n1")).alias("recall"),
                   (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    end = scored.sparkSession.createDataFrame([(float("inf"), 0.0, 1.0)], "threshold double, recall double, precision double")
    return pts.unionByName(end)


def pr_summary(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the precision-recall curve (trapezoids between neighbouring
    thresholds) and its baseline, the prevalence."""
    at = prefix.row_index(pr_points(scored, y, p), "threshold", name="i")
    after = at.select((F.col("i") - 1).alias("i"), F.col("recall").alias("r2"), F.col("precision").alias("p2"))
    area = at.join(after, "i").agg(F.sum((F.col("recall") - F.col("r2")) * (F.col("precision") + F.col("p2")) / 2.0).alias("pr_auc"))
    prevalence = scored.agg(F.avg(F.col(y).cast("double")).alias("baseline")).first()["baseline"]
    return area.select("pr_auc", F.lit(prevalence).cast("double").alias("baseline"))


def operating_metrics(scored: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts at ``threshold`` and sensitivity / specificity
    (NULL when the denominator is zero)."""
    pred = F.col(p) >= F.lit(threshold)
    yy = F.col(y) == 1
    m = scored.agg(F.count_if(pred & yy).alias("tp"), F.count_if(pred & ~yy).alias("fp"),
                   F.count_if(~pred & ~yy).alias("tn"), F.count_if(~pred & yy).alias("fn"))
    return m.select("tp", "fp", "tn", "fn",
                    F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("sensitivity"),
                    F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp")).alias("specificity"))


def confusion_matrix(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts per (y, pred)."""
    return scored.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def brier(scored: DataFrame, y: str = "y", p: str = "p") -> float:
    """Mean squared error of the probabilities."""
    return float(scored.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("b")).first()["b"])


def threshold_scan(scored: DataFrame, y: str = "y", p: str = "p", thresholds=THRESHOLDS) -> DataFrame:
    """Per threshold t: tp, fp, tn, fn, sensitivity, specificity and Youden J of
    ``p >= t``.  One pass: scores are bucketed against the grid, counted per
    (bucket, y), and the ≤ len(grid)+1 bucket counts are summed from the top."""
    spark = scored.sparkSession
    splits = [float("-inf")] + list(thresholds) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_p", outputCol="_b")
    counted = (b.transform(scored.select(F.col(p).cast("double").alias("_p"), F.col(y).alias("_y")))
               .groupBy("_b").agg(F.count_if(F.col("_y") == 1).alias("c1"), F.count_if(F.col("_y") == 0).alias("c0"))
               .collect())
    c1 = {int(r["_b"]): int(r["c1"]) for r in counted}
    c0 = {int(r["_b"]): int(r["c0"]) for r in counted}
    n1, n0 = sum(c1.values()), sum(c0.values())
    rows = []
    above1 = above0 = 0
    k = len(thresholds)
    for i in range(k - 1, -1, -1):  # bucket i+1 holds t_i <= p < t_{i+1}
        above1 += c1.get(i + 1, 0) + (c1.get(k + 1, 0) if i == k - 1 else 0)
        above0 += c0.get(i + 1, 0) + (c0.get(k + 1, 0) if i == k - 1 else 0)
        tp, fp = above1, above0
        fn, tn = n1 - tp, n0 - fp
        sens = tp / (tp + fn) if tp + fn else None
        spec = tn / (tn + fp) if tn + fp else None
        j = sens + spec - 1.0 if sens is not None and spec is not None else None
        rows.append((i, float(thresholds[i]), tp, fp, tn, fn, sens, spec, j))
    rows.sort()
    return spark.createDataFrame(rows, "i int, threshold double, tp long, fp long, tn long, fn long, "
                                       "sensitivity double, specificity double, youden_j double")


def _best_threshold(scan: DataFrame) -> float:
    """The lowest threshold with the largest J of a scan; 0.5 if there is none."""
    best = scan.where(F.col("youden_j").isNotNull()).agg(
        F.max_by("threshold", F.struct("youden_j", (-F.col("i")).alias("first"))).alias("t")).first()
    return 0.5 if best["t"] is None else best["t"]


def youden_threshold(scan: DataFrame) -> float:
    """The threshold with the largest J."""
    return _best_threshold(scan)


def min_sensitivity_threshold(scan: DataFrame, target: float) -> float:
    """The threshold with the largest J among those that reach ``target`` sensitivity."""
    return _best_threshold(scan.where(F.col("sensitivity") >= target))


def calibration(scored: DataFrame, y: str = "y", p: str = "p", edges=CALIBRATION_EDGES) -> DataFrame:
    """10 uniform bins (bin = number of inner edges strictly below p); empty bins omitted."""
    bin_ = sum((F.col(p) > F.lit(e)).cast("int") for e in edges)
    return scored.groupBy(bin_.alias("bin")).agg(
        F.avg(F.col(y).cast("double")).alias("prob_true"), F.avg(F.col(p)).alias("prob_pred"),
        F.count(F.lit(1)).alias("n"))


def probability_histogram(scored: DataFrame, y: str = "y", p: str = "p", bins: int = 30) -> DataFrame:
    """Per class, ``bins`` equal-width bins over that class's own score range."""
    rng = scored.groupBy(F.col(y).alias("_y")).agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    # two classes → two rows: a bounded broadcast
    j = scored.select(F.col(y).alias("_y"), F.col(p).alias("_p")).join(F.broadcast(rng), "_y")
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    k = F.least(F.floor((F.col("_p") - F.col("lo")) / w), F.lit(bins - 1))
    return (j.withColumn("_w", w).withColumn("bin", k.cast("int"))
            .groupBy(F.col("_y").alias("y"), "bin").agg(
                F.min(F.col("lo") + F.col("bin") * F.col("_w")).alias("lower"),
                F.min(F.col("lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"),
                F.count(F.lit(1)).alias("n")))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest importances (the top-k is the feature)."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(n)


def metrics_long(metrics: DataFrame) -> DataFrame:
    """One-row metrics table as (metric, value) text pairs."""
    cols = [c for c in metrics.columns]
    return metrics.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in cols])).alias("m")).select("m.*")


def auc_bootstrap_ci(scored: DataFrame, n_boot: int = 1000, ci_level: float = 0.95, seed: int = 42,
                     y: str = "y", p: str = "p"):
    """BCa interval of the AUC; percentile interval when BCa is undefined.

    Replicates resample the (score, class) count table with Poisson weights.
    The acceleration uses leave-one-out AUCs, which have a closed form from each
    row's placement (negatives below a positive, positives above a negative),
    computed per distinct score from running counts.
    """
    from ..functions import stats as S
    from . import bootstrap

    vt = infer.class_value_table(scored.select(F.col(p).alias("p"), F.col(y).alias("_y")), "_y", ["p"])
    ranked = infer.ranked_values(vt).persist()
    mw = infer.mann_whitney(None, ranked).first()
    n1, n0 = int(mw["n1"]), int(mw["n0"])
    if n1 < 2 or n0 < 2:
        ranked.unpersist()
        return None, None
    auc = mw["u1"] / (n1 * n0)
    reps = bootstrap.rank_biserial_replicates(vt, n_boot, seed).withColumn("r", (F.col("r") + 1.0) / 2.0)
    vals = sorted(r["r"] for r in reps.collect())  # n_boot values
    if len(vals) < max(50, int(0.2 * n_boot)):
        return None, None
    a = (1.0 - ci_level) / 2.0

    def pct(q):
        h = (len(vals) - 1) * q
        lo = int(np.floor(h))
        hi = min(lo + 1, len(vals) - 1)
        return vals[lo] + (vals[hi] - vals[lo]) * (h - lo)

    # jackknife: placements per distinct score
    counts = vt.groupBy(F.col("value").alias("v")).agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    cum = prefix.prefix_sums(counts, "v", ["c1", "c0"])
    ranked.unpersist()
    below0 = F.col("cum_c0") - F.col("c0")
    above1 = F.lit(n1) - F.col("cum_c1")
    place_pos = below0 + 0.5 * F.col("c0")      # for each positive at this score
    place_neg = above1 + 0.5 * F.col("c1")      # for each negative at this score
    u = mw["u1"]
    th_pos = (F.lit(u) - place_pos) / F.lit(float((n1 - 1) * n0))
    th_neg = (F.lit(u) - place_neg) / F.lit(float(n1 * (n0 - 1)))
    n = n1 + n0
    mean_row = cum.agg((F.sum(F.col("c1") * th_pos) + F.sum(F.col("c0") * th_neg)).alias("s")).first()
    mbar = mean_row["s"] / n
    d = cum.agg(
        (F.sum(F.col("c1") * F.pow(F.lit(mbar) - th_pos, 3)) + F.sum(F.col("c0") * F.pow(F.lit(mbar) - th_neg, 3))).alias("m3"),
        (F.sum(F.col("c1") * F.pow(F.lit(mbar) - th_pos, 2)) + F.sum(F.col("c0") * F.pow(F.lit(mbar) - th_neg, 2))).alias("m2"),
    ).first()
    frac = sum(1 for v in vals if v < auc) / len(vals)
    if d["m2"] and d["m2"] > 0 and 0.0 < frac < 1.0:
        acc = d["m3"] / (6.0 * d["m2"] ** 1.5)
        z0 = S.norm_ppf(frac)
        out = []
        for q in (a, 1.0 - a):
            zq = S.norm_ppf(q)
            adj = z0 + (z0 + zq) / (1.0 - acc * (z0 + zq))
            out.append(pct(min(1.0, max(0.0, 1.0 - S.norm_sf(adj)))))
        if all(np.isfinite(out)):
            return out[0], out[1]
    return pct(a), pct(1.0 - a)
