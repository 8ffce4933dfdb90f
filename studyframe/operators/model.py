"""Predictive modelling on MLlib.

Randomness comes from hashes of a stable row key, never from ``rand()`` over
unordered partitions, so the split and the folds are the same after any
repartitioning or recomputation.  Cross-validation runs as Spark jobs with a
fold column; every metric is an aggregate over a scored ``(y, p)`` table.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard
from . import diagnostics as D
from . import infer, logit, ranks, trees

MOST_CLASSES = 100  # a column with more values is refused as a class label
HASH_SPACE = 1 << 52  # hashes folded into exactly representable doubles


# ----------------------------------------------------------------- L1, L7, L8 folds

def _hash01(key_cols, seed: int):
    return F.pmod(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(int(seed))), F.lit(HASH_SPACE)).cast("double")


def _class_cutoffs(df: DataFrame, y: str, h: str, fractions) -> dict:
    """Per class label: for each fraction f, (hash value at rank ⌊f·n + ½⌋ − 1, ⌊f·n + ½⌋),
    exact order statistics by narrowing brackets."""
    labels = sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect())
    if len(labels) > MOST_CLASSES:
        raise ValueError(f"{y} has more than {MOST_CLASSES} classes; it is no class label")
    # the hashes of each class, as a column of its own
    hashes = {f"c{i}": F.when(F.col(y) == F.lit(lb), F.col(h)) for i, lb in enumerate(labels)}

    def rank(fr, n):
        return max(0, min(n - 1, int(math.floor(fr * n + 0.5)) - 1))

    got = ranks.select(df, hashes, fractions, lambda _, n: {rank(fr, n) for fr in fractions})
    out = {}
    for lb, c in zip(labels, hashes):
        n = got[c].n
        if n:
            out[lb] = [(got[c].value(rank(fr, n)), int(math.floor(fr * n + 0.5))) for fr in fractions]
    return out


def stratified_split(df: DataFrame, y: str, key_cols, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """L1: drop NULL targets; mark ``_test`` for the ``test_size`` share of each class
    with the smallest hash of the row key (exact count per class)."""
    d = df.where(F.col(y).isNotNull()).withColumn("_h", _hash01(key_cols, seed))
    cuts = _class_cutoffs(d, y, "_h", [test_size])
    test = F.lit(False)
    for lb, [(cut, k)] in cuts.items():
        if k > 0 and cut is not None:
            test = F.when(F.col(y) == F.lit(lb), F.col("_h") <= F.lit(cut)).otherwise(test)
    return d.withColumn("_test", test).drop("_h")


def fold_column(df: DataFrame, y: str, key_cols, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified folds: within each class, fold j holds hash ranks in [j/k, (j+1)/k)."""
    d = df.withColumn("_hf", _hash01(key_cols, seed + 1))
    fr = [j / k for j in range(1, k)]
    cuts = _class_cutoffs(d, y, "_hf", fr)
    fold = F.lit(0)
    for lb, pts in cuts.items():
        f = sum((F.col("_hf") > F.lit(v)).cast("int") for v, _ in pts if v is not None)
        fold = F.when(F.col(y) == F.lit(lb), f).otherwise(fold)
    return d.withColumn(name, fold.cast("int")).drop("_hf")


def balanced_weights(df: DataFrame, y: str, name: str = "w_balanced") -> DataFrame:
    """Weight n / (2 · n_class); the class counts are two numbers."""
    counts = {r[0]: int(r[1]) for r in df.groupBy(y).count().collect()}
    n = sum(counts.values())
    w = F.lit(None).cast("double")
    for lb, c in counts.items():
        w = F.when(F.col(y) == F.lit(lb), F.lit(n / (len(counts) * c))).otherwise(w)
    return df.withColumn(name, w).withColumn("w_one", F.lit(1.0))


# ----------------------------------------------------------------- L2, L3 preprocessing

class ModeFill(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULLs of string columns with their most frequent value (ties → smallest)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        from .impute import modes
        return ModeFillModel(inputCols=self.getInputCols(), fills=json.dumps(modes(dataset, self.getInputCols())))


class MedianFill(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULLs of numeric columns with their exact median (0 for a column without values)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        from .impute import medians
        known = medians(dataset, self.getInputCols())
        return ModeFillModel(inputCols=self.getInputCols(), fills=json.dumps({c: known.get(c, 0.0) for c in self.getInputCols()}))


class ModeFillModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "JSON map column → fill value", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        fills = json.loads(self.getOrDefault(self.fills))
        return dataset.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in fills.items()})


def preprocessor(df: DataFrame, predictors):
    """Stages turning predictors into ``features``: numeric/boolean → median fill →
    standardise; text/categorical → mode fill → index → one-hot (an unseen level is all zeros)."""
    num = [c for c in predictors if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    cat = [c for c in predictors if c not in num]
    stages, vec = [], []
    if num:
        cast = [f"_n_{c}" for c in num]
        stages.append(_cast_double_stage(num, cast))
        stages.append(MedianFill(inputCols=cast))
        stages.append(VectorAssembler(inputCols=cast, outputCol="_num_vec"))
        stages.append(StandardScaler(inputCol="_num_vec", outputCol="_num_std", withMean=True, withStd=True))
        vec.append("_num_std")
    if cat:
        stages.append(ModeFill(inputCols=cat))
        stages.append(StringIndexer(inputCols=cat, outputCols=[f"_ix_{c}" for c in cat], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_ix_{c}" for c in cat], outputCols=[f"_oh_{c}" for c in cat],
                                    dropLast=True))  # the last index is the unseen level's
        vec += [f"_oh_{c}" for c in cat]
    stages.append(VectorAssembler(inputCols=vec, outputCol="features"))
    return stages


def _cast_double_stage(cols, outs):
    from pyspark.ml.feature import SQLTransformer
    sel = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{o}`" for c, o in zip(cols, outs))
    return SQLTransformer(statement=f"SELECT *, {sel} FROM __THIS__")


# ----------------------------------------------------------------- L4–L6 candidates

FAMILIES = ("logistic_regression", "random_forest", "gradient_boosting")


def logistic_candidates(n_train: int):
    """L4: the classifier and its grid.  C maps to regParam = 1/(C·n), n of the rows fitted."""
    # The searched grid.
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=3000, probabilityCol="probability",
                            standardization=False)  # the penalty is on the encoded columns as they are
    return lr, (ParamGridBuilder()
                .addGrid(lr.regParam, [1.0 / (c * max(n_train, 1)) for c in (0.1, 1.0, 10.0)])
                .addGrid(lr.weightCol, ["w_one", "w_balanced"]).build())


def tree_candidates(family: str, seed: int = 42, fit_rows: int = 0) -> list[trees.TreesClassifier]:
    """One unfitted classifier a grid point; all rows are fitted unless ``fit_rows`` says how many."""
    grid = trees.FOREST_GRID if family == "random_forest" else trees.BOOST_GRID
    return [trees.TreesClassifier(family=family, points=json.dumps(p), seed=seed, fitRows=fit_rows) for p in trees.grid_points(grid)]


def _p1():
    return vector_to_array(F.col("probability")).getItem(1)


def _params_text(clf) -> str:
    if isinstance(clf, trees.TreesClassifier):
        return json.dumps(json.loads(clf.getOrDefault("points")), sort_keys=True)
    return json.dumps({"regParam": round(clf.getRegParam(), 12), "weightCol": clf.getWeightCol()}, sort_keys=True)


def run(df: DataFrame, target: str, predictors, positive_class, key_cols=("row_id",), test_size: float = 0.2,
        cv_folds: int = 5, n_boot: int = 1000, ci_level: float = 0.95, threshold_strategy: str = "youden",
        min_sensitivity_target: float = 0.75, random_state: int = 42, parallelism: int = 4,
        models=FAMILIES) -> dict:
    """L20 (L13 fixed 0.5, L11/L12 scanned thresholds): split → grid search per
    model family → pick best mean AUC → threshold from out-of-fold probabilities
    → held-out metrics.  Returns DataFrames:
    comparison, metrics, importance, scored_test, plus the fitted model.

    All families are searched and fitted on all training rows."""
    wrong = [text for text, ok in (("test_size is below one half and above 0", 0 < test_size < 0.5), ("cv_folds is 3 or more", cv_folds >= 3),
                                   ("n_boot is 200 or more", n_boot >= 200)) if not ok]
    if wrong:
        raise ValueError("needed: " + "; ".join(wrong))
    if threshold_strategy not in ("youden", "min_sensitivity", "fixed"):
        raise ValueError("threshold_strategy must be youden, min_sensitivity or fixed")
    spark = df.sparkSession
    from .govern import encode_binary
    y01, _, _ = encode_binary(df, target, positive_class)
    base = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*key_cols, *predictors])], y01.alias("label"))
    base = base.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    split = stratified_split(base, "label", key_cols, test_size, random_state)
    train = split.where(~F.col("_test")).drop("_test")
    test = split.where(F.col("_test")).drop("_test")
    train = fold_column(balanced_weights(train, "label"), "label", key_cols, cv_folds, random_state)
    train = train.withColumn(trees.PICK, _hash01(key_cols, random_state + 2) / float(HASH_SPACE))
    train = train.checkpoint(eager=True)  # reused by every fit: cut lineage once
    n_train = train.count()
    pre = preprocessor(train, list(predictors))
    comparison, fitted, preps = grid_search(train, pre, cv_folds, parallelism, [m for m in FAMILIES if m in models], random_state)
    comp_df = spark.createDataFrame(comparison, "model_name string, best_cv_auc_mean double, "
                                                "best_cv_auc_std double, best_params string")
    best_name = comparison[0][0]
    best_clf = fitted[best_name]
    best_pipe = Pipeline(stages=pre + [best_clf])
    best_model = best_pipe.fit(train)
    warning = gap_warning(comparison)

    if threshold_strategy == "fixed":
        threshold = 0.5
    else:
        oof = out_of_fold(train, best_clf, preps, parallelism)
        scan = D.threshold_scan(oof, "label", "p")
        threshold = (D.youden_threshold(scan) if threshold_strategy == "youden"
                     else D.min_sensitivity_threshold(scan, min_sensitivity_target))

    scored = score(best_model, test, [*key_cols, F.col("label").cast("int").alias("y")])
    scored = scored.withColumn("pred", (F.col("p") >= F.lit(threshold)).cast("int")).checkpoint(eager=True)
    auc = D.roc_auc(scored)
    lo, hi = D.auc_bootstrap_ci(scored, n_boot, ci_level, random_state)
    om = D.operating_metrics(scored, threshold).first()
    metrics = spark.createDataFrame([(
        best_name, threshold_strategy, float(threshold), auc, lo, hi, D.brier(scored),
        om["sensitivity"], om["specificity"], int(om["tp"]), int(om["fp"]), int(om["tn"]), int(om["fn"]),
        int(n_train), int(scored.count()))],
        "selected_model string, threshold_strategy string, threshold double, test_auc double, "
        "test_auc_ci_low double, test_auc_ci_high double, test_brier double, test_sensitivity double, "
        "test_specificity double, test_tp long, test_fp long, test_tn long, test_fn long, n_train long, n_test long")
    return {"comparison": comp_df, "metrics": metrics, "importance": feature_importance(best_model, spark),
            "scored_test": scored, "model": best_model, "warning": warning, "cv_folds": cv_folds,
            "n_points": {m: len(logistic_candidates(1)[1]) if m == "logistic_regression" else len(tree_candidates(m)) for m in FAMILIES if m in models}}


def _logistic_aucs(tr: DataFrame, va: DataFrame, parallelism: int) -> list[float]:
    """Exact held-out AUC of every logistic point, fitted on ``tr``."""
    lr, grid = logistic_candidates(tr.count())
    first = tr.select("features").first()
    if first is not None and first[0].size <= logit.MOST_FEATURES:
        points = logit.fit_points(tr, [logit.Point(pm[lr.regParam], pm[lr.weightCol]) for pm in grid], first[0].size)
        names = [f"s{k}" for k in range(len(points))]
        held = logit.scores(va, points).withColumn("_y", F.col("label").cast("int"))
        got = {r["column"]: r for r in infer.mann_whitney(infer.class_value_table(held, "_y", names)).collect()}
        return [float(got[c]["u1"] / (got[c]["n1"] * got[c]["n0"])) if c in got and got[c]["n1"] and got[c]["n0"] else math.nan for c in names]
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda pm: evaluator.evaluate(lr.copy(pm).fit(tr).transform(va)), grid))


def gap_warning(comparison: list[tuple]) -> str | None:
    """Set where the best mean AUC leads the second by less than half its standard deviation."""
    if len(comparison) >= 2 and comparison[0][1] - comparison[1][1] < comparison[0][2] / 2:
        return f"top-2 AUC gap below half the winner's CV sd: {comparison[0][0]} over {comparison[1][0]} is not conclusive"
    return None


def grid_search(train: DataFrame, pre, k: int, parallelism: int, models, seed: int = 42):
    """Stratified k-fold grid search on ROC-AUC.

    Preprocessing has no searched parameters, so it is fitted once per fold and
    the fold's feature vectors are cached.  The logistic points of a fold are fitted on them
    together (``logit.fit_points``); the points of both tree families, in all folds, are grown by
    one job over all rows of the folds (``trees.store``, ``trees.search``).  Every point is scored on the
    whole held-out fold with the exact AUC.  ``parallelism`` folds run at a time, so that the many small jobs of
    one fill the gaps of another.  Returns comparison rows (best mean, sd, params) sorted by
    mean AUC, the best classifier per family, unfitted, and the fitted preprocessing of each fold.
    """
    n_train = train.count()
    wooded = [m for m in models if m != "logistic_regression"]
    points: dict[str, list] = {m: tree_candidates(m, seed) for m in wooded}
    if "logistic_regression" in models:
        lr, grid = logistic_candidates(n_train)
        points["logistic_regression"] = [lr.copy(pm) for pm in grid]
    scores = {(name, i): [] for name, grid in points.items() for i in range(len(grid))}
    keep = ["features", "label", "w_one", "w_balanced", trees.PICK]
    weights = {r["label"]: r["w"] for r in train.groupBy("label").agg(F.max("w_balanced").alias("w")).collect()}

    def one_fold(f: int):
        prep = Pipeline(stages=list(pre)).fit(train.where(F.col("fold") != f))
        wood, aucs = None, []
        tr = prep.transform(train.where(F.col("fold") != f)).select(*keep).persist()
        va = prep.transform(train.where(F.col("fold") == f)).select(*keep).persist()
        try:
            if wooded:
                wood = trees.store(tr, va, (weights.get(0.0, 0.0), weights.get(1.0, 0.0)))
            if "logistic_regression" in models:
                aucs = _logistic_aucs(tr, va, parallelism)
        finally:
            tr.unpersist()
            va.unpersist()
        return prep, wood, aucs

    ran = _side_by_side(one_fold, k, parallelism)
    for _, _, aucs in ran:
        for i, auc in enumerate(aucs):
            scores["logistic_regression", i].append(auc)
    folds = [wood for _, wood, _ in ran if wood is not None]
    scores |= trees.search(train.sparkSession, folds, wooded, seed)
    for wood in folds:
        discard(wood.blocks)
    rows, best = [], {}
    for name in models:
        stats = []
        for i, clf in enumerate(points[name]):
            v = scores[name, i]
            mean = sum(v) / len(v)
            sd = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5
            stats.append((-1.0 if math.isnan(mean) else mean, -i, mean, sd))
        _, i, mean, sd = max(stats)
        best[name] = points[name][-i]
        rows.append((name, float(mean), float(sd), _params_text(best[name])))
    rows.sort(key=lambda r: -1.0 if math.isnan(r[1]) else r[1], reverse=True)
    return rows, best, [prep for prep, _, _ in ran]


def _side_by_side(work, k: int, parallelism: int) -> list:
    """``work`` of the folds 0 to k-1, ``parallelism`` of them at a time; results in order of the folds."""
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        return list(pool.map(work, range(k)))


def out_of_fold(train: DataFrame, clf, preps: list, parallelism: int = 4) -> DataFrame:
    """One refit of ``clf`` a fold, on the fold's fitted preprocessing, each scoring its
    held-out fold; union of the scored folds."""

    def one_fold(f: int) -> DataFrame:
        m = clf.fit(preps[f].transform(train.where(F.col("fold") != f)))
        held = preps[f].transform(train.where(F.col("fold") == f))
        return m.transform(held).select(F.col("label").cast("int").alias("label"), _p1().alias("p"))

    parts = None
    for s in _side_by_side(one_fold, len(preps), parallelism):
        parts = s if parts is None else parts.unionByName(s)
    return parts


def feature_importance(pipeline_model, spark) -> DataFrame:
    """Tree importances or |coefficients| by encoded feature name."""
    clf = pipeline_model.stages[-1]
    names = _feature_names(pipeline_model)
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in clf.coefficients.toArray().tolist()]
    if len(names) != len(vals):
        raise ValueError(f"{len(vals)} coefficients for {len(names)} features")
    return spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")


def _feature_names(pipeline_model) -> list[str]:
    # numeric inputs first (assembled in order), then one-hot blocks
    num, cat_sizes = [], []
    for st in pipeline_model.stages:
        cls = type(st).__name__
        if cls == "VectorAssembler" and st.getOutputCol() == "_num_vec":
            num = [c[len("_n_"):] for c in st.getInputCols()]
        if cls == "StringIndexerModel":
            cat_sizes = list(zip(st.getInputCols(), st.labelsArray))
    names = list(num)
    for col, labels in cat_sizes:
        names += [f"{col}={lb}" for lb in labels]  # dropLast leaves exactly the seen labels
    return names


def score(fitted, df: DataFrame, keep) -> DataFrame:
    """The columns ``keep`` and the probability ``p`` of the positive class, of a fitted or loaded pipeline."""
    return fitted.transform(df).select(*keep, _p1().alias("p"))


def scored_from_columns(df: DataFrame, y_col: str, p_expr, threshold: float = 0.5) -> DataFrame:
    """A scored table ``(y, p, pred)`` from existing columns."""
    return df.select(F.col(y_col).cast("int").alias("y"), p_expr.cast("double").alias("p")).withColumn(
        "pred", (F.col("p") >= F.lit(threshold)).cast("int"))

