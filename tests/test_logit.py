"""The logistic grid fitted together against MLlib's own fits."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from studyframe.operators import logit, model, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(700):
        x = rng.normal(size=3)
        rows.append((k, *map(float, x), ["u", "v", "w"][k % 3], float(x[0] - 0.5 * x[1] + (k % 3 == 1) + rng.normal() > 0.8)))
    df = model.balanced_weights(spark.createDataFrame(rows, "id long, a double, b double, c double, g string, label double"), "label")
    return df.withColumn(trees.PICK, F.lit(0.5)).repartition(5)


def test_points_are_those_of_separate_fits(spark, data):
    prep = Pipeline(stages=model.preprocessor(data, ["a", "b", "c", "g"])).fit(data)
    tr, va = prep.transform(data.where("id % 4 > 0")).cache(), prep.transform(data.where("id % 4 = 0")).cache()
    lr, grid = model.logistic_candidates(tr.count())
    points = logit.fit_points(tr, [logit.Point(pm[lr.regParam], pm[lr.weightCol]) for pm in grid], 6)
    area = BinaryClassificationEvaluator(numBins=0)
    aucs = model._logistic_aucs(tr, va, 2)
    for pm, point, auc in zip(grid, points, aucs):
        fitted = lr.copy(pm).copy({lr.tol: 1e-12}).fit(tr)
        assert point.beta[:-1] == pytest.approx(fitted.coefficients.toArray(), abs=1e-4)
        assert point.beta[-1] == pytest.approx(fitted.intercept, abs=1e-4)
        assert auc == pytest.approx(area.evaluate(fitted.transform(va)), abs=1e-3)
    few = tr.where("id < 0")
    assert all(np.isnan(a) for a in model._logistic_aucs(tr, few, 1))


def test_wide_data_is_fitted_point_by_point(spark, data, monkeypatch):
    prep = Pipeline(stages=model.preprocessor(data, ["a", "g"])).fit(data)
    tr, va = prep.transform(data.where("id % 4 > 0")).cache(), prep.transform(data.where("id % 4 = 0")).cache()
    together = model._logistic_aucs(tr, va, 2)
    monkeypatch.setattr(logit, "MOST_FEATURES", 1)
    assert model._logistic_aucs(tr, va, 2) == pytest.approx(together, abs=2e-3)


def test_separable_and_one_sided_data_end(spark):
    rows = [(float(k), float(k > 50), 1.0, 1.0) for k in range(100)]
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, label double, w_one double, w_balanced double"))
    points = logit.fit_points(df, [logit.Point(1e-4, "w_one"), logit.Point(0.1, "w_balanced")], 1)
    assert all(np.isfinite(p.beta).all() and p.beta[0] > 0 for p in points)
    one = logit.fit_points(df.where("x > 50"), [logit.Point(0.1, "w_one")], 1)[0]
    assert np.isfinite(one.beta).all()


def test_preprocessing_is_fitted_once_a_fold(spark, monkeypatch):
    rows = [(i, float((i * 31) % 17), ["u", "v"][i % 2], int((i * 7919) % 100 < 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, g string, y int")
    fits, fit = [], model.ModeFill._fit
    monkeypatch.setattr(model.ModeFill, "_fit", lambda self, dataset: fits.append(1) or fit(self, dataset))
    model.run(df, "y", ["x", "g"], positive_class=1, key_cols=("id",), cv_folds=3, n_boot=200, models=("logistic_regression",))
    assert len(fits) == 4  # each fold's, and that of all training rows
