"""Forests and boosting of a whole grid: what points share, plain MLlib as a yardstick, saved models, the registry."""

import json
import math
import uuid

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from studyframe.operators import model, trees
from studyframe.sources import registry


def sample(n, seed, p=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 5:] = x[:, 5:] > 0.7
    y = (x[:, 0] + x[:, 1] * x[:, 2] + x[:, 5] + rng.normal(size=n) * 0.6 > 0.4).astype(float)
    return x, y


def test_bins_split_where_values_do():
    few = np.array([3.0, 1.0, 1.0, 2.0, 7.0])
    assert trees.cut_values(few).tolist() == [1.5, 2.5, 5.0]
    assert trees.cut_values(np.ones(4)).tolist() == []
    many = np.r_[np.arange(1000.0), np.full(500, 5000.0)]
    cuts = trees.cut_values(many)
    assert len(cuts) < trees.BINS and (np.diff(cuts) > 0).all() and cuts[-1] < 5000 and not np.isin(cuts, many).any()
    data = trees.binned(many[:, None], np.zeros(1500), np.ones(1500))
    assert data.x.max() == len(cuts) and np.bincount(data.x[:, 0]).max() == 500


def test_forest_batches_limits_and_counts_share_their_trees():
    x, y = sample(400, 1)
    data = trees.binned(x, y, trees.balanced(y))
    held = data.of(sample(90, 2)[0])
    whole = trees.ForestBatch(data, np.ones(400), 3, range(12), 2, None, held, [2, 4])
    alone = [trees.ForestBatch(data, np.ones(400), 3, range(k, k + 1), 2, None, held, [2, 4]) for k in range(12)]
    for mark in (2, 4, None):
        assert np.allclose(whole.marked[mark], sum(a.marked[mark] for a in alone))
        limited = trees.ForestBatch(data, np.ones(400), 3, range(12), 2, mark, held, [])
        assert np.allclose(limited.marked[None], whole.marked[mark])
    for t, a in zip(whole.trees(), alone):
        b = a.trees()[0]
        assert all(np.array_equal(t[k], b[k]) for k in ("feature", "cut", "left", "value"))


def test_forest_leaves_and_odd_samples():
    x, y = sample(300, 4)
    data = trees.binned(x, y, np.ones(300))
    for leaf in (1, 5, 40):
        batch = trees.ForestBatch(data, np.ones(300), 1, range(3), leaf, None, None)
        for t, tree in enumerate(batch.trees()):
            rows = np.unique(np.random.default_rng([1, t]).integers(0, 300, 300))
            at = np.zeros(len(rows), int)
            for _ in range(60):
                inner = tree["left"][at] >= 0
                at = np.where(inner, tree["left"][at] + (x[rows, tree["feature"][at]] > tree["cut"][at]), at)
            assert np.bincount(at)[np.unique(at)].min() >= leaf
            assert abs(tree["importance"].sum() - 1) < 1e-9
    for odd_x, odd_y in ((x, np.ones(300)), (np.zeros((300, 3)), y), (np.zeros((300, 0)), y), (x[:1], y[:1])):
        odd = trees.binned(odd_x, odd_y, np.ones(len(odd_y)))
        got = trees.ForestBatch(odd, np.ones(len(odd_y)), 1, range(2), 1, None, odd.of(odd_x), [8])
        assert np.isfinite(got.marked[8]).all() and all(len(t["feature"]) == 1 for t in got.trees())
        _, kept, marked = trees.boost(odd, 3, 0.1, 2, odd.of(odd_x), (3,), keep=True)
        assert np.isfinite(marked[3]).all() and len(kept) == 3


def test_boosting_takes_the_best_split_and_newton_leaves():
    x, y = sample(200, 7)
    x = x[:, :4]
    w = trees.balanced(y)
    x = np.round(x, 1)
    data = trees.binned(x, y, w)
    start, kept, marked = trees.boost(data, 2, 0.1, 1, data.x, (1, 2), keep=True)
    p = (w * y).sum() / w.sum()
    assert start == pytest.approx(math.log(p / (1 - p)))
    r = y - p
    best = (-1.0, None)
    for j in range(4):
        for c in trees.cut_values(x[:, j]):
            go = x[:, j] <= c
            gain = w[go].sum() * w[~go].sum() / w.sum() * (np.average(r[go], weights=w[go]) - np.average(r[~go], weights=w[~go])) ** 2
            if gain > best[0] + 1e-12:
                best = (gain, (j, c, go))
    j, c, go = best[1]
    assert (kept[0]["feature"][0], kept[0]["cut"][0]) == (j, c)
    for side, leaf in ((go, 1), (~go, 2)):
        assert kept[0]["value"][leaf] == pytest.approx(0.1 * (w * r)[side].sum() / (w[side] * p * (1 - p)).sum())
    assert marked[1][go] == pytest.approx(start + kept[0]["value"][1])


def test_auc_with_ties():
    y, s = np.array([1, 0, 1, 0, 0]), np.array([0.5, 0.5, 0.9, 0.1, 0.5])
    assert trees.auc(y, s) == pytest.approx(sum((a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]) / 6)
    assert math.isnan(trees.auc(np.ones(3), s[:3]))


@pytest.fixture(scope="module")
def rows(spark):
    x, y = sample(900, 11)
    data = [(k, *map(float, r[:5]), "a" if r[5] else "b", float(c)) for k, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, x0 double, x1 double, x2 double, x3 double, x4 double, g string, y double")
    return df.withColumn("x3", F.when(F.col("id") % 9 != 0, F.col("x3")))


PREDICTORS = ["x0", "x1", "x2", "x3", "x4", "g"]


def test_one_point_of_each_family_is_as_good_as_plain_mllib(spark, rows):
    df = model.balanced_weights(rows.withColumnRenamed("y", "label"), "label").withColumn(trees.PICK, model._hash01(["id"], 1) / float(model.HASH_SPACE))
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    pre = Pipeline(stages=model.preprocessor(train, PREDICTORS)).fit(train)
    train, test = pre.transform(train).cache(), pre.transform(test).cache()

    def area(fitted):
        scored = fitted.transform(test).select("label", model._p1().alias("p")).toPandas()
        return trees.auc(scored["label"].to_numpy(), scored["p"].to_numpy())

    forest = trees.TreesClassifier(family="random_forest", points=json.dumps({"n_estimators": 200, "max_depth": 8, "min_samples_leaf": 3, "class_weight": None})).fit(train)
    plain = RandomForestClassifier(numTrees=60, maxDepth=8, minInstancesPerNode=3, seed=1).fit(train)
    ours, theirs = area(forest), area(plain)
    assert ours > theirs - 0.02, (ours, theirs)
    assert int(np.argmax(forest.featureImportances.toArray())) == int(np.argmax(plain.featureImportances.toArray()))
    boosted = trees.TreesClassifier(family="gradient_boosting", points=json.dumps({"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3})).fit(train)
    plain = GBTClassifier(maxIter=30, stepSize=0.3, maxDepth=3, weightCol="w_balanced", seed=1).fit(train)
    ours, theirs = area(boosted), area(plain)
    assert ours > theirs - 0.02, (ours, theirs)
    # the sample is bounded, the scores are those of all rows
    small = trees.TreesClassifier(family="random_forest", points=json.dumps({"n_estimators": 20, "max_depth": None, "min_samples_leaf": 1, "class_weight": "balanced"}), fitRows=100)
    x, y, _ = trees.collect_sample(train, 100)
    assert 60 < len(y) < 140 and small.fit(train).transform(test).count() == test.count()
    # rows come in any order
    again = trees.TreesClassifier(family="gradient_boosting", points=json.dumps({"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3})).fit(train.repartition(5))
    assert all(np.array_equal(a, b) for a, b in zip(again._forest(), boosted._forest()))


def test_search_scores_every_point_like_a_fit_of_its_own(spark):
    x, y = sample(240, 21)
    vx, vy = sample(120, 22)
    data = trees.binned(x, y, trees.balanced(y))
    held = data.of(vx)
    got = trees.search(spark, [(data, held, vy)] * 2, ["random_forest", "gradient_boosting"], 5)
    assert sum(f == "random_forest" for f, _ in got) == 36 and sum(f == "gradient_boosting" for f, _ in got) == 8
    assert all(len(v) == 2 and v[0] == v[1] and 0.5 < v[0] <= 1 for v in got.values())
    for i, p in enumerate(trees.grid_points(trees.FOREST_GRID)):
        if i in (0, 7, 16, 35):
            weights = trees.balanced(y) if p["class_weight"] else np.ones(len(y))
            alone = trees.ForestBatch(data, weights, 5, range(p["n_estimators"]), p["min_samples_leaf"], p["max_depth"], held).marked[None]
            assert got["random_forest", i][0] == pytest.approx(trees.auc(vy, np.round(alone, 9)), abs=1e-9)
    for i, p in enumerate(trees.grid_points(trees.BOOST_GRID)):
        raw = trees.boost(data, p["n_estimators"], p["learning_rate"], p["max_depth"], held, (p["n_estimators"],))[2][p["n_estimators"]]
        assert got["gradient_boosting", i][0] == pytest.approx(trees.auc(vy, np.round(raw, 9)), abs=1e-9)


def test_gap_rule_both_ways():
    assert model.gap_warning([("a", 0.9, 0.02, ""), ("b", 0.895, 0.01, "")]) is not None
    assert model.gap_warning([("a", 0.9, 0.02, ""), ("b", 0.88, 0.5, "")]) is None
    assert model.gap_warning([("a", 0.9, 0.02, "")]) is None


def test_full_run_registry_and_saved_model(spark, rows):
    # runs of earlier sessions stay in a shared folder: the name makes this one new
    task, params = f"trees test {uuid.uuid4().hex}", {"cv_folds": 3, "n_boot": 200, "random_state": 7}
    key = registry.key_of(rows, params)
    assert key == registry.key_of(rows.repartition(6), params)
    assert key != registry.key_of(rows.where("id > 0"), params) and key != registry.key_of(rows, params | {"cv_folds": 4})
    assert registry.find(spark, task, key) is None
    result = model.run(rows, "y", PREDICTORS, positive_class=1.0, key_cols=("id",), threshold_strategy="min_sensitivity", **params)
    assert [r.model_name for r in result["comparison"].collect()] != [] and result["comparison"].count() == 3
    order = [r.best_cv_auc_mean for r in result["comparison"].collect()]
    assert order == sorted(order, reverse=True) and min(order) > 0.6
    path = registry.publish(spark, task, key, result, params)
    assert registry.find(spark, task, key).rstrip("/").endswith(path.split("/")[-1])
    then = {r.id: r.p for r in registry.table(spark, path, "scored_test").collect()}
    now = {r.id: r.p for r in model.score(registry.fitted(path), rows, ["id"]).collect()}
    assert len(now) == 900 and len(then) == 180 and all(now[k] == pytest.approx(v, abs=1e-12) for k, v in then.items())
    # also where a tree family was not the best
    forest = Pipeline(stages=[*model.preprocessor(rows, PREDICTORS), model.tree_candidates("random_forest", 7, 300)[4]]).fit(rows.withColumn("label", F.col("y")))
    forest.write().overwrite().save(f"{path}/forest")
    from pyspark.ml import PipelineModel
    a = {r.id: r.p for r in model.score(forest, rows, ["id"]).collect()}
    assert a == {r.id: r.p for r in model.score(PipelineModel.load(f"{path}/forest"), rows, ["id"]).collect()}
    assert model.feature_importance(forest, spark).count() == 7
    # a run without its manifest is not complete
    other = registry.key_of(rows, {"other": 1})
    result["comparison"].write.parquet(f"{registry._home(spark, task, other)}/x/comparison")
    assert registry.find(spark, task, other) is None


def test_histograms_are_as_wide_as_the_features(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 2, (100, 36)).astype(float), rng.integers(0, 2, 100).astype(float)
    data, cells, bincount = trees.binned(x, y, np.ones(100)), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda a, weights=None, minlength=0: cells.append(minlength) or bincount(a, weights, minlength))
    batch = trees.ForestBatch(data, np.ones(100), 1, range(2), 1, 1, None)
    # two trees, six features tried a node, two cells a feature; 100 are the drawn rows
    assert max(cells) <= 100 and sum(len(f) for f in batch.feature) == 6


def test_long_units_are_dealt_to_different_tasks(spark):
    slots = 4 * spark.sparkContext.defaultParallelism
    units = [("boost", k) for k in range(slots)] + [("forest", k) for k in range(9 * slots)]
    parts = trees._spread_units(spark, units).select(F.spark_partition_id().alias("part"), "unit").groupBy("part").agg(
        F.count("*").alias("n"), F.count_if(F.col("unit").contains("boost")).alias("long")).collect()
    assert [(r["n"], r["long"]) for r in parts] == [(10, 1)] * slots
