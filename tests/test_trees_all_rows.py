"""Forests and boosting are fitted and searched on all rows, however many there are."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from studyframe.operators import model, trees

ROWS = 24_000  # more than any earlier limit


@pytest.fixture(scope="module")
def many(spark):
    """features (two values, hundreds of values), label, folds and order of 24,000 rows."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    df = spark.range(ROWS).select(
        "id", F.array((F.col("id") % 2).cast("double"), ((h - 500) / 7).cast("double")).alias("a"), (h < 300 + 200 * (F.col("id") % 2)).cast("double").alias("label"),
        F.lit(1.0).alias("w_one"), F.lit(1.0).alias("w_balanced"), (F.col("id") % 3).cast("int").alias("fold"))
    df = df.withColumn(trees.PICK, model._hash01(["id"], 1) / float(model.HASH_SPACE))
    return df.withColumn("features", array_to_vector("a")).drop("a").cache()


def test_cuts_are_those_of_all_rows(spark):
    rng = np.random.default_rng(8)
    n = 3000
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 64, n), rng.integers(0, 65, n), np.round(rng.normal(size=n), 1), np.full(n, 2.5),
                  np.where(rng.random(n) < 0.4, -1.25, rng.normal(size=n)), 1 + rng.random(n) * 1e-4, rng.integers(0, 3, n) * 0.0 - rng.integers(0, 2, n) * 0.0], 1).astype(np.float32)
    df = spark.createDataFrame([(r.tolist(),) for r in x.astype(float)], "a array<double>").select(array_to_vector("a").alias("features")).repartition(3)
    got = trees.cuts_of(df)
    assert len(got) == x.shape[1]
    for j, cuts in enumerate(got):
        assert np.array_equal(cuts, trees.cut_values(x[:, j].astype(float))), j


def test_a_boosted_leaf_is_the_newton_step_of_all_rows(many):
    fitted = trees.TreesClassifier(family="gradient_boosting", points=json.dumps({"n_estimators": 1, "learning_rate": 0.1, "max_depth": 1})).fit(many)
    tree = fitted._forest()
    rows = many.select("features", "label").toPandas()
    x, y = np.stack([f.toArray() for f in rows["features"]]), rows["label"].to_numpy()
    w = trees.balanced(y)
    p = (w * y).sum() / w.sum()
    go = x[:, tree[1][0]] <= tree[2][0]
    for side, leaf in ((go, 1), (~go, 2)):
        assert tree[4][leaf] == pytest.approx(0.1 * (w * (y - p))[side].sum() / (w[side] * p * (1 - p)).sum(), rel=1e-9)
    # and every row is scored
    scored = fitted.transform(many).select("id", "label", model._p1().alias("p")).toPandas()
    raw = np.where(x[:, tree[1][0]] <= tree[2][0], tree[4][1], tree[4][2])
    assert len(scored) == scored["id"].nunique() == ROWS and scored["p"].sum() == pytest.approx((1 / (1 + np.exp(-raw))).sum(), rel=1e-9)


def test_the_search_sees_every_row_of_every_fold(many, monkeypatch):
    seen = []

    def search(spark, folds, families, seed):
        for fold in folds:
            rows = fold.blocks.groupBy("held").agg(F.sum(F.length("y")).alias("n")).collect()
            seen.append({r["held"]: r["n"] for r in rows})
        return {("random_forest", i): [0.5] * len(folds) for i in range(36)}

    monkeypatch.setattr(trees, "search", search)
    rows, best, _ = model.grid_search(many.withColumn("x", F.col("id") % 7), model.preprocessor(many.withColumn("x", F.col("id") % 7), ["x"])[:-1] + [_Named()], 3, 2, ["random_forest"])
    assert seen == [{False: 16_000, True: 8_000}] * 3
    assert best["random_forest"].getOrDefault("fitRows") == 0


def _Named():
    """The features at hand, as a stage that adds nothing."""
    from pyspark.ml.feature import SQLTransformer
    return SQLTransformer(statement="SELECT * FROM __THIS__")


def test_equal_bins_are_grown_as_their_rows_would_be():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (500, 5)).astype(float)
    y = (rng.random(500) < 0.3 + 0.1 * x[:, 0]).astype(float)
    alone = trees.binned(x, y, trees.balanced(y))
    bins, cell = trees._different(alone.x)
    assert len(bins) < 450
    together = trees.Binned(bins, y, alone.w, alone.cuts, cell)
    for weights in (np.ones(500), trees.balanced(y)):
        a, b = (trees.ForestBatch(d, weights, 3, range(6), 3, None, alone.x, [2]) for d in (alone, together))
        assert all(np.array_equal(s[k], t[k]) for s, t in zip(a.trees(), b.trees()) for k in ("feature", "cut", "left", "value"))
        assert np.array_equal(a.marked[2], b.marked[2])
    a, b = (trees.boost(d, 5, 0.1, 2, alone.x, (5,))[2][5] for d in (alone, together))
    assert np.array_equal(a, b)
