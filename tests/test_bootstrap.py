"""Bootstrap weights and statistics: the law of the weights, brute force over the same weights, any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyframe.operators import bootstrap


@pytest.mark.parametrize("count", [1, 2, 7, 32, 33, 200, 5000, 9_000_000, 11_000_000, 4_000_000_000])
def test_weights_follow_the_poisson_law(count):
    keys = np.arange(1, 301, dtype=np.int64) * 7919
    w = bootstrap.poisson_weights(keys, np.full(300, count), 1000)
    assert abs(w.mean() - count) < 5 * math.sqrt(count / w.size)
    assert abs(w.var() / count - 1) < 0.02
    # replicates and values are not tied to each other
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.25
    if count == 1:
        share = np.bincount(w.astype(int).ravel(), minlength=6) / w.size
        assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.004 for k in range(6))


def test_weights_do_not_depend_on_blocks_or_lookup(monkeypatch):
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(-2**62, 2**62, 90), rng.choice([0, 1, 3, 30, 40], 90)
    whole = bootstrap.poisson_weights(keys, counts, 77)
    assert (whole[counts == 0] == 0).all()
    parts = [bootstrap.poisson_weights(keys[k:k + 7], counts[k:k + 7], 77) for k in range(0, 90, 7)]
    assert np.array_equal(whole, np.concatenate(parts))
    monkeypatch.setattr(bootstrap, "LOOKUP", 0)
    assert np.array_equal(whole, bootstrap.poisson_weights(keys, counts, 77))


def collected(reps):
    return {(r["column"], r["rep"]): r["r"] for r in reps.collect()}


def test_pearson_against_plain_sums(spark):
    rows = [("a" if k % 3 else "b", float(k % 37) + 1e6, float(k % 2)) for k in range(900)] + [("c", 1.0, float(k % 2)) for k in range(20)]
    long = spark.createDataFrame(rows, "column string, x double, y double")
    got = collected(bootstrap.pearson_replicates(long, 50, 3))
    pairs = long.groupBy("column", "x", "y").agg(F.count("*").alias("n")).withColumn("key", bootstrap._key(3, "column", "x", "y")).toPandas()
    for c in ("a", "b"):
        own = pairs[pairs["column"] == c]
        w = bootstrap.poisson_weights(own["key"].to_numpy(), own["n"].to_numpy(), 50)
        for k in range(50):
            x, y = np.repeat(own["x"].to_numpy(), w[:, k].astype(int)), np.repeat(own["y"].to_numpy(), w[:, k].astype(int))
            assert abs(got[c, k] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert not any(c == "c" for c, _ in got)
    again = collected(bootstrap.pearson_replicates(long.repartition(9), 50, 3))
    assert got.keys() == again.keys() and all(abs(got[k] - again[k]) < 1e-12 for k in got)


def test_ranks_against_plain_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("v", b, float(b * 1000 + k) / 7, int(rng.integers(0, 4)), int(rng.integers(0, 3))) for b in range(150) for k in range(6)]
    rows += [("w", 0, float(k), 1, 1) for k in range(700)] + [("one", 0, 1.0, 5, 0)]
    counts = spark.createDataFrame(rows, "column string, bucket int, value double, c1 long, c0 long")
    got = collected(bootstrap.rank_biserial_replicates(counts, 40, 5))
    keyed = counts.select("*", F.xxhash64(F.lit(5), "column", "value", F.lit(1)).alias("key1"), bootstrap._key(5, "column", "value")).toPandas()
    for c in ("v", "w"):
        own = keyed[keyed["column"] == c].sort_values("value")
        one = bootstrap.poisson_weights(own["key1"].to_numpy(), own["c1"].to_numpy(), 40)
        zero = bootstrap.poisson_weights(own["key"].to_numpy(), own["c0"].to_numpy(), 40)
        for k in range(40):
            u = sum(a * (zero[:i, k].sum() + zero[i, k] / 2) for i, a in enumerate(one[:, k]))
            assert abs(got[c, k] - (2 * u / (one[:, k].sum() * zero[:, k].sum()) - 1)) < 1e-12
    assert not any(c == "one" for c, _ in got)
    assert collected(bootstrap.rank_biserial_replicates(counts.repartition(7), 40, 5)) == got
    # other buckets, same values: same replicates
    other = counts.withColumn("bucket", F.floor(F.col("bucket") / 4).cast("int"))
    again = collected(bootstrap.rank_biserial_replicates(other, 40, 5))
    assert all(abs(got[k] - again[k]) < 1e-12 for k in got)


def plain_v(table):
    table = table[table.sum(1) > 0][:, table.sum(0) > 0]
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    return math.sqrt(((table - e) ** 2 / e).sum() / (table.sum() * (min(table.shape) - 1)))


def test_cramers_v_against_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(c, str(y), f"level {x}", int(rng.integers(1, 5))) for c in ("p", "q") for x in range(30 if c == "p" else 3) for y in range(2 if c == "p" else 4) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "column string, y string, x string, n long")
    got = collected(bootstrap.cramers_v_replicates(cells, 60, 9))
    keyed = cells.withColumn("key", bootstrap._key(9, "column", "y", "x")).toPandas()
    for c in ("p", "q"):
        own = keyed[keyed["column"] == c]
        w = bootstrap.poisson_weights(own["key"].to_numpy(), own["n"].to_numpy(), 60)
        ys, xs = sorted(own["y"].unique()), sorted(own["x"].unique())
        for k in range(60):
            table = np.zeros((len(ys), len(xs)))
            for y, x, v in zip(own["y"], own["x"], w[:, k]):
                table[ys.index(y), xs.index(x)] = v
            assert abs(got[c, k] - plain_v(table)) < 1e-9
    assert all(abs(v - got[k]) < 1e-12 for k, v in collected(bootstrap.cramers_v_replicates(cells.repartition(8), 60, 9)).items())


def test_cramers_v_of_very_many_levels(spark):
    cells = spark.range(0, 200_000, numPartitions=8).select(
        F.lit("c").alias("column"), (F.col("id") % 2).cast("string").alias("y"), F.floor(F.col("id") / 2).cast("string").alias("x"), (F.col("id") % 3 + 1).alias("n"))
    got = collected(bootstrap.cramers_v_replicates(cells, 30, 1))
    assert len(got) == 30 and 0 < min(got.values()) and max(got.values()) < 1


def test_empty_inputs(spark):
    assert collected(bootstrap.pearson_replicates(spark.createDataFrame([], "column string, x double, y double"), 20, 1)) == {}
    assert collected(bootstrap.rank_biserial_replicates(spark.createDataFrame([], "column string, bucket int, value double, c1 long, c0 long"), 20, 1)) == {}
    assert collected(bootstrap.cramers_v_replicates(spark.createDataFrame([], "column string, y string, x string, n long"), 20, 1)) == {}
