"""Bracket selection, packed value statistics and frequent modes against NumPy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyframe.operators import impute, profile, ranks


def column(spark, xs, parts=3):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double").repartition(parts)


def samples():
    rng = np.random.default_rng(3)
    yield rng.normal(size=3000).tolist()
    yield np.round(rng.exponential(size=2000), 2).tolist() + [None] * 50
    yield rng.integers(0, 4, 500).tolist()
    yield [7.0] * 40
    yield [1.0]
    yield [1e300, -1e300, 0.0, -0.0, 5e-324, 2.5] * 3
    yield [math.inf, -math.inf, 1.0, 2.0, math.inf, 3.0]
    yield np.concatenate([np.full(900, 3.25), rng.normal(size=100)]).tolist()


@pytest.mark.parametrize("accuracy, inside", [(10_000, 10**9), (10, 10**9), (10, 40)])
def test_every_rank(spark, monkeypatch, accuracy, inside):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    monkeypatch.setattr(ranks, "MOST_INSIDE", inside)
    for xs in samples():
        plain = np.sort([x for x in xs if x is not None])
        n = len(plain)
        wanted = sorted({0, n - 1, n // 2, n // 3, n // 10, n - 1 - n // 10})
        got = ranks.select(column(spark, xs), {"x": F.col("x")}, [0.1, 0.3, 0.5, 0.9], lambda _, m: wanted)["x"]
        assert got.n == n and sum(p[1] for p in got.pieces) == n
        assert [got.value(k) for k in wanted] == plain[wanted].tolist()
        for k in (0, n // 10):
            mean = got.trimmed_mean(k)
            if np.isfinite(plain).all():
                want = plain[k:n - k].mean() if plain[k] != plain[n - 1 - k] else plain[k]
                assert mean == pytest.approx(want, rel=1e-9, abs=1e-9 * max(1.0, abs(plain[k:n - k]).max()))


def test_nan_is_the_largest_and_nulls_do_not_count(spark):
    got = ranks.select(column(spark, [3.0, None, math.nan, 1.0, math.nan, 2.0]), {"x": F.col("x")}, [0.5], lambda _, n: range(n))["x"]
    assert got.n == 5 and [got.value(k) for k in range(3)] == [1.0, 2.0, 3.0] and all(math.isnan(got.value(k)) for k in (3, 4))
    none = ranks.select(column(spark, [None, None]), {"x": F.col("x")}, [0.5], lambda _, n: [0])["x"]
    assert none.n == 0 and none.quantile(0.5) is None and none.trimmed_mean(0) is None


def test_only_brackets_are_shuffled(spark):
    """Of a million distinct values, a handful of thousands reaches the shuffle for the median."""
    df = spark.range(1_000_000).select((F.xxhash64("id") / 2.0**40).alias("x"))
    row = df.agg(F.percentile_approx("x", ranks.sketch_places([0.5]), ranks.ACCURACY).alias("q"), F.percentile("x", 0.5).alias("m")).first()
    low, high = row["q"]
    assert low < row["m"] < high
    assert df.where(F.col("x").between(low, high)).count() < 2_000
    assert ranks.quantiles(df, {"x": F.col("x")}, [0.5])["x"] == [row["m"]]


def test_packed_values_come_back():
    rng = np.random.default_rng(4)
    for v in (np.array([0.0]), np.array([-3.0, 0.5, 1e308, math.inf, math.nan]), np.unique(rng.normal(size=999)), np.unique(np.round(rng.normal(size=999), 2)),
              np.arange(5.0) * 1e14, np.array([-1.25, 2.0**52 + 1])):
        packed, scale = ranks.pack_values(v)
        assert np.array_equal(ranks.unpack_values(packed, scale, len(v)), v, equal_nan=True)
    cents = np.unique(np.round(rng.uniform(900, 100_000, 200_000), 2))
    packed, scale = ranks.pack_values(cents)
    assert scale == 100 and len(packed) < 2 * len(cents)


@pytest.mark.parametrize("part", [1 << 22, 50])
def test_value_stats(spark, monkeypatch, part):
    monkeypatch.setattr(ranks, "PART", part)
    for xs in samples():
        plain = Counter(x + 0.0 for x in xs if x is not None)
        top = max(plain.values())
        want = (len(plain), top, sum(n == top for n in plain.values()), min(v for v, n in plain.items() if n == top))
        df = column(spark, xs, 5)
        assert ranks.value_stats(df, {"x": F.col("x")}, {"x": sum(plain.values())})["x"] == want
    assert ranks.value_stats(column(spark, [None]), {"x": F.col("x")}, {"x": 0}) == {}


def test_profile_of_several_columns_is_one_of_each(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), int(b), None) for a, b in zip(np.round(rng.gamma(2, size=700), 2), rng.integers(0, 30, 700))]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    both = {r["column"]: r for r in profile.numeric_profile(df, ["a", "b", "c"]).collect()}
    assert both["c"]["n"] == 0 and both["c"]["median"] is None
    for c in ("a", "b"):
        assert both[c] == profile.numeric_profile(df.repartition(4), [c]).first() or both[c]["trimmed_mean"] == pytest.approx(
            profile.numeric_profile(df, [c]).first()["trimmed_mean"], rel=1e-12)


def test_modes_settled_by_candidates_or_by_all_counts(spark):
    rows = [(f"v{k % 7 if k % 3 else 1}", f"u{k}", "b" if k % 2 else "a", None) for k in range(3000)]
    df = spark.createDataFrame(rows, "often string, never string, tied string, none string").repartition(4)
    found, open_ = ranks.frequent_modes(df, {c: F.col(c) for c in df.columns})
    assert found["often"] == ("v1", Counter(r[0] for r in rows)["v1"]) and found["tied"] == ("a", 1500)
    assert open_ == ["never"]
    assert impute.modes(df, df.columns) == {"often": "v1", "tied": "a", "never": "u0"}
    assert impute.medians(spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (9.0, None)], "x double, y double"), ["x", "y"]) == {"x": 3.0}
