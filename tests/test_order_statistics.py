"""Bucketed prefix sums and order statistics against brute force; invariance under repartitioning."""

import random

import numpy as np
from pyspark.sql import functions as F

from studyframe.operators import diagnostics as D
from studyframe.operators import infer, prefix, profile


def _values(seed=7, n=400):
    rnd = random.Random(seed)
    return [float(rnd.choice([1, 2, 2, 3, 5, 8, 8, 8, 13, 21]) + rnd.choice([0.0, 0.5])) for _ in range(n)]


def test_row_index_is_consecutive_and_ordered(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(300)], "k long, t long")
    got = prefix.row_index(df, "k", tiebreak=["t"], buckets=5).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(300))
    keys = [(r["k"], r["t"]) for r in got]
    assert keys == sorted(keys)


def test_suffix_min(spark):
    vals = [(i, float((i * 37) % 17)) for i in range(120)]
    df = spark.createDataFrame(vals, "k long, v double")
    got = {r["k"]: r["m"] for r in prefix.suffix_min(df, "k", "v", "m", buckets=4).collect()}
    for i, _ in vals:
        assert got[i] == min(v for k, v in vals if k >= i)


def test_numeric_profile_matches_numpy(spark):
    xs = _values()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for parts in (1, 7):
        r = profile.numeric_profile(df.repartition(parts), ["x"]).first()
        a = np.array(xs)
        assert abs(r["median"] - np.percentile(a, 50)) < 1e-12
        assert abs(r["p_5th"] - np.percentile(a, 5)) < 1e-12
        assert abs(r["iqrange"] - (np.percentile(a, 75) - np.percentile(a, 25))) < 1e-12
        k = int(0.1 * len(a))
        s = np.sort(a)
        assert abs(r["trimmed_mean"] - s[k:len(a) - k].mean()) < 1e-9
        assert abs(r["std_pop"] - a.std()) < 1e-9
        assert r["n_unique"] == len(set(xs))


def test_mann_whitney_auc_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 30)), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p double, y int")
    auc = D.roc_auc(df)
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(auc - brute) < 1e-12
    vt = infer.class_value_table(df.withColumnRenamed("y", "_y"), "_y", ["p"], bins=5)
    assert abs(infer.mann_whitney(vt).first()["rank_biserial"] - (2 * brute - 1)) < 1e-12


def test_threshold_scan_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "p double, y int")
    scan = {r["i"]: r for r in D.threshold_scan(df).collect()}
    for i in (0, 50, 100, 180):
        t = D.THRESHOLDS[i]
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y == 0)
        assert (scan[i]["tp"], scan[i]["fp"]) == (tp, fp)


def test_top_k_per_group_is_exact(spark):
    from studyframe.operators import ranking
    rows = [("g", f"v{i:03d}", i % 9) for i in range(200)]
    df = spark.createDataFrame(rows, "column string, value string, n long")
    got = ranking.top_k(df, "column", [F.col("n").desc(), F.col("value").asc()], 3, "value", salts=8).collect()
    want = sorted(rows, key=lambda r: (-r[2], r[1]))[:3]
    assert sorted((r["value"], r["n"]) for r in got) == sorted((v, n) for _, v, n in want)


def test_calibration_and_histogram_match_brute_force(spark):
    rnd = random.Random(11)
    rows = [(round(rnd.random(), 3), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    edges = np.linspace(0.0, 1.0, 11)[1:-1]
    want = {}
    for p, y in rows:
        b = int(np.searchsorted(edges, p, side="left"))
        want.setdefault(b, []).append((p, y))
    got = {r["bin"]: r for r in D.calibration(df).collect()}
    assert set(got) == set(want)
    for b, pts in want.items():
        assert abs(got[b]["prob_true"] - np.mean([y for _, y in pts])) < 1e-12
        assert abs(got[b]["prob_pred"] - np.mean([p for p, _ in pts])) < 1e-12
    h = D.probability_histogram(df, bins=30).collect()
    for cls in (0, 1):
        assert sum(r["n"] for r in h if r["y"] == cls) == sum(1 for _, y in rows if y == cls)
        assert max(r["bin"] for r in h if r["y"] == cls) <= 29


def test_overviews_on_a_small_frame(spark):
    from studyframe.operators import clean
    rows = [(1, "a", 2.0), (2, None, None), (3, "a", 4.0), (4, "b", None)]
    df = spark.createDataFrame(rows, "k long, s string, x double")
    shape = clean.frame_shape(df).first()
    assert (shape["n_rows"], shape["n_cols"], shape["null_cells"]) == (4, 3, 3)
    assert shape["null_pct"] == 25.0
    ov = {r["column"]: r for r in profile.dataset_overview(df).collect()}
    assert ov["x"]["dtype"] == "double" and ov["k"]["n_rows"] == 4 and ov["k"]["n_cols"] == 3
    vo = {r["column"]: r for r in profile.value_overview(df).collect()}
    assert vo["x"]["n_null"] == 2 and vo["x"]["mean"] == 3.0 and vo["s"]["n_unique"] == 2
    miss = [r["column"] for r in profile.missingness_ranking(df).collect()]
    assert miss == ["x", "s"]
    ext = {(r["side"], r["rank"]): r["value"] for r in profile.value_extremes(df, ["s"], k=2).collect()}
    assert ext[("common", 1)] == "a" and ext[("rare", 1)] == "b"
