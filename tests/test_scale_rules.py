"""Behaviour at sizes and shapes the small tables do not have."""

import math
import random

import pytest
from pyspark.sql import functions as F

from studyframe.operators import assoc, bootstrap, dedupe, diagnostics, govern, infer, model, prefix, profile
from studyframe.functions import stats
from studyframe.plans.tables import table
from studyframe.session import ensure_checkpoint_dir
from studyframe.sources import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_scan_prunes_columns_and_pushes_filters(spark):
    text = plan(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id").where("doc_id < 5"))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "LessThan(doc_id,5)" in text
    assert "Exchange" not in text and "InMemoryRelation" not in text and "InMemoryTableScan" not in text


def test_redundant_columns_are_given_up_to_the_latest_keep(spark):
    pairs = [("a", "b", "a"), ("b", "c", "c"), ("d", None, "a"), ("a", "a", "a")]
    want = {"b": "c", "d": "a"}
    assert {r.column_name: r.preferred_keep for r in govern.redundancy_drops(spark, pairs).collect()} == want
    df = spark.createDataFrame([(*p, 1) for p in pairs], "var_a string, var_b string, preferred_keep string, extra int")
    assert {r.column_name: r.preferred_keep for r in govern.redundancy_drops(spark, df.coalesce(1)).collect()} == want
    assert govern.redundancy_drops(spark, None).count() == 0
    with pytest.raises(ValueError):
        govern.redundancy_drops(spark, df.drop("var_b"))


def test_thresholds_take_the_first_of_the_best(spark):
    scan = spark.createDataFrame([(0, 0.1, 0.9, 0.2), (1, 0.2, 0.8, 0.5), (2, 0.3, 0.7, 0.5), (3, 0.4, None, None)],
                                 "i int, threshold double, sensitivity double, youden_j double")
    assert diagnostics.youden_threshold(scan) == 0.2
    assert diagnostics.min_sensitivity_threshold(scan, 0.85) == 0.1
    assert diagnostics.min_sensitivity_threshold(scan, 0.95) == 0.5


def approved(spark):
    return spark.createDataFrame([("x", "predictor", "keep"), ("z", "predictor", "keep"), ("w", "predictor", "drop"), ("y", "target", "keep"), ("gone", "predictor", "keep")],
                                 "column_name string, role string, action string")


def test_only_approved_predictors_are_screened(spark):
    rnd = random.Random(1)
    rows = [(k % 2, rnd.random() + k % 2, rnd.random(), rnd.random()) for k in range(80)]
    df = spark.createDataFrame(rows, "y int, z double, w double, x double")
    kinds = {c: "continuous" for c in "xzw"}
    assert govern.approved_predictors(approved(spark), df.columns) == ["z", "x"]
    assert govern.approved_predictors(approved(spark), df.columns, "x") == ["x"]
    assert govern.approved_predictors(approved(spark), df.columns, ["x", "z", "x"]) == ["x", "z"]
    for bad in ("w", "nope"):
        with pytest.raises(ValueError):
            govern.approved_predictors(approved(spark), df.columns, [bad])
    with pytest.raises(ValueError):
        govern.approved_predictors(approved(spark), ["y"])
    got = infer.screen(df, "y", kinds, 1, n_boot=100, decisions=approved(spark)).collect()
    assert {r.predictor for r in got} == {"x", "z"}
    with pytest.raises(ValueError):
        infer.qa_gate(infer.screen(df, "y", kinds, 1, n_boot=100), ["x", "z"])


def test_bootstrap_of_r_stands_large_offsets_and_any_partitioning(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(400):
        y = k % 2
        rows.append(("a", 1.7e9 + y + rnd.gauss(0, 1.5), float(y)))
    df = spark.createDataFrame(rows, "column string, x double, y double")

    def interval(d):
        reps = bootstrap.pearson_replicates(d, 200, 7)
        assert reps.count() == 200
        return bootstrap.percentile_ci(reps, 200, 0.95)["a"]

    lo, hi = interval(df.repartition(2))
    r = df.agg(F.corr(F.col("x") - 1.7e9, "y")).first()[0]
    assert lo < r < hi and hi - lo < 0.3
    assert interval(df.repartition(7)) == pytest.approx((lo, hi), rel=1e-9)


def test_bootstrap_of_ranks_uses_every_value(spark):
    rnd = random.Random(5)
    rows = [(int(k % 2), rnd.gauss(k % 2, 1.0)) for k in range(3000)]
    df = spark.createDataFrame(rows, "y int, v double")

    def interval(d):
        vt = infer.class_value_table(d, "y", ["v"], bins=8)
        r = infer.mann_whitney(vt).first()["rank_biserial"]
        return r, bootstrap.percentile_ci(bootstrap.rank_biserial_replicates(vt, 200, 1), 200, 0.95)["v"]

    r, (lo, hi) = interval(df)
    assert lo < r < hi and hi - lo < 0.15
    assert interval(df.repartition(5))[1] == pytest.approx((lo, hi), rel=1e-9)


def test_bootstrap_of_cramers_v(spark):
    cells = spark.createDataFrame([("c", y, x, n) for y, x, n in (("0", "a", 40), ("0", "b", 20), ("1", "a", 10), ("1", "b", 30), ("1", "z", 1))],
                                  "column string, y string, x string, n long")
    reps = bootstrap.cramers_v_replicates(cells, 300, 2)
    lo, hi = bootstrap.percentile_ci(reps, 300, 0.95)["c"]
    t = assoc.chi_square(cells, yates=False).first()
    v = math.sqrt(t["chi2"] / t["n"])
    assert lo < v < hi and reps.count() == 300


def test_chi_square_of_billions(spark):
    n = [[4_000_000_000, 5_000_000_000], [6_000_000_000, 4_500_000_000]]
    cells = spark.createDataFrame([("c", str(i), str(j), n[i][j]) for i in range(2) for j in range(2)], "column string, y string, x string, n long")
    total = sum(map(sum, n))
    want = 0.0
    for i in range(2):
        for j in range(2):
            e = sum(n[i]) * (n[0][j] + n[1][j]) / total
            want += (n[i][j] - e) ** 2 / e
    got = assoc.chi_square(cells, yates=False).first()
    assert got["chi2"] == pytest.approx(want, rel=1e-12)
    assert assoc.expected_share_below(cells).first()["pct_expected_lt5"] == 0


def test_chi_square_counts_empty_cells(spark):
    n = {("0", "a"): 30, ("0", "b"): 12, ("1", "a"): 8, ("1", "c"): 5}
    cells = spark.createDataFrame([("c", y, x, v) for (y, x), v in n.items()], "column string, y string, x string, n long")
    total, want = sum(n.values()), 0.0
    for y in "01":
        for x in "abc":
            e = sum(v for k, v in n.items() if k[0] == y) * sum(v for k, v in n.items() if k[1] == x) / total
            want += (n.get((y, x), 0) - e) ** 2 / e
    assert assoc.chi_square(cells).first()["chi2"] == pytest.approx(want, rel=1e-12)


def brute_fisher(a, b, c, d):
    r1, r2, c1 = a + b, c + d, a + c
    weights = {x: math.comb(r1, x) * math.comb(r2, c1 - x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
    return sum(w for w in weights.values() if w * 10**7 <= weights[a] * (10**7 + 1)) / sum(weights.values())


def test_fisher_equals_exact_sums_and_ends_for_billions():
    rnd = random.Random(9)
    for _ in range(200):
        t = [rnd.randrange(0, 40) for _ in range(4)]
        if sum(t):
            assert stats.fisher_exact_2x2(*t)[1] == pytest.approx(brute_fisher(*t), rel=1e-9, abs=1e-300), t
    assert stats.fisher_exact_2x2(300, 420, 350, 380)[1] == pytest.approx(brute_fisher(300, 420, 350, 380), rel=1e-9)
    # a shift of two standard errors among billions: as the normal approximation has it
    n = 4_000_000_000
    shift = int(2 * math.sqrt(n) / 2)
    p = stats.fisher_exact_2x2(n + shift, n, n, n + shift)[1]
    z = 4 * shift / math.sqrt(4 * n + 2 * shift) / 2
    assert p == pytest.approx(2 * stats.norm_sf(z), rel=1e-3)


@pytest.mark.parametrize("kind, make", [("string", lambda k: f"name/{k:05d}" if k % 3 else f"n{k}"), ("timestamp_ntz", None), ("date", None), ("double", lambda k: k / 7)])
def test_row_ids_in_the_order_of_any_key(spark, kind, make):
    if make:
        df = spark.createDataFrame([(make((k * 37) % 101),) for k in range(101)], f"k {kind}")
    else:
        df = spark.range(101).select(F.expr(f"cast(date_add(date'2020-01-01', cast((id * 37) % 101 as int)) as {kind})").alias("k"))
    ids = {r.k: r.row_id for r in prefix.row_index(df, "k", buckets=4).collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(101))


def test_adjusted_p_of_ties_and_of_untested_rows(spark):
    p = [0.01, 0.04, 0.04, None, 0.04, 0.5, 0.02, None]
    df = spark.createDataFrame(list(enumerate(p)), "predictor int, p_value double")
    got = {r.predictor: r.p_value_fdr for r in infer.benjamini_hochberg(df).collect()}
    tested = sorted(x for x in p if x is not None)
    for k, x in enumerate(p):
        want = None if x is None else min(min(y * 6 / (sum(z <= y for z in tested)) for y in tested if y >= x), 1.0)
        assert got[k] == (None if want is None else pytest.approx(want))


def test_duplicates_by_digest_keep_incomplete_keys_apart(spark):
    df = spark.createDataFrame([(1, "A ", 1.0), (2, "a", 1.0), (3, None, 1.0), (4, None, 1.0), (5, "a", -0.0), (6, "a", 0.0), (7, "1:a", 2.0)],
                               "id long, t string, v double")
    got = {r.id: (r._dup_group, r._dup_later) for r in dedupe.masks(df, ["t", "v"], ["id"]).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (False, False), 5: (True, False), 6: (True, True), 7: (False, False)}


def test_catalog_tells_one_two_and_more_levels(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0, True), (1, "b", None, float("nan"), None), (1, "c", None, 2.0, False)],
                               "one int, three string, none string, num double, flag boolean")
    levels = {c["column"]: c["n_unique"] for c in profile.column_catalog(df)}
    assert levels == {"one": 1, "three": 3, "none": 0, "num": 3, "flag": 2}
    wide = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("two"))
    assert {c["column"]: c["n_unique"] for c in profile.column_catalog(wide)} == {"id": 3, "two": 2}


def test_split_covers_every_class(spark):
    df = spark.range(500).select("id", (F.col("id") % 5).cast("int").alias("y"))
    test = {r.y: r["count"] for r in model.stratified_split(df, "y", ["id"]).where("_test").groupBy("y").count().collect()}
    assert test == {k: 20 for k in range(5)}


def test_unseen_levels_are_all_zeros_and_names_are_real(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = [(float(k % 7) if k % 5 else None, ["u", "v", "w"][k % 3], float(k % 2)) for k in range(60)]
    df = model.balanced_weights(spark.createDataFrame(rows, "x double, g string, label double"), "label")
    clf = model.logistic_candidates(60)[0]
    fitted = Pipeline(stages=[*model.preprocessor(df, ["x", "g"]), clf]).fit(df)
    assert {r.feature for r in model.feature_importance(fitted, spark).collect()} == {"x", "g=u", "g=v", "g=w"}
    new = spark.createDataFrame([(1.0, "unseen", 0.0)], "x double, g string, label double")
    pre = Pipeline(stages=model.preprocessor(df, ["x", "g"])).fit(df)
    assert pre.transform(new).select(vector_to_array("features").alias("f")).first().f[1:] == [0.0, 0.0, 0.0]


def test_source_order_survives_escaped_paths(spark, tmp_path):
    folder = tmp_path / "with space + plus%"
    folder.mkdir()
    for name, value in (("b é.csv", "#N/A"), ("a x.csv", "1.#QNAN"), ("c.csv", "kept")):
        (folder / name).write_text(f"id,v\n{name[0]},{value}\n", encoding="utf-8")
    paths = ingest.discover(spark, str(folder))
    rows = ingest.merge(spark, paths, {"id": None, "v": None}).orderBy("_src_order").collect()
    assert [r.id for r in rows] == ["a", "b", "c"] and [r.v for r in rows] == [None, None, "kept"]
    assert [r._src_order.file_index for r in rows] == [0, 1, 2]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_source_order_holds_when_files_are_split(spark, tmp_path):
    for name, start, n in (("a", 0, 4000), ("b", 4000, 900)):
        (tmp_path / f"{name}.csv").write_text("id,v\n" + "".join(f"{start + k},{'x' * (k % 40)}\n" for k in range(n)))
    known = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        rows = ingest.merge(spark, ingest.discover(spark, str(tmp_path)), {"id": None, "v": None})
        assert rows.rdd.getNumPartitions() > 5
        got = [int(r.id) for r in rows.orderBy("_src_order").select("id").collect()]
    finally:
        for c, v in known.items():
            spark.conf.set(c, v)
    assert got == list(range(4900))


def test_incomplete_keys_are_spread_and_never_duplicates(spark):
    rows = [(k, None if k % 3 else f"t{k % 60}", "same" if k % 2 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: (r._dup_group, r._dup_later) for r in dedupe.masks(df, ["a", "b"], ["id"]).collect()}
    first = {}
    for k, a, b in rows:
        if a and b:
            first.setdefault((a, b), k)
    assert len(got) == 900
    for k, a, b in rows:
        assert got[k] == ((True, first[a, b] != k) if a and b else (False, False))
