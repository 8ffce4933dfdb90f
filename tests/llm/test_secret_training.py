"""The network of the secret scan is taught all labelled findings of the corpus."""

import numpy as np

from studyframe.llm import secret_scan


def keys(n, seed=3):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    return ["".join(rng.choice(letters, 24)) + "7a" for _ in range(n)]


def corpus(spark, n):
    rows = [(f"use token = {k} now",) for k in keys(n)] + [(f"see /usr/share/doc/release{k:04d} now",) for k in range(n // 2)]
    return spark.createDataFrame(rows + rows[:50] + [(None,), ("",)], "text string").repartition(4)


def test_every_labelled_finding_is_taught(spark, monkeypatch):
    taught = {}
    monkeypatch.setattr(secret_scan, "train", lambda findings, *a, **k: taught.update(rows=findings) or {})
    secret_scan.fit_secrets(corpus(spark, 1300), made=60)
    made = secret_scan._made_findings(5, 60) + secret_scan._long_findings(5, 15)
    assert len(taught["rows"]) == 1300 + 650 + len(made)
    assert sum(f[3] for f in taught["rows"][:1950]) == 1300 and len(set(taught["rows"][:1950])) == 1950
    assert taught["rows"][1950:] == made


def test_shards_teach_like_one_list(spark, monkeypatch):
    docs = corpus(spark, 900)
    whole = secret_scan.fit_secrets(docs, made=900)
    monkeypatch.setattr(secret_scan, "SHARD", 300)
    seen = []
    inner = secret_scan.train_shards
    monkeypatch.setattr(secret_scan, "train_shards", lambda table, shards, *a, **k: seen.append((shards, table.count())) or inner(table, shards, *a, **k))
    parts = secret_scan.fit_secrets(docs, made=900)
    assert seen == [(5, 1350)]
    fresh = secret_scan._made_findings(77, 400)
    y = np.array([f[3] for f in fresh])
    for model in (whole, parts):
        p = secret_scan.probabilities(model, [f[:3] for f in fresh])
        assert (p[y == 1] >= model["threshold"]).mean() > 0.85 and (p[y == 0] >= model["threshold"]).mean() < 0.1
    # the same whatever the partitions are
    again = secret_scan.fit_secrets(docs.repartition(3), made=900)
    assert again["threshold"] == parts["threshold"] and all(np.array_equal(again[k], parts[k]) for k in ("taps", "weights", "shift", "bias"))


def test_many_easy_secrets_of_the_corpus_do_not_crowd_out_others():
    rng = np.random.default_rng(9)
    raw = np.concatenate([rng.normal(12, 1, 5000), rng.normal(3, 1, 100), rng.normal(-6, 1, 300)])
    y, made = np.r_[np.ones(5100), np.zeros(300)], np.arange(5400) >= 5000
    model = secret_scan._with_threshold({}, raw, y, made, 0.95)
    p = secret_scan.sigmoid(model["scale"] * raw + model["offset"])
    for kind in (False, True):
        assert (p[(y == 1) & (made == kind)] >= model["threshold"]).mean() >= 0.95
    assert (p[y == 0] < model["threshold"]).all()
