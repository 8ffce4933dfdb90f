"""Similarity joins against brute force on small tables with every awkward case."""

import random

import numpy as np
import pyarrow as pa
import pytest

from studyframe.llm import embedding_dedup, graph, ngram_join
from studyframe.llm.arrowtext import text_bytes
from studyframe.llm.shingles import shingle_sets


def smallest(ids, links):
    """Smallest non-null id of each row's component."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return [low.get(find(i)) for i in range(len(ids))]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def words_of(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out += [now] if now else []
            now = ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    return out + ([now] if now else [])


def plain_set(text):
    w = words_of(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingle_hashes_are_the_plain_sets():
    texts = ["A b  c d e f g", "", None, "a b", "a\xa0B", "\x0bword", " a b c d e f g ", "x " * 30, "é ß ñ ü ö", "É ß ñ ü ö", "a b c d e", "ab c d e f", "a" * 5000]
    sets = shingle_sets(*text_bytes(pa.array(texts)))
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]

    def near(text, edits):
        w = text.split()
        for _ in range(edits):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        return " ".join(w)

    def fresh(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    texts = []
    for _ in range(8):
        base = fresh(rnd.choice([3, 5, 9, 40, 90]))
        texts += [near(base, rnd.choice([0, 0, 1, 2, 3, 5])) for _ in range(rnd.choice([1, 2, 3, 20]))]
    base, passage = fresh(120), fresh(60)
    texts += [near(base, rnd.choice([1, 2, 3, 4, 6])) for _ in range(50)]
    texts += [fresh(rnd.choice([10, 30, 100])) + " " + passage for _ in range(50)]
    rows = [(i + 100, t) for i, t in enumerate(texts)]
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (None, texts[5]), (107, texts[7]), (None, "all alone here"), (6, "long " * 4000)]


@pytest.mark.parametrize("seed, heavy, small", [(1, 8, 32), (2, 3, 4)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, seed, heavy, small):
    monkeypatch.setattr(ngram_join, "HEAVY_FROM", heavy)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    rows = corpus(seed)
    sets = [plain_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    low = smallest([r[0] for r in rows], links)
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, component_id string, n int").repartition(5)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(df).collect()), key=key)
    assert got == sorted(((r[0], len(s), x if s else r[0]) for r, s, x in zip(rows, sets, low)), key=key)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 40, 41, 99, 100, 1000])
def test_prefixes_are_long_enough(n):
    # with fewer shared shingles than this no similar set is left
    assert n - ngram_join.probe_length(n) < -(-75 * n // 100) <= n
    assert ngram_join.index_length(n) <= ngram_join.probe_length(n) and ngram_join.index_length(n) >= 1
    assert n - ngram_join.index_length(n) < 2 * 75 * n / 175


def test_signatures_rule_out_only_what_does_not_link():
    rnd = random.Random(6)
    pool = np.unique(np.random.default_rng(6).integers(0, 2**64 - 1, 3000, dtype=np.uint64))
    ruled_out = 0
    for _ in range(400):
        base = rnd.sample(range(len(pool)), rnd.choice([1, 3, 40, 400, 900]))
        other = base[: max(1, int(len(base) * rnd.choice([0.3, 0.6, 0.75, 0.8, 0.9, 1])))] + rnd.sample(range(len(pool)), rnd.choice([0, 0, 5, 100]))
        x, y = (pool[sorted(set(k))] for k in (base, other))
        if ngram_join.similar(x, y):
            assert ngram_join.may_link(len(x), ngram_join.signature(x), len(y), ngram_join.signature(y))
        else:
            ruled_out += not ngram_join.may_link(len(x), ngram_join.signature(x), len(y), ngram_join.signature(y))
    assert ruled_out > 100
    same = np.arange(600, dtype=np.uint64)
    assert ngram_join.signature(same) == b"" and ngram_join.may_link(600, b"", 10, b"x")


def vectors(seed, dim):
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows) if len(rows) % 37 else None, v if v is None else [None if x is None else float(x) for x in v], label))

    for _ in range(20):
        centre, label = rng.normal(size=dim), int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            add((centre + rng.normal(size=dim) * rng.choice([0, .05, .2, .35])).astype(np.float32) * rng.choice([1, 3.0]), label)
    same = rng.normal(size=dim).astype(np.float32)
    for _ in range(40):
        add(same, 1)
    for odd in (None, [0] * dim, [None] + [1] * (dim - 1), [float("nan")] + [1] * (dim - 1), [float("inf")] * dim, [*same, 1], [1.0, 2.0], [1.0, 2.1], []):
        add(odd, 1)
    add(same, None)
    add([1e-30] * dim, 2)
    return rows


@pytest.mark.parametrize("seed, dim, block", [(1, 16, 32), (2, 3, 2048)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, seed, dim, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    rows = vectors(seed, dim)
    fine = [np.array(v, np.float32).astype(float) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None
            for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if fine[i] is not None and fine[j] is not None and rows[i][2] == rows[j][2] and len(fine[i]) == len(fine[j])
             and fine[i] @ fine[j] / (np.sqrt(fine[i] @ fine[i]) * np.sqrt(fine[j] @ fine[j])) >= 0.93]
    low = smallest([r[0] for r in rows], links)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = [(r[0], int(n), x, r[0] is not None and r[0] == x) for r, n, x in zip(rows, count, low)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, n_links double").repartition(4)
    got = [tuple(r) for r in embedding_dedup.dedup_embeddings(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("in_task", [500_000, 0])
def test_components_of_a_long_path_and_a_hub(spark, monkeypatch, in_task):
    monkeypatch.setattr(graph, "TASK_EDGES", in_task)
    path = [(k, k + 1) for k in range(60)]
    hub = [(1000, k) for k in range(1001, 1040)] + [(5000, 5000), (1003, 1000)]
    rows = graph.components(spark.createDataFrame(path + hub, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got)
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1040)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("share", [45, 55, 70])
def test_a_passage_of_thousands_selects_nobody(share):
    """Documents that share a passage only: their prefixes keep clear of it, in either half of the hash space."""
    rnd = random.Random(share)
    passage = [f"p{rnd.randrange(10**6)}" for _ in range(2 * share)]
    texts = []
    for _ in range(2000):
        own = [f"w{rnd.randrange(10**9)}" for _ in range(200 - len(passage))]
        k = rnd.randrange(len(own) + 1)
        texts.append(" ".join(own[:k] + passage + own[k:]))
    sets = shingle_sets(*text_bytes(pa.array(texts)))
    bits = 5
    codes, counts = np.unique(ngram_join._codes(np.concatenate(sets), bits), return_counts=True)
    heavy = counts >= ngram_join.HEAVY_FROM
    assert (codes[heavy] >> 32 < 16).any() and (codes[heavy] >> 32 >= 16).any()
    order = ngram_join.Order(codes[heavy], counts[heavy], bits)
    prefixes = order.prefix(sets)
    common = np.unique(np.concatenate(prefixes), return_counts=True)
    if share < 70:
        assert common[1].max() < 3
    # even where the passage is most of a text, only its fewest shingles are taken
    assert sum(int(n) for n in common[1] if n > 100) <= 2000 * max(0, ngram_join.probe_length(196) - (196 - 2 * share + 4))
    assert all(len(p) == ngram_join.probe_length(len(s)) for p, s in zip(prefixes, sets))


def test_signature_table_equals_pairwise_bound():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(1, 300, 60)]
    sets += [np.unique(np.append(s[5:], rng.integers(0, 2**64, 3, dtype=np.uint64))) for s in sets[:20]]
    signatures = [ngram_join.signature(s) for s in sets] + [b""]
    sizes = np.array([len(s) for s in sets] + [7])
    table = ngram_join.SignatureTable(signatures)
    j = np.arange(len(signatures))
    for i in range(len(signatures)):
        common = table.common(i, j)
        ok = 100 * common >= ngram_join.PERCENT * (sizes[i] + sizes[j] - common)
        assert ok.tolist() == [ngram_join.may_link(int(sizes[i]), signatures[i], int(sizes[k]), signatures[k]) for k in j]
