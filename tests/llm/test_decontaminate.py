"""Benchmark decontamination against brute force over all item-sized windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from studyframe.llm import decontaminate


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(words):
    return Counter([tuple(words[k:k + 5]) for k in range(len(words) - 4)]) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute(text, items):
    w, out = words_of(text), {}
    for k, item in items:
        own = words_of(item)
        if not own or not w or (len(own) < 5 and w != own):
            continue
        for s in range(max(1, len(w) - len(own) + 1)):
            a, b = bag(w[s:s + len(own)]), bag(own)
            small, large = sum((a & b).values()), sum((a | b).values())
            if 100 * small >= 75 * large:
                out[k] = max(out.get(k, 0), small / large)
    return out


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]

    def fresh(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    items = [(k, fresh(rnd.choice([6, 9, 20, 20, 33]))) for k in range(8)] + [(50, "short one"), (51, None), (52, "!!"), (53, "a " * 12)]
    items += [(60, items[3][1])]
    docs = []

    def add(text):
        docs.append((len(docs) if len(docs) % 17 else None, text))

    for _, t in items:
        if not t:
            continue
        for edits in (0, 1, 2, 3):
            w = t.split()
            for _ in range(edits):
                p = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[p] = "zz"
                else:
                    w.insert(p, "yy")
            add(fresh(rnd.choice([0, 1, 30])) + " " + " ".join(w).upper() + ", " + fresh(rnd.choice([0, 2, 40])))
        add(t)
    for _ in range(20):
        add(fresh(50))
    for t in (None, "", "Short, one!", "short one more", "a " * 40, "a a a a a a a", "w1 " * 6000):
        add(t)
    return items, [*docs, docs[3], (999, docs[2][1])]


def test_leaks_equal_brute_force(spark, tables):
    items, docs = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, key string").repartition(3)
    rows = decontaminate.leaks_by_document(df, bench).collect()

    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[2])

    want = [(d, sorted(b), round(max(b.values(), default=0.0), 9)) for d, t in docs for b in [brute(t, items)]]
    assert sorted(((r.doc_id, r.item_ids, round(r.similarity, 9)) for r in rows), key=key) == sorted(want, key=key)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not w[1] for w in want)


def test_empty_tables(spark, tables):
    items, docs = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs[:3], "doc_id long, text string")
    assert decontaminate.leaks_by_document(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.leaks_by_document(df, bench.limit(0)).collect())


def test_blocks_find_all_fingerprints_within_the_radius(spark):
    rnd = random.Random(2)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    prints, windows = [rnd.getrandbits(64) for _ in range(20)], []
    for g in prints:
        for turned in (0, 1, 5, 12, 20, 23, 24, 30):
            f = g
            for b in rnd.sample(range(64), turned):
                f ^= 1 << b
            windows.append(f)
    w = spark.createDataFrame([(bytes([k]), 9, 0, signed(f)) for k, f in enumerate(windows)], "key binary, words int, start int, fingerprint long")
    i = spark.createDataFrame([(k, 9, signed(g)) for k, g in enumerate(prints)], "item_id long, words int, fingerprint long")
    got = {(r.key[0], r.item_id) for r in decontaminate.within_radius(w, i).collect()}
    assert got == {(a, b) for a, f in enumerate(windows) for b, g in enumerate(prints) if bin(f ^ g).count("1") <= decontaminate.RADIUS}


def test_simhash_counts_weights(spark):
    rows = spark.createDataFrame([(1, s) for s in ["x", "x", "x", "y", "z"]], "id int, s string")
    only = spark.createDataFrame([(1, "x")], "id int, s string")
    assert decontaminate.simhash(rows, ["id"], "s").first().fingerprint == decontaminate.simhash(only, ["id"], "s").first().fingerprint
    assert decontaminate.simhash(only, ["id"], "s").select("size").first()[0] == 1
    h = only.select(F.xxhash64(F.lit("simhash"), "s")).first()[0]
    assert decontaminate.simhash(only, ["id"], "s").first().fingerprint == h


def test_repeated_words_in_the_differing_part(spark):
    rnd, items, docs = random.Random(8), [], []
    for k in range(40):
        common = [f"c{k}x{j}" for j in range(4 + rnd.choice([60, 90, 120]))]  # distinct shingles
        n = (len(common) - 4) // 6  # six sevenths of each bag; the rest is one word, repeated
        items.append((k, " ".join(common + ["stop"] * n)))
        docs += [(k, " ".join(common + ["go"] * n)), (100 + k, " ".join(common + ["go"] * (n // 2) + ["stop"] * (n - n // 2)))]
    rows = decontaminate.leaks_by_document(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {d: brute(t, items) for d, t in docs}
    assert sum(map(bool, want.values())) >= 40
    assert {r.doc_id: (r.item_ids, round(r.similarity, 9)) for r in rows} == {d: (sorted(b), round(max(b.values(), default=0.0), 9)) for d, b in want.items()}


def test_numbered_shingles_are_a_set(spark):
    rows = spark.createDataFrame([(0, ["b", "a", "b", "b"]), (1, ["a", "c"]), (2, []), (3, ["x"] * 3)], "k int, s array<string>")
    got = {r.k: sorted(r.n) for r in rows.select("k", decontaminate.numbered(F.col("s")).alias("n")).collect()}
    assert got == {0: ["a", "b", "b#2", "b#3"], 1: ["a", "c"], 2: [], 3: ["x", "x#2", "x#3"]}


def test_items_without_an_id_and_two_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (7, b), (7, c), (8, a)], "item_id long, text string")
    mixed = " ".join(b.split()[:20] + c.split()[20:])
    docs = spark.createDataFrame([(1, "x " + a), (2, b), (3, c), (4, mixed), (5, f"{a} and {b}")], "doc_id long, text string")
    rows = {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in decontaminate.leaks_by_document(docs, bench).collect()}
    assert rows == {1: (True, 2, [None, 8]), 2: (True, 1, [7]), 3: (True, 1, [7]), 4: (False, 0, []), 5: (True, 3, [None, 7, 8])}
    nameless = bench.where("item_id is null")
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, nameless).collect()} == {2, 3, 4}


def test_clashing_names_and_text_ids(spark):
    words = "one two three four five six seven eight nine ten".split()
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after", "x", "y"), (2, "nothing of the kind here at all", "x", "y")],
                                 "doc_id long, text string, leaked_key string, LEAKED_KEY_ string")
    bench = spark.createDataFrame([("item a", " ".join(words)), (None, " ".join(words))], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
    got = {r.doc_id: r.item_ids for r in decontaminate.leaks_by_document(docs, bench).collect()}
    assert got == {1: [None, "item a"], 2: []}
