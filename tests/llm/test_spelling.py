"""Spelling variants against a brute-force version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from studyframe.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, size string, region string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_forms(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                counts[w] += 1
    return brute_forms({w: n for w, n in counts.items() if n >= 3})


def collected(df):
    key = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    return sorted(key)


def test_texts_to_forms(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdeßéÀÿ") for _ in range(rnd.randint(4, 8))) for _ in range(60)]

    def word():
        w = rnd.choice(base)
        if rnd.random() < 0.3:
            k = rnd.randrange(len(w))
            w = rnd.choice((w[:k] + w[k + 1:], w[:k] + rnd.choice("abcé") + w[k + 1:], w[:k] + rnd.choice("abcé") + w[k:]))
        return rnd.choice((w, w.capitalize(), w.upper().replace("SS", "ß")))

    rows = [(k, " ".join(word() for _ in range(40)) + rnd.choice((".", " 12x3 ", "ÿ", "×÷", "\nthree-part_word"))) for k in range(120)]
    rows += [(None, "alone alone alone aloné"), (7, None), (8, ""), (9, "12 !!"), rows[0], rows[0], (10, ("spelling " * 70_000) + "z" * 3000)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    got = collected(spelling.group_spellings(df))
    assert got == brute(rows)
    assert any(f for _, f, *_ in got) and any(r[1] != r[2] and r[1] for r in got)
    # small regions: upper trees, blocks and copies
    assert collected(spelling.group_spellings(df, region=5)) == got


def test_equal_counts_and_chains(spark):
    rnd = random.Random(6)
    letters = list("abcdefgh")
    counts = {}
    for _ in range(500):  # anagrams: no tree parts them
        rnd.shuffle(letters)
        w = "".join(letters)
        counts[w] = rnd.randint(3, 50)
        counts[w[:3] + "x" + w[4:]] = rnd.randint(3, 9)
    w = "abcdefghijkl"
    for k in range(12):  # a chain of forms, each at least twice as common
        counts[w] = 3 * 2 ** k
        w = w[:k] + "z" + w[k + 1:]
    counts |= {"tiedaa": 4, "tiedab": 9, "tiedac": 9, "aaaaa": 3, "aaaaaa": 3, "é" * 300: 3, "é" * 301: 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    for region in (10, 4096):
        got = collected(spelling.spelling_forms(words, region=region))
        assert got == brute_forms(counts)
    assert ("tiedaa", "tiedab", "tiedab", 4, 2, 9) in got


def test_stretches_never_cut_a_run(monkeypatch):
    text = "one two,three " * 50 + "x" * 100 + " é" * 20
    whole = spelling.RUN.findall(text)
    for n in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(spelling, "STRETCH", n)
        assert [w for part in spelling._runs(text) for w in part] == whole


def test_trees_lose_no_reach():
    rng = np.random.default_rng(7)
    vectors = rng.integers(0, 3, (800, spelling.DIMS)).astype(np.int16)
    vectors[:, 6:] = 0
    asked = vectors[:200]
    apart = vectors[None].astype(int) - asked[:, None]
    for up, down in ((1, 1), (1, 0), (0, 0)):
        want = set(zip(*np.nonzero((np.maximum(apart, 0).sum(2) <= up) & (np.maximum(-apart, 0).sum(2) <= down))))
        tree = spelling.CountTree(vectors)
        assert {p for a, b in tree.near(asked, up, down) for p in zip(a, b)} == want
        upper, regions = spelling.upper_tree(vectors[:300], 40)
        assert regions > 20
        home = np.empty(len(vectors), int)
        rows, home_of = spelling.regions_of(upper, vectors, 0, 0)
        assert sorted(rows) == list(range(len(vectors)))
        home[rows] = home_of
        reach = set(zip(*spelling.regions_of(upper, asked, up, down)))
        assert all((a, home[b]) in reach for a, b in want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collected(spelling.group_spellings(empty)) == []
    few = spark.createDataFrame([(1, "word word only twice twice", "", "", "", "")], SCHEMA)
    assert collected(spelling.group_spellings(few)) == []
