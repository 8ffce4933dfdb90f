"""Operator 12: words that differ by one edit, found with k-d trees over letter-count vectors.

A vector counts how often each letter occurs in a word. Replacing a letter takes one from one
count and adds one to another (L1 distance 2, or 0 where both fall together); inserting one
adds one to one count. So all words near a word lie in a small box around its vector: for words
of its own length at most one up and one down, for words one letter longer one up. The trees
of the lengths are searched for each pair of lengths (n, n) and (n, n + 1): boxes without reach
are pruned, what is left in a leaf is compared by vectors and then by the order of the letters.

The upper part of each length's tree is fitted on a bounded sample of its words and only decides
who meets whom: every word is put into one region and asks all regions within its reach, so no
pair is lost. A region's words and askers are one group, whose lower tree is built in numpy.
Lengths with few words are one region. Regions grow in number with the vocabulary; a region that
stays large all the same (words with equal counts, which no tree can part, or very many askers)
is dealt in blocks of its words, which every asker visits, and in copies, which share its askers.

The words themselves are counted whole: texts are read in stretches, equal words are added up
in each task before they are sent.

Nulls: a null text has no words; a null id counts as the empty string in the checksum. Repeated
rows count again. Only the two columns are read. Empty tables give no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.session import discard, materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a task adds up before it sends them on.
HELD_WORDS = 200_000
#: Code points of a text that are read at once.
STRETCH = 1 << 20
#: Words of one region, about.
REGION = 4_096
#: Sampled words for each region that a tree is to have, and the most regions a length gets.
SAMPLE_PER_REGION, MOST_REGIONS = 32, 1_024
#: Askers of one group, about.
ASKERS = 65_536
#: Words of a leaf of the tree inside a region.
LEAF = 24
#: Counts: a to z, and everything else folded into a few (folding only shortens distances).
FOLDED = 6
DIMS = 26 + FOLDED


# -- words ---------------------------------------------------------------------------------

def _runs(text: str) -> Iterator[list[str]]:
    """All runs of a text, a stretch at a time; a run is never cut."""
    if len(text) <= STRETCH:
        yield RUN.findall(text)
        return
    at = 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        if end < len(text) and (open_run := RUN.match(text, end - 1)):
            end = open_run.end()
        yield RUN.findall(text, at, end)
        at = end


def _count_words(error_rate: int, shortest: int):
    """(word, n) of a task's rows, added up; every ``error_rate``-th word of a document loses a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                start = ((i.as_py() if i.is_valid else "") + ":").encode()
                of_id = zlib.crc32(start)
                for found in _runs(text.as_py()):
                    for w, n in Counter(found).items():
                        if len(w) < shortest:
                            continue
                        w = w.translate(LOWER)
                        h = zlib.crc32(w.encode(), of_id)
                        if error_rate and h % error_rate == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1:]
                            if len(w) < shortest:
                                continue
                        held[w] = held.get(w, 0) + n
                    if len(held) >= HELD_WORDS:
                        yield flush()
        if held:
            yield flush()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words with at least ``shortest`` letters and ``least`` occurrences in all texts.

    A run is lower-cased (A-Z). If ``error_rate`` divides the CRC-32 h of "id:run", the letter at
    h % length is taken out (a made-up misspelling; 0 turns this off).
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(_count_words(error_rate, shortest), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- vectors and trees ------------------------------------------------------------------------

def code_matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1) if words else np.zeros((0, 0), "<u4")


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """The count vectors; counts above 30,000 stay there, which only shortens distances."""
    place = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % FOLDED).astype(np.int64)
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])
    out = np.bincount(rows * DIMS + place.ravel(), minlength=len(codes) * DIMS).reshape(len(codes), DIMS)
    return np.minimum(out, 30_000).astype(np.int16)


def _split(vectors: np.ndarray) -> tuple[int, int] | None:
    """(dimension, bound) that parts the vectors into counts up to and above the bound; None if all are equal."""
    if len(vectors) < 2:
        return None
    low, high = vectors.min(0), vectors.max(0)
    best = None
    for d in np.argsort(low.astype(np.int64) - high, kind="stable")[:8] if (low < high).any() else ():
        if low[d] == high[d]:
            break
        # the split nearest to half and half, of the widest dimensions
        bound = min(max(int(np.median(vectors[:, d])), int(low[d])), int(high[d]) - 1)
        for b in (bound - 1, bound):
            if low[d] <= b < high[d]:
                left = np.count_nonzero(vectors[:, d] <= b)
                off = abs(2 * left - len(vectors))
                if best is None or off < best[0]:
                    best = (off, int(d), b)
    return best and best[1:]


def upper_tree(vectors: np.ndarray, regions: int) -> tuple[list, int]:
    """(nodes, number of regions); a node is [dimension, bound, left, right], a leaf [region]."""
    tree, numbers = [], 0
    todo = [(vectors, regions, None, 0)]
    while todo:
        part, wanted, parent, side = todo.pop()
        at = len(tree)
        if parent is not None:
            tree[parent][2 + side] = at
        cut = _split(part) if wanted > 1 else None
        if cut is None:
            tree.append([numbers])
            numbers += 1
            continue
        d, bound = cut
        tree.append([d, bound, -1, -1])
        left = part[:, d] <= bound
        share = min(max(round(wanted * left.mean()), 1), wanted - 1)
        todo.append((part[left], share, at, 0))
        todo.append((part[~left], wanted - share, at, 1))
    return tree, numbers


def regions_of(tree: list, vectors: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, region) of all regions that hold a vector reached by ``up`` added and ``down`` taken letters."""
    rows, found = [], []
    todo = [(0, np.arange(len(vectors)), np.full(len(vectors), up), np.full(len(vectors), down))]
    while todo:
        at, idx, ups, downs = todo.pop()
        if not len(idx):
            continue
        node = tree[at]
        if len(node) == 1:
            rows.append(idx)
            found.append(np.full(len(idx), node[0]))
            continue
        d, bound, left, right = node
        x = vectors[idx, d].astype(np.int64)
        # moving below the bound takes letters, moving above adds some
        take, add = np.maximum(x - bound, 0), np.maximum(bound + 1 - x, 0)
        near = take <= downs
        todo.append((left, idx[near], ups[near], (downs - take)[near]))
        near = add <= ups
        todo.append((right, idx[near], (ups - add)[near], downs[near]))
    return np.concatenate(rows), np.concatenate(found)


class CountTree:
    """A k-d tree over the vectors of one region, with the bounding box of every node."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(vectors)), None, 0)]
        while todo:
            idx, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side + 2] = at
            part = vectors[idx]
            cut = _split(part) if len(idx) > LEAF else None
            box = [part.min(0), part.max(0)]
            if cut is None:
                self.nodes.append([*box, None, None, idx])
                continue
            self.nodes.append([*box, -1, -1, None])
            left = part[:, cut[0]] <= cut[1]
            todo += [(idx[left], at, 0), (idx[~left], at, 1)]

    def near(self, asked: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``asked``, row of the tree) in blocks, for all vectors reached by at most so many letters."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            at, idx = todo.pop()
            low, high, left, right, own = self.nodes[at]
            q = asked[idx]
            keep = (np.maximum(low - q, 0).sum(1) <= up) & (np.maximum(q - high, 0).sum(1) <= down)
            idx = idx[keep]
            if not len(idx):
                continue
            if own is None:
                todo += [(left, idx), (right, idx)]
                continue
            step = max(1, (1 << 22) // (len(own) * DIMS))
            for k in range(0, len(idx), step):
                some = idx[k:k + step]
                apart = self.vectors[own][None, :, :] - asked[some][:, None, :]
                ok = (np.maximum(apart, 0).sum(2) <= up) & (np.maximum(-apart, 0).sum(2) <= down)
                a, b = np.nonzero(ok)
                if len(a):
                    yield some[a], own[b]


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by exactly one replaced, or one inserted, code point."""
    n = short.shape[1]
    same = short == long[:, :n]
    if long.shape[1] == n:
        return (n - same.sum(1)) == 1
    before = np.where(same.all(1), n, np.argmin(same, 1))
    back = short[:, ::-1] == long[:, :0:-1]
    after = np.where(back.all(1), n, np.argmin(back, 1))
    return before + after >= n


# -- near words ----------------------------------------------------------------------------------

@dataclass
class Upper:
    """The upper tree of a length, and into how many blocks and copies each region is dealt."""

    tree: list
    blocks: np.ndarray
    copies: np.ndarray


def fit_upper_trees(words: DataFrame, region: int = REGION, askers: int = ASKERS) -> dict[int, Upper]:
    """The upper trees of the lengths that have, or are asked by, more than ``region`` words.

    All are fitted on one sample: for each length that has more than ``region`` words (at most
    number of words / region lengths) about SAMPLE_PER_REGION words a region, at most
    SAMPLE_PER_REGION * MOST_REGIONS, those with certain hashes.
    """
    spark = words.sparkSession
    sizes = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > region)
    sizes = {r["size"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return {}
    wanted = {s: min(-(-n // region), MOST_REGIONS) for s, n in sizes.items()}
    rates = spark.createDataFrame([(s, max(n // (wanted[s] * SAMPLE_PER_REGION), 1)) for s, n in sizes.items()], "size int, rate long")
    some = words.select("word", F.length("word").alias("size")).join(F.broadcast(rates), "size").where("pmod(xxhash64(word), rate) = 0")
    sample: dict[int, list[str]] = {}
    for r in some.collect():
        sample.setdefault(r["size"], []).append(r["word"])
    vectors = {s: letter_counts(code_matrix(sorted(w))) for s, w in sample.items()}
    uppers = {}
    for size in sorted(sizes.keys() | {s + 1 for s in sizes}):
        own = vectors.get(size, np.zeros((0, DIMS), np.int16))
        tree, regions = upper_tree(own, wanted.get(size, 1))
        words_in, asking = np.zeros(regions), np.zeros(regions)
        for at, up, down, into in ((size, 0, 0, words_in), (size, 1, 1, asking), (size - 1, 1, 0, asking)):
            if at in vectors and len(vectors[at]):
                _, hit = regions_of(tree, vectors[at], up, down)
                into += np.bincount(hit, minlength=regions) * (sizes[at] / len(vectors[at]))
        uppers[size] = Upper(tree, np.maximum(np.ceil(words_in / (2 * region)), 1).astype(np.int64), np.maximum(np.ceil(asking / askers), 1).astype(np.int64))
    return uppers


def _spread(at: np.ndarray, region: np.ndarray, block: np.ndarray, copy: np.ndarray, times: np.ndarray, over_copies: bool):
    """Repeat rows over all copies (or blocks) of their region: (row, region, block, copy)."""
    at, region, block, copy = (np.repeat(x, times) for x in (at, region, block, copy))
    each = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return (at, region, block, each) if over_copies else (at, region, each, copy)


def _deal(uppers: dict[int, Upper]):
    """Rows (size, region, block, copy, asks, word, n): each word in its own region, and as asker where its reach ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            sizes = np.array([len(w) for w in words])
            hashes = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                vectors = letter_counts(code_matrix([words[k] for k in rows]))
                for target, up, down, asks in ((size, 0, 0, False), (size, 1, 1, True), (size + 1, 1, 0, True)):
                    upper = uppers.get(int(target))
                    if upper is None:
                        at, region = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                        block = copy = region
                    else:
                        at, region = regions_of(upper.tree, vectors, up, down)
                        blocks, copies = upper.blocks[region], upper.copies[region]
                        block, copy = hashes[rows[at]] % blocks, (hashes[rows[at]] >> 10) % copies
                        at, region, block, copy = _spread(at, region, block, copy, blocks if asks else copies, not asks)
                    take = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), target), pa.int64()), pa.array(region, pa.int64()), pa.array(block, pa.int64()), pa.array(copy, pa.int64()),
                         pa.array(np.full(len(at), asks)), batch.column(0).take(take), batch.column(1).take(take)],
                        ["size", "region", "block", "copy", "asks", "word", "n"])

    return run


def _best(words: list[str], counts: np.ndarray, who: np.ndarray, whom: np.ndarray, rank: np.ndarray) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best) of the askers ``who``: near words, and the commonest, first in code-point order."""
    if not len(who):
        return None
    order = np.lexsort((rank[whom], -counts[whom], who))
    who, whom = who[order], whom[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    near = np.diff(np.r_[first, len(who)])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in who[first]]), pa.array(near, pa.int64()), pa.array(counts[whom[first]], pa.int64()), pa.array([words[k] for k in whom[first]])],
        ["word", "n_near", "best_n", "best"])


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Near words inside a region: own words by own words and askers of this length or one below."""
    size = key[0].as_py()
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    asks = table.column("asks").to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    own = np.flatnonzero(~asks)
    empty = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]).empty_table()
    if not len(own):
        return empty
    target = code_matrix([words[k] for k in own])
    tree = CountTree(letter_counts(target))
    sizes = np.array([len(w) for w in words])
    out = []
    for askers, up, down in ((np.flatnonzero(asks & (sizes == size)), 1, 1), (np.flatnonzero(sizes == size - 1), 1, 0)):
        if not len(askers):
            continue
        codes = code_matrix([words[k] for k in askers])
        who, whom = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in tree.near(letter_counts(codes), up, down):
            ok = one_edit(codes[a], target[b])
            who.append(askers[a[ok]])
            whom.append(own[b[ok]])
        who, whom = np.concatenate(who), np.concatenate(whom)
        out.append(_best(words, counts, who, whom, rank))
        if up != down:  # a shorter word is near, too
            out.append(_best(words, counts, whom, who, rank))
    out = [b for b in out if b is not None]
    return pa.Table.from_batches(out) if out else empty


def near_words(words: DataFrame, region: int = REGION) -> DataFrame:
    """(word, n_near, best, best_n): for each word with near words their number and the commonest.

    ``words`` has distinct words and their counts n. Ties of n go to the first word in code-point order.
    """
    uppers = fit_upper_trees(words, region)
    dealt = words.select("word", "n").mapInArrow(_deal(uppers), "size long, region long, block long, copy long, asks boolean, word string, n long")
    parts = dealt.groupBy("size", "region", "block", "copy").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def spelling_forms(words: DataFrame, ratio: int = 2, region: int = REGION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all ``words`` (word, n).

    The form is the commonest near word if it is at least ``ratio`` times as common; following
    forms ends at the root. Each step at least doubles n, so a chain has at most 63 steps; each
    round doubles the steps made, and words that have arrived leave the rounds. No round has a
    hot key: a word has a bounded number of near words, and only words still under way are joined.
    """
    near = near_words(words, region)
    big = F.col("best_n") >= F.col("n") * ratio
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, F.col("best")).alias("form"), F.when(big, F.col("best_n")).alias("form_n"))
    table = materialize(table, "spelling-forms")
    # where each walk is; a word without a form is where walks end
    walk = materialize(table.where("form is not null").select("word", F.col("form").alias("at"), F.lit(False).alias("done")), "spelling-walk")
    while walk.where("not done").limit(1).count():
        onward = walk.select(F.col("word").alias("at"), F.col("at").alias("next"), F.col("done").alias("there"))
        moved = walk.where("not done").join(onward, "at", "left").select(
            "word", F.coalesce("next", "at").alias("at"), (F.col("next").isNull() | F.col("there")).alias("done"))
        before, walk = walk, materialize(walk.where("done").unionByName(moved), "spelling-walk")
        discard(before)
    roots = walk.select("word", F.col("at").alias("root"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int = 97, shortest: int = 5, least: int = 3,
                    ratio: int = 2, region: int = REGION) -> DataFrame:
    """The words of all texts with their forms and roots; see ``word_counts`` and ``spelling_forms``."""
    words = materialize(word_counts(docs, id_col, text_col, error_rate, shortest, least), "spelling-words")
    out = spelling_forms(words, ratio, region)
    discard(words)
    return out
