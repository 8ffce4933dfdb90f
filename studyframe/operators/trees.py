"""Forests and boosted trees for a whole grid in one Spark job.

Trees are fitted on all labelled rows, binned once a fold: cuts are exact quantiles of all rows
(``cuts_of``), and rows are kept in the order of a hash of their key as blocks of a table (``store``),
where a row is the place of its bins among the different ones. Rows of equal bins are grown as one,
with their drawn weights added up, so the work of a level is one pass over different bins. No row
comes to the driver. What the grid points have in common is grown once:

* the first 200 of 400 trees are the forest of 200;
* a tree grown without a depth limit holds the trees of all limits, since levels are grown in
  order and a node's split does not depend on what comes below;
* boosting for 200 rounds passes the model of 100.

So the 36 forest points are six growths (smallest leaf x class weight) and the 8 boosting points
four chains (rate x depth), each in every fold. The growths are cut into stretches of trees and
dealt over the cluster; each task gets the blocks of its fold and grows its trees in batches, a
level at a time, the histograms of all nodes of all its trees in one pass. Scores of the different
held-out bins are added up for all depth limits and come back as one array a task and growth.

Every draw (bootstrap, features of a node) is a hash of seed, tree and place in the tree, so the
result does not depend on batches, tasks or recomputed executors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import logit

#: Rows of a block of a stored sample.
BLOCK = 1 << 16
#: Bins of a feature; a feature with at most so many values is split exactly.
BINS = 64
#: (tree, row) pairs that a batch grows together, and histogram cells made at once.
PAIRS, CELLS = 1 << 15, 1 << 20
#: Name of the column that orders the rows, uniform in 0..1.
PICK = "_pick"

# The searched grids.
FOREST_GRID = {"n_estimators": [200, 400], "max_depth": [None, 8, 16], "min_samples_leaf": [1, 3, 5], "class_weight": [None, "balanced"]}
BOOST_GRID = {"n_estimators": [100, 200], "learning_rate": [0.03, 0.1], "max_depth": [2, 3]}


def grid_points(grid: dict) -> list[dict]:
    """All combinations, the last name changing fastest."""
    points = [{}]
    for name, values in grid.items():
        points = [p | {name: v} for p in points for v in values]
    return points


# ----------------------------------------------------------------- binned samples

@dataclass
class Binned:
    """Rows: bins, labels, weights for boosting, real cut values of each feature.

    Row k has the bins ``x[k]``, or ``x[cell[k]]`` where ``x`` holds different bins only.
    """

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    cuts: list[np.ndarray]
    cell: np.ndarray | None = None

    def of(self, features: np.ndarray) -> np.ndarray:
        """Other rows in the same bins."""
        return np.stack([np.searchsorted(c, features[:, j]) for j, c in enumerate(self.cuts)], 1).astype(np.uint8) if len(self.cuts) else np.zeros((len(features), 0), np.uint8)

    def grouped(self) -> Binned:
        """One row for all rows of equal bins and label, their weights added up, in order of the bins."""
        x, cell = (self.x, self.cell) if self.cell is not None else _different(self.x)
        code = 2 * cell.astype(np.int64) + (self.y > 0)
        weight = np.bincount(code, self.w, 2 * len(x))
        there = np.flatnonzero(np.bincount(code, minlength=2 * len(x)))
        return Binned(x[there // 2], (there % 2).astype(float), weight[there], self.cuts)


def cut_values(column: np.ndarray) -> np.ndarray:
    """Cuts between neighbouring values: all of them, or those next to the BINS-quantiles."""
    values = np.unique(column)
    if len(values) > BINS:
        at, times = np.unique(np.searchsorted(values, np.quantile(column, np.arange(1, BINS) / BINS, method="inverted_cdf")), return_counts=True)
        # a value that fills several quantiles is cut off on both sides
        at = np.unique(np.r_[at, at[times > 1] - 1])
        at = at[(at >= 0) & (at < len(values) - 1)]
        return (values[at] + values[at + 1]) / 2
    return (values[1:] + values[:-1]) / 2


def collect_sample(rows: DataFrame, fit_rows: int, extra: tuple[str, ...] = (), picked: float = 1.0) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """(features, labels, extra columns) of about ``fit_rows`` rows at most, for inspection; no fit or search uses it."""
    first = rows.select("features").first()
    if first is None:
        return np.zeros((0, 0)), np.zeros(0), pd.DataFrame(columns=extra)
    n = rows.count()
    rows = _ordered_rows(rows)
    if n > fit_rows:
        rows = rows.where(F.col(PICK) < picked * fit_rows / n)
    got = rows.select(vector_to_array("features", "float32").alias("features"), "label", PICK, *extra).toPandas()
    # the order of arrival must not matter
    got = got.sort_values([PICK, "label"], kind="stable").reset_index(drop=True)
    x = np.stack(got["features"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, first[0].size))
    return x, got["label"].to_numpy(float), got[list(extra)]


def binned(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Binned:
    cuts = [cut_values(x[:, j]) for j in range(x.shape[1])]
    out = Binned(np.zeros((0, 0), np.uint8), y, w, cuts)
    out.x = out.of(x)
    return out


def balanced(y: np.ndarray) -> np.ndarray:
    """n / (2 * rows of the class) for each row."""
    n1 = max(float((y == 1).sum()), 1.0)
    n0 = max(float((y == 0).sum()), 1.0)
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))


# ----------------------------------------------------------------- all rows, stored as blocks

def _ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows with the column PICK; without a key it is a hash of the row itself."""
    if PICK in rows.columns:
        return rows
    return rows.withColumn(PICK, F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(1 << 52)) / float(1 << 52))


def _ranked(x: np.ndarray) -> np.ndarray:
    """Numbers of 32-bit floats in the order of their values."""
    bits = x.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits >= 0, bits, -(1 << 31) - bits)


def _unranked(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= 0, keys, -(1 << 31) - keys).astype(np.int32).view(np.float32).astype(np.float64)


def _wanted_ranks(n: int) -> np.ndarray:
    """0-based ranks of the BINS-quantiles (inverted distribution function)."""
    return (n * np.arange(1, BINS, dtype=object) + BINS - 1) // BINS - 1


def cuts_of(rows: DataFrame) -> list[np.ndarray]:
    """``cut_values`` of every feature over all rows, in two passes.

    The upper halves of the values' bits make buckets; the first pass counts them, the second the
    values of the buckets that hold a wanted rank (of all, where there are BINS or fewer). A
    feature has at most 65,536 buckets, a bucket as many values.
    """
    first = rows.select("features").first()
    if first is None or not first[0].size:
        return []
    p = first[0].size
    rows = rows.select(vector_to_array("features", "float32").alias("features"))

    def counted(take, names):
        def run(batches):
            for x, _ in logit._blocks(batches):
                keys, found = _ranked(x[:, :-1]), []
                for j in range(p):
                    values, times = np.unique(keys[:, j], return_counts=True)
                    found += take(j, values, times)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)
        return run

    def buckets(j, values, times):
        b = values >> 16
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        return [(np.full(len(at), j, np.int32), b[at], np.add.reduceat(times, at).astype(np.int64), values[at], values[np.r_[at[1:], len(b)] - 1])]

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket").reset_index(drop=True)
        ends = part["n"].cumsum()
        part["before"] = ends - part["n"]
        part["last"], part["next"] = part["most"].shift().fillna(part["least"]).astype("int64"), part["least"].shift(-1).fillna(part["most"]).astype("int64")
        part["total"] = int(ends.iloc[-1])
        if len(part) > BINS:
            part = part.iloc[np.unique(np.searchsorted(ends.to_numpy(), _wanted_ranks(int(ends.iloc[-1])).astype(np.int64), side="right"))]
        return part[["j", "bucket", "before", "last", "next", "total"]]

    of = rows.mapInArrow(counted(buckets, ["j", "bucket", "n", "least", "most"]), "j int, bucket long, n long, least long, most long").groupBy("j", "bucket").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    # at most BINS buckets a feature
    asked = of.groupBy("j").applyInPandas(chosen, "j int, bucket long, before long, last long, next long, total long").toPandas().sort_values(["j", "bucket"])
    wanted = {int(j): own for j, own in asked.groupby("j")}

    def inside(j, values, times):
        keep = np.isin(values >> 16, wanted[j]["bucket"].to_numpy())
        return [(np.full(int(keep.sum()), j, np.int32), values[keep], times[keep].astype(np.int64))] if keep.any() else []

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        j, own = int(part["j"].iloc[0]), wanted[int(part["j"].iloc[0])]
        part = part.sort_values("key")
        keys, times = part["key"].to_numpy(), part["n"].to_numpy()
        # the values next to a bucket are known too
        near = np.unique(np.r_[keys, own["last"].to_numpy(), own["next"].to_numpy()])
        values = _unranked(near)
        if len(own) <= BINS and len(near) <= BINS and int(times.sum()) == int(own["total"].iloc[0]):
            cuts = (values[1:] + values[:-1]) / 2
        else:
            bucket = np.searchsorted(own["bucket"].to_numpy(), keys >> 16)
            starts = np.searchsorted(bucket, np.arange(len(own)))
            ends = np.cumsum(times)
            # rows up to and with each value
            upto = ends - (ends - times)[starts][bucket] + own["before"].to_numpy()[bucket]
            ranks = _wanted_ranks(int(own["total"].iloc[0])).astype(np.int64)
            at, often = np.unique(np.searchsorted(near, keys[np.searchsorted(upto, ranks, side="right")]), return_counts=True)
            # a value that fills several quantiles is cut off on both sides
            at = np.unique(np.r_[at, at[often > 1] - 1])
            at = at[(at >= 0) & (at < len(near) - 1)]
            cuts = (values[at] + values[at + 1]) / 2
        return pd.DataFrame({"j": [j], "cuts": [cuts.astype("<f8").tobytes()]})

    exact = rows.mapInArrow(counted(inside, ["j", "key", "n"]), "j int, key long, n long").groupBy("j", "key").agg(F.sum("n").alias("n"))
    got = {r["j"]: np.frombuffer(r["cuts"], "<f8") for r in exact.groupBy("j").applyInPandas(cut, "j int, cuts binary").collect()}  # one row a feature
    return [got[j] for j in range(p)]


def _different(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of bytes, sorted, and the place of each row among them."""
    n, p = bins.shape
    if not p:
        return bins[:min(n, 1)], np.zeros(n, np.int64)
    _, first, place = np.unique(np.ascontiguousarray(bins).view(f"V{p}").ravel(), return_index=True, return_inverse=True)
    return bins[first], place.ravel()


def _bytes_of(bins: np.ndarray) -> pa.Array:
    n, p = bins.shape
    offsets = np.arange(n + 1, dtype=np.int32) * p
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])


def _blocks_of(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """All rows in the order of PICK, as blocks: PICK of the first and last row, different bins, each row's place among them, labels."""
    like, p = Binned(np.zeros((0, len(cuts)), np.uint8), np.zeros(0), np.zeros(0), cuts), len(cuts)

    def to_bins(batches):
        for x, table in logit._blocks(batches):
            yield pa.RecordBatch.from_arrays([_bytes_of(like.of(x[:, :-1])), *(table.column(c).combine_chunks() for c in ("label", PICK))], ["bins", "label", PICK])

    def pack(batches):
        held, rows = [], 0

        def block():
            table = pa.Table.from_batches(held)
            bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(rows, p)
            x, cell = _different(bins)
            return pa.RecordBatch.from_pydict({"first": pa.array([table.column(PICK)[0].as_py()], pa.float64()),
                                               "last": pa.array([table.column(PICK)[rows - 1].as_py()], pa.float64()), "x": pa.array([x.tobytes()], pa.binary()),
                                               "cell": pa.array([cell.astype("<i4").tobytes()], pa.binary()),
                                               "y": pa.array([table.column("label").to_numpy().astype(np.uint8).tobytes()], pa.binary())})

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield block()
                held, rows = [], 0
        if rows:
            yield block()

    named = rows.select(vector_to_array("features", "float32").alias("features"), F.col("label").cast("double").alias("label"), PICK)
    ordered = named.mapInArrow(to_bins, f"bins binary, label double, `{PICK}` double").repartitionByRange(PICK).sortWithinPartitions(PICK, "label", "bins")
    return ordered.mapInArrow(pack, "first double, last double, x binary, cell binary, y binary")


@dataclass
class Stored:
    """The rows of one fold: table of blocks (fitted and held out), cut values, boosting weights of the classes 0 and 1."""

    blocks: DataFrame
    cuts: list[np.ndarray]
    weights: tuple[float, float]


def store(fit: DataFrame, held: DataFrame | None, weights: tuple[float, float] | None = None) -> Stored:
    """All rows of ``fit`` and ``held`` (features, label, PICK) binned by the values of ``fit``; without ``weights`` classes are balanced."""
    cuts = cuts_of(fit)
    blocks = _blocks_of(fit, cuts).withColumn("held", F.lit(False))
    if held is not None:
        blocks = blocks.unionByName(_blocks_of(held, cuts).withColumn("held", F.lit(True)))
    return Stored(materialize(blocks, "bins"), cuts, weights)


def _stored(spark: SparkSession, data: Binned, held: np.ndarray, truth: np.ndarray) -> Stored:
    """A fold at hand as a stored one; boosting weights are those of the classes."""
    weights = tuple(float(data.w[data.y == y].max(initial=0.0)) for y in (0, 1))
    if not np.allclose(data.w, np.where(data.y == 1, weights[1], weights[0])):
        raise ValueError("boosting weights are one a class")
    rows = [(0.0, 1.0, data.x.tobytes(), (np.arange(len(data.y)) if data.cell is None else data.cell).astype("<i4").tobytes(), data.y.astype(np.uint8).tobytes(), False),
            (0.0, 1.0, held.tobytes(), np.arange(len(truth)).astype("<i4").tobytes(), truth.astype(np.uint8).tobytes(), True)]
    return Stored(spark.createDataFrame(rows, "first double, last double, x binary, cell binary, y binary, held boolean"), data.cuts, weights)


def _gathered(part: pd.DataFrame, cuts: list[np.ndarray], weights: tuple[float, float] | None) -> Binned:
    """Blocks laid end to end again."""
    part = part.sort_values(["first", "last"])
    xs, cells, at = [np.zeros((0, len(cuts)), np.uint8)], [np.zeros(0, np.int32)], 0
    for x, cell in zip(part["x"], part["cell"]):
        cell = np.frombuffer(cell, "<i4")
        xs.append(np.frombuffer(x, np.uint8).reshape(int(cell.max()) + 1, len(cuts)))
        cells.append(cell + np.int32(at))
        at += len(xs[-1])
    x, place = _different(np.concatenate(xs))
    y = np.frombuffer(b"".join(part["y"]), np.uint8).astype(float)
    w = balanced(y) if weights is None else np.where(y == 1, weights[1], weights[0])
    return Binned(x, y, w, cuts, place.astype(np.int32)[np.concatenate(cells)])


def _slot_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers; a table dealt by them to n tasks brings the k-th to the task k."""
    part = F.pmod(F.hash("id"), F.lit(n))
    return [r[1] for r in spark.range(100 * n + 1000).groupBy(part.alias("part")).agg(F.min("id")).orderBy("part").collect()]


def _deal(spark: SparkSession, folds: list[Stored], units: list[tuple[int, tuple]], work, schema: str) -> DataFrame:
    """``work(unit, blocks)`` of every (fold, unit), each in a task of its own that gets all blocks of its fold."""
    keys = _slot_keys(spark, len(units))
    of = spark.sparkContext.broadcast({key: unit for key, (_, unit) in zip(keys, units)})
    blocks = None
    for k, fold in enumerate(folds):
        own = fold.blocks.withColumn("fold", F.lit(k))
        blocks = own if blocks is None else blocks.unionByName(own)
    slots = spark.createDataFrame([(key, k) for key, (k, _) in zip(keys, units)], "slot long, fold int")
    dealt = blocks.join(F.broadcast(slots), "fold").repartition(len(units), "slot")
    return dealt.groupBy("slot").applyInPandas(lambda part: work(of.value[int(part["slot"].iloc[0])], part), schema)


# ----------------------------------------------------------------- forests

def _mixed(z: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number (splitmix64)."""
    with np.errstate(over="ignore"):
        z = z + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class ForestBatch:
    """Trees grown together: ``nodes`` has feature, bin, left child, share of class 1 and tree of each node."""

    def __init__(self, data: Binned, weights: np.ndarray, seed: int, trees: range, min_leaf: int, limit: int | None, valid: np.ndarray | None, marks=()):
        self.data, self.min_leaf = data, min_leaf
        n, p = len(data.y), data.x.shape[1]
        self.tried = max(1, int(math.sqrt(p)))
        self.feature, self.cut, self.left, self.value, self.tree, self.gain = [], [], [], [], [], []
        # pairs of a tree and different bins, with the drawn weights of both classes and the number of rows drawn;
        # the weight of a class is a factor of its own, so that sums are whole numbers, exact in any order
        self.scale = tuple(float(weights[data.y == c].max(initial=0.0)) or 1.0 for c in (1, 0))
        rates = weights / np.where(data.y == 1, *self.scale)
        pairs = []
        for t, number in enumerate(trees):
            counts = np.bincount(np.random.default_rng([seed, number]).integers(0, n, n), minlength=n)
            drawn = counts * rates
            sums = drawn * data.y, drawn * (1 - data.y), (counts > 0).astype(float)
            if data.cell is not None:
                sums = [np.bincount(data.cell, c, len(data.x)) for c in sums]
            own = np.flatnonzero(sums[2])
            pairs.append((own, np.full(len(own), t), *(c[own] for c in sums)))
        self.row, self.at, self.w1, self.w0, self.rows = (np.concatenate(c) for c in zip(*pairs))
        keys = _mixed(_mixed(np.array([seed], np.uint64)) ^ np.array(list(trees), np.uint64))
        tree = np.arange(len(trees))
        self.size = len(trees)
        vrow = vat = None
        if valid is not None:
            vrow = np.tile(np.arange(len(valid)), len(trees))
            vat = np.repeat(np.arange(len(trees)), len(valid))
            now = np.zeros((len(trees), len(valid)))
            flat = now.ravel()
            spot = np.arange(len(flat))
        self.marked = {}
        depth, first = 0, 0
        while len(keys):
            a = len(keys)
            t1, t0 = self.scale[0] * np.bincount(self.at, self.w1, a), self.scale[1] * np.bincount(self.at, self.w0, a)
            value = t1 / (t1 + t0)
            number = np.bincount(self.at, self.rows, a)
            if valid is not None:
                flat[spot] = value[vat]
                if depth in marks:
                    self.marked[depth] = now.sum(0)
            able = (t1 > 0) & (t0 > 0) & (number >= 2 * min_leaf)
            if limit is not None and depth >= limit:
                able[:] = False
            feature, cut, gain = self._splits(able, keys, t1, t0, number)
            split = feature >= 0
            rank = np.cumsum(split) - 1
            left = np.where(split, first + a + 2 * rank, -1)
            for store, x in ((self.feature, feature), (self.cut, cut), (self.left, left), (self.value, value), (self.tree, tree), (self.gain, gain)):
                store.append(x)
            first += a
            # rows of split nodes go on to the children
            go = split[self.at]
            self.row, self.at, self.w1, self.w0, self.rows = self.row[go], self.at[go], self.w1[go], self.w0[go], self.rows[go]
            self.at = 2 * rank[self.at] + (data.x[self.row, feature[self.at]] > cut[self.at])
            if valid is not None:
                go = split[vat]
                vrow, vat, spot = vrow[go], vat[go], spot[go]
                vat = 2 * rank[vat] + (valid[vrow, feature[vat]] > cut[vat])
            with np.errstate(over="ignore"):
                keys = np.repeat(keys[split], 2) * np.uint64(2)
            keys[1::2] += np.uint64(1)
            keys = _mixed(keys)
            tree = np.repeat(tree[split], 2)
            depth += 1
        if valid is not None:
            for m in marks:
                self.marked.setdefault(m, now.sum(0))
            self.marked[None] = now.sum(0)

    def _splits(self, able, keys, t1, t0, number):
        """Best (feature, bin, gain) of every able node; -1 where no feature splits it.

        A node looks at a few features drawn for it; where none of them splits it, at the next ones.
        """
        a, p = len(able), self.data.x.shape[1]
        feature, cut, gain = np.full(a, -1), np.zeros(a, np.int64), np.zeros(a)
        todo = np.flatnonzero(able) if p else np.zeros(0, np.int64)
        if not len(todo):
            return feature, cut, gain
        order = np.empty((a, p), np.int32)
        for k in range(0, len(todo), max(1, CELLS // p)):
            some = todo[k:k + max(1, CELLS // p)]
            order[some] = np.argsort(_mixed(keys[some, None] ^ _mixed(np.arange(p, dtype=np.uint64))[None]), 1)
        step = max(1, CELLS // (self.tried * BINS))
        # pairs in order of their nodes, so that a stretch of nodes is a stretch of pairs
        sort = np.argsort(self.at, kind="stable")
        pairs = np.bincount(self.at, minlength=a)
        ends = np.cumsum(pairs)
        # a feature's histogram is as wide as the next power of two of its bins: most one-hot features need two cells
        width = np.array([1 << max(1, len(c).bit_length()) for c in self.data.cuts])
        for tried in range(0, p, self.tried):
            failed = []
            for k in range(0, len(todo), step):
                nodes = todo[k:k + step]
                picked = order[nodes, tried:tried + self.tried]
                m = picked.shape[1]
                lengths = pairs[nodes]
                idx = sort[np.repeat(ends[nodes] - lengths, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
                local = np.repeat(np.arange(len(nodes)), lengths)
                bins = self.data.x[self.row[idx, None], picked[local]]
                # histograms (node, feature) of one width lie side by side
                wide = width[picked].ravel()
                by_width = np.argsort(wide, kind="stable")
                begin = np.empty(len(wide), np.int64)
                begin[by_width] = np.cumsum(wide[by_width]) - wide[by_width]
                cells = int(wide.sum())
                cell = (begin.reshape(-1, m)[local] + bins).ravel()
                h1 = np.bincount(cell, np.repeat(self.w1[idx], m), cells)
                h0 = np.bincount(cell, np.repeat(self.w0[idx], m), cells)
                hn = np.bincount(cell, np.repeat(self.rows[idx], m), cells)
                top, at_bin = np.empty(len(wide)), np.empty(len(wide), np.int64)
                start = 0
                for size, times in zip(*np.unique(wide, return_counts=True)):
                    own, spot = by_width[start:start + times], begin[by_width[start]]
                    start += times
                    l1, l0, ln = (by * h[spot:spot + times * size].reshape(times, size).cumsum(1) for by, h in ((self.scale[0], h1), (self.scale[1], h0), (1, hn)))
                    node = own // m
                    of = nodes[node]
                    r1, r0, rn = t1[of, None] - l1, t0[of, None] - l0, number[of, None] - ln
                    fine = (ln >= self.min_leaf) & (rn >= self.min_leaf)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = (l1 * l1 + l0 * l0) / (l1 + l0) + (r1 * r1 + r0 * r0) / (r1 + r0)
                    score = np.where(fine, score, -np.inf)
                    best = score.argmax(1)
                    at_bin[own], top[own] = best, score[np.arange(times), best]
                # the first of equally good features, in the order drawn
                best = top.reshape(-1, m).argmax(1) + m * np.arange(len(nodes))
                top = top[best]
                ok = top > -np.inf
                done = nodes[ok]
                feature[done] = picked.ravel()[best[ok]]
                cut[done] = at_bin[best[ok]]
                gain[done] = np.maximum(top[ok] - (t1[done] ** 2 + t0[done] ** 2) / (t1[done] + t0[done]), 0)
                failed.append(nodes[~ok])
            todo = np.concatenate(failed)
            if not len(todo):
                break
        return feature, cut, gain

    def trees(self) -> list[dict]:
        """Each tree's nodes as arrays, cuts as real values (go left where value <= cut), and its importances."""
        feature, cut, left, value, tree, gain = (np.concatenate(x) for x in (self.feature, self.cut, self.left, self.value, self.tree, self.gain))
        real = np.array([self.data.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
        out = []
        for t in range(self.size):
            own = np.flatnonzero(tree == t)
            place = np.full(len(tree), -1)
            place[own] = np.arange(len(own))
            inner = feature[own] >= 0
            importance = np.bincount(feature[own][inner], gain[own][inner], len(self.data.cuts))
            total = importance.sum()
            out.append({"feature": feature[own].astype(np.int32), "cut": real[own], "left": np.where(inner, place[left[own]], -1).astype(np.int32),
                        "value": value[own], "importance": importance / total if total > 0 else importance})
        return out


# ----------------------------------------------------------------- boosting

def _boost_tree(data: Binned, residual: np.ndarray, hessian: np.ndarray, depth: int) -> tuple[dict, np.ndarray]:
    """One regression tree on the residuals (Friedman's gain, Newton leaves); the tree and each row's leaf value."""
    n, p = data.x.shape
    at = np.zeros(n, np.int64)
    feature, cut, left, value, gain = [], [], [], [], []
    first, a = 0, 1
    place = np.zeros(n, np.int64)
    wr = data.w * residual
    alive = np.arange(n)
    flat = np.arange(p) * BINS
    for level in range(depth + 1):
        tw, tr = np.bincount(at, data.w[alive], a), np.bincount(at, wr[alive], a)
        th = np.bincount(at, hessian[alive], a)
        leaf = np.where(th > 1e-150, tr / np.maximum(th, 1e-150), 0.0)
        place[alive] = first + at
        f, c, g = np.full(a, -1), np.zeros(a, np.int64), np.zeros(a)
        if level < depth and p:
            number = np.bincount(at, minlength=a)
            best = np.full(a, -np.inf)
            # features in stretches, so that rows x features stays small
            for j in range(0, p, max(1, CELLS // max(n, 1))):
                own = slice(j, min(j + max(1, CELLS // max(n, 1)), p))
                m = own.stop - own.start
                cell = (at[:, None] * (m * BINS) + (flat[:m] + data.x[alive, own])).ravel()
                shape, cells = (a, m, BINS), a * m * BINS
                lw = np.bincount(cell, np.repeat(data.w[alive], m), cells).reshape(shape).cumsum(2)
                lr = np.bincount(cell, np.repeat(wr[alive], m), cells).reshape(shape).cumsum(2)
                ln = np.bincount(cell, minlength=cells).reshape(shape).cumsum(2)
                rw, rr, rn = tw[:, None, None] - lw, tr[:, None, None] - lr, number[:, None, None] - ln
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (rw * lr - lw * rr) ** 2 / (lw * rw * (lw + rw))
                score = np.where((ln > 0) & (rn > 0), score, -np.inf).reshape(a, -1)
                top = score.argmax(1)
                s = score[np.arange(a), top]
                better = s > best
                best[better] = s[better]
                f[better], c[better] = j + top[better] // BINS, top[better] % BINS
            f = np.where(best > 1e-12, f, -1)
            g = np.where(f >= 0, best, 0.0)
        split = f >= 0
        rank = np.cumsum(split) - 1
        feature.append(f)
        cut.append(c)
        left.append(np.where(split, first + a + 2 * rank, -1))
        value.append(leaf)
        gain.append(g)
        first += a
        if not split.any():
            break
        go = split[at]
        alive, at = alive[go], at[go]
        at = 2 * rank[at] + (data.x[alive, f[at]] > c[at])
        a = 2 * int(split.sum())
    feature, cut, left, value, gain = (np.concatenate(x) for x in (feature, cut, left, value, gain))
    return {"feature": feature, "bin": cut, "left": left, "value": value, "gain": gain}, value[place]


def _walk_bins(tree: dict, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = tree["left"][at[rows]] >= 0
        rows = rows[inner]
        if not len(rows):
            return tree["value"][at]
        node = at[rows]
        at[rows] = tree["left"][node] + (x[rows, tree["feature"][node]] > tree["bin"][node])


def boost(data: Binned, rounds: int, rate: float, depth: int, valid: np.ndarray | None = None, marks=(), keep: bool = False):
    """(start, trees, {rounds: raw scores of ``valid``}) of boosting on weighted log-loss."""
    data = data.grouped()
    p1 = np.clip((data.w * data.y).sum() / data.w.sum(), 1e-15, 1 - 1e-15)
    start = float(np.log(p1 / (1 - p1)))
    raw = np.full(len(data.y), start)
    held = None if valid is None else np.full(len(valid), start)
    trees, marked = [], {}
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-raw))
        tree, leaves = _boost_tree(data, data.y - p, data.w * p * (1 - p), depth)
        raw += rate * leaves
        if valid is not None:
            held += rate * _walk_bins(tree, valid)
            if k in marks:
                marked[k] = held.copy()
        if keep:
            inner = tree["feature"] >= 0
            total = tree["gain"].sum()
            importance = np.bincount(tree["feature"][inner], tree["gain"][inner], len(data.cuts))
            trees.append({"feature": tree["feature"].astype(np.int32), "left": tree["left"].astype(np.int32), "value": rate * tree["value"],
                          "cut": np.array([data.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(tree["feature"], tree["bin"])]),
                          "importance": importance / total if total > 0 else importance})
    return start, trees, marked


# ----------------------------------------------------------------- the search

def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Exact ROC area, ties counted half; NaN with one class."""
    return counted_auc((y == 1).astype(float), (y != 1).astype(float), score)


def counted_auc(n1: np.ndarray, n0: np.ndarray, score: np.ndarray) -> float:
    """The same of scores that ``n1`` rows of class 1 and ``n0`` others have."""
    values, place = np.unique(score, return_inverse=True)
    ones, others = np.bincount(place, n1, len(values)), np.bincount(place, n0, len(values))
    pairs = ones.sum() * others.sum()
    return float((ones * (np.cumsum(others) - others / 2)).sum() / pairs) if pairs else math.nan


def batches_of(n: int, counts: list[int], start: int = 0) -> list[range]:
    """Trees ``start`` to the largest count in batches of about PAIRS pairs that end at every count."""
    step = max(1, min(50, PAIRS // max(n, 1)))
    out = []
    for stop in sorted(counts):
        out += [range(a, min(a + step, stop)) for a in range(start, stop, step)]
        start = stop
    return out


def _spread_units(spark: SparkSession, units: list[tuple]) -> DataFrame:
    """The work table: one JSON row a unit, dealt in turn, so that long units which follow each other go to different tasks."""
    slots = min(len(units), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.sparkContext.parallelize([[json.dumps(u) for u in units[k::slots]] for k in range(slots)], slots)
    return spark.createDataFrame(rows.flatMap(lambda own: [(u,) for u in own]), "unit string")


def _stretches(n: int, pieces: int) -> list[tuple[int, int]]:
    """Trees 0 to n - 1 in about equal stretches."""
    ends = np.unique(np.linspace(0, n, min(n, pieces) + 1).astype(int)).tolist()
    return list(zip(ends, ends[1:]))


def search(spark: SparkSession, folds: list, families: list[str], seed: int) -> dict[tuple[str, int], list[float]]:
    """{(family, grid point): AUC of each fold}; a fold is stored, or (binned training rows, held-out bins, held-out labels)."""
    folds = [f if isinstance(f, Stored) else _stored(spark, *f) for f in folds]
    units: list[tuple[int, tuple]] = []
    counts = sorted(FOREST_GRID["n_estimators"])
    if "gradient_boosting" in families:
        # the long units first
        units += [(k, ("boost", k, rate, depth)) for k in range(len(folds)) for rate in BOOST_GRID["learning_rate"] for depth in BOOST_GRID["max_depth"]]
    if "random_forest" in families:
        growths = [(k, leaf, cw) for k in range(len(folds)) for leaf in FOREST_GRID["min_samples_leaf"] for cw in FOREST_GRID["class_weight"]]
        pieces = max(1, math.ceil(4 * spark.sparkContext.defaultParallelism / max(len(growths), 1)))
        units += [(k, ("forest", k, leaf, cw, start, stop)) for k, leaf, cw in growths for start, stop in _stretches(max(counts), pieces)]
    if not units or not folds:
        return {}
    depths = [d for d in FOREST_GRID["max_depth"] if d is not None]
    marks = tuple(BOOST_GRID["n_estimators"])
    known = spark.sparkContext.broadcast([(f.cuts, f.weights) for f in folds])

    def work(unit: tuple, part: pd.DataFrame) -> pd.DataFrame:
        kind, k = unit[:2]
        data, held = (_gathered(part[part["held"] == h], *known.value[k]) for h in (False, True))
        sums: dict[tuple, np.ndarray] = {}
        if kind == "boost":
            _, _, got = boost(data, max(marks), unit[2], unit[3], held.x, marks)
            for rounds, raw in got.items():
                sums["boost", k, unit[2], str(unit[3]), str(rounds)] = raw
        else:
            _, _, leaf, cw, start, stop = unit
            weights = balanced(data.y) if cw else np.ones(len(data.y))
            for b in batches_of(max(len(data.x), len(held.x)), [c for c in counts if start < c < stop] + [stop], start):
                batch = ForestBatch(data, weights, seed, b, leaf, None, held.x, depths)
                piece = next(c for c in counts if b.stop <= c)
                for depth, total in batch.marked.items():
                    key = ("forest", k, float(leaf), f"{cw}/{depth}", str(piece))
                    sums[key] = sums.get(key, 0) + total
        # rows of both classes with each of the held-out bins: once a growth
        truth = [np.bincount(held.cell, held.y == y, len(held.x)).astype("<f8").tobytes() for y in (1, 0)] if kind == "boost" or unit[4] == 0 else [None, None]
        start = 0 if kind == "boost" else unit[4]
        return pd.DataFrame([(*key, start, v.astype("<f8").tobytes(), *truth) for key, v in sums.items()], columns=["kind", "fold", "a", "b", "c", "start", "sums", "n1", "n0"])

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """The AUCs of one growth of a fold: stretches of forests are added up in their order."""
        kind, k, a, b = key
        there = part[part["n1"].notna()].iloc[0]
        n1, n0 = (np.frombuffer(there[c], "<f8") for c in ("n1", "n0"))
        total, out = np.zeros(len(n1)), []
        for c in sorted(part["c"].unique(), key=int):
            own = np.zeros(len(n1))
            for s in part.loc[part["c"] == c].sort_values("start")["sums"]:
                own = own + np.frombuffer(s, "<f8")
            total = own if kind == "boost" else total + own
            # rounded, so that the order in which tasks are added up makes no ties or breaks them
            out.append((kind, k, a, b, c, counted_auc(n1, n0, np.round(total, 9))))
        return pd.DataFrame(out, columns=["kind", "fold", "a", "b", "c", "auc"])

    kinds = "kind string, fold int, a double, b string, c string"
    parts = _deal(spark, folds, units, work, f"{kinds}, start int, sums binary, n1 binary, n0 binary")
    scores = parts.groupBy("kind", "fold", "a", "b").applyInPandas(join, f"{kinds}, auc double").collect()
    of = {(r["kind"], r["a"], r["b"], r["c"], r["fold"]): r["auc"] for r in scores}
    out = {}
    for family, grid in (("random_forest", FOREST_GRID), ("gradient_boosting", BOOST_GRID)):
        if family in families:
            for i, p in enumerate(grid_points(grid)):
                name = (("forest", float(p["min_samples_leaf"]), f"{p['class_weight']}/{p['max_depth']}") if family == "random_forest"
                        else ("boost", p["learning_rate"], str(p["max_depth"])))
                out[family, i] = [of[(*name, str(p["n_estimators"]), k)] for k in range(len(folds))]
    return out


# ----------------------------------------------------------------- fitted models

class _Trees(Params):
    family = Param(Params._dummy(), "family", "random_forest or gradient_boosting", typeConverter=TypeConverters.toString)
    points = Param(Params._dummy(), "points", "the grid point, as JSON", typeConverter=TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of all draws", typeConverter=TypeConverters.toInt)
    fitRows = Param(Params._dummy(), "fitRows", "rows fitted on at most, about, where asked for; 0 means all", typeConverter=TypeConverters.toInt)


class TreesClassifier(Estimator, _Trees, HasFeaturesCol, HasLabelCol, HasProbabilityCol):
    """One grid point of a family, fitted on all rows; its trees are grown by one Spark job."""

    @keyword_only
    def __init__(self, family=None, points=None, seed=42, fitRows=0):
        super().__init__()
        self._setDefault(seed=42, fitRows=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TreesModel:
        spark = dataset.sparkSession
        family, point, seed = self.getOrDefault("family"), json.loads(self.getOrDefault("points")), self.getOrDefault("seed")
        rows = _ordered_rows(dataset).select("features", "label", PICK)
        if self.getOrDefault("fitRows"):
            rows = rows.where(F.col(PICK) < self.getOrDefault("fitRows") / max(rows.count(), 1))
        kept = store(rows, None)
        cuts = spark.sparkContext.broadcast(kept.cuts)

        def work(unit: tuple, part: pd.DataFrame) -> pd.DataFrame:
            data, first = _gathered(part, cuts.value, None), 0.0
            if family == "random_forest":
                weights = balanced(data.y) if point["class_weight"] else np.ones(len(data.y))
                grown = (t for b in batches_of(len(data.x), [unit[1]], unit[0])
                         for t in ForestBatch(data, weights, seed, b, point["min_samples_leaf"], point["max_depth"], None).trees())
            else:
                first, grown, _ = boost(data, unit[1], point["learning_rate"], point["max_depth"], keep=True)
            return pd.DataFrame([(unit[0] + i, t["feature"].astype("<i4").tobytes(), t["cut"].astype("<f8").tobytes(), t["left"].astype("<i4").tobytes(),
                                  t["value"].astype("<f8").tobytes(), t["importance"].astype("<f8").tobytes(), first) for i, t in enumerate(grown)],
                                columns=["tree", "feature", "cut", "left", "value", "importance", "start"])

        n = point["n_estimators"]
        units = [(0, u) for u in (_stretches(n, 4 * spark.sparkContext.defaultParallelism) if family == "random_forest" else [(0, n)])]
        # the trees stay in the shared folder: those of all rows may be many times the driver's memory
        table = materialize(_deal(spark, [kept], units, work, f"{TREES}, start double"), "trees")
        discard(kept.blocks)
        start = table.agg(F.max("start")).first()[0]
        return TreesModel(family=family, points=json.dumps(point), start=start, cuts=json.dumps([c.tolist() for c in kept.cuts]))._with(table.drop("start"))


TREES = "tree int, feature binary, cut binary, left binary, value binary, importance binary"


class TreesModel(Model, _Trees, HasFeaturesCol, HasProbabilityCol, MLWritable, MLReadable):
    """A fitted ensemble; its trees are rows of a Parquet table, before and after it is saved."""

    start = Param(Params._dummy(), "start", "raw score before the first tree", typeConverter=TypeConverters.toFloat)
    cuts = Param(Params._dummy(), "cuts", "cut values of each feature, as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, family=None, points=None, start=0.0, cuts="[]"):
        super().__init__()
        self._setDefault(start=0.0, cuts="[]")
        self._set(**self._input_kwargs)
        self.table: DataFrame | None = None

    def _with(self, table: DataFrame) -> TreesModel:
        self.table = table
        return self

    @property
    def featureImportances(self) -> DenseVector:
        # one short array a tree
        total = sum(np.frombuffer(b, "<f8") for b in self.table.select("tree", "importance").toPandas().sort_values("tree")["importance"])
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _forest(self) -> tuple[np.ndarray, ...]:
        """All trees as one set of arrays, for inspection: roots, feature, cut, left, value."""
        return _laid_out(self.table.toPandas().sort_values("tree"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Different bins are scored, not rows: each task takes some trees to all of them, and sums are added in the trees' order."""
        spark = dataset.sparkSession
        forest, start = self.getOrDefault("family") == "random_forest", self.getOrDefault("start")
        cuts = [np.array(c) for c in json.loads(self.getOrDefault("cuts"))]
        like, p = Binned(np.zeros((0, len(cuts)), np.uint8), np.zeros(0), np.zeros(0), cuts), len(cuts)
        trees = json.loads(self.getOrDefault("points"))["n_estimators"]
        slots = min(trees, spark.sparkContext.defaultParallelism)

        @F.pandas_udf("binary")
        def to_bins(features: pd.Series) -> pd.Series:
            return pd.Series(_bytes_of(like.of(np.stack(features.to_numpy()).astype(np.float64).reshape(len(features), p))).to_pylist()) if len(features) else pd.Series([], dtype=object)

        def pack(batches):
            held = []
            for batch in batches:
                held += batch.column(0).to_pylist()
                while len(held) >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held[:BLOCK])], pa.binary()), pa.array([BLOCK], pa.int32())], ["bins", "n"])
                    held = held[BLOCK:]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int32())], ["bins", "n"])

        def add(key: tuple, grown: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            if not len(grown) or not len(cells):
                return pd.DataFrame({"_cell": [], "part": [], "total": []})
            own, out = _laid_out(grown.sort_values("tree")), []
            for bins, n in zip(cells["bins"], cells["n"]):
                x = np.frombuffer(bins, np.uint8).reshape(n, p)
                # a value inside each bin
                shown = np.stack([np.r_[c, np.inf][x[:, j]] for j, c in enumerate(cuts)], 1) if p else np.zeros((n, 0))
                out.append(pd.DataFrame({"_cell": _bytes_of(x).to_pylist(), "part": int(grown["part"].iloc[0]), "total": _sums_of(own, shown)}))
            return pd.concat(out, ignore_index=True)

        keyed = dataset.withColumn("_cell", to_bins(vector_to_array(F.col(self.getFeaturesCol()), "float32")))
        cells = keyed.select("_cell").distinct().mapInArrow(pack, "bins binary, n int")
        keys = _slot_keys(spark, slots)
        part = F.floor(F.col("tree") * slots / trees).cast("int")
        grown = self.table.withColumn("part", part).withColumn("slot", F.element_at(F.array(*[F.lit(k).cast("long") for k in keys]), F.col("part") + 1))
        asked = cells.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in keys], "slot long")))
        sums = grown.select("slot", "part", "tree", "feature", "cut", "left", "value").repartition(slots, "slot").groupBy("slot").cogroup(
            asked.repartition(slots, "slot").groupBy("slot")).applyInPandas(add, "_cell binary, part int, total double")
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "total"))), F.lit(0.0), lambda a, s: a + s["total"])
        scored = sums.groupBy("_cell").agg(total.alias("_tree_p"))
        scored = scored.withColumn("_tree_p", F.col("_tree_p") / trees if forest else 1 / (1 + F.exp(-(F.lit(start) + F.col("_tree_p")))))
        p1 = F.col("_tree_p")
        return keyed.join(scored, "_cell", "left").withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p1, p1))).drop("_cell", "_tree_p")

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


def _laid_out(table: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The trees of a table as one set of arrays: roots, feature, cut, left, value."""
    parts = {c: [np.frombuffer(b, "<i4" if c in ("feature", "left") else "<f8") for b in table[c]] for c in ("feature", "cut", "left", "value")}
    sizes = np.array([len(f) for f in parts["feature"]], np.int64)
    roots = np.cumsum(sizes) - sizes
    left = np.concatenate([np.where(x >= 0, x + r, -1) for x, r in zip(parts["left"], roots)])
    return roots, np.concatenate(parts["feature"]), np.concatenate(parts["cut"]), left, np.concatenate(parts["value"])


def _sums_of(grown: tuple[np.ndarray, ...], features: np.ndarray) -> np.ndarray:
    """The sum of all trees' leaf values for each row."""
    roots, feature, cut, left, value = grown
    out = np.empty(len(features))
    step = max(1, CELLS // max(len(roots), 1))
    for k in range(0, len(features), step):
        x = features[k:k + step]
        at = np.tile(roots, len(x))
        row = np.repeat(np.arange(len(x)), len(roots))
        on = np.flatnonzero(left[at] >= 0)
        while len(on):
            node = at[on]
            at[on] = left[node] + (x[row[on], feature[node]] > cut[node])
            on = on[left[at[on]] >= 0]
        out[k:k + len(x)] = value[at].reshape(len(x), len(roots)).sum(1)
    return out


class _TreesWriter(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/trees")


class _TreesReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._with(self.sparkSession.read.parquet(f"{path}/trees"))
