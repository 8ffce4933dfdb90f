"""Operator 5: near-duplicate vectors by an epsilon grid order join.

Vectors of one label link when their cosine reaches a threshold, that is, when their unit
vectors are no farther apart than epsilon. Equal vectors are collapsed into one class with
a count. Classes are sorted by the grid cells (of width epsilon) of their leading principal
coordinates; the sorted sequence is cut into blocks. Two blocks meet only if the boxes
around their coordinates come within epsilon, and inside a meeting both intervals are
halved again and again, leaving out parts whose boxes are provably too far apart; what is
left is compared exactly in double precision. A meeting emits, for each class that has a
link there, the number of vectors linked and one edge of a spanning forest, so no list of
all pairs ever exists.

The principal directions come from sums over all classes; they decide only what can be
skipped, never what links.

Nulls: a null label, a null or zero vector, or one with null or non-finite parts links with
nothing. Vectors of unlike length are never compared. A null id is counted like any other
row but is no component id; a component without ids has a null one. An empty table gives
no rows. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.session import materialize

from .graph import components

DIMS = 6          # principal coordinates in the grid order and the boxes
BLOCK = 2048      # classes in a block
LEAF = 128        # classes compared at once
SLACK = 1e-9


def _valid(embedding: str, label: str):
    e = F.col(embedding)
    whole = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & whole & F.exists(e, lambda x: x != 0), F.lit(False))


def vector_classes(rows: DataFrame) -> DataFrame:
    """Classes of equal vectors of one label: key, label, dim, vec (double), weight, first_id."""
    return rows.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("weight"),
                                   F.min("id").alias("first_id")).withColumn("dim", F.size("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the leading directions of the unit vectors (rows).

    Tasks sum up products; the driver gets dim x dim sums for each length.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                u = _unit(_matrix(batch.column(1).filter(pa.array(dims == d)), d))
                u = np.concatenate([u, np.ones((len(u), 1))], 1)
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)),
                                              pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())], ["dim", "i", "j", "s"])

    sums = classes.select("dim", "vec").mapInArrow(run, "dim int, i int, j int, s double")
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.dim, np.zeros((r.dim + 1, r.dim + 1)))[r.i, r.j] = r.s
    for d, s in out.items():
        n, mean = s[d, d], s[:d, d] / s[d, d]
        _, directions = np.linalg.eigh(s[:d, :d] / n - np.outer(mean, mean))
        out[d] = directions[:, ::-1].T[:DIMS]
    return out


def _blocks(batches, directions: dict[int, np.ndarray]):
    """Cut a sorted stream into block rows."""
    held: list[pa.RecordBatch] = []

    def emit(rows: pa.Table):
        dim = rows["dim"][0].as_py()
        v = _matrix(rows["vec"].combine_chunks(), dim)
        p = _unit(v) @ directions[dim].T
        keys = rows["key"].to_pylist()
        return pa.RecordBatch.from_arrays([
            pa.array([keys[0]]), rows["label"].combine_chunks()[:1], pa.array([dim], pa.int32()),
            pa.array([list(p.min(0))], pa.list_(pa.float64())), pa.array([list(p.max(0))], pa.list_(pa.float64())),
            pa.array([keys], pa.list_(pa.string())), pa.array([rows["weight"].to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())],
            ["block", "label", "dim", "lo", "hi", "keys", "weights", "vecs"])

    def groups(batch):
        label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
        at = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or (label[k], dim[k]) != (label[at], dim[at]):
                yield (label[at], dim[at]), batch.slice(at, k - at)
                at = k

    now, count = None, 0
    for batch in batches:
        for key, part in groups(batch):
            if key != now and held:
                yield emit(pa.Table.from_batches(held))
                held, count = [], 0
            now = key
            while part.num_rows:
                take = min(part.num_rows, BLOCK - count)
                held.append(part.slice(0, take))
                count += take
                part = part.slice(take)
                if count == BLOCK:
                    yield emit(pa.Table.from_batches(held))
                    held, count = [], 0
    if held:
        yield emit(pa.Table.from_batches(held))


class Forest:
    """Components among the classes of one meeting; roots are the smallest places."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(root[root], root):
                root[:] = root[root]


def meet(ua, ub, pa_, pb, weight_a, weight_b, same: bool, cosine: float, epsilon: float):
    """Links between two intervals: (linked weight for each of a, of b, forest over a then b)."""
    n = len(ua)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(ub), np.int64)
    forest = Forest(n if same else n + len(ub))
    shift = 0 if same else n
    todo = [(0, n, 0, len(ub))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue  # the mirror image of another part
        x, y = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > epsilon * epsilon:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            halves_a = [(a0, am), (am, a1)] if a1 - a0 > LEAF else [(a0, a1)]
            halves_b = [(b0, bm), (bm, b1)] if b1 - b0 > LEAF else [(b0, b1)]
            todo += [(*s, *t) for s in halves_a for t in halves_b]
            continue
        near = ua[a0:a1] @ ub[b0:b1].T >= cosine
        if same:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)
        if near.any():
            links_a[a0:a1] += near @ weight_b[b0:b1]
            links_b[b0:b1] += near.T @ weight_a[a0:a1]
            i, j = np.nonzero(near)
            forest.link(i + a0, j + b0 + shift)
    return links_a, links_b, forest


def _meetings(batches, directions, cosine: float, epsilon: float):
    for batch in batches:
        for r in batch.to_pylist():
            p = directions[r["dim"]].T
            same = r["block"] == r["other"]
            ua = _unit(np.frombuffer(r["vecs"]).reshape(-1, r["dim"]))
            ub = ua if same else _unit(np.frombuffer(r["vecs_b"]).reshape(-1, r["dim"]))
            wa = np.array(r["weights"])
            wb = wa if same else np.array(r["weights_b"])
            la, lb, forest = meet(ua, ub, ua @ p, ub @ p, wa, wb, same, cosine, epsilon)
            keys = r["keys"] if same else r["keys"] + r["keys_b"]
            links = la + lb if same else np.append(la, lb)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.string()), pa.array([keys[k] for k in forest.root[at]], pa.string()),
                                              pa.array(links[at])], ["key", "near", "links"])


def class_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(key, near, links): for each class and meeting the weight linked and a forest edge."""
    spark = classes.sparkSession
    directions = principal_directions(classes)
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def cells(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, DIMS), np.int64)
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for d in np.unique(dims).tolist():
                own = dims == d
                p = _unit(_matrix(batch.column(batch.schema.get_field_index("vec")).filter(pa.array(own)), d)) @ directions[d].T
                out[own, :p.shape[1]] = np.floor(p / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int64()))], [*batch.schema.names, "cell"])

    base = classes.select("key", "label", "dim", "vec", "weight")
    kind = classes.schema["label"].dataType.simpleString()
    placed = base.mapInArrow(cells, f"key string, label {kind}, dim int, vec array<double>, weight long, cell array<long>")
    total = classes.count()
    parts = max(1, -(-total // (4 * BLOCK)))
    placed = placed.repartitionByRange(parts, "label", "dim", "cell", "key").sortWithinPartitions("label", "dim", "cell", "key")
    blocks = placed.mapInArrow(lambda batches: _blocks(batches, directions),
                               f"block string, label {kind}, dim int, lo array<double>, hi array<double>, keys array<string>, weights array<long>, vecs binary")
    blocks = materialize(blocks, "blocks")
    # blocks that may meet: first coordinates at most one cell apart, then boxes within epsilon
    width = F.lit(epsilon)
    first = F.floor(F.col("lo")[0] / width)
    last = F.floor(F.col("hi")[0] / width)
    a = blocks.select("block", "label", "dim", "lo", "hi", F.explode(F.sequence(first, last)).alias("c"))
    b = blocks.select(F.col("block").alias("other"), F.col("label").alias("label_b"), F.col("dim").alias("dim_b"), F.col("lo").alias("lo_b"),
                      F.col("hi").alias("hi_b"), F.explode(F.sequence(first - 1, last + 1)).alias("c_b"))
    gaps = F.zip_with(F.zip_with("lo", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi", lambda x, y: x - y),
                      lambda x, y: F.greatest(x, y, F.lit(0.0)))
    square = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    pairs = a.join(b, (F.col("label") == F.col("label_b")) & (F.col("dim") == F.col("dim_b")) & (F.col("c") == F.col("c_b"))
                   & (F.col("block") <= F.col("other"))).where(square <= F.lit(epsilon * epsilon + SLACK))
    pairs = pairs.select("block", "other").distinct()
    left = blocks.select("block", "dim", "keys", "weights", "vecs")
    right = blocks.select(F.col("block").alias("other"), F.col("keys").alias("keys_b"), F.col("weights").alias("weights_b"), F.col("vecs").alias("vecs_b"))
    met = pairs.join(left, "block").join(right, "other").select("block", "other", "dim", "keys", "weights", "vecs", "keys_b", "weights_b", "vecs_b")
    # meetings are costly and few: deal them out evenly, a handful in a batch
    spread = max(spark.sparkContext.defaultParallelism, pairs.count() // 4 + 1)
    met = met.repartition(spread)
    return met.mapInArrow(lambda batches: _meetings(batches, directions, cosine, epsilon), "key string, near string, links long")


def dedup_embeddings(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("raw"), _valid(vec_col, label_col).alias("valid"))
    key = F.concat(F.hex(F.xxhash64("label", "raw")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "raw", "label")), F.lit("-"), F.size("raw").cast("string"))
    usable = rows.where("valid").select("id", "label", key.alias("key"), F.transform("raw", lambda x: x.cast("double")).alias("vec"))
    classes = materialize(vector_classes(usable), "vector-classes")
    links = materialize(class_links(classes, cosine), "vector-links")
    roots = components(links.select(F.col("key").alias("a"), F.col("near").alias("b")))
    found = (classes.select("key", "weight", "first_id")
             .join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
             .join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    heads = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = found.join(heads, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = usable.select("id", "key").join(found, "key").select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                         F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
