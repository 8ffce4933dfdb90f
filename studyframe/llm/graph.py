"""Connected components of an edge table, by star contraction.

Large-star links every larger neighbour of a node to the node's smallest neighbour;
small-star links the smaller ones. Alternating them turns every component into a star
around its smallest node in a number of rounds that grows with the logarithm of its
size. Each round is written to the shared folder, so a lost executor costs one round.

Up to ``TASK_EDGES`` edges, which fit a small task, are contracted by one task instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.session import discard, materialize


#: Edges that one task contracts by itself at most.
TASK_EDGES = 500_000


def _contract(batches):
    """(a, b) stars of all edges of one task, by union-find; roots are the smallest nodes."""
    root: dict = {}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    pairs = [(k, find(k)) for k in root]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], kind), pa.array([r for _, r in pairs], kind)], ["node", "root"])


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge; ``edges`` has columns a and b of one ordered type.

    A root is the smallest node of its component and has a row of its own. Self-links and
    repeated edges do not matter.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    if mark[0] <= TASK_EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_contract, f"node {kind}, root {kind}")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.where("a != b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), "low")
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(
            F.struct(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a != b").distinct()
        after = materialize(small, "small-star")
        new_mark = _mark(after)
        discard(now)
        discard(large)
        now = after
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
