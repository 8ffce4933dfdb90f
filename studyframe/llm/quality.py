"""Operator 8: a byte-level convolutional quality classifier over whole documents.

Filters over a few bytes (a learned table per tap, so a response is a sum of lookups)
run over every place of a text. Responses are max-pooled inside overlapping chunks;
a chunk is two neighbouring half-chunks, so the chunks cover all of the text. Mean and
maximum over the chunks give one probability.

The network is fitted on the driver from at most ``max_labelled`` labelled rows (chosen
by a hash of the id); scoring runs over all rows in tasks and sees the text alone.

Nulls: a null text is empty and scored as such; rows whose label or id is null are not
learnt from. Without labels of both kinds the score is the share of positive labels
(0.5 without any). Repeated rows are scored each; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import per_slice, text_bytes
from .neural import Adam, respond, sigmoid

WIDTH, FILTERS, HALF = 4, 8, 128
#: Half-chunks responded to at once, so that the work stays in the processor's cache.
_BLOCK = 512


def _halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols padded to whole half-chunks, half-chunks per text, first half-chunk of each, start of each half-chunk).

    Symbol 256 stands for the padding; an empty text is one half-chunk of it. A gap of padding
    after every text keeps the filters from reaching into the next one.
    """
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-sizes // HALF))
    first = np.cumsum(halves) - halves
    gap = np.arange(len(sizes)) * (WIDTH - 1)
    symbols = np.full(int(halves.sum()) * HALF + len(sizes) * (WIDTH - 1), 256, np.int16)
    if len(data):
        symbols[np.arange(len(data)) + np.repeat(first * HALF + gap - offsets[:-1], sizes)] = data
    return symbols, halves, first, np.arange(int(halves.sum())) * HALF + np.repeat(gap, halves)


def _pool(taps: np.ndarray, symbols: np.ndarray, starts: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each half-chunk (and its place)."""
    n, span = len(starts), HALF + WIDTH - 1
    best = np.empty((n, taps.shape[2]), np.float32)
    place = np.empty((n, taps.shape[2]), np.int64) if where else None
    for a in range(0, n, _BLOCK):
        b = min(a + _BLOCK, n)
        own = np.full((b - a) * span + WIDTH - 1, 256, np.int16)
        own[:(b - a) * span] = symbols[starts[a:b, None] + np.arange(span)].ravel()
        r = respond(taps, own).reshape(b - a, span, -1)[:, :HALF]
        best[a:b] = r.max(axis=1)
        if where:
            place[a:b] = r.argmax(axis=1) + starts[a:b, None]
    return best, place


def _chunks(halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right half-chunk of each overlapping chunk, and the first chunk of each text."""
    count = np.maximum(1, halves - 1)
    begin = np.cumsum(count) - count
    left = np.arange(int(count.sum())) + np.repeat(first - begin, count)
    return left, left + np.repeat((halves > 1).astype(np.int64), count), begin


class Network:
    """Parameters and forward pass; ``state`` is a plain dict that travels to tasks."""

    def __init__(self, state: dict[str, np.ndarray]):
        self.state = state

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        taps = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        return cls({"taps": taps, "shift": np.zeros(FILTERS, np.float32),
                    "weights": rng.normal(0, 0.3, 2 * FILTERS), "bias": np.zeros(1)})

    def forward(self, data: np.ndarray, offsets: np.ndarray, train: bool = False):
        s = self.state
        symbols, halves, first, starts = _halves(data, offsets)
        best, place = _pool(s["taps"], symbols, starts, train)
        left, right, begin = _chunks(halves, first)
        takes_left = best[left] >= best[right]
        pooled = np.tanh(np.where(takes_left, best[left], best[right]) + s["shift"])
        count = np.diff(np.append(begin, len(left)))
        mean = np.add.reduceat(pooled, begin) / count[:, None]
        top = np.maximum.reduceat(pooled, begin)
        features = np.concatenate([mean, top], 1).astype(np.float64)
        logit = (features * s["weights"]).sum(1) + s["bias"][0]  # in the same order for any number of rows
        return (logit, (symbols, place, left, right, takes_left, pooled, count, begin, top, features)) if train else logit

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        s = self.state
        logit, (symbols, place, left, right, takes_left, pooled, count, _, top, features) = self.forward(data, offsets, True)
        err = (sigmoid(logit) - labels) / len(labels)
        owner = np.repeat(np.arange(len(count)), count)
        g = err[owner, None] * s["weights"][None, :FILTERS] / count[owner, None]
        is_top = pooled == top[owner]
        g = (g + is_top * (err[owner, None] * s["weights"][None, FILTERS:])) * (1 - pooled ** 2)
        taps = np.zeros_like(s["taps"])
        spot = np.where(takes_left, place[left], place[right])
        f = np.broadcast_to(np.arange(FILTERS), spot.shape)
        for k in range(WIDTH):
            np.add.at(taps[k], (symbols[spot + k], f), g.astype(np.float32))
        return {"taps": taps, "shift": g.sum(0).astype(np.float32), "weights": features.T @ err + 1e-4 * s["weights"],
                "bias": np.array([err.sum()])}


def train(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 7) -> dict:
    """Fit on whole texts; the result is ``{"prior": p}`` if labels are of one kind."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return {"prior": float(y.mean()) if len(y) else 0.5}
    net = Network.fresh(seed)
    net.state["bias"][0] = np.log(y.mean() / (1 - y.mean()))
    adam, rng = Adam(net.state, rate), np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            own = order[a:a + batch]
            data, offsets = text_bytes(pa.array([texts[k] for k in own], pa.string()))
            adam.step(net.gradients(data, offsets, y[own]))
    return net.state


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id",
                max_labelled: int = 2500) -> dict:
    """Fit from rows with a label; ``max_labelled`` bounds the rows that come to the driver."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    rows = rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64(id_col), id_col, "y", "t").limit(max_labelled).collect()
    return train([r.t for r in rows], [r.y for r in rows])


def score_quality(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (probability of label 1)."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        net = None if "prior" in model else Network(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = text_bytes(batch.column(1))
            score = np.full(batch.num_rows, model["prior"]) if net is None else sigmoid(net.forward(data, offsets))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.astype(np.float64))], [id_col, "score"])

        return work

    run = per_slice(make, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return df.select(id_col, text_col).mapInArrow(scored, f"`{id_col}` {kind}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_labelled: int = 2500) -> DataFrame:
    """Text and label of at most ``max_labelled`` labelled ids, the first by a hash of the id.

    The ids are chosen before the join, so no other text is looked up.
    """
    ids = labels.where(F.col(id_col).isNotNull()).select(id_col, F.col(label_col)).distinct()
    ids = ids.orderBy(F.xxhash64(id_col), id_col, label_col).limit(max_labelled)
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col)
