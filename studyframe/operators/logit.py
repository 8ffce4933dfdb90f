"""All points of a logistic grid fitted together, by Newton steps.

A step needs the gradient and the Hessian of every point's penalised likelihood, which are sums
over rows: one pass over the data makes them for all points at once, each task returning one small
matrix a point. So a grid takes about ten jobs, however many points it has, where a fit of each
point takes one job an iteration. The objective is that of MLlib's LogisticRegression (weighted
mean of the log-loss plus regParam / 2 times the squared coefficients, no penalty on the intercept,
columns as they are), which has one minimum, so both give the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features up to which the Hessians are made; wider data is fitted point by point.
MOST_FEATURES = 400
#: Features of the rows that are added up at once, about.
CELLS = 1 << 18
#: Steps at most, and the largest gradient that ends them.
STEPS, CLOSE = 60, 1e-9


@dataclass
class Point:
    """One grid point: its penalty and weight column, and the coefficients so far (the intercept last)."""

    reg: float
    weight: str
    beta: np.ndarray | None = None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(features with a last column of ones, all columns) of about CELLS features at a time; features come first."""
    held, rows = [], 0

    def block():
        table = pa.Table.from_batches(held)
        # the lists of a column lie end to end
        x = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
        return np.concatenate([x, np.ones((rows, 1))], 1), table

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if sum(len(b.column(0).flatten()) for b in held) >= CELLS:
            yield block()
            held, rows = [], 0
    if held:
        yield block()


def _sums(rows: DataFrame, weights: list[str], trial: list[tuple[str, np.ndarray]]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """(weight, loss, gradient, Hessian) of each (weight column, coefficients), summed over all rows."""
    size = len(trial[0][1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trial), 2 + size + size * size))
        for x, table in _blocks(batches):
            y = table.column("label").to_numpy()
            for k, (weight, beta) in enumerate(trial):
                w = table.column(weight).to_numpy()
                eta = x @ beta
                mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                total[k, 0] += w.sum()
                total[k, 1] += (w * (np.logaddexp(0, eta) - y * eta)).sum()
                total[k, 2:2 + size] += x.T @ (w * (mu - y))
                total[k, 2 + size:] += ((x * (w * mu * (1 - mu))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(add, "sums binary").collect()  # one small matrix a task
    total = sum(np.frombuffer(p["sums"], "<f8") for p in parts).reshape(len(trial), -1)
    return [(t[0], t[1], t[2:2 + size], t[2 + size:].reshape(size, size)) for t in total]


def fit_points(rows: DataFrame, points: list[Point], n_features: int) -> list[Point]:
    """``rows`` has features (vector), label and the weight columns; the points get their coefficients."""
    weights = sorted({p.weight for p in points})
    data = rows.select(vector_to_array("features").alias("features"), "label", *weights)
    size = n_features + 1
    penalty = np.append(np.ones(n_features), 0.0)
    state = [{"beta": np.zeros(size), "step": np.zeros(size), "loss": np.inf, "done": False} for _ in points]
    for _ in range(STEPS):
        open_ = [k for k, s in enumerate(state) if not s["done"]]
        if not open_:
            break
        got = _sums(data, weights, [(points[k].weight, state[k]["beta"] + state[k]["step"]) for k in open_])
        for k, (weight, loss, gradient, hessian) in zip(open_, got):
            s, reg = state[k], points[k].reg
            if weight <= 0:
                s["done"] = True
                continue
            beta = s["beta"] + s["step"]
            loss = loss / weight + reg / 2 * float((penalty * beta * beta).sum())
            if loss > s["loss"] + 1e-12 * abs(s["loss"]):
                # too far: half the step, from where it started
                s["step"] = s["step"] / 2
                s["done"] = float(np.abs(s["step"]).max()) < 1e-12
                continue
            gradient = gradient / weight + reg * penalty * beta
            s["beta"], s["loss"] = beta, loss
            if np.abs(gradient).max() < CLOSE:
                s["done"] = True
                continue
            curve = hessian / weight + np.diag(reg * penalty) + 1e-12 * np.eye(size)
            s["step"] = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
    return [Point(p.reg, p.weight, s["beta"]) for p, s in zip(points, state)]


def scores(rows: DataFrame, points: list[Point]) -> DataFrame:
    """(label, s0, s1, ...): the linear score of every point, for ranking."""
    betas = np.stack([p.beta for p in points], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, table in _blocks(batches):
            got = x @ betas
            yield pa.RecordBatch.from_arrays([table.column("label").combine_chunks(), *(pa.array(got[:, k]) for k in range(len(points)))],
                                             ["label", *(f"s{k}" for k in range(len(points)))])

    data = rows.select(vector_to_array("features").alias("features"), F.col("label").cast("double").alias("label"))
    return data.mapInArrow(work, "label double, " + ", ".join(f"s{k} double" for k in range(len(points))))
