"""Small convolutional networks over bytes, in numpy: lookup filters, max pooling, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.999 ** self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def respond(taps: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Filter responses at every place: symbols (n + width - 1), taps (width, symbols, filters)."""
    width = taps.shape[0]
    n = len(symbols) - width + 1
    out = taps[0][symbols[:n]]
    for k in range(1, width):
        out += taps[k][symbols[k:k + n]]
    return out


def calibrate(logits: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of logits by Newton steps on the log loss (Platt's smoothed targets)."""
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - target) + 1e-6 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
