"""Sparse multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of (feature, value) pairs: row i holds features[bounds[i]:bounds[i + 1]]."""

    features: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        bounds = np.cumsum([0, *[len(f) for f, _ in rows]])
        features, values = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
        for (f, v), a, b in zip(rows, bounds[:-1], bounds[1:]):
            features[a:b], values[a:b] = f, v
        return cls(features, values, bounds)

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.bounds)[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.bounds[rows] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        return Sparse(self.features[at], self.values[at], np.concatenate([[0], ends]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Row sums of value times weight row, one column for each column of weights."""
        rows = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        return np.stack([np.bincount(rows, self.values * weights[self.features, k], len(self.bounds) - 1) for k in range(weights.shape[1])], 1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: Sparse, y: np.ndarray, classes: int, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0, epochs: int = 4, batch: int = 32, seed: int = 5) -> np.ndarray:
    """Weights (size x classes) for labels y; each step is a batch of rows in a fixed random order."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed).permutation(len(y))
    steps = []
    for rows in np.array_split(order, max(1, -(-len(order) // batch))):
        part = x.take(rows)
        at, inverse = np.unique(part.features, return_inverse=True)
        steps.append((at, Sparse(inverse.astype(np.int32), part.values, part.bounds), np.eye(classes)[y[rows]], np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(part.bounds))))
    for _ in range(epochs):
        for at, part, truth, row in steps:
            w = weights(at)
            error = softmax(part.times(w)) - truth
            g = np.stack([np.bincount(part.features, part.values * error[row, k], len(at)) for k in range(classes)], 1)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The number that logits are divided by so that the log-likelihood of labels is largest (golden section)."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
