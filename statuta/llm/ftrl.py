"""Follow-the-regularised-leader logistic regression on hashed sparse features."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """One weight for each hashed feature; example by example, per-coordinate rates, L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ values) - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 0) -> Ftrl:
        """Passes over the rows in a fixed random order each."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.update(*rows[i], labels[i])
        return self

