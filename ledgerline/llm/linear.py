"""Sparse linear models by follow-the-regularised-leader, trained on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of dims x classes under elastic-net penalties; a coordinate with little evidence is exactly zero."""

    def __init__(self, dims: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((dims, classes))
        self.n = np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        pulled = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, pulled / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, rows: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """rows are distinct; weights are what weights(rows) gave."""
        n = self.n[rows]
        after = n + gradient * gradient
        self.z[rows] += gradient - (np.sqrt(after) - np.sqrt(n)) / self.alpha * weights
        self.n[rows] = after


def least(f, low: float, high: float, steps: int = 60) -> float:
    """Where the unimodal f is least, by golden section."""
    g = (5**0.5 - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2
