"""Small gradient-boosted trees for training examples that are counted by equal ones (numpy only)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-two trees, cut at any value of the examples.

    Training runs on the driver over examples whose bound its caller documents, each
    with its weight, the number of equal ones; the fitted model is a few kilobytes
    and scores arrays inside Python workers.
    """

    def __init__(self, rounds: int = 40, rate: float = 0.3):
        self.rounds, self.rate = rounds, rate
        self.start = 0.0
        self.trees: list[tuple] = []

    @staticmethod
    def _split(values: list[np.ndarray], codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        best = (1e-9, -1, 0.0)
        total = g.sum() ** 2 / (h.sum() + 1.0)
        for k, own in enumerate(values):
            gl, hl, n = (np.bincount(codes[:, k], w, len(own)).cumsum()[:-1] for w in (g, h, None))
            gain = np.where((n > 0) & (n < len(g)), gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - total, 0.0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), k, float(own[gain.argmax()]))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Boosted":
        x, y = np.asarray(x, float), np.asarray(y, float)
        weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        p = np.clip(np.average(y, weights=weight) if len(y) else 0.5, 0.01, 0.99)
        self.start = float(np.log(p / (1 - p)))
        odds = np.full(len(y), self.start)
        coded = [np.unique(column, return_inverse=True) for column in x.T]
        values, codes = [v for v, _ in coded], np.stack([c for _, c in coded], 1) if coded else np.empty((len(y), 0), int)
        leaf = lambda g, h: -g.sum() / (h.sum() + 1.0)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-odds))
            g, h = (q - y) * weight, q * (1 - q) * weight
            gain, k, cut = self._split(values, codes, g, h)
            if k < 0:
                break
            sides = []
            left = x[:, k] <= cut
            for side in (left, ~left):
                gain2, k2, cut2 = self._split(values, codes[side], g[side], h[side])
                if k2 < 0:
                    sides.append((0, np.inf, leaf(g[side], h[side]), 0.0))
                else:
                    low = x[side][:, k2] <= cut2
                    sides.append((k2, cut2, leaf(g[side][low], h[side][low]), leaf(g[side][~low], h[side][~low])))
            self.trees.append((k, cut, *sides))
            odds += self.rate * self._tree(self.trees[-1], x)
        return self

    @staticmethod
    def _tree(tree: tuple, x: np.ndarray) -> np.ndarray:
        k, cut, (ka, ca, a0, a1), (kb, cb, b0, b1) = tree
        return np.where(x[:, k] <= cut, np.where(x[:, ka] <= ca, a0, a1), np.where(x[:, kb] <= cb, b0, b1))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        x = np.asarray(x, float)
        odds = np.full(len(x), self.start)
        for tree in self.trees:
            odds += self.rate * self._tree(tree, x)
        return 1 / (1 + np.exp(-odds))
