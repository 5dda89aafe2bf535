"""Gradient-boosted trees in numpy: training on small tables, vectorised scoring."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Additive trees of the log-odds, flattened into node arrays.

    ``monotone[f]`` is 1 or -1 where the score may only rise or fall with
    feature ``f``, else 0. Splits that break it are not taken, and the middle of
    a split's two values bounds all values below either side.
    """

    def __init__(self, monotone, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0):
        self.monotone = list(monotone)
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.base, self.roots = 0.0, np.zeros(0, np.int64)
        self.feature, self.threshold, self.right, self.value = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.float64))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """``x`` rows by features, ``y`` 0 or 1. One class only, or no row, gives a constant."""
        mean = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(mean / (1 - mean)))
        if not 0 < y.sum() < len(y):
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
        score, nodes, roots = np.full(len(y), self.base), [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            roots.append(len(nodes))
            self._grow(nodes, np.arange(len(y)), y - p, p * (1 - p), binned, cuts, 0, -np.inf, np.inf, score)
        self.roots = np.array(roots)
        self.feature, self.threshold, self.right, self.value = map(np.array, zip(*nodes))
        return self

    def _leaf(self, g, h, low, high):
        return float(np.clip(g / (h + self.ridge), low, high))

    def _grow(self, nodes, rows, gradient, hessian, binned, cuts, depth, low, high, score):
        here = len(nodes)
        value = self._leaf(gradient[rows].sum(), hessian[rows].sum(), low, high)
        nodes.append((-1, 0.0, here, self.rate * value))
        best = self._split(rows, gradient, hessian, binned, low, high) if depth < self.depth else None
        if best is None:
            score[rows] += self.rate * value
            return
        feature, cut, left_value, right_value = best
        goes = binned[rows, feature] <= cut
        middle = (left_value + right_value) / 2
        sign = self.monotone[feature]
        bounds = [(low, high), (low, high)]
        if sign:
            bounds = [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]
        # The left child is the next node; the right one follows the left subtree.
        left_at = len(nodes)
        self._grow(nodes, rows[goes], gradient, hessian, binned, cuts, depth + 1, *bounds[0], score)
        right_at = len(nodes)
        self._grow(nodes, rows[~goes], gradient, hessian, binned, cuts, depth + 1, *bounds[1], score)
        assert left_at == here + 1
        nodes[here] = (feature, float(cuts[feature][cut]), right_at, self.rate * value)

    def _split(self, rows, gradient, hessian, binned, low, high):
        g, h = gradient[rows], hessian[rows]
        best, gain_of = None, lambda a, b: a * a / (b + self.ridge)
        least_gain = gain_of(g.sum(), h.sum()) + 1e-6
        for f in range(binned.shape[1]):
            gs, hs = np.bincount(binned[rows, f], g, BINS + 1).cumsum(), np.bincount(binned[rows, f], h, BINS + 1).cumsum()
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            left, right = np.clip(gl / (hl + self.ridge), low, high), np.clip(gr / (hr + self.ridge), low, high)
            fits = (hl * 4 >= self.least) & (hr * 4 >= self.least)
            if self.monotone[f]:
                fits &= self.monotone[f] * (right - left) >= 0
            gain = np.where(fits, gain_of(gl, hl) + gain_of(gr, hr), -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > least_gain:
                least_gain, best = gain[cut], (f, cut, left[cut], right[cut])
        return best

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows walk each tree at once: a node's left child is the next node, ``right`` the other."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                goes = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes, at + 1, self.right[at]), at)
            score += self.value[at]
        return 1 / (1 + np.exp(-score))
