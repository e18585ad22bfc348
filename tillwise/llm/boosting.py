"""Gradient-boosted trees on small matrices of whole-number features, in numpy.

Fitted on a bounded sample on the driver; the trees are a few hundred numbers, sent to tasks to
score candidates there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Full trees of one depth: ``feature`` and ``cut`` by tree and inner node, ``value`` by leaf. A
    row goes right where its feature is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while len(feature) and node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total


def _best_split(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[int, int]:
    """The (feature, cut) with the largest gain; a cut above all values where none gains."""
    best, found = 1e-6, (0, 255)
    whole = slope.sum() ** 2 / (weight.sum() + penalty)
    for f in range(x.shape[1]):
        s = np.cumsum(np.bincount(x[:, f], slope, 256))[:-1]
        w = np.cumsum(np.bincount(x[:, f], weight, 256))[:-1]
        gain = s**2 / (w + penalty) + (slope.sum() - s) ** 2 / (weight.sum() - w + penalty) - whole
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (f, at)
    return found


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Trees for the probability that y is 1; x holds whole numbers from 0 to 255."""
    inner = (1 << depth) - 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    raw = np.full(len(y), base)
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, weight = y - p, p * (1 - p) + 1e-9
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, 255), np.zeros(len(y), np.int64)
        for n in range(inner):
            here = np.flatnonzero(node == n)
            if len(here):
                feature[n], cut[n] = _best_split(x[here], slope[here], weight[here], penalty)
                node[here] = 2 * n + 1 + (x[here, feature[n]] > cut[n])
        leaf = node - inner
        value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, weight, inner + 1) + penalty)
        raw = raw + value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), base)


def calibrate(raw: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * raw + b))) fits held-out labels, each counted ``times``
    times, by Newton's method with a small pull towards (1, 0)."""
    a, b, pull = 1.0, 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w, off = p * (1 - p) * times, (y - p) * times
        slope = np.array([(off * raw).sum() - pull * (a - 1), off.sum() - pull * b])
        bend = np.array([[(w * raw * raw).sum() + pull, (w * raw).sum()], [(w * raw).sum(), w.sum() + pull]])
        step = np.linalg.solve(bend, slope)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b
