"""Isolation forest: anomaly = short average path over random splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), split, left child (right is left + 1), path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int
    unit: float

    @classmethod
    def fit(cls, x: np.ndarray, box: np.ndarray | None = None, trees: int = 128, subsample: int = 512, seed: int = 7) -> IsolationForest:
        """x: rows to take as normal; box: rows whose range the cuts span (default: x).

        An empty x gives a forest that scores all rows alike.
        """
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        depth = 2 * int(np.ceil(np.log2(max(size, 2))))
        box = x if box is None else box
        low, high = (box.min(axis=0), box.max(axis=0)) if len(box) else (np.zeros(1), np.zeros(1))
        grown = []
        for _ in range(trees if size else 1):
            grown.append(cls._grow(x[rng.choice(len(x), size, replace=False)] if size else np.zeros((1, 1)), low, high, depth, rng))
        width = max(len(g[0]) for g in grown)
        packed = [np.stack([np.pad(g[k], (0, width - len(g[k])), constant_values=-1 if k == 0 else 0) for g in grown]) for k in range(4)]
        return cls(*packed, depth=depth, unit=float(max(_average_path(max(size, 2)), 1e-9)))

    @staticmethod
    def _grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """One tree. Cuts are drawn over the node's whole box, not over its rows' range, so that
        rows outside the normal range fall into empty boxes near the root."""
        feature, split, left, length = [-1], [0.0], [0], [0.0]
        stack = [(0, np.arange(len(x)), low, high, 0)]
        while stack:
            node, rows, a, b, at = stack.pop()
            open_ = np.flatnonzero(b > a)
            if at >= depth or len(rows) <= 1 or not len(open_):
                length[node] = at + float(_average_path(len(rows)))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(a[f], b[f])
            goes = x[rows, f] <= cut
            feature[node], split[node], left[node] = f, cut, len(feature)
            under, over = b.copy(), a.copy()
            under[f] = over[f] = cut
            for side, box in ((goes, (a, under)), (~goes, (over, b))):
                stack.append((len(feature), rows[side], *box, at + 1))
                feature.append(-1), split.append(0.0), left.append(0), length.append(0.0)
        return np.array(feature, np.int16), np.array(split), np.array(left, np.int32), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): 0 to 1, higher is more anomalous."""
        total = np.zeros(len(x))
        for f, s, c, p in zip(self.feature, self.split, self.left, self.length, strict=True):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                kind = f[node]
                inner = np.flatnonzero(kind >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = c[at] + (x[inner, kind[inner]] > s[at])
            total += p[node]
        return 2.0 ** (-(total / len(self.feature)) / self.unit)


def calibrate(score: np.ndarray, good: np.ndarray, keep: float = 0.995) -> float:
    """The threshold with the best balanced accuracy among those that keep at least the given share of good rows.

    Rows at or below it are kept. Without good rows nothing is known, and every row is kept.
    """
    normal = np.sort(score[good])
    if not len(normal):
        return 1.0
    least = normal[min(len(normal) - 1, int(np.ceil(keep * len(normal))) - 1)]
    bad = np.sort(score[~good])
    options = np.unique(np.concatenate([[least], normal[normal >= least], [normal[-1] + 0.02]]))
    missed = np.searchsorted(bad, options, side="right") / max(len(bad), 1)
    lost = 1 - np.searchsorted(normal, options, side="right") / len(normal)
    return float(options[np.argmin(missed + lost)])


def calibrate_counts(step: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = 0.995) -> int | None:
    """The same from counts of good and bad rows at each step of the score, in rising order; None without good rows."""
    if not good.sum():
        return None
    kept, passed = np.cumsum(good), np.cumsum(bad)
    least = int(np.searchsorted(kept, max(int(np.ceil(keep * kept[-1])), 1)))
    lost, missed = 1 - kept[least:] / kept[-1], passed[least:] / max(passed[-1], 1)
    return int(step[least + np.argmin(missed + lost)])
