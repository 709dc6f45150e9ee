"""Generalised additive model with pairwise interactions.

Cyclic gradient boosting: each round visits every feature in turn and adds a shallow
tree over that feature's bins alone; then every chosen pair of features gets trees over
its two-dimensional bins, fitted to what the single features leave. Adding up the trees
gives one lookup table a term, so scoring is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """Values by bin of a tree of so many leaves: best-first splits by Newton gain."""
    out = np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        lg, lh = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
        rg, rh = cg[b] - cg[a + 1 : b], ch[b] - ch[a + 1 : b]
        gain = lg**2 / (lh + damp) + rg**2 / (rh + damp) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
        k = int(np.argmax(gain))
        return float(gain[k]), a + 1 + k

    parts = [(*best(0, len(g)), 0, len(g))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: parts[j][0])
        gain, cut, a, b = parts[i]
        if gain <= 1e-12:
            break
        parts[i : i + 1] = [(*best(a, cut), a, cut), (*best(cut, b), cut, b)]
    for _, _, a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return out


@dataclass
class AdditiveModel:
    """Score = sigmoid(base + sum of single tables + sum of pair tables)."""

    cuts: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int32)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 3, damp: float = 3.0) -> AdditiveModel:
        """y: 0 or 1. With no rows, or with one class, the score is a constant."""
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        rate_of = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        base = float(np.log(rate_of / (1 - rate_of)))
        model = cls(edges, base, [np.zeros(len(c) + 1) for c in edges])
        if not len(y) or y.min() == y.max():
            return model
        b = model.bins(x)
        z = np.full(len(y), base)
        for _ in range(rounds):
            for j, table in enumerate(model.single):
                step = rate * cls._step(b[:, j], len(table), y, z, leaves, damp)
                table += step
                z += step[b[:, j]]
        model._add_pairs(b, y, z, pairs, pair_rounds, rate, damp)
        return model

    @staticmethod
    def _step(b: np.ndarray, n: int, y: np.ndarray, z: np.ndarray, leaves: int, damp: float) -> np.ndarray:
        p = _sigmoid(z)
        return _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), leaves, damp)

    def _add_pairs(self, b: np.ndarray, y: np.ndarray, z: np.ndarray, pairs: int, rounds: int, rate: float, damp: float) -> None:
        """Ranks pairs by what one full step over their coarse grid would gain, then boosts the best."""
        grid = b // self.coarse
        wide = [len(c) // self.coarse + 1 for c in self.cuts]
        p = _sigmoid(z)

        def cells(i: int, j: int) -> tuple[np.ndarray, int]:
            return grid[:, i] * wide[j] + grid[:, j], wide[i] * wide[j]

        def gain(i: int, j: int) -> float:
            c, n = cells(i, j)
            g, h = np.bincount(c, y - p, n), np.bincount(c, p * (1 - p), n)
            return float((g**2 / (h + damp)).sum())

        ranked = sorted(combinations(range(len(self.cuts)), 2), key=lambda ij: (-gain(*ij), ij))
        self.pairs = ranked[:pairs]
        self.double = [np.zeros((wide[i], wide[j])) for i, j in self.pairs]
        for _ in range(rounds):
            for (i, j), table in zip(self.pairs, self.double, strict=True):
                c, n = cells(i, j)
                p = _sigmoid(z)
                g, h = np.bincount(c, y - p, n).reshape(table.shape), np.bincount(c, p * (1 - p), n).reshape(table.shape)
                rows = np.stack([_tree(g[r], h[r], 2, damp) for r in range(table.shape[0])])
                table += rate * rows
                z += (rate * rows).ravel()[c]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            z += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.double, strict=True):
            z += table[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return _sigmoid(z)
