"""A generalised additive model with pairwise interactions, boosted in cycles.

Every round fits one shallow tree to each feature in turn, on the gradient that the
features before have left, and adds it to the feature's lookup table. Afterwards the
pairs of features with the most left to explain get tables of their own in the same way.
A score is the sum of one entry of each table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE, SMOOTHING, LEAVES = 0.15, 4.0, 3


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders of at most ``bins`` bins with about as many rows each."""
    points = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")
    return np.unique(points)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, one for each row of features."""
        total = np.full(len(rows), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[_bins(rows[:, k], self.cuts[k])]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[
                _bins(rows[:, a], self.pair_cuts[a]), _bins(rows[:, b], self.pair_cuts[b])
            ]
        return sigmoid(total)


def _bins(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right")


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A regression tree over ordered bins, as one value per bin."""
    g, w = np.cumsum(gradient), np.cumsum(weight)

    def worth(low: int, high: int) -> float:
        total = g[high - 1] - (g[low - 1] if low else 0.0)
        return total**2 / (w[high - 1] - (w[low - 1] if low else 0.0) + SMOOTHING)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(
            (
                (worth(a, m) + worth(m, b) - worth(a, b), a, m, b)
                for a, b in parts
                for m in range(a + 1, b)
            ),
            default=(0.0, 0, 0, 0),
        )
        if best[0] <= 1e-9:
            break
        _, a, m, b = best
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    values = np.empty(len(g))
    for a, b in parts:
        values[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + SMOOTHING)
    return values


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut into four quadrants, as one value per cell, and what it gains."""
    g = gradient.cumsum(0).cumsum(1)
    w = weight.cumsum(0).cumsum(1)

    def quadrants(t: np.ndarray) -> list[np.ndarray]:
        all_, top, left, corner = t[-1, -1], t[:-1, -1:], t[-1:, :-1], t[:-1, :-1]
        return [corner, top - corner, left - corner, all_ - top - left + corner]

    if min(g.shape) < 2:
        return np.zeros_like(gradient), 0.0
    pairs = list(zip(quadrants(g), quadrants(w), strict=True))
    gains = sum(a**2 / (b + SMOOTHING) for a, b in pairs)
    r, c = np.unravel_index(np.argmax(gains), gains.shape)
    values = np.empty_like(gradient)
    slices = [
        (slice(None, r + 1), slice(None, c + 1)),
        (slice(None, r + 1), slice(c + 1, None)),
        (slice(r + 1, None), slice(None, c + 1)),
        (slice(r + 1, None), slice(c + 1, None)),
    ]
    for place, (a, b) in zip(slices, pairs, strict=True):
        values[place] = a[r, c] / (b[r, c] + SMOOTHING)
    return values, float(gains[r, c])


def fit(rows: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """The model of labelled rows of features; constant where there is but one label."""
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model
    columns = rows.T
    model.cuts = [cuts_of(c, BINS) for c in columns]
    places = [_bins(c, cuts) for c, cuts in zip(columns, model.cuts, strict=True)]
    model.tables = [np.zeros(len(cuts) + 1) for cuts in model.cuts]
    total = np.full(len(labels), model.intercept)
    for _ in range(ROUNDS):
        for place, table in zip(places, model.tables, strict=True):
            p = sigmoid(total)
            g = np.bincount(place, labels - p, len(table))
            w = np.bincount(place, p * (1 - p), len(table))
            step = RATE * _tree(g, w, LEAVES)
            table += step
            total += step[place]
    model.pair_cuts = [cuts_of(c, PAIR_BINS) for c in columns]
    small = [_bins(c, cuts) for c, cuts in zip(columns, model.pair_cuts, strict=True)]

    def left(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1
        cell = small[a] * shape[1] + small[b]
        p = sigmoid(total)
        sums = (np.bincount(cell, x, shape[0] * shape[1]) for x in (labels - p, p * (1 - p)))
        g, w = (s.reshape(shape) for s in sums)
        return g, w, cell

    all_pairs = [(a, b) for a in range(len(places)) for b in range(a)]
    gains = {pair: _pair_tree(*left(*pair)[:2])[1] for pair in all_pairs}
    model.pairs = sorted(all_pairs, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [
        np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1))
        for a, b in model.pairs
    ]
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(model.pairs, model.pair_tables, strict=True):
            g, w, cell = left(*pair)
            step = RATE * _pair_tree(g, w)[0]
            table += step
            total += step.ravel()[cell]
    return model
