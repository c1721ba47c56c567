"""Gradient-boosted trees on binned features, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemark.llm.additive_model import cuts_of, sigmoid

BINS, DEPTH, ROUNDS, RATE, SMOOTHING, FOLDS = 48, 3, 80, 0.15, 2.0, 4


@dataclass
class Trees:
    """Complete trees of ``DEPTH``: a feature and a bin at each inner node, a value at each leaf."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    nodes: list[list[tuple[int, int]]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        places = [np.searchsorted(c, rows[:, k], "right") for k, c in enumerate(self.cuts)]
        total = np.full(len(rows), self.intercept)
        for nodes, leaves in zip(self.nodes, self.leaves, strict=True):
            total += leaves[_descend(places, nodes, len(rows))]
        return total


def _descend(places: list[np.ndarray], nodes: list[tuple[int, int]], n: int) -> np.ndarray:
    """Each row's leaf; the children of node k are 2k + 1 and 2k + 2."""
    at = np.zeros(n, np.int64)
    for _ in range(DEPTH):
        right = np.zeros(n, bool)
        for node in np.unique(at):
            mine = at == node
            feature, bin_ = nodes[node]
            right[mine] = places[feature][mine] > bin_
        at = 2 * at + 1 + right
    return at - (2**DEPTH - 1)


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    model = Trees(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model
    model.cuts = [cuts_of(c, BINS) for c in rows.T]
    places = [np.searchsorted(c, rows[:, k], "right") for k, c in enumerate(model.cuts)]
    total = np.full(len(rows), model.intercept)
    for _ in range(ROUNDS):
        p = sigmoid(total)
        gradient, weight = labels - p, p * (1 - p)
        at, nodes = np.zeros(len(rows), np.int64), []
        for depth in range(DEPTH):
            for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
                nodes.append(_best_cut(places, model.cuts, gradient, weight, at == node))
            right = np.zeros(len(rows), bool)
            for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
                mine = at == node
                right[mine] = places[nodes[node][0]][mine] > nodes[node][1]
            at = 2 * at + 1 + right
        leaf = at - (2**DEPTH - 1)
        g = np.bincount(leaf, gradient, 2**DEPTH)
        w = np.bincount(leaf, weight, 2**DEPTH)
        values = RATE * g / (w + SMOOTHING)
        model.nodes.append(nodes)
        model.leaves.append(values)
        total += values[leaf]
    return model


def _best_cut(places, cuts, gradient, weight, mine) -> tuple[int, int]:
    """The feature and bin that split a node's rows best; rows above the bin go right."""
    best = (0.0, 0, len(cuts[0]))
    g_all, w_all = gradient[mine].sum(), weight[mine].sum()
    base = g_all**2 / (w_all + SMOOTHING)
    for feature, place in enumerate(places):
        size = len(cuts[feature]) + 1
        if size == 1:
            continue
        g = np.bincount(place[mine], gradient[mine], size).cumsum()[:-1]
        w = np.bincount(place[mine], weight[mine], size).cumsum()[:-1]
        gains = g**2 / (w + SMOOTHING) + (g_all - g) ** 2 / (w_all - w + SMOOTHING) - base
        k = int(np.argmax(gains))
        if gains[k] > best[0] + 1e-9:
            best = (float(gains[k]), feature, k)
    return best[1], best[2]


@dataclass
class Calibration:
    """A rising step function through (margin, probability), linear between steps."""

    margins: np.ndarray
    chances: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.margins, self.chances)


def isotonic(margin: np.ndarray, labels: np.ndarray) -> Calibration:
    """Pool adjacent violators; each block stands at the mean of its margins."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, y in zip(margin[order].tolist(), labels[order].tolist(), strict=True):
        blocks.append([y, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    middles = np.array([b[2] / b[1] for b in blocks])
    # One row's weight of doubt on either side keeps scores off 0 and 1.
    chances = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])
    return Calibration(middles, np.maximum.accumulate(chances))


@dataclass
class CalibratedTrees:
    trees: Trees
    calibration: Calibration | None

    def score(self, rows: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(rows)
        return self.calibration(margin) if self.calibration else sigmoid(margin)


def fit(rows: np.ndarray, labels: np.ndarray) -> CalibratedTrees:
    """Trees on all rows, calibrated by what trees on other rows said of each row."""
    trees = fit_trees(rows, labels)
    if len(np.unique(labels)) < 2 or min(labels.sum(), len(labels) - labels.sum()) < FOLDS:
        return CalibratedTrees(trees, None)
    part = np.empty(len(labels), np.int64)
    for value in (0, 1):
        own = np.flatnonzero(labels == value)
        part[own] = np.arange(len(own)) % FOLDS
    margin = np.empty(len(labels))
    for k in range(FOLDS):
        margin[part == k] = fit_trees(rows[part != k], labels[part != k]).margin(rows[part == k])
    return CalibratedTrees(trees, isotonic(margin, labels))
