"""A hierarchical navigable small-world graph over one shard, as flat neighbour arrays.

Layer 0 holds all vectors, every layer above about one in ``LINKS`` of the one below. Nodes
are inserted in batches, those of high layers first: a batch is searched in the graph so far
side by side, its members are compared with each other, and links are kept by the rule that
a neighbour must be nearer to the node than to any neighbour kept before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS, GROUND_LINKS = 16, 32
BUILD_WIDTH, SEARCH_WIDTH = 64, 96
BATCH, STEP = 256, 4


@dataclass
class Graph:
    """``layers`` from the ground up: each a node list (None: all) and links, -1 for none."""

    layers: list[tuple[np.ndarray | None, np.ndarray]]

    def search(self, points: Points, queries: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` near nodes of each query, -1 for none."""
        entry = np.zeros((len(queries), 1), np.int64)
        for nodes, links in reversed(self.layers[1:]):
            local = Points(points.values[nodes])
            top, _ = beam(local, links, len(nodes), queries, _within(nodes, entry), 1)
            entry = nodes[top]
        return beam(points, self.layers[0][1], len(points.values), queries, entry, width)[0]


class Frame:
    """Where a graph's vectors lie: single precision tells them apart once shifted and scaled."""

    def __init__(self, values: np.ndarray):
        _, self.power = np.frexp(np.abs(values).max(initial=0.0))
        scaled = np.ldexp(values, -self.power)
        self.center = scaled.mean(axis=0)
        self.extent = float(np.abs(scaled - self.center).max(initial=0.0)) or 1.0

    def place(self, values: np.ndarray) -> np.ndarray:
        """``values`` with the graph's own vectors between -1 and 1; infinite where too far off."""
        with np.errstate(over="ignore", invalid="ignore"):
            return (np.ldexp(values, -self.power) - self.center) / self.extent


class Points:
    """Vectors in single precision, with squared lengths."""

    def __init__(self, values: np.ndarray):
        self.values = np.ascontiguousarray(values, np.float32)
        self.squares = np.einsum("nd,nd->n", self.values, self.values)

    def distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, less the query's own square, to ``ids`` (a row for each query)."""
        inner = np.matmul(self.values[ids], queries[:, :, None])[:, :, 0]
        return self.squares[ids] - 2 * inner


def _within(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of ``ids`` in the sorted ``nodes``; 0 for those that aren't there."""
    at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
    return np.where(nodes[at] == ids, at, 0)


def beam(
    points: Points, links: np.ndarray, size: int, queries: np.ndarray, entry: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that a best-first search meets, and their distances.

    All queries go side by side; each step expands the nearest open nodes of every query.
    """
    n = len(queries)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, size), bool)
    ids = np.full((n, width), -1, np.int64)
    far = np.full((n, width), np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    seen[rows, entry] = True
    first = entry[:, :width]
    ids[:, : first.shape[1]] = first
    far[:, : first.shape[1]] = points.distances(queries, first)
    open_[:, : first.shape[1]] = True
    step = min(STEP, width)
    active = np.arange(n)
    while active.size:
        r = np.arange(len(active))[:, None]
        waiting = np.where(open_[active], far[active], np.inf)
        pick = np.argpartition(waiting, step - 1, axis=1)[:, :step]
        live = np.isfinite(waiting[r, pick])
        going = live.any(axis=1)
        if not going.all():
            active, pick, live = active[going], pick[going], live[going]
            r = r[: len(active)]
            if not active.size:
                break
        a = active[:, None]
        open_[a, pick] = False
        near = links[np.where(live, ids[a, pick], 0)]
        near[~live] = -1
        near = np.sort(near.reshape(len(active), -1), axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[a, near]
        # The new ones of every query to the left.
        most = int(fresh.sum(axis=1).max(initial=0))
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near, fresh = near[r, order], fresh[r, order]
        known = np.where(fresh, near, 0)
        here = np.broadcast_to(a, near.shape)
        seen[here[fresh], near[fresh]] = True
        gap = np.where(fresh, points.distances(queries[active], known), np.inf)
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_far = np.concatenate([far[active], gap], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        ids[active], far[active] = all_ids[r, best], all_far[r, best]
        open_[active] = all_open[r, best]
    order = np.argsort(far, axis=1, kind="stable")
    return ids[rows, order], far[rows, order]


def _kept(points: Points, nodes: np.ndarray, options: np.ndarray, limit: int) -> np.ndarray:
    """For each node at most ``limit`` of its options (-1 for none), spread in all directions."""
    options = np.sort(options, axis=1)[:, ::-1].copy()
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    options[options == nodes[:, None]] = -1
    ids = np.where(options >= 0, options, 0)
    own = points.values[nodes]
    far = points.distances(own, ids) + points.squares[nodes][:, None]
    far = np.where(options >= 0, far, np.inf)
    # Beyond a few times the limit nothing is kept anyway.
    order = np.argsort(far, axis=1, kind="stable")[:, : 2 * limit]
    rows = np.arange(len(nodes))[:, None]
    options, far, ids = options[rows, order], far[rows, order], ids[rows, order]
    values = points.values[ids]
    between = points.squares[ids][:, :, None] + points.squares[ids][:, None, :]
    between -= 2 * np.matmul(values, values.transpose(0, 2, 1))
    keep = np.zeros(options.shape, bool)
    for k in range(options.shape[1]):
        closer = (keep[:, :k] & (between[:, k, :k] < far[:, k : k + 1])).any(axis=1)
        keep[:, k] = np.isfinite(far[:, k]) & ~closer & (keep[:, :k].sum(axis=1) < limit)
    # The nearest of the others fill up.
    rank = np.where(keep, 0, np.where(np.isfinite(far), 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :limit]
    chosen = np.where(rank[rows, order] < 2, options[rows, order], -1)
    if chosen.shape[1] < limit:
        chosen = np.pad(chosen, ((0, 0), (0, limit - chosen.shape[1])), constant_values=-1)
    return chosen


def _layer(points: Points, entries: np.ndarray, limit: int) -> np.ndarray:
    """Links of one layer; node k's search starts at ``entries[k]``, nodes come in their order."""
    n = len(points.values)
    links = np.full((n, limit), -1, np.int64)
    done = 0
    while done < n:
        batch = np.arange(done, min(n, done + (BATCH if done else 64)))
        values = points.values[batch]
        among = points.squares[batch][None, :] - 2 * values @ values.T
        np.fill_diagonal(among, np.inf)
        mates = min(limit, len(batch) - 1)
        options = batch[np.argsort(among, axis=1, kind="stable")[:, :mates]]
        if done:
            entry = np.where(entries[batch] < done, entries[batch], 0)[:, None]
            found, _ = beam(points, links, done, values, entry, min(BUILD_WIDTH, done))
            options = np.concatenate([options, found], axis=1)
        if options.shape[1]:
            links[batch] = _kept(points, batch, options, limit)
            _link_back(points, links, batch, limit)
        done += len(batch)
    return links


def _link_back(points: Points, links: np.ndarray, batch: np.ndarray, limit: int) -> None:
    """The batch's links in the other direction as well; full nodes choose anew."""
    targets = links[batch].ravel()
    sources = np.repeat(batch, links.shape[1])[targets >= 0]
    targets = targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    starts = np.flatnonzero(np.r_[True, targets[1:] != targets[:-1]])
    nth = np.arange(len(targets)) - np.repeat(starts, np.diff(np.r_[starts, len(targets)]))
    # In rounds of ``limit`` new links a node, so that a common neighbour needs no wide table.
    for low in range(0, int(nth.max(initial=-1)) + 1, limit):
        part = (nth >= low) & (nth < low + limit)
        nodes, place = np.unique(targets[part], return_inverse=True)
        options = np.full((len(nodes), 2 * limit), -1, np.int64)
        options[:, :limit] = links[nodes]
        options[place, limit + nth[part] - low] = sources[part]
        for k in range(0, len(nodes), 1024):
            some = slice(k, k + 1024)
            links[nodes[some]] = _kept(points, nodes[some], options[some], limit)


def build(values: np.ndarray, levels: np.ndarray) -> Graph:
    """The graph of ``values``, which must be sorted by ``levels``, highest first."""
    layers: list[tuple[np.ndarray | None, np.ndarray]] = []
    for level in range(int(levels.max(initial=0)), -1, -1):
        count = int((levels >= level).sum())
        points = Points(values[:count])
        entries = np.zeros((count, 1), np.int64)
        for nodes, links in layers[::-1]:
            above = Points(values[nodes])
            for low in range(0, count, BATCH):
                some = slice(low, low + BATCH)
                start = _within(nodes, entries[some])
                top, _ = beam(above, links, len(nodes), points.values[some], start, 1)
                entries[some] = nodes[top]
        limit = GROUND_LINKS if level == 0 else LINKS
        layers.insert(0, (np.arange(count), _layer(points, entries[:, 0], limit)))
    return Graph(layers)
