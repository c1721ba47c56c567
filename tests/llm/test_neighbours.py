"""Nearest neighbours: recall against brute force, exact scores, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import neighbours, queries
from tidemark.llm.neighbours import nearest_neighbours
from tidemark.llm.small_world import Points, build

VECTORS = "vec_id long, embedding array<double>, label int"


def exact(vectors, query_id, query, k=10):
    near = [
        (float(np.sqrt(((np.array(v) - query) ** 2).sum())), i)
        for i, v in vectors
        if i != query_id and len(v) == len(query)
    ]
    return sorted(near)[:k]


def recall(rows, vectors, query_ids):
    by_id, hits, wanted = dict(vectors), 0, 0
    for q in query_ids:
        best = exact(vectors, q, np.array(by_id[q]))
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        for r in own:
            assert r.score == pytest.approx(np.linalg.norm(np.subtract(by_id[r.vec_id], by_id[q])), rel=1e-12)
        hits += len({r.vec_id for r in own} & {i for _, i in best})
        wanted += len(best)
    return hits / wanted


def test_query_recall(spark):
    data = "/root/testdata/sf0.1"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rows = queries.op9_neighbours(spark, data).collect()
    asked = [i for i, _ in vectors if i % 100 == 0]
    assert len(rows) == 10 * len(asked)
    assert recall(rows, vectors, asked) >= 0.95


def test_shards_and_query_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 6 * 7)
    draws = np.random.Generator(np.random.PCG64(5))
    vectors = [(k, v.tolist()) for k, v in enumerate(draws.normal(size=(900, 6)))]
    frame = spark.createDataFrame([(*v, 0) for v in vectors], VECTORS)
    rows = nearest_neighbours(frame, frame.filter("vec_id % 45 = 0")).collect()
    assert recall(rows, vectors, range(0, 900, 45)) >= 0.95


def test_copies_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 400)
    draws = np.random.Generator(np.random.PCG64(7))
    hot = draws.normal(size=6).tolist()
    # Shuffled, so that small ids are nowhere near each other.
    places = draws.permutation(1200).tolist()
    vectors = [(k, hot if p % 3 == 0 else draws.normal(size=6).tolist()) for k, p in enumerate(places)]
    # An id of its own copies only, and one that stands beside others.
    vectors += [(5000, [9.0] * 6)] * 12 + [(5001, [9.0] * 5 + [8.0])] * 12
    frame = spark.createDataFrame([(*v, 0) for v in vectors], VECTORS)
    copies = [k for k, v in vectors if v is hot]
    asked = [*copies[:3], copies[-1], 5000]
    rows = nearest_neighbours(frame, frame.filter(frame.vec_id.isin(asked))).collect()
    for q in asked[:-1]:
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert own == [(n, i, 0.0) for n, i in enumerate([c for c in copies if c != q][:10], 1)]
    assert [r.vec_id for r in rows if r.query_id == 5000] == [5001] * 10


def test_clumps_stay_reachable():
    draws = np.random.Generator(np.random.PCG64(6))
    clumps = [c + draws.normal(scale=1e-4, size=(400, 16)) for c in draws.normal(size=(5, 16))]
    values = np.concatenate([*clumps, np.tile(draws.normal(size=16), (300, 1)), draws.normal(size=(500, 16))])
    levels = np.zeros(len(values), int)
    levels[:100], levels[:8] = 1, 2
    order = draws.permutation(len(values))
    graph, points = build(values[order], levels), Points(values[order])
    asked = points.values[::50]
    found = graph.search(points, asked, 96)
    far = ((points.values[None] - asked[:, None]) ** 2).sum(2)
    limits = np.sort(far, axis=1)[:, 9] + 1e-5
    hits = [(far[k][found[k][:10]] <= limits[k]).mean() for k in range(len(asked))]
    assert np.mean(hits) >= 0.95


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, []),
        (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, None]), (None, [1.0, 1.0]),
        (9, [1.0, 2.0, 3.0]), (10, [3.0, 0.0]), (0, [1.0, 0.0]),
    ]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    found = nearest_neighbours(vectors, vectors.filter("vec_id IN (0, 3, 5, 9)"))
    got = [(r.query_id, r.rank, r.vec_id) for r in found.collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 10), (0, 3, 2), (0, 4, 2)]
    assert nearest_neighbours(vectors.limit(0), vectors).collect() == []
    assert nearest_neighbours(vectors, vectors.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["offset", "huge", "tiny", "vast", "mixed", "one far"])
def test_any_finite_vectors(spark, monkeypatch, kind):
    """Ten rows for every query and hardly any miss, wherever the vectors lie."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 400)
    draws = np.random.Generator(np.random.PCG64(11))
    values = draws.normal(size=(900, 8))
    scale = {"huge": 1e20, "tiny": 1e-25, "vast": 1e200}.get(kind, 1.0)
    values = values * scale + (1e5 if kind == "offset" else 0)
    if kind == "mixed":
        values *= np.repeat([1e20, 1.0, 1e-25], 300)[:, None]
    if kind == "one far":
        values[0] = 1e30
    vectors = [(k, v.tolist()) for k, v in enumerate(values)]
    frame = spark.createDataFrame([(*v, 0) for v in vectors], VECTORS)
    rows = nearest_neighbours(frame, frame.filter("vec_id % 20 = 0")).collect()
    asked = range(0, 900, 20)
    assert len(rows) == 10 * len(asked)
    hits = 0
    for q in asked:
        gaps = neighbours.distances(values, values[q])
        best = sorted((g, k) for k, g in enumerate(gaps) if k != q)[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        for _, k, score in own:
            assert score == pytest.approx(gaps[k], rel=1e-12)
        hits += len({r[1] for r in own} & {k for _, k in best})
    assert hits / (10 * len(asked)) >= 0.95


def test_distances_beyond_squares():
    a = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0]])
    assert neighbours.distances(a, np.zeros(2)) == pytest.approx([5e200, 5e-200, 5.0, 0.0], rel=1e-15)
