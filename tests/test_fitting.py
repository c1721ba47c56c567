"""Moments and alert counts."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators.fitting import alerts_per, fit_moments


def test_moments_of_what_parses(spark):
    texts = ["1.5", "2.5", "x", None, "9", "4", ""]
    rows = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "`a.b` int, amt string")
    got = fit_moments(rows, "amt").first()
    values = [1.5, 2.5, 9.0, 4.0]
    assert got.n == 4
    assert got.mean == pytest.approx(statistics.mean(values))
    assert got["std"] == pytest.approx(statistics.stdev(values))
    by = {r["a.b"]: r.n for r in fit_moments(rows, "amt", ["a.b"]).collect()}
    assert by == {0: 2, 1: 2}
    none = fit_moments(rows.limit(0), "amt").first()
    assert (none.n, none.mean, none["std"]) == (0, None, None)


def test_alerts(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 0, 0)], "s string, x int, y int")
    got = {r.step: (r.rows, r.x, r.y) for r in alerts_per(rows, F.col("s"), ["x", "y"]).collect()}
    assert got == {"a": (2, 2, 1), "b": (1, 0, 0)}
