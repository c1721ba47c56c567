"""Small helpers shared by the tests."""

from __future__ import annotations

import contextlib
import io
from collections import Counter

from pyspark.sql import DataFrame


def bag(rows: DataFrame, columns: list[str] | None = None) -> Counter:
    """All rows with their counts, whatever their order."""
    return Counter(tuple(r) for r in rows.select(*(columns or rows.columns)).collect())


def plan(rows: DataFrame) -> str:
    """The physical plan as text."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        rows.explain("formatted")
    return text.getvalue()
