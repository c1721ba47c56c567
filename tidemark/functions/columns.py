"""Column references and the text-to-number comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The top-level column called ``name``, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The column called ``name`` as text; topics deliver bytes."""
    return named(name).cast("string")


def exceeds(value: Column, threshold: float | Column) -> Column:
    """1 where ``value`` is above ``threshold``, otherwise 0, never null.

    Nothing is above a null threshold.

    The cast must be a ``try_cast``: under ANSI mode a plain one would fail the
    whole query, or every restart of a stream, on the first bad amount.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(value.try_cast("double") > limit, 1).otherwise(0)
