"""Text lists and the comma-separated wire form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CSV wire form writes a missing field as this word.
NULL_TEXT = "null"


def split_list(value: Column) -> Column:
    """P10: items of a comma-separated list, untrimmed, trailing empty items dropped.

    Inner empty items stay. An empty text is one empty item; a text of commas
    only has no items.
    """
    kept = F.rtrim(value, F.lit(","))
    only_commas = (kept == "") & (value != "")
    return F.when(only_commas, F.array().cast("array<string>")).otherwise(F.split(kept, ","))


def csv_line(columns: Sequence[Column]) -> Column:
    """The fields joined with commas, without quoting or escaping."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit(NULL_TEXT)) for c in columns])


def csv_field(fields: Column, position: int) -> Column:
    """One field of a split line; null where it is absent or the null word."""
    field = F.get(fields, position)
    return F.when(field != NULL_TEXT, field)


def padded(text: Column, width: int) -> Column:
    """Zeros before ``text`` up to ``width`` characters; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
