"""Messages to transactions and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import named, text_of
from tidemark.functions.text import csv_field, csv_line
from tidemark.schema import SCORED_SCHEMA, TRANSACTION_COLUMNS, TRANSACTION_SCHEMA

# The parser's own limits would turn a whole record into nulls for one very long
# field. Options rule out pruning of unused fields, so pass a smaller schema instead.
_NO_LIMIT = str(2**31 - 1)
WHOLE_TEXTS = {
    "maxStringLen": _NO_LIMIT,
    "maxNumLen": _NO_LIMIT,
    "maxNestingDepth": _NO_LIMIT,
}


def decode_json(
    messages: DataFrame, schema: T.StructType = TRANSACTION_SCHEMA, value: str = "value"
) -> DataFrame:
    """One row per message, with the columns of ``schema`` and no others parsed.

    A message that is not a JSON object gives a row of nulls; none is dropped and
    none fails the query. Texts of any length are read whole.
    """
    parsed = messages.select(F.from_json(text_of(value), schema, WHOLE_TEXTS).alias("data"))
    return parsed.select("data.*")


def decode_scored(messages: DataFrame, value: str = "value") -> DataFrame:
    """The scored output topic as rows with 14 text columns and two flags."""
    return decode_json(messages, SCORED_SCHEMA, value)


def decode_csv(
    messages: DataFrame, columns: Sequence[str] = TRANSACTION_COLUMNS, value: str = "value"
) -> DataFrame:
    """One row per comma-separated line; missing fields are null, extra ones ignored.

    A plain split reverses :func:`encode_csv` for fields that have no comma and aren't the
    word ``null``: the wire form has no escapes. :func:`csv_exact` tells which lines have as
    many fields as columns. A CSV parser would take quotes in the data for quoting, and
    empty fields for nulls.
    """
    split = messages.select(F.split(text_of(value), ",").alias("fields"))
    return split.select([csv_field(F.col("fields"), i).alias(c) for i, c in enumerate(columns)])


def csv_exact(columns: Sequence[str] = TRANSACTION_COLUMNS, value: str = "value") -> Column:
    """Whether a line has exactly one field for each column, so that none was cut or missed."""
    return F.size(F.split(text_of(value), ",")) == len(columns)


def encode_json(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row as one JSON object in ``value``; null fields are left out."""
    return rows.select(json_value(columns or rows.columns).alias("value"))


def encode_csv(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row as one comma-separated line in ``value``."""
    return rows.select(csv_value(columns or rows.columns).alias("value"))


def json_value(columns: Sequence[str]) -> Column:
    """The named columns as one JSON object."""
    return F.to_json(F.struct(*[named(c) for c in columns]))


def csv_value(columns: Sequence[str]) -> Column:
    """The named columns as one comma-separated line."""
    return csv_line([named(c) for c in columns])


def keyed(messages: DataFrame, key: Column) -> DataFrame:
    """K4: messages with a key before the value.

    A constant key sends every record to one topic partition; use a column
    wherever the volume matters.
    """
    return messages.select(key.cast("string").alias("key"), "value")
