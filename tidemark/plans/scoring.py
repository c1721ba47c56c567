"""The scoring job: messages in, flagged messages out, on a table or on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.detect import PRESETS, ThresholdModel, flag
from tidemark.operators.messages import decode_csv, decode_json, encode_json
from tidemark.schema import TRANSACTION_SCHEMA
from tidemark.sources.endpoint import Endpoint


def _from_csv(messages: DataFrame, value: str, schema: StructType) -> DataFrame:
    return decode_csv(messages, schema.names, value)


WIRE_FORMS: Mapping[str, Callable[..., DataFrame]] = {"json": decode_json, "csv": _from_csv}


def score(
    messages: DataFrame,
    models: Iterable[ThresholdModel] = PRESETS,
    wire: str = "json",
    value: str = "value",
    schema: StructType = TRANSACTION_SCHEMA,
) -> DataFrame:
    """Messages as flagged rows; as many rows as messages.

    Only the columns of ``schema`` are parsed and kept; give the few that the models and
    the readers of the result need.
    """
    return flag(WIRE_FORMS[wire](messages, value=value, schema=schema), models)


def score_messages(
    messages: DataFrame,
    models: Iterable[ThresholdModel] = PRESETS,
    wire: str = "json",
    schema: StructType = TRANSACTION_SCHEMA,
) -> DataFrame:
    """Messages as scored messages, in the one column a topic takes.

    The plan is map-only: no shuffle, one task for each split of the source.
    """
    return encode_json(score(messages, models, wire, schema=schema))


def run_batch(
    spark: SparkSession,
    source: Endpoint,
    sink: Endpoint,
    models: Iterable[ThresholdModel] = PRESETS,
    wire: str = "json",
    schema: StructType = TRANSACTION_SCHEMA,
) -> None:
    """Score what a source holds now."""
    sink.write(score_messages(source.read(spark), models, wire, schema))


def start_stream(
    spark: SparkSession,
    source: Endpoint,
    sink: Endpoint,
    checkpoint: str,
    models: Iterable[ThresholdModel] = PRESETS,
    wire: str = "json",
    trigger: Mapping[str, object] | None = None,
    name: str | None = None,
    schema: StructType = TRANSACTION_SCHEMA,
) -> StreamingQuery:
    """Start scoring a stream; give ``checkpoint`` a durable folder that all executors share."""
    scored = score_messages(source.read_stream(spark), models, wire, schema)
    return sink.write_stream(scored, checkpoint, trigger, name)
