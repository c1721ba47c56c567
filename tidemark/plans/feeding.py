"""The feeding job: synthetic transactions as messages, as a table or at a steady rate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.columns import named
from tidemark.operators.messages import csv_value, json_value
from tidemark.operators.synth import SynthConfig, read_properties, synth_transactions
from tidemark.schema import TRANSACTION_COLUMNS
from tidemark.sources.endpoint import Endpoint, paced

WIRE_FORMS = {"json": json_value, "csv": csv_value}

# Some 300 MB of JSON text.
ROWS_PER_TASK = 1_000_000

# How many records are offered at once, and every how many seconds.
CONCURRENCY = 1000
THROTTLE_SECONDS = 2


def offered_rate(properties: str = "") -> int:
    """Rows per second from the ``concurrency`` and ``throttle`` of a properties text.

    At least what they ask for: a fraction is rounded up.
    """
    given = read_properties(properties)
    records = int(given.get("concurrency", CONCURRENCY))
    return max(1, -(-records // int(given.get("throttle", THROTTLE_SECONDS))))


def feed_messages(
    transactions: DataFrame, wire: str = "json", key: Column | str | None = "card_num"
) -> DataFrame:
    """P5/K4: transactions as ``(key, value)`` messages, or ``value`` alone with no key.

    The key is a column by default, which spreads the records over the topic's
    partitions; pass a literal for one constant key.
    """
    value = WIRE_FORMS[wire](TRANSACTION_COLUMNS).alias("value")
    if key is None:
        return transactions.select(value)
    key_column = named(key) if isinstance(key, str) else key
    return transactions.select(key_column.cast("string").alias("key"), value)


def run_batch(
    spark: SparkSession,
    sink: Endpoint,
    rows: int,
    wire: str = "json",
    config: SynthConfig | None = None,
    seed: int = 42,
    key: Column | str | None = "card_num",
) -> None:
    """Write ``rows`` synthetic transactions, in tasks of a bounded size."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    made = synth_transactions(spark.range(0, rows, 1, tasks), "id", config, seed)
    sink.write(feed_messages(made, wire, key))


def start_stream(
    spark: SparkSession,
    sink: Endpoint,
    checkpoint: str,
    rows_per_second: int | None = None,
    wire: str = "json",
    config: SynthConfig | None = None,
    seed: int = 42,
    key: Column | str | None = "card_num",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write synthetic transactions at a steady rate, each with the time of its making."""
    ticks = paced(rows_per_second or offered_rate()).read_stream(spark)
    made = synth_transactions(ticks, "value", config, seed, time_col="timestamp")
    return sink.write_stream(feed_messages(made, wire, key), checkpoint, trigger)


def constant_key(key: str = "key") -> Column:
    """K4: one key for all records, which puts them all into one topic partition."""
    return F.lit(key)
