"""The ``events`` table as card transactions and as topic records.

``events(event_id, ts, user_id, event_type, value, props)`` stands in for the input
topic. All 14 columns are plain functions of the event's own columns, so a query over
them spends its time on its own operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import padded
from tidemark.operators.messages import json_value
from tidemark.schema import TRANSACTION_COLUMNS
from tidemark.sources.endpoint import INPUT_TOPIC

PARTITIONS = 4
ROWS_PER_BATCH = 1_000
BYTES_PER_TRIGGER = 2**40

# Fixed value: the columns of the events table, for streaming reads.
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def events_stream(
    spark: SparkSession, data_dir: str, max_bytes_per_trigger: int = BYTES_PER_TRIGGER
) -> DataFrame:
    """The events table, one file or a folder of them, as a file stream.

    The path is written as a pattern that matches only this table, because the
    file source takes a plain path for a folder. The limit keeps a micro-batch, and
    so what a restart has to do again, to a part of a large table.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    limited = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return limited.parquet(f"{data_dir}/{{events}}.parquet")


def _partition() -> Column:
    return (F.col("event_id") % PARTITIONS).cast("int")


def _offset() -> Column:
    return F.expr(f"event_id div {PARTITIONS}")


def _since_epoch(step: str) -> Column:
    """Whole steps from the epoch to a timestamp without time zone.

    Interval arithmetic, because ``timestampdiff`` goes through the session's time
    zone and is an hour off where that zone skips one.
    """
    return F.expr(f"(ts - timestamp_ntz'1970-01-01 00:00:00') div interval '{step}' second")


# What a record's lists hold, as the generator has them.
CITIES = ("London", "Manchester", "Cardiff")
ZIPS = {
    "London": ("WC1V", "EC1R", "EC1M", "EC2A", "EC4Y"),
    "Manchester": ("M45", "M61", "M30", "M23"),
    "Cardiff": ("CF15", "CF14"),
}
CARD_TYPES = ("credit", "debit")
CHARGEBACK_CATEGORIES = (
    "cancelled", "fraud", "non_receipt_goods", "processing_error", "request_for_info", "NA",
)
CHARGEBACK_RESULTS = ("charged_back", "open", "represented", "NA")


def _one_of(values: Sequence[str], number: str) -> Column:
    listed = F.array(*map(F.lit, values))
    return F.get(listed, F.pmod(F.col(number), F.lit(len(values))).cast("int"))


def _event_columns() -> dict[str, Column]:
    city = _one_of(CITIES, "user_id")
    zips = F
    for name in CITIES:
        zips = zips.when(city == name, _one_of(ZIPS[name], "event_id"))
    return {
        "unique_transact_id": padded(F.col("event_id").cast("string"), 9),
        "card_num": padded(F.col("user_id").cast("string"), 18),
        "processing_flag": F.when(F.col("event_type") == "error", "declined").otherwise("approved"),
        "trans_amt": F.col("value").cast("string"),
        "trans_time": _since_epoch("0.001").cast("string"),
        "card_type": _one_of(CARD_TYPES, "user_id"),
        "merchant_key": padded(F.get_json_object("props", "$.k"), 4),
        "mcc_desc": padded(F.pmod(F.col("user_id"), F.lit(10_000)).cast("string"), 4),
        "category_name": F.col("event_type"),
        "city": city,
        "zip": zips,
        "chrgbck_amt": (F.col("value") / 4).cast("string"),
        "chargeback_cat": _one_of(CHARGEBACK_CATEGORIES, "event_id"),
        "chargeback_res": _one_of(CHARGEBACK_RESULTS, "event_id"),
    }


def transactions(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events as rows of the 14 transaction columns, and of those to ``keep``."""
    columns = _event_columns()
    return events.select(*(columns[c].alias(c) for c in TRANSACTION_COLUMNS), *keep)


def timed(events: DataFrame) -> DataFrame:
    """Events with their time as a timestamp with time zone, in ``timestamp``."""
    return events.withColumn("timestamp", F.timestamp_micros(_since_epoch("0.000001")))


def envelope(events: DataFrame) -> DataFrame:
    """Events as topic records over four partitions, in the order of their ids."""
    placed = transactions(timed(events), keep=["event_id", "timestamp"])
    return placed.select(
        F.col("card_num").cast("binary").alias("key"),
        json_value(TRANSACTION_COLUMNS).cast("binary").alias("value"),
        F.lit(INPUT_TOPIC).alias("topic"),
        _partition().alias("partition"),
        _offset().alias("offset"),
        "timestamp",
        F.lit(0).alias("timestampType"),
    )


def progress_messages(
    events: DataFrame, reported: bool = False, made: bool = False
) -> DataFrame:
    """Progress as a stream over these records would report it, one message per 1,000 ids.

    With ``reported`` each message also has latest offsets: those after as many rows
    again. With ``made`` its time is that of the batch's last record. One grouping on the batch number; the end offset of every topic partition
    is a maximum, so all of it is combined within the tasks first.
    """
    names = [str(p) for p in range(PARTITIONS)]
    ends = [
        (F.max(F.when(_partition() == p, _offset())) + 1).alias(name)
        for p, name in enumerate(names)
    ]
    batches = events.groupBy(F.expr(f"event_id div {ROWS_PER_BATCH}").alias("batchId")).agg(
        F.count("*").alias("numInputRows"), F.max("ts").alias("last_ts"), *ends
    )
    stamp = F.date_format(F.col("last_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fixed = F.lit("2024-01-01T00:00:00.000Z")
    first = F.struct(*(F.greatest(F.col(n) - 250, F.lit(0)).alias(n) for n in names))
    rates = [
        (F.col("numInputRows") / 8).alias("inputRowsPerSecond"),
        (F.col("numInputRows") / 4).alias("processedRowsPerSecond"),
    ]
    fields = [
        F.lit("events").alias("description"),
        F.struct(first.alias(INPUT_TOPIC)).alias("startOffset"),
        F.struct(F.struct(*names).alias(INPUT_TOPIC)).alias("endOffset"),
        F.col("numInputRows"),
        *rates,
    ]
    if reported:
        ahead = F.expr(f"numInputRows div {PARTITIONS}")
        latest = F.struct(*[(F.col(name) + ahead).alias(name) for name in names])
        fields.append(F.struct(latest.alias(INPUT_TOPIC)).alias("latestOffset"))
    message = F.struct(
        F.lit("00000000-0000-0000-0000-000000000001").alias("id"),
        F.lit("00000000-0000-0000-0000-000000000002").alias("runId"),
        F.lit("score").alias("name"),
        (stamp if made else fixed).alias("timestamp"),
        "batchId",
        "numInputRows",
        *rates,
        F.struct((F.col("batchId") + 7).alias("triggerExecution")).alias("durationMs"),
        F.array(F.struct(*fields)).alias("sources"),
        # Fields that no schema here knows, in no order, with numbers that a double can't hold.
        F.struct(
            F.lit("sink").alias("description"),
            F.lit(200.0).alias("b"),
            (F.col("batchId").cast("decimal(38,0)") + F.lit("1" + 30 * "0").cast("decimal(38,0)")).alias("a"),
        ).alias("sink"),
    )
    return batches.select(F.to_json(message).alias("value"))
