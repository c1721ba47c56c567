"""Record schemas shared by the batch and the streaming side."""

from __future__ import annotations

from pyspark.sql import types as T

# The transaction record, all text, in wire order.
TRANSACTION_COLUMNS = (
    "unique_transact_id",
    "card_num",
    "processing_flag",
    "trans_amt",
    "trans_time",
    "card_type",
    "merchant_key",
    "mcc_desc",
    "category_name",
    "city",
    "zip",
    "chrgbck_amt",
    "chargeback_cat",
    "chargeback_res",
)

# The columns that the two preset detectors add.
UPPER_WARNING = "Upper_Warning"
UPPER_ACTION = "Upper_Action"

TRANSACTION_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType(), True) for name in TRANSACTION_COLUMNS]
)

SCORED_SCHEMA = T.StructType(
    TRANSACTION_SCHEMA.fields
    + [T.StructField(name, T.IntegerType(), True) for name in (UPPER_WARNING, UPPER_ACTION)]
)

# What a chart needs of a scored record.
POINT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType(), True) for name in ("trans_time", "trans_amt")]
)

# The columns of Spark's Kafka source; file-backed topics use the same ones.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("timestampType", T.IntegerType(), True),
    ]
)

# The parts of Spark's progress JSON that are read as columns. Offsets stay JSON
# text because their shape depends on the source: nested map (Kafka), number
# (rate), object with logOffset (files) or null.
SOURCE_PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("description", T.StringType(), True),
        T.StructField("startOffset", T.StringType(), True),
        T.StructField("endOffset", T.StringType(), True),
        T.StructField("latestOffset", T.StringType(), True),
        T.StructField("numInputRows", T.LongType(), True),
        T.StructField("inputRowsPerSecond", T.DoubleType(), True),
        T.StructField("processedRowsPerSecond", T.DoubleType(), True),
    ]
)

PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("runId", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("batchId", T.LongType(), True),
        T.StructField("numInputRows", T.LongType(), True),
        T.StructField("inputRowsPerSecond", T.DoubleType(), True),
        T.StructField("processedRowsPerSecond", T.DoubleType(), True),
        T.StructField("durationMs", T.MapType(T.StringType(), T.LongType()), True),
        T.StructField("sources", T.ArrayType(SOURCE_PROGRESS_SCHEMA), True),
    ]
)
