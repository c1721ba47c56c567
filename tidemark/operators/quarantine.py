"""Messages that are no records, told apart in the pass that decodes them (Q1)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import named, text_of
from tidemark.operators.messages import WHOLE_TEXTS
from tidemark.schema import TRANSACTION_SCHEMA

CORRUPT = "_corrupt"
REASON, RAW, VERDICT = "reason", "raw", "verdict"
GOOD, BAD = "good", "bad"


def judge(
    messages: DataFrame, schema: T.StructType = TRANSACTION_SCHEMA, value: str = "value"
) -> DataFrame:
    """The columns of ``schema``, ``reason`` and ``raw``, one row per message; none is dropped.

    ``reason`` is null for a record, and else why it is none: ``null`` or ``empty`` for what
    has no text, ``malformed`` for what the parser refuses, ``no fields`` for an object or a
    list without any of the columns. ``raw`` keeps the text of what is no record, as it came.
    """
    if {CORRUPT, REASON, RAW, VERDICT} & {n.lower() for n in schema.names}:
        raise ValueError(f"{CORRUPT}, {REASON}, {RAW} and {VERDICT} are not for records")
    with_corrupt = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    options = {**WHOLE_TEXTS, "columnNameOfCorruptRecord": CORRUPT}
    text = text_of(value).alias(RAW)
    rows = messages.select(text).select(RAW, F.from_json(RAW, with_corrupt, options).alias("data"))
    fields = [F.col("data").getField(n) for n in schema.names]
    nothing = F.lit(True)
    for field in fields:
        nothing = nothing & field.isNull()
    reason = (
        F.when(F.col(RAW).isNull(), "null")
        .when(F.trim(RAW) == "", "empty")
        .when(F.col("data").getField(CORRUPT).isNotNull() | F.col("data").isNull(), "malformed")
        .when(nothing, "no fields")
    )
    judged = rows.withColumn(REASON, reason)
    bad = F.col(REASON).isNotNull()
    kept = [F.when(~bad, f).alias(n) for f, n in zip(fields, schema.names, strict=True)]
    return judged.select(*kept, REASON, F.when(bad, F.col(RAW)).alias(RAW))


@dataclass(frozen=True)
class Quarantine:
    """One written table with a folder for records and one for everything else."""

    folder: str
    schema: T.StructType = TRANSACTION_SCHEMA

    def _written(self) -> T.StructType:
        more = [T.StructField(n, T.StringType()) for n in (REASON, RAW, VERDICT)]
        return T.StructType([*self.schema, *more])

    def write(self, messages: DataFrame, value: str = "value") -> None:
        """Decode and route messages in one pass: the source is read once and nothing is kept.

        No shuffle; each task writes to both folders.
        """
        judged = judge(messages, self.schema, value)
        routed = judged.withColumn(VERDICT, self.verdict())
        routed.write.mode("append").partitionBy(VERDICT).parquet(self.folder)

    @staticmethod
    def verdict() -> Column:
        return F.when(F.col(REASON).isNull(), GOOD).otherwise(BAD)

    def start(self, messages: DataFrame, checkpoint: str, trigger: Mapping[str, object] | None = None):
        """The same for a stream: one source, one query, both folders."""
        routed = judge(messages, self.schema).withColumn(VERDICT, self.verdict())
        writer = routed.writeStream.format("parquet").option("path", self.folder)
        writer = writer.option("checkpointLocation", checkpoint).partitionBy(VERDICT)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def good(self, spark: SparkSession) -> DataFrame:
        """The records; reads their folder only."""
        rows = spark.read.schema(self._written()).parquet(self.folder).filter(named(VERDICT) == GOOD)
        return rows.select(*map(named, self.schema.names))

    def bad(self, spark: SparkSession) -> DataFrame:
        """``reason, raw`` of all else; reads its folder only."""
        rows = spark.read.schema(self._written()).parquet(self.folder).filter(named(VERDICT) == BAD)
        return rows.select(REASON, RAW)
