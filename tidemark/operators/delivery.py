"""Event time on streams: repeats after at-least-once delivery, and windows of alerts (K1, D3)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import named

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside goes to RocksDB rather than the executors' heap.

    Keys then may outnumber what memory holds. A stream keeps the store it began with; the
    session's own setting is back afterwards.
    """
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def without_repeats(rows: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """One row for each value of ``keys``: the first to come, on a stream within ``delay``.

    On a stream, keys are remembered until the watermark, the latest ``time`` less
    ``delay``, is ``delay`` past theirs, so state holds what came within twice the delay and
    no more. Rows whose ``time`` is behind the watermark are too late to be told from
    repeats; they are dropped and counted in the progress. A table has no delay: any of
    equal rows stays. Rows with null keys count as equal; a null time is never late.
    """
    if not rows.isStreaming:
        return rows.dropDuplicates(list(keys))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def alerts_per_window(
    flagged: DataFrame, time: str, width: str, flags: Sequence[str], delay: str | None = None
) -> DataFrame:
    """``start, rows`` and how many rows each flag marks, for windows of ``width``.

    A stream gives a window once, in append mode, when the watermark has passed its end:
    the one that is set already, or the latest ``time`` less ``delay``. Partial sums within
    the tasks, so a busy window is a row a task.
    """
    if delay and flagged.isStreaming:
        flagged = flagged.withWatermark(time, delay)
    marked = [F.sum(named(f)).alias(f) for f in flags]
    windows = flagged.groupBy(F.window(time, width)).agg(F.count("*").alias("rows"), *marked)
    return windows.select(F.col("window.start").alias("start"), "rows", *flags)
