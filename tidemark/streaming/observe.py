"""What streams report about themselves, as tables."""

from __future__ import annotations

import json
import logging
import threading
from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.functions.columns import named, text_of
from tidemark.functions.offsets import all_reported, reported_latest
from tidemark.operators.messages import keyed
from tidemark.operators.progress import with_field, with_latest_offset
from tidemark.sources.endpoint import INPUT_TOPIC, Endpoint, literal_rows

logger = logging.getLogger(__name__)

LIFECYCLE_SCHEMA = "event string, id string, runId string"
# Fixed value: the key of every progress message.
PROGRESS_KEY = "key"
LIFECYCLE_KEY = "lifecycle"
# The field that holds what all sources report.
ALL_OFFSETS = "latestOffsets"
# Some 30 MB of messages in one job.
WRITE_MESSAGES = 10_000


class ProgressLog(StreamingQueryListener):
    """Takes notes of every event of a session's streams until they are written out.

    The callbacks only append, so they never hold up Spark's listener thread;
    writing happens in bulk from the caller's thread. Notes wait on the driver
    between two writes: a few kilobytes for each micro-batch, whatever its size.
    """

    def __init__(self) -> None:
        self._lifecycle: deque[tuple[str, str, str]] = deque()
        self._progress: deque[str] = deque()
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        logger.info("query started: %s", event.id)
        with self._changed:
            self._lifecycle.append(("started", str(event.id), str(event.runId)))

    def onQueryProgress(self, event) -> None:
        logger.info("progress: %s", event.progress.json)
        with self._changed:
            self._progress.append(event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        logger.info("query terminated: %s", event.id)
        with self._changed:
            self._lifecycle.append(("terminated", str(event.id), str(event.runId)))
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait_ended(self, query: StreamingQuery, timeout: float = 60.0) -> bool:
        """Wait until a query's last event has come in; events arrive after the query ends."""
        run_id = str(query.runId)
        with self._changed:
            came = self._changed.wait_for(lambda: run_id in self._ended, timeout)
            self._ended.discard(run_id)
            return came

    @property
    def pending(self) -> int:
        """How many progress messages wait to be written."""
        return len(self._progress)

    def take_progress(self, most: int | None = None) -> list[str]:
        """The oldest progress messages noted since the last call, all or at most so many."""
        with self._changed:
            count = len(self._progress) if most is None else min(most, len(self._progress))
            return [self._progress.popleft() for _ in range(count)]

    def take_lifecycle(self) -> list[tuple[str, str, str]]:
        """The start and end events noted since the last call."""
        with self._changed:
            taken = list(self._lifecycle)
            self._lifecycle.clear()
        return taken

    def flush(
        self,
        spark: SparkSession,
        sink: Endpoint,
        topic: str | None = INPUT_TOPIC,
        partition: int = 0,
    ) -> int:
        """K5: write the noted progress messages, keyed, in jobs of bounded size; returns how many.

        Each message gets what its sources report: the latest offset of the given topic
        partition in ``latestOffset``, unless ``topic`` is None, and that of all sources,
        topics and partitions in ``latestOffsets``. Messages of a failed write are noted
        again.
        """
        written = 0
        while taken := self.take_progress(WRITE_MESSAGES):
            messages = literal_rows(spark, taken)
            if topic is not None:
                latest = reported_latest(F.col("value"), topic, partition)
                messages = with_latest_offset(messages, latest)
            messages = with_field(messages, ALL_OFFSETS, all_reported(F.col("value")))
            try:
                sink.write(keyed(messages, F.lit(PROGRESS_KEY)))
            except Exception:
                with self._changed:
                    self._progress.extendleft(reversed(taken))
                raise
            written += len(taken)
        return written

    def flush_lifecycle(self, spark: SparkSession, sink: Endpoint) -> int:
        """T5: write the noted start and end events as keyed JSON messages; returns how many."""
        taken = self.take_lifecycle()
        if taken:
            names = ("event", "id", "runId")
            texts = [json.dumps(dict(zip(names, event, strict=True))) for event in taken]
            try:
                sink.write(keyed(literal_rows(spark, texts), F.lit(LIFECYCLE_KEY)))
            except Exception:
                with self._changed:
                    self._lifecycle.extendleft(reversed(taken))
                raise
        return len(taken)


def progress_messages(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The progress a query still remembers, one JSON message per event.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` events;
    use :class:`ProgressLog` for all of them.
    """
    return literal_rows(spark, [p.json for p in query.recentProgress])


def lifecycle_rows(spark: SparkSession, events: Iterable[tuple[str, str, str]]) -> DataFrame:
    """T5: start and end events as a table."""
    return spark.createDataFrame(list(events), LIFECYCLE_SCHEMA)


def counted(flagged: DataFrame, name: str, flags: Sequence[str], *more: Column) -> DataFrame:
    """``flagged``, which counts its rows and flags into its own progress events.

    Spark adds up ``rows`` and the flags, and ``more`` aliased aggregates, while a batch is
    written, without a second pass; :func:`observed` reads them back. A retried task is
    counted once.
    """
    marked = [F.coalesce(F.sum(named(f)), F.lit(0)).cast("long").alias(f) for f in flags]
    return flagged.observe(name, F.count(F.lit(1)).alias("rows"), *marked, *more)


def observed(progress: DataFrame, name: str, fields: str, value: str = "value") -> DataFrame:
    """``id, batchId`` and the metrics ``fields`` (a schema) of every event that has them."""
    schema = f"id string, batchId long, observedMetrics struct<`{name}`: struct<{fields}>>"
    events = progress.select(F.from_json(text_of(value), schema).alias("e")).select("e.*")
    metrics = F.col("observedMetrics").getField(name)
    return events.filter(metrics.isNotNull()).select("id", "batchId", metrics.alias("m")).select("id", "batchId", "m.*")


def state_rows(progress: DataFrame, value: str = "value") -> DataFrame:
    """``id, batchId, operator, rows, late``: what each stateful operator keeps after a batch.

    ``late`` counts rows that came behind the watermark and were dropped; an aggregation
    counts its partial sums there, an operator on single rows the rows.
    """
    state = "operatorName: string, numRowsTotal: long, numRowsDroppedByWatermark: long"
    schema = f"id string, batchId long, stateOperators array<struct<{state}>>"
    events = progress.select(F.from_json(text_of(value), schema).alias("e")).select("e.*")
    rows = events.select("id", "batchId", F.explode("stateOperators").alias("s"))
    return rows.select(
        "id",
        "batchId",
        F.col("s.operatorName").alias("operator"),
        F.col("s.numRowsTotal").alias("rows"),
        F.col("s.numRowsDroppedByWatermark").alias("late"),
    )
