"""Starting streams and waiting for them."""

from __future__ import annotations

import logging

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.endpoint import INPUT_TOPIC, Endpoint
from tidemark.streaming.observe import ProgressLog

logger = logging.getLogger(__name__)

FLUSH_SECONDS = 30


def run_available(rows: DataFrame, sink: Endpoint, checkpoint: str) -> StreamingQuery:
    """Write everything a stream has now, in as many micro-batches as its rate limit asks."""
    query = sink.write_stream(rows, checkpoint, trigger={"availableNow": True})
    query.awaitTermination()
    return query


def run_until_stopped(
    spark: SparkSession,
    query: StreamingQuery,
    log: ProgressLog,
    progress_sink: Endpoint,
    flush_seconds: float = FLUSH_SECONDS,
    *,
    topic: str | None = INPUT_TOPIC,
    partition: int = 0,
    events_sink: Endpoint | None = None,
    spill: Endpoint | None = None,
) -> None:
    """Block until a query ends, meanwhile writing out its progress from time to time.

    ``topic`` and ``partition`` are those whose latest offset has a field of its own; all
    others are in a list. Start and end events go to ``events_sink`` if there is one.

    When progress can't be written, what to do is the caller's choice: with a ``spill``, a
    sink in a durable folder, it is written there and scoring goes on; without, the query
    is stopped and the failure raised. When the query itself fails, what it did before is
    written and the failure raised. A last event that doesn't arrive is an error.
    """

    def write() -> None:
        if events_sink:
            _or_spilled(spill, lambda sink: log.flush_lifecycle(spark, sink), events_sink)
        _or_spilled(spill, lambda sink: log.flush(spark, sink, topic, partition), progress_sink)

    try:
        while not query.awaitTermination(flush_seconds):
            try:
                write()
            except Exception:
                query.stop()
                raise
    except StreamingQueryException as failure:
        complete = log.wait_ended(query)
        try:
            write()
        except Exception as unwritten:
            failure.add_note(f"{log.pending} progress messages were not written: {unwritten}")
        if not complete:
            failure.add_note("the query's last events did not arrive")
        raise
    complete = log.wait_ended(query)
    write()
    if not complete:
        raise TimeoutError("the query's last events did not arrive")


def _or_spilled(spill: Endpoint | None, write, sink: Endpoint) -> None:
    try:
        write(sink)
    except Exception:
        if spill is None:
            raise
        logger.warning("progress could not be written and is spilled", exc_info=True)
        write(spill)
