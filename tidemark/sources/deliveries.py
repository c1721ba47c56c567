"""The ``events`` table as a topic delivered in the order of time, with repeats and late rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.endpoint import Endpoint, files
from tidemark.sources.events import timed, transactions

#: Parts of equal time that a topic comes in, and rows of one of its files at most.
PARTS, FILE_ROWS = 8, 5_000_000
#: One in so many rows comes again with the next part; one of the first two parts' with the last.
REPEATED, LATE, LATE_REST = 5, 97, 5
DELIVERED = "event_id long, timestamp timestamp, category_name string, trans_amt string, part int"


@dataclass(frozen=True)
class Deliveries:
    """A topic and the time, in milliseconds, that two of its parts take."""

    topic: Endpoint
    delay_millis: int

    @property
    def delay(self) -> str:
        return f"{self.delay_millis} milliseconds"


def deliver(events: DataFrame, folder: str, *, repeats: bool = False, late: bool = False) -> Deliveries:
    """Write ``events`` below ``folder`` part by part; a micro-batch reads one part.

    With ``repeats`` some rows come twice, with ``late`` some come long after their time.
    The files' own times give the order, so parts are written one after the other.
    """
    rows = transactions(timed(events), keep=["event_id", "timestamp"])
    micros = F.unix_micros("timestamp")
    low, high, count = rows.agg(F.min(micros), F.max(micros), F.count("*")).first()
    low, high = low or 0, high or 0
    span = high - low + 1
    part = F.expr(f"(unix_micros(timestamp) - {low}) * {PARTS} div {span}").cast("int")
    rows = rows.select("event_id", "timestamp", "category_name", "trans_amt", part.alias("part"))
    spread = 1 + count // (PARTS * FILE_ROWS)
    topic = files(folder, schema=DELIVERED, max_files_per_trigger=spread)
    for k in range(PARTS):
        # A filter on part would not reach the scan; one on the time does not either, after
        # the arithmetic that makes it. What a part costs is one pass over four columns.
        own = rows.filter(_comes_with(k, repeats, late))
        topic.write(own.repartition(spread))
    return Deliveries(topic, 2 * span // PARTS // 1000)


def _comes_with(k: int, repeats: bool, late: bool) -> Column:
    part, number = F.col("part"), F.col("event_id")
    delayed = (part <= 1) & (number % LATE == LATE_REST) if late else F.lit(False)
    comes = (part == k) & ~delayed
    if repeats:
        comes = comes | ((part == k - 1) & (number % REPEATED == 0) & ~delayed)
    if k == PARTS - 1:
        comes = comes | delayed
    return comes
