"""Repeats, windows and late rows on streams (K1, D3)."""

from __future__ import annotations

from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import bag
from tidemark.operators.delivery import (
    ROCKSDB,
    STATE_STORE,
    alerts_per_window,
    state_on_disk,
    without_repeats,
)
from tidemark.plans.workspace import new_folder
from tidemark.sources.deliveries import PARTS, deliver
from tidemark.sources.endpoint import files
from tidemark.sources.events import table
from tidemark.streaming.observe import counted, observed, progress_messages, state_rows
from tidemark.streaming.run import run_available

SCHEMA = "k string, at timestamp, v int"
START = datetime(2024, 3, 1, tzinfo=UTC)
NOW = {"availableNow": True}


def rows_at(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(minutes=m), v) for k, m, v in rows], SCHEMA)


def topic_of(spark, *batches):
    topic = files(new_folder(spark, "topic"), schema=SCHEMA, max_files_per_trigger=1)
    for batch in batches:
        topic.write(rows_at(spark, batch).coalesce(1))
    return topic


def test_repeats_within_the_delay_go_and_state_shrinks(spark):
    batches = [[(f"{b}-{k}", 60 * b + k, 1) for k in range(20)] for b in range(8)]
    again = [[], *[b[:5] for b in batches[:-1]]]
    topic = topic_of(spark, *[b + r + r for b, r in zip(batches, again, strict=True)])
    rows = without_repeats(topic.read_stream(spark), ["k"], "at", "90 minutes")
    output = files(new_folder(spark, "out"), schema=SCHEMA)
    with state_on_disk(spark):
        assert spark.conf.get(STATE_STORE) == ROCKSDB
        query = run_available(rows, output, new_folder(spark, "checkpoint"))
    assert spark.conf.get(STATE_STORE) != ROCKSDB
    assert bag(output.read(spark), ["k"]) == Counter((k,) for b in batches for k, _, _ in b)
    kept = state_rows(progress_messages(spark, query)).orderBy("batchId").collect()
    sizes = [r.rows for r in kept]
    assert max(sizes) < 8 * 20
    assert sizes[-1] < max(sizes)
    assert sum(r.late for r in kept) == 0


def test_repeats_in_a_table(spark):
    rows = rows_at(spark, [("a", 0, 1), ("a", 500, 1), ("b", 0, 2), (None, 0, 3), (None, 9, 3)])
    assert bag(without_repeats(rows, ["k"], "at", "1 minute"), ["k"]) == Counter([("a",), ("b",), (None,)])
    assert without_repeats(rows.limit(0), ["k"], "at", "1 minute").collect() == []


def test_windows_close_once_and_late_rows_are_counted(spark):
    first = [("a", 5, 1), ("b", 65, 0), ("c", 130, 1)]
    second = [("d", 70, 1), ("e", 300, 0)]
    third = [("late", 6, 1), ("f", 301, 1)]
    topic = topic_of(spark, first, second, third)
    rows = without_repeats(topic.read_stream(spark), ["k"], "at", "30 minutes")
    windows = alerts_per_window(rows, "at", "1 hour", ["v"])
    output = files(new_folder(spark, "out"), schema="start timestamp, rows long, v long")
    query = run_available(windows, output, new_folder(spark, "checkpoint"))
    got = {r.start: (r.rows, r.v) for r in output.read(spark).withColumn("start", F.unix_seconds("start")).collect()}
    begin = int(START.timestamp())
    assert got == {begin: (1, 1), begin + 3600: (2, 1), begin + 7200: (1, 1)}
    kept = state_rows(progress_messages(spark, query)).filter(F.col("operator").startswith("dedupe"))
    assert kept.agg(F.sum("late")).first()[0] == 1


def test_restarted_windows_go_on(spark):
    """State survives between runs: a window that is open at the end of one closes in the next."""
    topic = topic_of(spark, [("a", 5, 1), ("b", 50, 1)])
    checkpoint, output = new_folder(spark, "checkpoint"), files(new_folder(spark, "out"), schema="start timestamp, rows long, v long")

    def run():
        windows = alerts_per_window(topic.read_stream(spark), "at", "1 hour", ["v"], "10 minutes")
        run_available(windows, output, checkpoint)
        return sorted((r.rows, r.v) for r in output.read(spark).collect())

    assert run() == []
    topic.write(rows_at(spark, [("c", 40, 0), ("d", 75, 1)]).coalesce(1))
    assert run() == [(3, 2)]
    topic.write(rows_at(spark, [("e", 500, 0)]))
    assert run() == [(1, 1), (3, 2)]


def test_windows_of_a_table(spark):
    rows = rows_at(spark, [("a", 5, 1), ("b", 59, 0), ("c", 60, 1), ("d", 61, None)])
    got = alerts_per_window(rows, "at", "1 hour", ["v"], "10 minutes")
    assert bag(got, ["rows", "v"]) == Counter([(2, 1), (2, 1)])


def test_metrics_of_each_batch(spark):
    topic = topic_of(spark, [("a", 0, 1), ("b", 1, 0)], [("c", 2, None)], [])
    rows = counted(topic.read_stream(spark), "m", ["v"], F.max("k").alias("last"))
    query = run_available(rows, files(new_folder(spark, "out"), schema=SCHEMA), new_folder(spark, "checkpoint"))
    got = observed(progress_messages(spark, query), "m", "rows: long, v: long, last: string").drop("id")
    assert {tuple(r) for r in got.filter("rows > 0").collect()} == {(0, 2, 1, "b"), (1, 1, 0, "c")}
    assert observed(progress_messages(spark, query), "other", "rows: long").collect() == []


@pytest.mark.parametrize(("repeats", "late"), [(False, False), (True, True)])
def test_deliveries(spark, data_dir, repeats, late):
    events = table(spark, data_dir, "events")
    topic = deliver(events, new_folder(spark, "deliveries"), repeats=repeats, late=late)
    got = topic.topic.read(spark)
    assert got.select("event_id").distinct().count() == events.count()
    assert (got.count() > events.count()) == repeats
    assert {r.part for r in got.select("part").distinct().collect()} == set(range(PARTS))
    assert deliver(events.limit(0), new_folder(spark, "none")).topic.read(spark).collect() == []
