"""Outputs that no replayed batch repeats (K1, K5)."""

from __future__ import annotations

import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import bag, plan
from tidemark.plans.workspace import new_folder
from tidemark.sources.endpoint import files
from tidemark.streaming.ledger import Ledger, start_once

SCHEMA = "k long, t string"
NOW = {"availableNow": True}
ROOT = Path(__file__).resolve().parent.parent


def topic_of(spark, batches=4, rows=10):
    topic = files(new_folder(spark, "topic"), schema=SCHEMA, max_files_per_trigger=1)
    for b in range(batches):
        topic.write(spark.range(b * rows, (b + 1) * rows, 1, 1).select(F.col("id").alias("k"), F.lit("x").alias("t")))
    return topic


@pytest.fixture
def ledger(spark):
    return Ledger(new_folder(spark, "ledger"), SCHEMA)


def test_nothing_yet(spark, ledger):
    assert ledger.read(spark).collect() == []
    assert ledger.entries(spark).collect() == []
    assert not ledger.has(spark, "q", 0)
    assert ledger.batch(spark, "q", 0).collect() == []


def test_a_batch_is_put_once(spark, ledger):
    rows = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    assert ledger.put(rows, "q", 3)
    assert not ledger.put(rows.union(rows), "q", 3)
    assert ledger.put(rows, "other", 3)
    assert ledger.put(rows.limit(0), "q", 4)
    assert bag(ledger.read(spark, keep=("query", "batch"))) == Counter(
        [(k, t, q, 3) for k, t in ((1, "a"), (2, None)) for q in ("q", "other")]
    )
    entries = {(r["query"], r.batch): r.rows for r in ledger.entries(spark).collect()}
    assert entries == {("q", 3): 2, ("other", 3): 2, ("q", 4): 0}
    assert bag(ledger.batch(spark, "q", 3)) == Counter([(1, "a"), (2, None)])


def test_rows_without_an_entry_are_not_read_and_are_replaced(spark, ledger):
    class Torn(Ledger):
        def enter(self, *where):
            raise InterruptedError

    rows = spark.createDataFrame([(1, "torn")], SCHEMA)
    with pytest.raises(InterruptedError):
        Torn(ledger.folder, SCHEMA).put(rows, "q", 0)
    assert ledger.read(spark).collect() == []
    ledger.put(spark.createDataFrame([(2, "whole")], SCHEMA), "q", 0)
    assert bag(ledger.read(spark)) == Counter([(2, "whole")])


@pytest.mark.parametrize("after_entry", [False, True])
def test_interrupted_stream(spark, ledger, after_entry):
    """Dies on either side of the entry, so before Spark commits the batch; both are replayed."""

    class Torn(Ledger):
        def enter(self, spark, query, batch):
            if batch == 2 and not after_entry:
                raise InterruptedError
            super().enter(spark, query, batch)
            if batch == 2:
                raise InterruptedError

    topic, checkpoint = topic_of(spark), new_folder(spark, "checkpoint")
    worked = []

    def work(batch, number):
        worked.append(number)
        return batch

    torn = Torn(ledger.folder, SCHEMA)
    with pytest.raises(StreamingQueryException):
        start_once(topic.read_stream(spark), torn, checkpoint, "q", NOW, work).awaitTermination()
    assert ledger.read(spark).count() == (30 if after_entry else 20)
    start_once(topic.read_stream(spark), ledger, checkpoint, "q", NOW, work).awaitTermination()
    assert bag(ledger.read(spark)) == Counter((k, "x") for k in range(40))
    assert worked == ([0, 1, 2, 3] if after_entry else [0, 1, 2, 2, 3])
    start_once(topic.read_stream(spark), ledger, checkpoint, "q", NOW, work).awaitTermination()
    assert ledger.read(spark).count() == 40


def test_killed_process(spark, ledger):
    """The whole driver goes between a batch's rows and its entry."""
    topic, checkpoint = topic_of(spark), new_folder(spark, "checkpoint")
    job = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        from tidemark.sources.endpoint import files
        from tidemark.streaming.ledger import Ledger, start_once

        class Killed(Ledger):
            def enter(self, spark, query, batch):
                if batch == 1:
                    os._exit(9)
                super().enter(spark, query, batch)

        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        topic = files({topic.options["path"]!r}, schema={SCHEMA!r}, max_files_per_trigger=1)
        ledger = Killed({ledger.folder!r}, {SCHEMA!r})
        start_once(topic.read_stream(spark), ledger, {checkpoint!r}, "q", {NOW!r}).awaitTermination()
    """)
    done = subprocess.run([sys.executable, "-c", job], capture_output=True, timeout=120, check=False)
    assert done.returncode == 9
    assert ledger.read(spark).count() == 10
    start_once(topic.read_stream(spark), ledger, checkpoint, "q", NOW).awaitTermination()
    assert bag(ledger.read(spark)) == Counter((k, "x") for k in range(40))


def test_plan_reads_entered_folders(spark, ledger):
    for batch in range(3):
        ledger.put(spark.createDataFrame([(batch, "a")], SCHEMA), "q", batch)
    shown = plan(ledger.read(spark))
    assert "PartitionFilters" in shown
    assert "dynamicpruning" in shown or "BroadcastHashJoin" in shown
