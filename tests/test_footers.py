"""Ends of stored topics from file footers."""

from __future__ import annotations

from collections import Counter

import pytest

from tidemark.operators.progress import input_lag, latest_offsets
from tidemark.plans import reporting
from tidemark.schema import ENVELOPE_SCHEMA
from tidemark.sources import files
from tidemark.sources.events import envelope, progress_messages, table
from tidemark.sources.footers import TOPIC_FOLDERS, stored_ends


def bag(rows):
    return Counter(map(tuple, rows.select(sorted(rows.columns)).collect()))


@pytest.fixture(scope="module")
def topic(spark, data_dir, tmp_path_factory):
    place = files(str(tmp_path_factory.mktemp("topic") / "stored"), partition_by=TOPIC_FOLDERS)
    records = envelope(table(spark, data_dir, "events"))
    place.write(records.filter("offset % 3 < 2"))
    # A later write, and a topic whose name looks like a number.
    place.write(records.filter("offset % 3 = 2"))
    place.write(records.limit(7).selectExpr("key", "value", "'007' topic", "9 partition", "offset", "timestamp", "timestampType"))
    return place


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_footers_tell_the_ends(spark, topic):
    ends = stored_ends(spark, topic)
    assert bag(ends) == bag(latest_offsets(topic.read(spark)))
    assert ends.schema == latest_offsets(topic.read(spark)).schema
    assert {"007", "input"} == {r.topic for r in ends.collect()}


def test_no_row_is_read_and_the_session_stays(spark, topic):
    before = dict(spark.conf.getAll)
    text = plan(stored_ends(spark, topic))
    assert "PushedAggregation: [MAX(offset)]" in text
    assert "PushedGroupBy: [topic, partition]" in text
    assert dict(spark.conf.getAll) == before
    assert "PushedAggregation: [MAX" not in plan(latest_offsets(topic.read(spark)))


def test_lag_behind_the_stored_end(spark, data_dir, topic, tmp_path):
    progress, sink = files(str(tmp_path / "p"), schema=None), files(str(tmp_path / "l"), schema=None)
    progress.write(progress_messages(table(spark, data_dir, "events")))
    reporting.write_lag(spark, progress, sink, topic, now=True)
    expected = input_lag(progress.read(spark), latest_offsets(topic.read(spark)))
    assert bag(sink.read(spark)) == bag(expected)
    assert "PushedAggregation: [MAX(offset)]" in plan(input_lag(progress.read(spark), stored_ends(spark, topic)))


def test_no_files_and_other_layouts(spark, tmp_path):
    (tmp_path / "none").mkdir()
    empty = files(str(tmp_path / "none"), partition_by=TOPIC_FOLDERS)
    assert stored_ends(spark, empty).collect() == []
    for other in (files("x"), files("x", format="json", partition_by=TOPIC_FOLDERS)):
        with pytest.raises(ValueError, match="partitioned by topic, partition"):
            stored_ends(spark, other)
    place = files(str(tmp_path / "one"), partition_by=TOPIC_FOLDERS)
    place.write(spark.createDataFrame([], ENVELOPE_SCHEMA))
    assert stored_ends(spark, place).collect() == []
