"""The scoring job as a stream: parity, restart, observation."""

from __future__ import annotations

import json
import os
import threading
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import bag
from tidemark.operators.messages import decode_scored
from tidemark.operators.progress import input_lag, latest_offsets, progress_rows
from tidemark.plans import queries, reporting, scoring
from tidemark.plans.workspace import new_folder
from tidemark.schema import SCORED_SCHEMA
from tidemark.sources.endpoint import Endpoint, files, literal_rows, paced
from tidemark.sources.events import envelope, events_stream, table
from tidemark.streaming import (
    ProgressLog,
    lifecycle_rows,
    observe,
    progress_messages,
    run_available,
    run_until_stopped,
)

AVAILABLE_NOW = {"availableNow": True}


@pytest.fixture(scope="module")
def records(spark, data_dir):
    return envelope(table(spark, data_dir, "events"))


def _topic_of(spark, records, parts=4):
    """The records as a file-backed topic, one file for each of its partitions."""
    topic = files(new_folder(spark, "input"), max_files_per_trigger=1)
    topic.write(records.repartition(parts))
    return topic


def _output(spark):
    return files(new_folder(spark, "output"), schema="value string")


def _finish(query):
    query.awaitTermination()
    return [p.numInputRows for p in query.recentProgress if p.numInputRows]


def test_stream_and_batch_agree_over_several_batches(spark, records):
    topic, output = _topic_of(spark, records), _output(spark)
    query = scoring.start_stream(
        spark, topic, output, new_folder(spark, "checkpoint"), trigger=AVAILABLE_NOW
    )
    batches = _finish(query)
    assert len(batches) == 4
    assert sum(batches) == 1000
    assert not any(p.stateOperators for p in query.recentProgress)
    assert bag(output.read(spark)) == bag(scoring.score_messages(records))


def test_restart_reads_only_what_is_new(spark, records):
    topic, output = _topic_of(spark, records), _output(spark)
    checkpoint = new_folder(spark, "checkpoint")

    def run():
        query = scoring.start_stream(spark, topic, output, checkpoint, trigger=AVAILABLE_NOW)
        return sum(_finish(query))

    assert run() == 1000
    assert run() == 0
    topic.write(records.limit(7).coalesce(1))
    assert run() == 7
    assert output.read(spark).count() == 1007


def test_interrupted_stream_ends_with_the_same_rows(spark, records):
    topic, output = _topic_of(spark, records, parts=6), _output(spark)
    checkpoint = new_folder(spark, "checkpoint")
    query = scoring.start_stream(spark, topic, output, checkpoint)
    for _ in range(100):
        query.awaitTermination(0.1)
        if query.lastProgress and query.lastProgress.batchId >= 1:
            break
    query.stop()
    done = sum(p.numInputRows for p in query.recentProgress)
    assert done > 0
    query = scoring.start_stream(spark, topic, output, checkpoint, trigger=AVAILABLE_NOW)
    query.awaitTermination()
    assert bag(output.read(spark)) == bag(scoring.score_messages(records))


def test_bad_messages_do_not_stop_a_stream(spark):
    values = ["not json", "", None, '{"trans_amt":"abc"}', '{"trans_amt":"99"}', "1,2,3"]
    topic = files(new_folder(spark, "input"), schema="value string")
    topic.write(literal_rows(spark, values))
    output = _output(spark)
    query = scoring.start_stream(
        spark, topic, output, new_folder(spark, "checkpoint"), trigger=AVAILABLE_NOW
    )
    assert sum(_finish(query)) == 6
    scored = decode_scored(output.read(spark))
    assert scored.schema == SCORED_SCHEMA
    assert bag(scored, ["trans_amt", "Upper_Warning", "Upper_Action"]) == {
        (None, 0, 0): 4,
        ("abc", 0, 0): 1,
        ("99", 1, 0): 1,
    }


def test_csv_stream(spark):
    topic = files(new_folder(spark, "input"), schema="value string")
    topic.write(literal_rows(spark, ["1,2,approved,120", "3,4,declined,90"]))
    output = _output(spark)
    _finish(
        scoring.start_stream(
            spark, topic, output, new_folder(spark, "checkpoint"), wire="csv",
            trigger=AVAILABLE_NOW,
        )
    )
    got = bag(decode_scored(output.read(spark)), ["trans_amt", "Upper_Warning", "Upper_Action"])
    assert got == {("120", 1, 1): 1, ("90", 1, 0): 1}


def test_batch_job_equals_stream_job(spark, records):
    topic, output = _topic_of(spark, records), _output(spark)
    scoring.run_batch(spark, topic, output)
    assert bag(output.read(spark)) == bag(scoring.score_messages(records))


def test_events_as_a_folder_of_files(spark, data_dir):
    folder = new_folder(spark, "data")
    events = table(spark, data_dir, "events")
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    events.limit(5).write.parquet(f"{folder}/events_old.parquet")
    streamed = queries.stream_score_transactions(spark, folder)
    assert bag(streamed) == bag(queries.score_transactions(spark, folder))
    assert sum(r.rows_read for r in queries.stream_progress(spark, folder).collect()) == 1000


def test_large_types_stay_one_batch_each(spark, data_dir):
    folder = new_folder(spark, "data")
    events = table(spark, data_dir, "events")
    events.repartition(6).write.parquet(f"{folder}/events.parquet")
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.files.maxPartitionBytes": "8k",
        "spark.sql.files.openCostInBytes": "8k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = queries.stream_progress(spark, folder).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == events.select("event_type").distinct().count()


def test_events_in_limited_batches(spark, data_dir):
    folder = new_folder(spark, "data")
    table(spark, data_dir, "events").repartition(3).write.parquet(f"{folder}/events.parquet")
    scored = scoring.score_messages(envelope(events_stream(spark, folder, 1000)))
    output = _output(spark)
    query = run_available(scored, output, new_folder(spark, "checkpoint"))
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    assert output.read(spark).count() == 1000


def test_points_of_a_stream(spark, records):
    scored, points = _output(spark), _output(spark)
    scored.write(scoring.score_messages(records))
    query = reporting.write_points(spark, scored, points, new_folder(spark, "checkpoint"))
    query.processAllAvailable()
    query.stop()
    batch = _output(spark)
    assert reporting.write_points(spark, scored, batch) is None
    assert bag(points.read(spark)) == bag(batch.read(spark))
    assert points.read(spark).count() == 1000


@pytest.fixture
def log(spark):
    listener = ProgressLog()
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def test_t4_t5_t6_k5_every_event_is_noted_and_written(spark, records, log):
    topic, output = _topic_of(spark, records, parts=3), _output(spark)
    progress_topic = files(new_folder(spark, "progress"), schema="key string, value string")
    query = scoring.start_stream(
        spark, topic, output, new_folder(spark, "checkpoint"), trigger=AVAILABLE_NOW
    )
    run_until_stopped(spark, query, log, progress_topic, flush_seconds=0.2)
    written = progress_topic.read(spark)
    assert {r.key for r in written.collect()} == {"key"}
    events = [e for e in progress_rows(written).collect() if e.id == str(query.id)]
    assert sum(e.numInputRows for e in events) == 1000
    assert sorted(e.batchId for e in events if e.numInputRows) == [0, 1, 2]
    lifecycle = lifecycle_rows(spark, log.take_lifecycle())
    assert bag(lifecycle.filter(F.col("id") == str(query.id))) == {
        ("started", str(query.id), str(query.runId)): 1,
        ("terminated", str(query.id), str(query.runId)): 1,
    }
    assert lifecycle_rows(spark, log.take_lifecycle()).count() == 0


def test_failed_stream_raises_and_leaves_its_progress(spark, records, log):
    topic, output = _topic_of(spark, records.limit(10), parts=1), _output(spark)
    broken = Path(topic.options["path"]) / "zz.parquet"
    broken.write_text("this is no parquet file")
    os.utime(broken, (time.time() + 60, time.time() + 60))
    progress_topic = files(new_folder(spark, "progress"), schema="key string, value string")
    query = scoring.start_stream(
        spark, topic, output, new_folder(spark, "checkpoint"), trigger=AVAILABLE_NOW
    )
    with pytest.raises(StreamingQueryException):
        run_until_stopped(spark, query, log, progress_topic, flush_seconds=0.2)
    assert output.read(spark).count() == 10
    events = [
        e for e in progress_rows(progress_topic.read(spark)).collect() if e.id == str(query.id)
    ]
    assert [e.numInputRows for e in events if e.numInputRows] == [10]
    lifecycle = [event for event, id, _ in log.take_lifecycle() if id == str(query.id)]
    assert lifecycle == ["started", "terminated"]


def test_scoring_goes_on_while_progress_is_spilled(spark, records, log, caplog):
    topic, output = _topic_of(spark, records), _output(spark)
    spill = files(new_folder(spark, "spill"), schema="key string, value string")
    query = scoring.start_stream(spark, topic, output, new_folder(spark, "checkpoint"))
    stopper = threading.Timer(6.0, query.stop)
    stopper.start()
    broken = Endpoint("no_such_format")
    run_until_stopped(spark, query, log, broken, 0.5, events_sink=broken, spill=spill)
    assert "spilled" in caplog.text
    assert output.read(spark).count() == 1000
    kept = [(r.key, json.loads(r.value)) for r in spill.read(spark).collect()]
    own = [(key, m) for key, m in kept if m["id"] == str(query.id)]
    assert sum(m["numInputRows"] for key, m in own if key == "key") == 1000
    assert {m["event"] for key, m in own if key == "lifecycle"} == {"started", "terminated"}
    assert log.pending == 0


def test_a_failing_progress_sink_stops_the_query_without_a_spill(spark, log):
    query = Endpoint("noop").write_stream(
        paced(50).read_stream(spark), new_folder(spark, "checkpoint")
    )
    log._progress.append('{"a":1}')
    with pytest.raises(Exception, match="no_such_format"):
        run_until_stopped(spark, query, log, Endpoint("no_such_format"), flush_seconds=0.2)
    assert not query.isActive
    assert log.pending >= 1


def test_a_missing_last_event_is_an_error(spark, records, log, monkeypatch):
    topic, output = _topic_of(spark, records), _output(spark)
    progress_topic = files(new_folder(spark, "progress"), schema="key string, value string")
    query = scoring.start_stream(
        spark, topic, output, new_folder(spark, "checkpoint"), trigger=AVAILABLE_NOW
    )
    monkeypatch.setattr(log, "wait_ended", lambda query: False)
    with pytest.raises(TimeoutError):
        run_until_stopped(spark, query, log, progress_topic)


def test_progress_names_a_topic_and_all_others(spark, log):
    offsets = {"payments": {"0": 4, "3": 9}}
    log._progress.append(json.dumps({"sources": [{"latestOffset": offsets}, {"latestOffset": None}]}))
    sink = files(new_folder(spark, "progress"), schema="key string, value string")
    log.flush(spark, sink, "payments", 3)
    written = next(m for m in map(json.loads, (r.value for r in sink.read(spark).collect()))
                   if "latestOffsets" in m)
    assert written["latestOffset"] == {"latestOffset": 9}
    assert written["latestOffsets"] == [offsets, None]


def test_many_notes_are_written_in_parts(spark, log, monkeypatch):
    monkeypatch.setattr(observe, "WRITE_MESSAGES", 3)
    log._progress.extend(f'{{"a":{k}}}' for k in range(8))
    sink = files(new_folder(spark, "progress"), schema="key string, value string")
    assert log.flush(spark, sink, topic=None) >= 8
    got = [json.loads(r.value) for r in sink.read(spark).collect()]
    assert sorted(m["a"] for m in got if "a" in m) == list(range(8))


def test_k5_messages_of_a_failed_write_are_kept(spark, log):
    log._progress.extend(['{"a":1}', '{"a":2}'])
    with pytest.raises(Exception, match="no_such_format"):
        log.flush(spark, Endpoint("no_such_format"))
    log._progress.append('{"a":3}')
    sink = files(new_folder(spark, "progress"), schema="key string, value string")
    assert log.flush(spark, sink) >= 3
    written = [json.loads(r.value) for r in sink.read(spark).collect()]
    assert sorted(m["a"] for m in written if "a" in m) == [1, 2, 3]


def test_t6_recent_progress_of_file_and_rate_streams(spark, records):
    topic = _topic_of(spark, records, parts=2)
    query = scoring.start_stream(
        spark, topic, Endpoint("noop"), new_folder(spark, "checkpoint"), trigger=AVAILABLE_NOW
    )
    query.awaitTermination()
    lags = input_lag(progress_messages(spark, query)).collect()
    assert lags and all(r.topic is None and r.lag is None for r in lags)
    assert {r.end_offset for r in lags} >= {0, 1}

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    query = Endpoint("noop").write_stream(ticks, new_folder(spark, "checkpoint"))
    try:
        for _ in range(40):
            query.awaitTermination(0.25)
            if len([p for p in query.recentProgress if p.numInputRows]) >= 2:
                break
    finally:
        query.stop()
    lags = input_lag(progress_messages(spark, query)).collect()
    assert any(r.lag is not None for r in lags)
    assert all(r.lag is None or r.lag >= 0 for r in lags)


def test_lag_job(spark, records):
    topic = _topic_of(spark, records)
    progress = files(new_folder(spark, "progress"), schema="value string")
    end = {"input": {"0": 100, "1": 250, "2": 0, "3": 260}}
    progress.write(
        literal_rows(
            spark, [json.dumps({"id": "q", "batchId": 0, "sources": [{"endOffset": end}]})]
        )
    )
    sink = files(new_folder(spark, "lag"), schema=None)
    reporting.write_lag(spark, progress, sink, topic, now=True)
    got = bag(sink.read(spark), ["partition", "end_offset", "latest_offset", "lag"])
    assert got == {
        (0, 100, 250, 150): 1, (1, 250, 250, 0): 1, (2, 0, 250, 250): 1, (3, 260, 250, 0): 1,
    }


def test_lag_over_a_stream_of_progress(spark, records):
    progress = files(new_folder(spark, "progress"), schema="value string")
    progress.write(
        literal_rows(
            spark,
            [json.dumps({"id": "q", "batchId": b,
                         "sources": [{"endOffset": {"input": {"0": b * 50}}}]}) for b in range(5)],
        )
    )
    sink = files(new_folder(spark, "lag"), schema=None)
    lags = input_lag(progress.read_stream(spark), latest_offsets(records))
    query = sink.write_stream(lags, new_folder(spark, "checkpoint"), AVAILABLE_NOW)
    query.awaitTermination()
    got = sink.read(spark).select("batchId", "lag").orderBy("batchId").collect()
    assert [tuple(r) for r in got] == [(0, 250), (1, 200), (2, 150), (3, 100), (4, 50)]


def test_records_keep_their_offsets_per_partition(records):
    spans = records.groupBy("topic", "partition").agg(
        F.min("offset"), F.max("offset"), F.count("*"), F.count_distinct("offset")
    )
    assert bag(spans) == {("input", p, 0, 249, 250, 250): 1 for p in range(4)}
