"""Offsets, merged progress messages and input lag."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.helpers import bag, plan
from tidemark.functions.offsets import all_reported, reported_latest
from tidemark.operators.progress import (
    input_lag,
    latest_offsets,
    offsets_by_time,
    offsets_json,
    progress_rows,
    with_latest_offset,
)
from tidemark.plans import reporting
from tidemark.sources.endpoint import literal_rows


def _progress(batch, end, latest=None, **more):
    source = {"description": "s", "startOffset": None, "endOffset": end, "latestOffset": latest}
    return json.dumps({"id": "q", "runId": "r", "batchId": batch, "sources": [source], **more})


def test_s6_latest_offsets_against_brute_force(spark):
    rng = random.Random(3)
    records = []
    for topic, partition, count in [("a", 0, 900), ("a", 1, 30), ("b", 0, 1), ("b", 3, 69)]:
        records += [(topic, partition, o) for o in range(count) if rng.random() < 0.6]
    rng.shuffle(records)
    envelope = spark.createDataFrame(records, "topic string, partition int, offset bigint")
    got = bag(latest_offsets(envelope.repartition(5)))
    expected = {}
    for topic, partition, offset in records:
        expected[topic, partition] = max(expected.get((topic, partition), 0), offset + 1)
    assert got == {(*key, n): 1 for key, n in expected.items()}


def test_p8_adds_the_field_and_keeps_the_rest(spark):
    message = '{"id":"x","batchId":3,"deep":{"a":[1,null,"t"]},"nothing":null}'
    merged = with_latest_offset(literal_rows(spark, [message]), F.lit(77)).first().value
    assert json.loads(merged) == {**json.loads(message), "latestOffset": {"latestOffset": 77}}
    assert list(json.loads(merged)) == ["id", "batchId", "deep", "nothing", "latestOffset"]


@pytest.mark.parametrize(
    ("message", "rest"),
    [
        ('{"latestOffset":1,"a":2.0}', '{"a":2.0,'),
        ('{"a":2.0,"latestOffset":{"latestOffset":4}}', '{"a":2.0,'),
        ('{"b":{"latestOffset":3}, "latestOffset":"x}","a":[1, 2]}', '{"b":{"latestOffset":3},"a":[1, 2],'),
        ('{"latestOffset":null}', "{"),
        ('{"b":{"latestOffset":3}}', '{"b":{"latestOffset":3},'),
        (" { } ", " {"),
        ('{"b":200.0,"z":1e5,"a":1234567890123456789012345678901234567890,"c":{"y":1,"x":"\\u00e9}"}}\n',
         '{"b":200.0,"z":1e5,"a":1234567890123456789012345678901234567890,"c":{"y":1,"x":"\\u00e9}"},'),
    ],
)
def test_p8_leaves_the_text_of_other_fields(spark, message, rest):
    merged = with_latest_offset(literal_rows(spark, [message]), F.lit(5)).first().value
    assert merged == rest + '"latestOffset":{"latestOffset":5}}'


@pytest.mark.parametrize(
    "message",
    ["not json", "[1]", "3", "", None, '{"a":1', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}',
     '{"a":1} {"b":2}', '{"a":1} x', '{"latestOffset":[1]}'],
)
def test_p8_keeps_what_it_cannot_merge(spark, message):
    assert with_latest_offset(literal_rows(spark, [message]), F.lit(5)).first().value == message


def test_p8_unknown_offset_leaves_the_message(spark):
    merged = with_latest_offset(literal_rows(spark, ['{"a":1}', "{}"]), F.lit(None))
    assert [r.value for r in merged.collect()] == ['{"a":1}', "{}"]


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**30), 10**30)
    | st.floats(allow_nan=False, allow_infinity=False)
    | st.text(st.characters(codec="utf-8", exclude_categories=["Cc"]), max_size=5),
    lambda inner: st.lists(inner, max_size=3)
    | st.dictionaries(st.sampled_from("abc"), inner, max_size=3),
    max_leaves=8,
)
NAMES = st.sampled_from(["id", "sources", "a b", "z", "\u00e9"])


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
@given(objects=st.lists(st.dictionaries(NAMES, VALUES, max_size=4), min_size=1, max_size=20))
def test_p8_merges_any_object(spark, objects):
    messages = literal_rows(spark, [json.dumps(o) for o in objects])
    merged = with_latest_offset(messages, F.lit(9)).collect()
    for before, after in zip(objects, merged, strict=True):
        assert json.loads(after.value) == {**before, "latestOffset": {"latestOffset": 9}}


def test_progress_as_bytes(spark):
    text = literal_rows(spark, [_progress(1, {"a": {"0": 10}}, {"a": {"0": 12}}), "x", None])
    as_bytes = text.select(F.col("value").cast("binary").alias("value"))
    assert bag(input_lag(as_bytes)) == bag(input_lag(text))
    assert bag(with_latest_offset(as_bytes, F.lit(3))) == bag(with_latest_offset(text, F.lit(3)))


def test_t6_typed_progress(spark):
    message = _progress(4, 9, numInputRows=12, durationMs={"addBatch": 3}, unknown=[1])
    row = progress_rows(literal_rows(spark, [message])).first()
    assert (row.id, row.runId, row.batchId, row.numInputRows) == ("q", "r", 4, 12)
    assert row.durationMs == {"addBatch": 3}
    assert (row.sources[0].endOffset, row.sources[0].latestOffset) == ("9", None)


def _lags(rows):
    return sorted(
        (r.batchId, r.topic, r.partition, r.end_offset, r.latest_offset, r.lag)
        for r in rows.collect()
    )


def test_t7_kafka_offsets_with_their_own_latest(spark):
    message = _progress(
        1, {"a": {"0": 10, "1": 20}, "b.c": {"0": 5}}, {"a": {"0": 15, "1": 20}, "b.c": {"0": 4}}
    )
    assert _lags(input_lag(literal_rows(spark, [message]))) == [
        (1, "a", 0, 10, 15, 5),
        (1, "a", 1, 20, 20, 0),
        (1, "b.c", 0, 5, 4, 0),
    ]


def test_t7_kafka_offsets_with_a_probe(spark):
    messages = [_progress(0, {"a": {"0": 10, "1": 20}}), _progress(1, {"a": {"0": 25, "9": 1}})]
    latest = spark.createDataFrame(
        [("a", 0, 30), ("a", 1, 20), ("b", 0, 99)],
        "topic string, partition int, latest_offset bigint",
    )
    lags = input_lag(literal_rows(spark, messages), latest).orderBy("batchId", "partition")
    assert [tuple(r)[2:] for r in lags.collect()] == [
        (0, 0, "a", 0, 10, 30, 20),
        (0, 0, "a", 1, 20, 20, 0),
        (1, 0, "a", 0, 25, 30, 5),
        (1, 0, "a", 9, 1, None, None),
    ]


def test_t7_reported_latest_counts_before_the_probe(spark):
    message = _progress(1, {"a": {"0": 10}}, {"a": {"0": 12}})
    latest = spark.createDataFrame(
        [("a", 0, 30)], "topic string, partition int, latest_offset bigint"
    )
    assert _lags(input_lag(literal_rows(spark, [message]), latest)) == [(1, "a", 0, 10, 12, 2)]


def test_t7_rate_and_file_offsets(spark):
    messages = [_progress(0, 5, 7), _progress(1, {"logOffset": 3}), _progress(2, None)]
    lags = input_lag(literal_rows(spark, messages)).orderBy("batchId")
    assert [tuple(r)[2:] for r in lags.collect()] == [
        (0, 0, None, None, 5, 7, 2),
        (1, 0, None, None, 3, None, None),
        (2, 0, None, None, None, None, None),
    ]


def test_t7_several_sources_and_none(spark):
    two = json.dumps(
        {"id": "q", "batchId": 1, "sources": [{"endOffset": 1, "latestOffset": 4},
                                              {"endOffset": {"t": {"0": 2}}}]}
    )
    none = json.dumps({"id": "q", "batchId": 2, "sources": []})
    lags = input_lag(literal_rows(spark, [two, none])).orderBy("batchId", "source")
    assert [(r.batchId, r.source, r.topic, r.lag) for r in lags.collect()] == [
        (1, 0, None, 3),
        (1, 1, "t", None),
        (2, None, None, None),
    ]


def test_t7_many_events_on_one_partition_against_brute_force(spark):
    rng = random.Random(5)
    ends = [(b, {"hot": {"0": b * 10}, **({"cold": {"1": b}} if b % 7 == 0 else {})})
            for b in range(600)]
    latest = {("hot", 0): 4000, ("cold", 1): 300}
    messages = [_progress(b, end) for b, end in ends]
    rng.shuffle(messages)
    probe = spark.createDataFrame(
        [(*key, n) for key, n in latest.items()],
        "topic string, partition int, latest_offset bigint",
    )
    expected = sorted(
        (b, topic, int(part), at, latest[topic, int(part)],
         max(latest[topic, int(part)] - at, 0))
        for b, end in ends for topic, parts in end.items() for part, at in parts.items()
    )
    for threshold in ("10485760", "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert _lags(input_lag(literal_rows(spark, messages), probe)) == expected
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_t7_hot_partition_is_split_without_adaptive_execution(spark):
    messages = literal_rows(spark, [_progress(b, {"hot": {"0": b}}) for b in range(4000)])
    probe = spark.createDataFrame(
        [("hot", 0, 5000)], "topic string, partition int, latest_offset bigint"
    )
    settings_for_test = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {name: spark.conf.get(name) for name in settings_for_test}
    for name, setting in settings_for_test.items():
        spark.conf.set(name, setting)
    try:
        lags = input_lag(messages.repartition(4), probe)
        sizes = [
            r["count"] for r in lags.groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
    finally:
        for name, setting in before.items():
            spark.conf.set(name, setting)
    assert sum(sizes) == 4000
    assert len(sizes) >= 8 and max(sizes) <= 4000 / 4


def test_reported_latest(spark):
    sources = [{"latestOffset": {"other": {"0": 3}}}, {"latestOffset": {"input": {"0": 8}}}]
    messages = literal_rows(
        spark,
        [
            _progress(0, 1, {"input": {"0": 8, "1": 9}}),
            _progress(0, 1, 6),
            _progress(0, 1),
            "x",
            json.dumps({"sources": sources}),
        ],
    )
    got = messages.select(reported_latest(F.col("value"), "input", 0)).collect()
    assert [r[0] for r in got] == [8, 6, None, None, 8]
    other = messages.select(reported_latest(F.col("value"), "other", 0)).collect()
    assert other[-1][0] == 3
    listed = [r[0] and json.loads(r[0]) for r in messages.select(all_reported(F.col("value"))).collect()]
    assert listed == [
        [{"input": {"0": 8, "1": 9}}], [6], None, None, [{"other": {"0": 3}}, {"input": {"0": 8}}]
    ]


def test_offsets_json(spark):
    rows = [("b", 10, 4), ("b", 2, 5), ('a"\\', 0, 7)]
    latest = spark.createDataFrame(rows, "topic string, partition int, latest_offset bigint")
    text = offsets_json(latest).first().offsets
    assert json.loads(text) == {"b": {"2": 5, "10": 4}, 'a"\\': {"0": 7}}


def test_lag_as_of_the_events_time(spark):
    def at(seconds):
        return f"2024-05-0{1 + seconds // 86400}T{seconds // 3600 % 24:02}:{seconds // 60 % 60:02}:{seconds % 60:02}Z"

    rng = random.Random(11)
    records = [(p, o, rng.randrange(170_000)) for p in (0, 1) for o in range(300)]
    envelope = spark.createDataFrame(
        [("t", p, o, at(s)) for p, o, s in records],
        "topic string, partition int, offset bigint, at string",
    ).withColumn("timestamp", F.col("at").cast("timestamp"))
    times = [rng.randrange(170_000) for _ in range(40)]
    messages = literal_rows(
        spark, [_progress(k, {"t": {"0": 5, "1": 150}}, timestamp=at(s)) for k, s in enumerate(times)]
    )
    rows = input_lag(messages, offsets_by_time(envelope)).collect()
    assert len(rows) == 80
    for r in rows:
        seen = [o for p, o, s in records if p == r.partition and s <= times[r.batchId]]
        latest = max(seen, default=None)
        assert r.latest_offset == (None if latest is None else latest + 1)
        assert r.lag == (None if latest is None else max(0, latest + 1 - r.end_offset))


def test_each_partition_is_read_from_its_own_end(spark):
    """An idle partition doesn't make the others be read again."""
    rows = [("t", p, o) for p, n in ((0, 5), (1, 1000), (2, 40)) for o in range(n)] + [("u", 0, 3), (None, 1, 2)]
    records = spark.createDataFrame(rows, "topic string, `partition` int, offset long")
    ends = [Row(topic="t", partition=0, end=5), Row(topic="t", partition=1, end=990)]
    got = reporting.from_ends(records, ends)
    # A record before each end, all of what isn't known.
    assert bag(got) == bag(records.filter("topic IS NULL OR topic = 'u' OR `partition` = 2 OR offset >= 989 OR (`partition` = 0 AND offset = 4)"))
    shown = plan(got)
    assert "4" in shown
    assert "989" in shown
    assert bag(reporting.from_ends(records, [])) == bag(records)


def test_newest_ends(spark):
    def event(batch, ends):
        return json.dumps({"id": "a", "runId": "b", "batchId": batch, "timestamp": "2024-01-01T00:00:00.000Z",
                           "sources": [{"endOffset": {"t": ends}}, {"endOffset": None}]})

    progress = spark.createDataFrame([(event(0, {"0": 5, "1": 7}),), (event(1, {"0": 6}),)], "value string")
    got = {(r.topic, r.partition): r.end for r in reporting.newest_ends(progress)}
    assert got == {("t", 0): 6, ("t", 1): 7}
    assert len(reporting.newest_ends(progress, 1)) == 1
