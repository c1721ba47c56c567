"""Endpoints for tables and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import bag
from tidemark.operators.detect import flag
from tidemark.operators.messages import decode_csv, decode_json, keyed
from tidemark.operators.synth import synth_transactions
from tidemark.plans import feeding
from tidemark.plans.workspace import new_folder
from tidemark.schema import ENVELOPE_SCHEMA, TRANSACTION_COLUMNS
from tidemark.sources.endpoint import (
    Endpoint,
    files,
    kafka_sink,
    kafka_source,
    literal_rows,
    paced,
)
from tidemark.sources.events import envelope, table, transactions


def test_s1_s3_kafka_source_options():
    source = kafka_source("a:9092,b:9092", failOnDataLoss=False)
    assert source.format == "kafka"
    assert dict(source.options) == {
        "kafka.bootstrap.servers": "a:9092,b:9092",
        "subscribe": "input",
        "failOnDataLoss": "false",
    }
    assert dict(source.stream_options) == {
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "10000",
    }


def test_s3_rate_limit_can_be_lifted():
    source = kafka_source("a:9092", "t", "earliest", max_offsets_per_trigger=None)
    assert dict(source.stream_options) == {"startingOffsets": "earliest"}


def test_k1_kafka_sink_options():
    sink = kafka_sink("a:9092", includeHeaders=True)
    assert dict(sink.options) == {
        "kafka.bootstrap.servers": "a:9092",
        "topic": "output",
        "includeHeaders": "true",
    }


def test_s4_literal_rows(spark):
    rows = literal_rows(spark, ["a", None])
    assert rows.schema.simpleString() == "struct<value:string>"
    assert [r.value for r in rows.collect()] == ["a", None]


def test_k3_batch_write_and_read(spark, data_dir):
    topic = files(new_folder(spark, "topic"))
    records = envelope(table(spark, data_dir, "events"))
    topic.write(records)
    topic.write(records.limit(3))
    back = topic.read(spark)
    assert back.schema == ENVELOPE_SCHEMA
    assert back.count() == 1003


@pytest.mark.parametrize("format", ["json", "orc", "csv"])
def test_k3_other_file_formats(spark, format):
    topic = files(new_folder(spark, "topic"), format, "key string, value string", sep="\t")
    messages = feeding.feed_messages(synth_transactions(spark.range(50)))
    topic.write(messages)
    assert bag(topic.read(spark)) == bag(messages)


def test_k3_text_lines(spark):
    lines = files(new_folder(spark, "lines"), "text", "value string")
    transactions = synth_transactions(spark.range(50))
    lines.write(feeding.feed_messages(transactions, "csv", key=None))
    assert bag(decode_csv(lines.read(spark))) == bag(transactions)


def test_partitioned_output_prunes(spark):
    folder = new_folder(spark, "curated")
    sink = files(folder, schema=None, partition_by=["city"])
    sink.write(flag(synth_transactions(spark.range(400))))
    cardiff = sink.read(spark).filter(F.col("city") == "Cardiff")
    assert 0 < len(cardiff.inputFiles())
    scan = cardiff._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in scan
    assert cardiff.filter(~F.col("zip").startswith("CF")).count() == 0


def test_k4_keys(spark):
    transactions = synth_transactions(spark.range(20))
    by_card = feeding.feed_messages(transactions)
    assert bag(by_card.select("key")) == bag(transactions.select("card_num"))
    constant = feeding.feed_messages(transactions, "csv", feeding.constant_key())
    assert bag(constant.select("key")) == {("key",): 20}
    assert feeding.feed_messages(transactions, key=None).columns == ["value"]
    assert bag(keyed(literal_rows(spark, ["v"]), F.lit(3))) == {("3", "v"): 1}


def test_k2_checkpoint_is_required(spark):
    ticks = paced(10).read_stream(spark)
    with pytest.raises(ValueError, match="checkpoint"):
        Endpoint("noop").write_stream(ticks, "")
    with pytest.raises(ValueError, match="checkpoint"):
        Endpoint("noop").put(ticks)


def test_t3_put_follows_the_kind_of_rows(spark):
    topic = files(new_folder(spark, "topic"), schema="value string")
    assert topic.put(literal_rows(spark, ["a", "b"])) is None
    sink = files(new_folder(spark, "copy"), schema="value string")
    query = sink.put(
        topic.read_stream(spark), new_folder(spark, "checkpoint"), trigger={"availableNow": True}
    )
    query.awaitTermination()
    assert bag(sink.read(spark)) == {("a",): 1, ("b",): 1}


def test_s7_paced_transactions(spark):
    sink = files(new_folder(spark, "paced"), schema="key string, value string")
    query = feeding.start_stream(spark, sink, new_folder(spark, "checkpoint"), 200)
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            if query.lastProgress and sum(p.numInputRows for p in query.recentProgress) >= 200:
                break
    finally:
        query.stop()
    made = decode_json(sink.read(spark)).collect()
    assert len(made) >= 200
    # Apart from the time, the rows are those of a table with the same ids.
    known = [c for c in TRANSACTION_COLUMNS if c != "trans_time"]
    expected = bag(synth_transactions(spark.range(len(made))), known)
    assert {tuple(r[c] for c in known) for r in made} == set(expected)
    times = sorted(int(r.trans_time) for r in made)
    assert times[-1] - times[0] >= 900


def test_s7_offered_rate():
    assert feeding.offered_rate() == 500
    assert feeding.offered_rate("#load\nconcurrency=90\n\nthrottle=3") == 30
    assert feeding.offered_rate("concurrency=1") == 1


def test_new_folder_is_below_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = new_folder(spark, "x"), new_folder(spark, "x")
    assert first != second
    assert first.startswith(base) and second.startswith(base)


def test_new_folder_needs_a_shared_one_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_folder(Session(), "x")
    Session.sparkContext.master = "local[4]"
    assert "tidemark" in new_folder(Session(), "x")


def test_ids_of_any_length_stay_apart(spark):
    ids = [7, 1_234_567_890, 1_234_567_891, 9_223_372_036_854_775_806]
    events = spark.createDataFrame(
        [(i, i, "view", 1.0, '{"k": %d}' % (i % 10**7)) for i in ids],
        "event_id bigint, user_id bigint, event_type string, value double, props string",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = transactions(events).collect()
    assert [r.unique_transact_id for r in rows] == [
        "000000007", "1234567890", "1234567891", "9223372036854775806"
    ]
    assert rows[3].card_num == "9223372036854775806"
    assert [r.merchant_key for r in rows] == ["0007", "4567890", "4567891", "4775806"]
    wide = rows[1].asDict()
    assert wide["mcc_desc"] == "7890"
    assert wide["city"] == ("London", "Manchester", "Cardiff")[1_234_567_890 % 3]
    assert wide["chrgbck_amt"] == "0.25"
