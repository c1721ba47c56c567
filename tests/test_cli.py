"""The jobs from the command line."""

from __future__ import annotations

import json

import pytest

from tests.helpers import bag
from tidemark.__main__ import _parser, _source, main
from tidemark.operators.messages import decode_csv, decode_scored
from tidemark.operators.synth import synth_transactions
from tidemark.plans.scoring import score
from tidemark.plans.workspace import new_folder


def _files(name, folder):
    return [f"--{name}", "parquet", f"--{name}-option", f"path={folder}"]


def test_feed_score_points_and_lag(spark):
    fed, scored, points, progress, lag = (
        new_folder(spark, n) for n in ("fed", "scored", "points", "progress", "lag")
    )
    main(["feed", *_files("sink", fed), "--rows", "300", "--wire", "csv"])
    messages = spark.read.parquet(fed)
    assert bag(decode_csv(messages)) == bag(synth_transactions(spark.range(300)))

    main(
        ["score", *_files("source", fed), *_files("sink", scored), *_files("progress", progress),
         "--wire", "csv", "--checkpoint", new_folder(spark, "checkpoint"), "--available-now"]
    )
    expected = bag(score(messages, wire="csv"))
    assert bag(decode_scored(spark.read.parquet(scored))) == expected

    again = new_folder(spark, "scored")
    main(["score", *_files("source", fed), *_files("sink", again), "--wire", "csv"])
    assert bag(decode_scored(spark.read.parquet(again))) == expected

    main(["points", *_files("source", scored), *_files("sink", points)])
    drawn = [json.loads(r.value) for r in spark.read.parquet(points).collect()]
    assert len(drawn) == 300 and all(len(p["x"]) == len(p["y"]) == 1 for p in drawn)

    main(["lag", *_files("progress", progress), *_files("sink", lag)])
    assert spark.read.parquet(lag).count() >= 1


def test_feed_with_properties(spark, tmp_path):
    properties = tmp_path / "feed.properties"
    properties.write_text("#lists\ncardTypeList=gold,silver\n")
    fed = new_folder(spark, "fed")
    main(["feed", *_files("sink", fed), "--rows", "100", "--wire", "csv",
          "--properties", str(properties)])
    cards = decode_csv(spark.read.parquet(fed)).select("card_type")
    assert {r[0] for r in cards.collect()} == {"gold", "silver"}


def test_score_with_a_schema_events_and_a_stream_of_points(spark):
    fed, scored, points, progress, events = (
        new_folder(spark, n) for n in ("fed", "scored", "points", "progress", "events")
    )
    main(["feed", *_files("sink", fed), "--rows", "50"])
    main(
        ["score", *_files("source", fed), *_files("sink", scored), *_files("progress", progress),
         *_files("events", events), *_files("spill", events), "--topic", "t", "--partition", "2",
         "--schema", "trans_time string, trans_amt string",
         "--checkpoint", new_folder(spark, "checkpoint"), "--available-now"]
    )
    kept = [json.loads(r.value) for r in spark.read.parquet(scored).collect()]
    assert {frozenset(m) for m in kept} == {
        frozenset(("trans_time", "trans_amt", "Upper_Warning", "Upper_Action"))
    }
    noted = [json.loads(r.value)["event"] for r in spark.read.parquet(events).collect()]
    assert sorted(set(noted)) == ["started", "terminated"]
    main(["points", *_files("source", scored), *_files("sink", points),
          "--checkpoint", new_folder(spark, "checkpoint"), "--available-now"])
    assert spark.read.parquet(points).count() == 50


def test_sources_that_are_no_files_bring_their_schema(spark):
    out = new_folder(spark, "scored")
    main(["score", "--source", "rate", "--source-option", "rowsPerSecond=5",
          *_files("sink", out), "--checkpoint", new_folder(spark, "checkpoint"),
          "--available-now"])


def test_lag_now_and_as_of(spark):
    topic, progress = new_folder(spark, "topic"), new_folder(spark, "progress")
    rows = [("input", 0, k, f"2024-01-01 00:00:{k:02}") for k in range(20)]
    given = spark.createDataFrame(rows, "topic string, partition int, offset bigint, at string")
    given.withColumn("timestamp", given["at"].cast("timestamp")).write.parquet(topic)
    message = {"timestamp": "2024-01-01T00:00:09Z", "batchId": 1,
               "sources": [{"endOffset": {"input": {"0": 6}}}]}
    spark.createDataFrame([(json.dumps(message),)], "value string").write.parquet(progress)
    for more, lag in ((["--now", "--salts", "3"], 14), ([], 4)):
        out = new_folder(spark, "lag")
        main(["lag", *_files("progress", progress), *_files("topic", topic), *_files("sink", out), *more])
        assert [r.lag for r in spark.read.parquet(out).collect()] == [lag]


def test_kafka_streams_start_at_the_end_and_are_limited():
    def source(*options):
        given = [x for o in options for x in ("--source-option", o)]
        argv = ["score", "--source", "kafka", *given, "--sink", "noop", "--checkpoint", "x"]
        return _source(_parser().parse_args(argv), "value string")

    plain = source("kafka.bootstrap.servers=a:1", "subscribe=payments")
    assert plain.options == {"kafka.bootstrap.servers": "a:1", "subscribe": "payments"}
    assert plain.stream_options == {"startingOffsets": "latest", "maxOffsetsPerTrigger": "10000"}
    other = source("startingOffsets=earliest", "maxOffsetsPerTrigger=7", "failOnDataLoss=false")
    assert other.stream_options == {"startingOffsets": "earliest", "maxOffsetsPerTrigger": "7"}
    assert other.options["failOnDataLoss"] == "false"


def test_positions_and_topics_reach_both_readers():
    """A table read starts where it is told to; a limit per trigger is for streams alone."""

    def source(*options, stream=True):
        given = [x for o in options for x in ("--source-option", o)]
        argv = ["score", "--source", "kafka", *given, "--sink", "noop", *(["--checkpoint", "x"] if stream else [])]
        return _source(_parser().parse_args(argv), "value string")

    start = '{"input":{"0":5}}'
    for stream in (False, True):
        found = source(f"startingOffsets={start}", "minPartitions=9", "maxOffsetsPerTrigger=7", stream=stream)
        batch, streaming = ({**found.options, **o} for o in (found.batch_options, found.stream_options))
        assert batch["startingOffsets"] == streaming["startingOffsets"] == start
        assert batch["minPartitions"] == streaming["minPartitions"] == "9"
        assert streaming["maxOffsetsPerTrigger"] == "7"
        assert "maxOffsetsPerTrigger" not in batch
    assert source(stream=False).batch_options == {}
    for name in ("subscribePattern", "assign"):
        found = source(f"{name}=x.*")
        assert found.options[name] == "x.*"
        assert "subscribe" not in found.options
    with pytest.raises(ValueError, match="one of"):
        source("subscribe=a", "subscribePattern=b")


@pytest.mark.parametrize(
    ("argv", "said"),
    [
        (["--source-option", "startingOffsets=latest"], "reads nothing"),
        (["--checkpoint", "x", "--spill", "noop"], "--progress"),
        (["--schema", "a string", "--wire", "csv"], "JSON"),
    ],
)
def test_arguments_that_make_no_sense(argv, said, capsys):
    with pytest.raises(SystemExit):
        main(["score", "--source", "kafka", "--sink", "noop", *argv])
    assert said in capsys.readouterr().err


@pytest.mark.parametrize(
    "argv",
    [
        ["feed", "--sink", "noop"],
        ["score", "--source", "rate", "--sink", "noop", "--available-now"],
        ["score", "--source", "rate", "--sink", "noop", "--progress", "noop"],
        ["points", "--source", "rate", "--sink", "noop", "--available-now"],
    ],
)
def test_streams_need_a_checkpoint(argv, capsys):
    with pytest.raises(SystemExit):
        main(argv)
    assert "--checkpoint" in capsys.readouterr().err


def test_bad_option_is_refused(capsys):
    with pytest.raises(SystemExit):
        main(["feed", "--sink", "parquet", "--sink-option", "path"])
    assert "name=value" in capsys.readouterr().err
