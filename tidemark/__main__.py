"""The jobs from the command line, for ``spark-submit`` or ``python -m tidemark``.

Sources and sinks are given as a format and any of its options, for example

    score --source kafka --source-option kafka.bootstrap.servers=a:9092
          --source-option subscribe=input --source-option startingOffsets=latest
          --sink kafka --sink-option kafka.bootstrap.servers=a:9092
          --sink-option topic=output --checkpoint /shared/score
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from tidemark.operators.progress import LAG_SALTS
from tidemark.operators.synth import SynthConfig
from tidemark.plans import feeding, reporting, scoring
from tidemark.schema import TRANSACTION_SCHEMA
from tidemark.sources.endpoint import INPUT_TOPIC, Endpoint, kafka_source
from tidemark.streaming.observe import ProgressLog
from tidemark.streaming.run import FLUSH_SECONDS, run_until_stopped

# The sources that need a schema given; others bring their own.
FILE_FORMATS = frozenset(("parquet", "orc", "json", "csv", "avro"))
MESSAGE_SCHEMA = "value string"
STARTING = "startingOffsets"
# What a table read doesn't know, or has its own default for.
STREAM_OPTIONS = frozenset((STARTING, "maxOffsetsPerTrigger"))
PARTITIONED_SCHEMA = "topic string, partition int, offset bigint, timestamp timestamp"


def _option(text: str) -> tuple[str, str]:
    name, separator, value = text.partition("=")
    if not separator or not name:
        raise argparse.ArgumentTypeError(f"expected name=value, got {text!r}")
    return name, value


def _add_endpoint(parser: argparse.ArgumentParser, name: str, required: bool = True) -> None:
    parser.add_argument(f"--{name}", required=required, metavar="FORMAT")
    parser.add_argument(
        f"--{name}-option", type=_option, action="append", default=[], metavar="NAME=VALUE"
    )


def _endpoint(args: argparse.Namespace, name: str, schema: str | None = None) -> Endpoint | None:
    format = getattr(args, name)
    if format is None:
        return None
    options = dict(getattr(args, f"{name}_option"))
    return Endpoint(format, options, schema=schema if format in FILE_FORMATS else None)


def _source(args: argparse.Namespace, schema: str) -> Endpoint:
    """The source of a job; a Kafka stream starts and is limited as :func:`kafka_source` says."""
    source = _endpoint(args, "source", schema)
    if source.format != "kafka":
        return source
    options = dict(source.options)
    given = {n: options.pop(n) for n in tuple(options) if n in STREAM_OPTIONS}
    servers = options.pop("kafka.bootstrap.servers", "")
    start = {"starting_offsets": given.pop(STARTING)} if STARTING in given else {}
    defaults = kafka_source(servers, **start, **options)
    return replace(defaults, stream_options={**defaults.stream_options, **given})


def _trigger(args: argparse.Namespace) -> dict[str, object] | None:
    return {"availableNow": True} if args.available_now else None


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    jobs = parser.add_subparsers(dest="job", required=True)

    score = jobs.add_parser("score", help="flag messages of one topic into another")
    _add_endpoint(score, "source")
    _add_endpoint(score, "sink")
    for name in ("progress", "events", "spill"):
        _add_endpoint(score, name, required=False)
    score.add_argument("--topic", help="topic whose latest offset is added to the progress")
    score.add_argument("--partition", type=int, default=0, help="partition of that topic")
    score.add_argument("--schema", help="columns of the JSON messages, all but these are ignored")
    score.add_argument("--wire", choices=sorted(scoring.WIRE_FORMS), default="json")
    score.add_argument("--checkpoint", help="run as a stream that resumes from this folder")
    score.add_argument("--available-now", action="store_true", help="end when caught up")

    feed = jobs.add_parser("feed", help="write synthetic transactions")
    _add_endpoint(feed, "sink")
    feed.add_argument("--wire", choices=sorted(feeding.WIRE_FORMS), default="json")
    feed.add_argument("--rows", type=int, help="write so many rows at once")
    feed.add_argument("--rows-per-second", type=int)
    feed.add_argument("--load-properties", type=Path, help="rate as concurrency and throttle")
    feed.add_argument("--checkpoint", help="folder of the endless stream without --rows")
    feed.add_argument("--properties", type=Path, help="lengths, ranges and lists to draw from")
    feed.add_argument("--seed", type=int, default=42)

    points = jobs.add_parser("points", help="chart points of scored messages")
    _add_endpoint(points, "source")
    _add_endpoint(points, "sink")
    points.add_argument("--checkpoint", help="run as a stream that resumes from this folder")
    points.add_argument("--available-now", action="store_true", help="end when caught up")

    lag = jobs.add_parser("lag", help="input lag at every progress event")
    _add_endpoint(lag, "progress")
    _add_endpoint(lag, "topic", required=False)
    lag.add_argument("--salts", type=int, default=LAG_SALTS, help="parts of a partition's events")
    lag.add_argument("--now", action="store_true", help="lag behind today's end of the topic")
    _add_endpoint(lag, "sink")
    return parser


def _schema(args: argparse.Namespace) -> StructType:
    return StructType.fromDDL(args.schema) if args.schema else TRANSACTION_SCHEMA


def _score(spark: SparkSession, args: argparse.Namespace) -> None:
    source, sink = _source(args, MESSAGE_SCHEMA), _endpoint(args, "sink")
    schema = _schema(args)
    if not args.checkpoint:
        scoring.run_batch(spark, source, sink, wire=args.wire, schema=schema)
        return
    progress_sink = _endpoint(args, "progress")
    log = ProgressLog()
    # Registered with or without a sink: it also logs every event.
    spark.streams.addListener(log)
    try:
        query = scoring.start_stream(
            spark,
            source,
            sink,
            args.checkpoint,
            wire=args.wire,
            trigger=_trigger(args),
            schema=schema,
        )
        if progress_sink:
            run_until_stopped(
                spark,
                query,
                log,
                progress_sink,
                topic=args.topic or source.options.get("subscribe", INPUT_TOPIC),
                partition=args.partition,
                events_sink=_endpoint(args, "events"),
                spill=_endpoint(args, "spill"),
            )
        else:
            while not query.awaitTermination(FLUSH_SECONDS):
                log.take_progress()
    finally:
        spark.streams.removeListener(log)


def _feed(spark: SparkSession, args: argparse.Namespace) -> None:
    sink = _endpoint(args, "sink")
    config = SynthConfig.from_properties(args.properties.read_text()) if args.properties else None
    if args.rows is not None:
        feeding.run_batch(spark, sink, args.rows, args.wire, config, args.seed)
        return
    load = args.load_properties.read_text() if args.load_properties else ""
    rate = args.rows_per_second or feeding.offered_rate(load)
    query = feeding.start_stream(
        spark, sink, args.checkpoint, rate, args.wire, config, args.seed
    )
    query.awaitTermination()


def _points(spark: SparkSession, args: argparse.Namespace) -> None:
    source, sink = _source(args, MESSAGE_SCHEMA), _endpoint(args, "sink")
    query = reporting.write_points(spark, source, sink, args.checkpoint, _trigger(args))
    if query is not None:
        query.awaitTermination()


def _lag(spark: SparkSession, args: argparse.Namespace) -> None:
    reporting.write_lag(
        spark,
        _endpoint(args, "progress", MESSAGE_SCHEMA),
        _endpoint(args, "sink"),
        _endpoint(args, "topic", PARTITIONED_SCHEMA),
        salts=args.salts,
        now=args.now,
    )


_JOBS = {"score": _score, "feed": _feed, "points": _points, "lag": _lag}


def _check(parser: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    if args.job in ("score", "points") and not args.checkpoint:
        if getattr(args, "progress", None) or args.available_now:
            parser.error("--progress and --available-now are for streams, which need --checkpoint")
        if dict(args.source_option).get("startingOffsets") == "latest":
            parser.error("startingOffsets=latest reads nothing without --checkpoint")
    if args.job == "score" and not args.progress and (args.events or args.spill):
        parser.error("--events and --spill go with --progress")
    if args.job == "score" and args.schema and args.wire != "json":
        parser.error("--schema is for JSON messages")


def main(argv: Sequence[str] | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    _check(parser, args)
    if args.job == "feed" and args.rows is None and not args.checkpoint:
        parser.error("give --rows, or --checkpoint for an endless stream")
    spark = SparkSession.builder.appName(f"tidemark-{args.job}").getOrCreate()
    _JOBS[args.job](spark, args)


if __name__ == "__main__":
    main()
