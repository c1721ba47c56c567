"""One small description of a source or sink for both tables and streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import ENVELOPE_SCHEMA

# Topic names and records per micro-batch.
INPUT_TOPIC = "input"
OUTPUT_TOPIC = "output"
PROGRESS_TOPIC = "test"
MAX_OFFSETS_PER_TRIGGER = 10_000
# The options that select topics.
SELECTIONS = ("subscribe", "subscribePattern", "assign")


@dataclass(frozen=True)
class Endpoint:
    """A Spark format with its options.

    ``stream_options`` apply only to streaming reads, where alone Spark knows
    them, such as rate limits and ``startingOffsets=latest``; ``batch_options`` only to
    reads of a table.
    """

    format: str
    options: Mapping[str, str] = field(default_factory=dict)
    stream_options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | str | None = None
    partition_by: Sequence[str] = ()
    batch_options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        """The data there is now, as a table."""
        reader = spark.read.format(self.format).options(**{**self.options, **self.batch_options})
        return (reader.schema(self.schema) if self.schema else reader).load()

    def read_stream(self, spark: SparkSession) -> DataFrame:
        """The data as it comes, as a stream."""
        reader = spark.readStream.format(self.format).options(
            **{**self.options, **self.stream_options}
        )
        return (reader.schema(self.schema) if self.schema else reader).load()

    def write(self, rows: DataFrame, mode: str = "append") -> None:
        """K3: write a table.

        Rows are dealt out by the folders they go to, so that these get few files; large
        folders are split over several tasks.
        """
        if self.partition_by:
            rows = rows.hint("rebalance", *self.partition_by)
        writer = rows.write.format(self.format).options(**self.options).mode(mode)
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).save()

    def write_stream(
        self,
        rows: DataFrame,
        checkpoint: str,
        trigger: Mapping[str, object] | None = None,
        name: str | None = None,
    ) -> StreamingQuery:
        """K1/K2: start writing a stream; ``checkpoint`` is where a restart resumes from.

        Without a ``trigger`` micro-batches follow each other as fast as they can.
        """
        if not checkpoint:
            raise ValueError("a stream needs a checkpoint folder of its own")
        writer = (
            rows.writeStream.format(self.format)
            .options(**self.options)
            .option("checkpointLocation", checkpoint)
        )
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        if trigger:
            writer = writer.trigger(**trigger)
        if name:
            writer = writer.queryName(name)
        return writer.start()

    def put(
        self, rows: DataFrame, checkpoint: str | None = None, **stream_args: object
    ) -> StreamingQuery | None:
        """Write a table, or start writing a stream, whichever ``rows`` is."""
        if rows.isStreaming:
            return self.write_stream(rows, checkpoint or "", **stream_args)
        self.write(rows)
        return None


def kafka_source(
    servers: str,
    topic: str = INPUT_TOPIC,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = MAX_OFFSETS_PER_TRIGGER,
    **options: object,
) -> Endpoint:
    """Topics as Kafka's envelope rows.

    One topic, or what ``subscribePattern`` or ``assign`` selects in its place. The starting
    position of a stream counts for a new query only; a restarted one goes on from its
    checkpoint. A table read starts there as well, or where the topic does, since the end
    is no place for it to start. Raise the rate limit to what the cluster can take.
    """
    selected = [n for n in SELECTIONS if n in options]
    if len(selected) > 1:
        raise ValueError(f"topics are selected by one of {', '.join(SELECTIONS)}, not by {selected}")
    selection = {} if selected else {"subscribe": topic}
    stream_options = {"startingOffsets": starting_offsets}
    if max_offsets_per_trigger is not None:
        stream_options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return Endpoint(
        "kafka",
        {"kafka.bootstrap.servers": servers, **selection, **_texts(options)},
        stream_options,
        batch_options={} if starting_offsets == "latest" else {"startingOffsets": starting_offsets},
    )


def kafka_sink(servers: str, topic: str = OUTPUT_TOPIC, **options: object) -> Endpoint:
    """K1/K3: a topic that takes ``value`` rows, with or without a ``key``."""
    return Endpoint(
        "kafka", {"kafka.bootstrap.servers": servers, "topic": topic, **_texts(options)}
    )


def files(
    path: str,
    format: str = "parquet",
    schema: T.StructType | str | None = ENVELOPE_SCHEMA,
    max_files_per_trigger: int | None = None,
    partition_by: Sequence[str] = (),
    **options: object,
) -> Endpoint:
    """A folder of files; as a source it stands in for a topic."""
    stream_options = {}
    if max_files_per_trigger is not None:
        stream_options["maxFilesPerTrigger"] = str(max_files_per_trigger)
    return Endpoint(
        format, {"path": path, **_texts(options)}, stream_options, schema, tuple(partition_by)
    )


def paced(rows_per_second: int, **options: object) -> Endpoint:
    """A stream of ``(timestamp, value)`` rows at a steady rate; ``value`` counts up."""
    return Endpoint("rate", {"rowsPerSecond": str(rows_per_second), **_texts(options)})


def literal_rows(spark: SparkSession, values: Sequence[str | None]) -> DataFrame:
    """A handful of messages as a table; for volumes read a source instead."""
    return spark.createDataFrame([(v,) for v in values], "value string")


def _texts(options: Mapping[str, object]) -> dict[str, str]:
    return {
        name: str(value).lower() if isinstance(value, bool) else str(value)
        for name, value in options.items()
    }
