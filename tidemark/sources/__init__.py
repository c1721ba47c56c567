"""Where records come from and go to."""

from tidemark.sources.endpoint import (
    INPUT_TOPIC,
    OUTPUT_TOPIC,
    PROGRESS_TOPIC,
    Endpoint,
    files,
    kafka_sink,
    kafka_source,
    literal_rows,
    paced,
)

__all__ = [
    "INPUT_TOPIC",
    "OUTPUT_TOPIC",
    "PROGRESS_TOPIC",
    "Endpoint",
    "files",
    "kafka_sink",
    "kafka_source",
    "literal_rows",
    "paced",
]
