"""The end of a stored topic from the statistics of its files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.progress import latest_offsets
from tidemark.sources.endpoint import Endpoint

#: What a stored topic is partitioned by, so that its files' footers tell the offsets.
TOPIC_FOLDERS = ("topic", "partition")
_V1_SOURCES = "spark.sql.sources.useV1SourceList"


def has_footers(endpoint: Endpoint) -> bool:
    """Whether a topic's end can be told from footers."""
    return endpoint.format == "parquet" and tuple(endpoint.partition_by) == TOPIC_FOLDERS


def stored_ends(spark: SparkSession, topic: Endpoint) -> DataFrame:
    """:func:`latest_offsets` of a topic stored in folders of ``TOPIC_FOLDERS``, no row read.

    Spark takes each file's largest offset from its footer, so the cost grows with the
    number of files only. The settings for that belong to a session of its own, which
    shares the context; the caller's stays as it is. Spark finds the column by its place, so
    all files must have their columns in one order, as one job's files have. A
    folder without files has no ends; files without statistics are an error.
    """
    if not has_footers(topic):
        raise ValueError(f"a topic's footers need Parquet partitioned by {', '.join(TOPIC_FOLDERS)}")
    own = spark.newSession()
    others = [s for s in own.conf.get(_V1_SOURCES).split(",") if s.strip() != "parquet"]
    own.conf.set(_V1_SOURCES, ",".join(others))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    # Folder names are texts, also those of topics that look like numbers.
    own.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        # No schema from outside: its order could differ from that of the files.
        records = own.read.format("parquet").options(**topic.options).load()
    except AnalysisException as refused:
        if refused.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], "topic string, `partition` int, latest_offset bigint")
    ends = latest_offsets(records)
    return ends.withColumn("partition", F.col("partition").cast("int"))
