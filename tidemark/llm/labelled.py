"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Labelled rows that a classifier is fitted on at most, taken in the order of a hash.
SAMPLE_ROWS = 16_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    *,
    folds: int,
    held_out: int,
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``text, label`` (0 or 1) of at most about ``rows`` labelled documents, stored.

    Leaves out the fold ``held_out``, and ids whose labels are null or contradict each
    other. The ids are chosen before the texts are read; they are at most ``rows``, so
    they can be broadcast whatever the size of the tables.
    """
    agreed = (
        labels.filter((fold(F.col("doc_id"), folds) != held_out) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_high"))
        .filter(F.col("label") == F.col("_high"))
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Documents repeat where their ids do; one row an id is enough.
    return stored(
        texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
        .groupBy("doc_id")
        .agg(F.max_by("text", F.length("text")).alias("text"), F.first("label").alias("label"))
        .select("text", "label"),
        "labelled",
    )
