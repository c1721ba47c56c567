"""The corpus pipeline: filters, near-dedup, decontamination and packing, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``docs`` as they came, whatever their names; the last returns one row per packed piece. Empty
tables give empty results; rows with null or empty texts pass the filters, since nothing
speaks against them but the quality score of a text without words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import queries, quality, toxicity
from tidemark.llm.common import stored, table
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.near_dedup import without_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: SQL can't express the fitted classifiers.
ORACLE_SQL = None


def _with_own_columns(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose other columns can't clash with what it adds."""
    aside = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = work(docs.toDF(*(aside.get(c, c) for c in docs.columns)))
    return done.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = toxicity.toxicity_score(model, F.col("text"))
    return docs.filter(score < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = quality.quality_score(model, F.col("text"))
    return docs.filter(score >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, from 80 percent on."""
    return _with_own_columns(docs, without_near_duplicates)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _with_own_columns(
        docs, lambda own: find_contamination(own, benchmark).filter("NOT contaminated")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece of a document."""
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
