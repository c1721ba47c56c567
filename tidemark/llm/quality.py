"""Operator 2, quality classifier: an additive model over dense text features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidemark.llm.additive_model import AdditiveModel, fit
from tidemark.llm.common import arrow_map, prepare_workers
from tidemark.llm.labelled import SAMPLE_ROWS, fold, training_sample
from tidemark.llm.text_features import QUALITY_FEATURES, quality_features

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS
) -> AdditiveModel:
    """The model of at most ``sample_rows`` labelled documents outside the held-out fold.

    Tasks compute the features; the driver gets that many short rows and no text. Without
    rows of both labels the model gives every text the same score.
    """
    sample = training_sample(
        docs, labels, "quality", folds=FOLDS, held_out=HELD_OUT, rows=sample_rows
    )

    def features(batch: pa.RecordBatch) -> dict[str, list]:
        texts, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        return {"features": [quality_features(t) for t in texts], "label": given}

    schema = StructType.fromDDL("features array<double>, label int")
    # In a fixed order, so that a fit can be repeated.
    rows = sorted(map(tuple, arrow_map(sample, features, schema).collect()))
    matrix = np.array([r[0] for r in rows], float).reshape(len(rows), len(QUALITY_FEATURES))
    return fit(matrix, np.array([r[1] for r in rows], float))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """The score (0 to 1) of each whole text; null counts as empty."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([quality_features(t) for t in texts], float)
        return pd.Series(model.score(rows.reshape(len(texts), len(QUALITY_FEATURES))))

    return score(F.coalesce(text, F.lit("")))


def score_quality(
    docs: DataFrame, model: AdditiveModel, *, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` plus ``held_out, score, predicted``, from each whole ``text`` alone.

    ``score`` (0 to 1) is higher the likelier label 1 is; ``predicted`` is 1 from
    ``threshold`` on. Null and empty texts are scored alike, by features that are all 0.
    ``held_out`` marks the fold that is never learned from, false for a null id. Columns
    called like the added ones are replaced; other columns and repeated rows stay.
    """
    prepare_workers(docs.sparkSession)
    scored = docs.withColumn("score", quality_score(model, F.col("text")))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.withColumns({"held_out": held, "predicted": predicted})
