"""Operator 6, toxicity: calibrated boosted trees over dense text features.

The lexicon behind the densities is learned from labelled rows as well: words, and
beginnings of words, that toxic documents hold far oftener. What counts is in how many
different surroundings a word stands, so that copies of one document count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidemark.llm.boosted_trees import CalibratedTrees, fit
from tidemark.llm.common import arrow_map, prepare_workers
from tidemark.llm.labelled import SAMPLE_ROWS, fold, training_sample
from tidemark.llm.text_features import TOXICITY_FEATURES, Lexicon, bare, forms, toxicity_features

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: A lexicon entry stands in so many surroundings, and is so much likelier (log odds) in toxic text.
LEAST_SURROUNDINGS, LEAST_WEIGHT = 5, 2.0
#: Entries of a lexicon, the heaviest of all forms.
ENTRIES = 2_000


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    trees: CalibratedTrees


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of words and beginnings from ``text, label`` rows; the ``ENTRIES`` heaviest.

    Forms are counted under both labels and weighed in one Spark aggregation, so no form
    is left out before its weight is known; only the heaviest reach the driver.
    """
    schema = StructType.fromDDL("form string, toxic long, other long, surrounding long")

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        held: tuple[Counter, Counter] = Counter(), Counter()
        around = set()
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for text, label in zip(texts, labels, strict=True):
            words = ["", *map(bare, text.split()), ""]
            held[label].update({f for w in set(words) if w for f in forms(w)})
            if label:
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    if word:
                        place = _number(f"{before} {after}")
                        around.update((f, place) for f in forms(word))
        rows = [(f, 0, n, None) for f, n in held[0].items()]
        rows += [(f, n, 0, None) for f, n in held[1].items()]
        rows += [(f, 0, 0, place) for f, place in around]
        return {n: [r[k] for r in rows] for k, n in enumerate(schema.names)}

    counts = (
        arrow_map(sample, count, schema)
        .groupBy("form")
        .agg(
            F.sum("toxic").alias("toxic"),
            F.sum("other").alias("other"),
            F.count_distinct("surrounding").alias("places"),
        )
        .withColumn("held", F.least("toxic", "places"))
        .filter(F.col("held") >= LEAST_SURROUNDINGS)
    )
    toxic, other = sample.agg(F.sum("label"), F.count_if(F.col("label") == 0)).first()
    of_toxic = (F.col("held") + 0.5) / F.lit((toxic or 0) + 1)
    of_other = (F.col("other") + 0.5) / F.lit(other + 1)
    weighed = counts.select("form", (F.log(of_toxic) - F.log(of_other)).alias("weight"))
    heaviest = weighed.filter(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "form")
    return {r.form: r.weight for r in heaviest.limit(ENTRIES).collect()}


def _number(words: str) -> int:
    return int.from_bytes(blake2b(words.encode(), digest_size=8).digest(), "big", signed=True)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """Lexicon and trees of at most ``sample_rows`` documents outside the held-out fold.

    Tasks count words and compute features; the driver gets bounded tables and no text.
    Without rows of both labels every text gets the same score.
    """
    sample = training_sample(
        docs, labels, "toxic", folds=FOLDS, held_out=HELD_OUT, rows=sample_rows
    )
    weights = learn_lexicon(sample)

    def features(batch: pa.RecordBatch) -> dict[str, list]:
        lexicon = Lexicon(weights)
        texts, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        return {"features": [toxicity_features(t, lexicon) for t in texts], "label": given}

    schema = StructType.fromDDL("features array<double>, label int")
    # In a fixed order, so that a fit can be repeated.
    rows = sorted(map(tuple, arrow_map(sample, features, schema).collect()))
    matrix = np.array([r[0] for r in rows], float).reshape(len(rows), len(TOXICITY_FEATURES))
    return ToxicityModel(weights, fit(matrix, np.array([r[1] for r in rows], float)))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score (0 to 1) of each whole text; null counts as empty."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # The words that a task has met are forgotten with it.
        lexicon = Lexicon(model.weights)
        for texts in batches:
            rows = np.array([toxicity_features(t, lexicon) for t in texts], float)
            yield pd.Series(model.trees.score(rows.reshape(len(texts), len(TOXICITY_FEATURES))))

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` plus ``held_out, score, predicted``, from each whole ``text`` alone.

    ``score`` (0 to 1) is higher the likelier label 1 is; ``predicted`` is 1 from
    ``threshold`` on. Null and empty texts are scored alike, by features that are all 0;
    equal texts get equal scores, and very long ones are read whole, one at a time.
    ``held_out`` marks the fold that is never learned from, false for a null id. Columns
    called like the added ones are replaced; other columns and repeated rows stay.
    """
    prepare_workers(docs.sparkSession)
    scored = docs.withColumn("score", toxicity_score(model, F.col("text")))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.withColumns({"held_out": held, "predicted": predicted})

