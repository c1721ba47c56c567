"""Scoring by thresholds that follow the data: each batch is judged by what came before it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.detect import PRESET_COEFFICIENTS, PRESETS, ThresholdModel, flag_by_key
from tidemark.operators.fitting import merge_states, moment_states, moments_of
from tidemark.streaming.ledger import Ledger, start_once

VERSIONS = "moments"


def state_schema(rows: DataFrame, by: Sequence[str]) -> T.StructType:
    """The schema of a table of moment states by the columns ``by`` of ``rows``."""
    return T.StructType([*(rows.schema[c] for c in by), *T.StructType.fromDDL("n long, mean double, m2 double")])


def scored_schema(rows: DataFrame, models: Iterable[ThresholdModel] = PRESETS) -> T.StructType:
    """The schema of scored batches: the rows' own columns, the flags and the version."""
    flags = [T.StructField(m.output_col, T.IntegerType()) for m in models]
    return T.StructType([*rows.schema, *flags, T.StructField("version", T.LongType())])


def start_learning(
    rows: DataFrame,
    by: Sequence[str],
    amount: str,
    scored: Ledger,
    states: Ledger,
    checkpoint: str,
    query: str,
    *,
    models: Sequence[ThresholdModel] = PRESETS,
    coefficients: Mapping[str, tuple[float, float]] = PRESET_COEFFICIENTS,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Flag a stream by the moments of each key over all earlier batches, and keep those up to date.

    Batch N is judged by version N of the moments, read anew, which holds batches 0 to N - 1;
    version N + 1 is that one merged with the batch's own. So a batch that runs again is
    judged by the same version, and neither its rows nor its amounts count twice. A version
    has one row a key; what a batch shuffles is its partial sums and the keys.
    """

    def work(batch: DataFrame, number: int) -> DataFrame:
        known = states.batch(batch.sparkSession, VERSIONS, number)
        states.put(merge_states(known.unionByName(moment_states(batch, amount, by)), by), VERSIONS, number + 1)
        flagged = flag_by_key(batch, moments_of(known, by), by, models, coefficients)
        return flagged.withColumn("version", F.lit(number).cast("long"))

    return start_once(rows, scored, checkpoint, query, trigger, work)


def latest_moments(spark, states: Ledger, by: Sequence[str]) -> DataFrame:
    """The moments of all batches so far: the newest version in the ledger."""
    newest = states.entries(spark).agg(F.max("batch")).first()[0] or 0
    return moments_of(states.batch(spark, VERSIONS, newest), by)
