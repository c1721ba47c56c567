"""Threshold detectors (D1-D8): rows are flagged, never dropped."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import exceeds, named
from tidemark.schema import UPPER_ACTION, UPPER_WARNING

# The moments every model uses unless told otherwise, and the
# coefficients of the two presets. They give the thresholds 81.0 and 114.0.
DEFAULT_MEAN = 10.0
DEFAULT_STD = 2.0
AMOUNT_COLUMN = "trans_amt"
WARNING_COEFFICIENTS = (7.0, 5.5)
ACTION_COEFFICIENTS = (10.0, 7.0)


@dataclass(frozen=True)
class ThresholdModel:
    """Flags ``input_col`` in ``output_col`` where it is above ``threshold``."""

    mean: float
    std: float
    input_col: str
    output_col: str
    threshold: float

    @classmethod
    def of(
        cls,
        input_col: str,
        output_col: str,
        mean_coeff: float,
        std_coeff: float,
        mean: float = DEFAULT_MEAN,
        std: float = DEFAULT_STD,
    ) -> ThresholdModel:
        """The model with ``threshold = mean_coeff * mean + std_coeff * std``."""
        threshold = mean_coeff * mean + std_coeff * std
        return cls(float(mean), float(std), input_col, output_col, float(threshold))

    def predict(self, rows: DataFrame, replace: bool = False) -> DataFrame:
        """D3: ``rows`` with this model's flag as a further column."""
        return flag(rows, [self], replace)


UPPER_WARNING_MODEL = ThresholdModel.of(AMOUNT_COLUMN, UPPER_WARNING, *WARNING_COEFFICIENTS)
UPPER_ACTION_MODEL = ThresholdModel.of(AMOUNT_COLUMN, UPPER_ACTION, *ACTION_COEFFICIENTS)
PRESETS = (UPPER_WARNING_MODEL, UPPER_ACTION_MODEL)
PRESET_COEFFICIENTS = {UPPER_WARNING: WARNING_COEFFICIENTS, UPPER_ACTION: ACTION_COEFFICIENTS}


def flag(
    rows: DataFrame, models: Iterable[ThresholdModel] = PRESETS, replace: bool = False
) -> DataFrame:
    """Apply the models in order; a later one may read an earlier one's flag.

    Column names are checked before anything runs. A flag that would overwrite a
    column, which Spark matches without regard to case, is refused unless
    ``replace`` is set. Models that do not read each other's flags share one
    projection, so a long list of them stays a short plan.
    """
    present = list(rows.columns)
    pending: dict[str, Column] = {}
    for model in models:
        if model.input_col not in present:
            raise ValueError(f"column {model.input_col!r} is not among {present}")
        taken = [c for c in present if c.lower() == model.output_col.lower()]
        if taken and not replace:
            raise ValueError(f"flag {model.output_col!r} would overwrite column {taken[0]!r}")
        if pending.keys() & {model.input_col, *taken}:
            rows, pending = rows.withColumns(pending), {}
        pending[model.output_col] = exceeds(named(model.input_col), model.threshold)
        present = [c for c in present if c not in taken] + [model.output_col]
    return rows.withColumns(pending) if pending else rows


def flag_by_key(
    rows: DataFrame,
    moments: DataFrame,
    by: Sequence[str],
    models: Iterable[ThresholdModel] = PRESETS,
    coefficients: Mapping[str, tuple[float, float]] = PRESET_COEFFICIENTS,
) -> DataFrame:
    """Flags by each key's own moments (``by``, mean, std) in place of the models' fixed ones.

    ``coefficients`` has those of the mean and the deviation by output column. A key
    without moments, or with no deviation yet, is not flagged: nothing is known about it.
    Null keys match null keys. ``moments`` has one row a key and no size that is known
    beforehand, so there is no broadcast hint; adaptive execution decides by its real size.
    """
    known = moments.select(
        *(named(c).alias(f"_key_{k}") for k, c in enumerate(by)),
        F.col("mean").alias("_mean"),
        F.col("std").alias("_std"),
    )
    same = [named(c).eqNullSafe(F.col(f"_key_{k}")) for k, c in enumerate(by)]
    joined = rows.join(known, same, "left")
    flags = {}
    for model in models:
        mean, std = coefficients[model.output_col]
        flags[model.output_col] = exceeds(named(model.input_col), mean * F.col("_mean") + std * F.col("_std"))
    return joined.withColumns(flags).select(*map(named, rows.columns), *flags)
