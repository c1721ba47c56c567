"""Moments and alert counts over flagged rows: what thresholds are chosen by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import named


def fit_moments(rows: DataFrame, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and the count, mean and sample deviation of the amounts that parse as numbers.

    Partial sums within the tasks, one row for each group and task in the shuffle; the
    result is a table, so many groups cost the driver nothing. Without ``by`` one row,
    whose moments are null where nothing parses.
    """
    value = named(amount).try_cast("double")
    return rows.groupBy(*map(named, by)).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )


def alerts_per(rows: DataFrame, step: Column, flags: Sequence[str]) -> DataFrame:
    """For each ``step``, how many rows there are and how many each flag marks."""
    marked = [F.sum(named(f)).alias(f) for f in flags]
    return rows.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), *marked)


def moment_states(rows: DataFrame, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and the count, mean and summed squared deviation of the amounts that parse.

    States of different rows merge to that of all of them, whatever the split.
    """
    fitted = fit_moments(rows, amount, by)
    squares = F.coalesce(F.col("std") * F.col("std") * (F.col("n") - 1), F.lit(0.0))
    return fitted.select(*map(named, by), "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), squares.alias("m2"))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state for each group with amounts, out of any number of states.

    Deviations are taken from one of the group's means, never from 0, so large means lose
    no digits. Two sums within the tasks first; no list of a group's states is made.
    """
    keys = {f"_key_{k}": named(c) for k, c in enumerate(by)} or {"_key_0": F.lit(0)}
    placed = states.select(*(c.alias(k) for k, c in keys.items()), "n", "mean", "m2").filter("n > 0")
    about = placed.groupBy(*keys).agg(F.max("mean").alias("about"))
    about = about.withColumnsRenamed({k: f"{k}_" for k in keys})
    apart = F.col("mean") - F.col("about")
    sums = (
        placed.join(about, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
        .groupBy(*keys, "about")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * apart).alias("shift"),
            F.sum(F.col("m2") + F.col("n") * apart * apart).alias("spread"),
        )
    )
    return sums.select(
        *(F.col(f"_key_{k}").alias(c) for k, c in enumerate(by)),
        "n",
        (F.col("about") + F.col("shift") / F.col("n")).alias("mean"),
        F.greatest(F.col("spread") - F.col("shift") * F.col("shift") / F.col("n"), F.lit(0.0)).alias("m2"),
    )


def moments_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States as the moments that :func:`fit_moments` gives."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    mean = F.when(F.col("n") > 0, F.col("mean"))
    return states.select(*map(named, by), "n", mean.alias("mean"), std.alias("std"))
