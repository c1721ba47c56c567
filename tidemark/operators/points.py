"""Chart points from scored messages or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import named

TIME_COLUMN = "trans_time"
AMOUNT_COLUMN = "trans_amt"


def chart_points(rows: DataFrame, x: str = TIME_COLUMN, y: str = AMOUNT_COLUMN) -> DataFrame:
    """One point per row; a missing coordinate is null rather than an error."""
    return rows.select(named(x).alias("x"), named(y).alias("y"))


def chart_points_json(rows: DataFrame, x: str = TIME_COLUMN, y: str = AMOUNT_COLUMN) -> DataFrame:
    """The same points as messages, each coordinate a list of one."""
    point = F.struct(F.array(named(x)).alias("x"), F.array(named(y)).alias("y"))
    return rows.select(F.to_json(point).alias("value"))


def thinned(points: DataFrame, width: int, salts: int = 16) -> DataFrame:
    """``bucket, x, y``: at most four points of each bucket of ``width`` along ``x``.

    They are the first and the last (by ``x``, then ``y``) and the smallest and the largest
    (by ``y``, then ``x``), so a line through them has the extent of the whole at any
    resolution of the chart. A point that is several of them is there once. Points whose ``x``
    is no whole number or whose ``y`` is no number are left out; NaN is above all numbers.

    A bucket's points are spread over ``salts`` parts by a hash of the point, whose four
    points are then combined, so that no task gets a whole bucket however hot it is.
    """
    if width < 1 or salts < 1:
        raise ValueError("width and salts are at least 1")
    x, y = F.col("x").try_cast("bigint"), F.col("y").try_cast("double")
    rows = points.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    bucket = F.expr(f"(x - pmod(x, {width}L)) div {width}L")
    parts = rows.select(bucket.alias("bucket"), F.pmod(F.xxhash64("x", "y"), F.lit(salts)).alias("salt"), "x", "y")
    along, up = F.struct("x", "y"), F.struct("y", "x")
    ends = [F.min(along).alias("first"), F.max(along).alias("last"), F.min(up).alias("low"), F.max(up).alias("high")]
    partial = parts.groupBy("bucket", "salt").agg(*ends)
    whole = partial.groupBy("bucket").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    turned = [F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")) for c in ("low", "high")]
    four = F.array_distinct(F.array(F.col("first"), F.col("last"), *turned))
    return whole.select("bucket", F.explode(four).alias("point")).select("bucket", "point.x", "point.y")
