"""Threshold models and flags."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.detect import (
    PRESETS,
    UPPER_ACTION_MODEL,
    UPPER_WARNING_MODEL,
    ThresholdModel,
    flag,
)

# Amount text, flag at 81.0, flag at 114.0.
AMOUNTS = [
    ("81.0", 0, 0),
    ("81.0000001", 1, 0),
    ("80.999", 0, 0),
    ("114", 1, 0),
    ("114.0", 1, 0),
    ("114.5", 1, 1),
    (None, 0, 0),
    ("", 0, 0),
    ("abc", 0, 0),
    ("1,000", 0, 0),
    ("1_0", 0, 0),
    ("NaN", 1, 1),
    ("Infinity", 1, 1),
    ("-Infinity", 0, 0),
    (" 90 ", 1, 0),
    ("1e2", 1, 0),
    ("100d", 1, 0),
    ("100f", 1, 0),
    ("0x1p7", 1, 1),
    ("-500", 0, 0),
]


def test_d1_d2_d7_d8_preset_thresholds():
    assert (UPPER_WARNING_MODEL.threshold, UPPER_ACTION_MODEL.threshold) == (81.0, 114.0)
    assert (UPPER_WARNING_MODEL.mean, UPPER_WARNING_MODEL.std) == (10.0, 2.0)
    assert [m.output_col for m in PRESETS] == ["Upper_Warning", "Upper_Action"]
    assert {m.input_col for m in PRESETS} == {"trans_amt"}


def test_d1_threshold_from_given_moments():
    model = ThresholdModel.of("a", "b", 2.0, -3.0, mean=5.0, std=0.5)
    assert model == ThresholdModel(5.0, 0.5, "a", "b", 8.5)


def test_d1_models_are_immutable():
    with pytest.raises(AttributeError):
        UPPER_WARNING_MODEL.threshold = 1.0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_d3_d4_text_amounts(spark, ansi):
    amounts = spark.createDataFrame([(a,) for a, _, _ in AMOUNTS], "trans_amt string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = [tuple(r) for r in flag(amounts).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == AMOUNTS


def test_d3_flags_are_non_null_ints(spark):
    scored = flag(spark.createDataFrame([("1",)], "trans_amt string"))
    for name in ("Upper_Warning", "Upper_Action"):
        field = scored.schema[name]
        assert (field.dataType, field.nullable) == (T.IntegerType(), False)


@pytest.mark.parametrize("kind", ["double", "float", "int", "bigint", "decimal(12,4)", "string"])
def test_d3_numeric_amounts(spark, kind):
    amounts = spark.createDataFrame([("80",), ("81",), ("82",), (None,)], "t string")
    typed = amounts.select(F.col("t").cast(kind).alias("trans_amt"))
    assert [r.Upper_Warning for r in UPPER_WARNING_MODEL.predict(typed).collect()] == [0, 0, 1, 0]


def test_d5_missing_column_is_refused_before_running(spark):
    amounts = spark.createDataFrame([("1",)], "amount string")
    with pytest.raises(ValueError, match="trans_amt"):
        flag(amounts)


def test_d5_check_minds_case(spark):
    amounts = spark.createDataFrame([("1",)], "TRANS_AMT string")
    with pytest.raises(ValueError, match="trans_amt"):
        flag(amounts)


def test_d5_names_with_dots_and_backticks(spark):
    amounts = spark.createDataFrame([("90", "1")], T.StructType([
        T.StructField("a.b", T.StringType()), T.StructField("c`d", T.StringType())
    ]))
    models = [ThresholdModel.of("a.b", "x", 7.0, 5.5), ThresholdModel.of("c`d", "y", 7.0, 5.5)]
    assert [tuple(r) for r in flag(amounts, models).collect()] == [("90", "1", 1, 0)]


def test_d6_all_columns_are_kept_in_order(spark):
    rows = spark.createDataFrame([("1", "90", "x")], "a string, trans_amt string, z string")
    assert flag(rows).columns == ["a", "trans_amt", "z", "Upper_Warning", "Upper_Action"]


def test_d6_a_model_may_read_an_earlier_flag(spark):
    rows = spark.createDataFrame([("90",), ("10",)], "trans_amt string")
    again = ThresholdModel.of("Upper_Warning", "Again", 0.0, 0.25)
    got = [tuple(r) for r in flag(rows, [UPPER_WARNING_MODEL, again]).collect()]
    assert got == [("90", 1, 1), ("10", 0, 0)]


def test_d6_order_matters_for_chained_models(spark):
    rows = spark.createDataFrame([("90",)], "trans_amt string")
    again = ThresholdModel.of("Upper_Warning", "Again", 0.0, 0.25)
    with pytest.raises(ValueError, match="Upper_Warning"):
        flag(rows, [again, UPPER_WARNING_MODEL])


def test_flag_name_collision(spark):
    rows = spark.createDataFrame([("90", "old")], "trans_amt string, upper_warning string")
    with pytest.raises(ValueError, match="upper_warning"):
        UPPER_WARNING_MODEL.predict(rows)
    replaced = UPPER_WARNING_MODEL.predict(rows, replace=True)
    assert [tuple(r) for r in replaced.collect()] == [("90", 1)]


def test_replaced_flags_keep_the_order_of_the_models(spark):
    rows = spark.createDataFrame([("90",)], "trans_amt string")
    models = [
        ThresholdModel.of("trans_amt", "a", 7.0, 5.5),
        ThresholdModel.of("a", "b", 0.0, 0.25),
        ThresholdModel.of("trans_amt", "A", 10.0, 7.0),
        ThresholdModel.of("A", "c", 0.0, 0.25),
    ]
    row = flag(rows, models, replace=True).first().asDict()
    assert {k.lower(): v for k, v in row.items()} == {"trans_amt": "90", "a": 0, "b": 1, "c": 0}


def test_many_models_share_one_projection(spark):
    rows = spark.createDataFrame([("90.5",)], "trans_amt string")
    models = [ThresholdModel.of("trans_amt", f"f{i}", 0.0, i / 2) for i in range(300)]
    flagged = flag(rows, models)
    assert list(flagged.first())[1:] == [int(90.5 > i) for i in range(300)]
    assert flag(rows, []).columns == ["trans_amt"]


def test_rows_are_flagged_never_dropped_and_action_implies_warning(spark):
    rng = random.Random(7)
    values = [rng.choice([None, "x", "", repr(rng.uniform(-50, 200))]) for _ in range(2000)]
    scored = flag(spark.createDataFrame([(v,) for v in values], "trans_amt string")).collect()
    assert [r.trans_amt for r in scored] == values
    assert all(r.Upper_Warning >= r.Upper_Action for r in scored)


def test_flags_fall_as_the_threshold_rises(spark):
    rng = random.Random(8)
    thresholds = sorted(rng.uniform(0, 150) for _ in range(12))
    models = [
        ThresholdModel(10.0, 2.0, "trans_amt", f"t{i}", t) for i, t in enumerate(thresholds)
    ]
    values = [rng.uniform(-10, 200) for _ in range(500)] + [math.nan]
    scored = flag(spark.createDataFrame([(v,) for v in values], "trans_amt double"), models)
    for row in scored.collect():
        flags = list(row)[1:]
        assert flags == sorted(flags, reverse=True)
