"""The physical plans that a large cluster would run."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan
from tidemark.operators.detect import flag
from tidemark.operators.messages import decode_json, encode_json
from tidemark.operators.points import chart_points
from tidemark.operators.progress import input_lag, latest_offsets
from tidemark.operators.synth import synth_transactions
from tidemark.plans.queries import QUERIES
from tidemark.plans.scoring import score, score_messages
from tidemark.plans.workspace import new_folder
from tidemark.schema import POINT_SCHEMA
from tidemark.sources.endpoint import files
from tidemark.sources.events import envelope, progress_messages, table, transactions

SHUFFLED = {
    "alerts_per_hour",
    "fit_by_category",
    "fit_global",
    "latest_offsets",
    "latest_offsets_stored",
    "chart_thinned",
    "progress_merge",
    "progress_rows",
    "input_lag",
    "input_lag_as_of",
    "input_lag_reported",
    "stream_progress",
}
STREAMS = {name for name in QUERIES if name.startswith("stream_")}


@pytest.fixture(scope="module")
def stored(spark, data_dir):
    """The input topic as stored records, as the job would meet it."""
    topic = files(new_folder(spark, "topic"))
    topic.write(envelope(table(spark, data_dir, "events")))
    return topic.read(spark)


def _read_schema(text):
    return re.findall(r"ReadSchema: struct<(.*?)>\s", text)


def test_scoring_is_one_map_only_pass(stored):
    text = plan(score_messages(stored))
    assert text.count("from_json(") == 1
    assert "Exchange" not in text
    assert "Python" not in text
    assert _read_schema(text) == ["value:binary"]


def test_thresholds_are_literals(stored):
    text = plan(score(stored))
    assert "> 81.0)" in text and "> 114.0)" in text


def test_only_the_fields_of_the_schema_are_parsed(stored):
    text = plan(chart_points(decode_json(stored, POINT_SCHEMA)))
    parsed = re.search(r"from_json\((.*?), \(max", text).group(1)
    assert re.findall(r"StructField\((\w+),", parsed) == ["trans_time", "trans_amt"]
    assert text.count("from_json(") == 1


def test_latest_offsets_reads_three_columns_and_combines_first(stored):
    text = plan(latest_offsets(stored))
    assert _read_schema(text) == ["topic:string,partition:int,offset:bigint"]
    assert "partial_max" in text
    assert text.count("Exchange") >= 1


def test_merge_parses_once_and_looks_up_the_offset_once(spark, data_dir):
    text = plan(QUERIES["progress_merge"](spark, data_dir))
    # One scan for the messages, one for the offset and one for all offsets.
    assert len(_read_schema(text)) == 3


def test_lag_join_is_not_a_cross_join(spark, data_dir, stored):
    progress = progress_messages(table(spark, data_dir, "events"))
    text = plan(input_lag(progress, latest_offsets(stored)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_lag_join_shuffles_on_a_salted_key(spark, data_dir, stored):
    progress = progress_messages(table(spark, data_dir, "events"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(input_lag(progress, latest_offsets(stored)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin LeftOuter" in text
    salted = re.findall(r"hashpartitioning\(topic#\d+, partition#\d+, salt#\d+", text)
    assert len(salted) == 2
    assert "topic:string,partition:int,offset:bigint" in _read_schema(text)


def test_numeric_amounts_filter_at_the_scan(spark, data_dir):
    orders = table(spark, data_dir, "orders").select("o_totalprice")
    text = plan(orders.filter(F.col("o_totalprice") > 81.0))
    assert "GreaterThan(o_totalprice,81.0)" in text


def test_generator_hashes_once_per_subject(spark):
    text = plan(synth_transactions(spark.range(10)))
    assert text.count("md5(") == 4 and text.count("conv(") == 8
    assert "Exchange" not in text
    assert len(re.findall(r"codegen id : 1\b", text)) >= 1 and "codegen id : 2" not in text


def test_generator_draws_only_what_is_asked_for(spark):
    text = plan(synth_transactions(spark.range(10)).select("card_type"))
    assert text.count("md5(") == 1 and text.count("conv(") == 1


def test_offsets_of_the_adapter_draw_nothing(spark, data_dir):
    text = plan(latest_offsets(envelope(table(spark, data_dir, "events"))))
    assert "md5(" not in text
    assert _read_schema(text) == ["event_id:bigint"]


def test_encoding_and_decoding_add_no_shuffle(spark, data_dir):
    rows = flag(decode_json(encode_json(transactions(table(spark, data_dir, "events")))))
    assert "Exchange" not in plan(rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_registered_queries_stay_in_the_jvm(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    assert "Python" not in text and "Pandas" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert ("Exchange" in text) == (name in SHUFFLED)
