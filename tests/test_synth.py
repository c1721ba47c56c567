"""Synthetic transactions (G1-G7) and the adapter over the events table."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import bag
from tidemark.functions import draws
from tidemark.functions.text import split_list
from tidemark.operators.detect import flag
from tidemark.operators.synth import SynthConfig, synth_transactions
from tidemark.schema import TRANSACTION_COLUMNS, TRANSACTION_SCHEMA
from tidemark.sources.events import envelope, table, transactions

ROWS = 20_000
ZIPS = {
    "London": {"WC1V", "EC1R", "EC1M", "EC2A", "EC4Y"},
    "Manchester": {"M45", "M61", "M30", "M23"},
    "Cardiff": {"CF15", "CF14"},
}
DOMAINS = {
    "processing_flag": {"approved", "declined"},
    "card_type": {"credit", "debit"},
    "category_name": {"leisure", "public_sector", "prof_services", "retail", "transport"},
    "city": set(ZIPS),
    "chargeback_cat": {
        "cancelled", "fraud", "non_receipt_goods", "processing_error", "request_for_info", "NA",
    },
    "chargeback_res": {"charged_back", "open", "represented", "NA"},
}


@pytest.fixture(scope="module")
def made(spark):
    return synth_transactions(spark.range(ROWS)).collect()


def _half(seed, row_id, tag, which):
    digest = hashlib.md5(f"{seed}:{row_id}:{tag}".encode()).hexdigest()
    return int(digest[15 * which : 15 * which + 15], 16)


def test_draws_match_plain_python(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 17, -5, 2**62)], "id bigint")
    hashed = ids.withColumn("d", draws.digest(9, F.col("id"), "tag"))
    halves = hashed.select(
        "id", draws.half(F.col("d"), 0).alias("a"), draws.half(F.col("d"), 1).alias("b")
    )
    rows = halves.select(
        "id",
        draws.wide(F.col("a")).alias("wide"),
        draws.narrow(F.col("b")).alias("narrow"),
        draws.digits([draws.wide(F.col("a")), draws.wide(F.col("b"))], 12).alias("digits"),
        draws.uniform(draws.wide(F.col("b")), -1.0, 3.0).alias("uniform"),
    ).collect()
    for row in rows:
        a, b = (_half(9, row.id, "tag", w) for w in (0, 1))
        assert (row.wide, row.narrow) == (a >> 16, b & 0xFFFF)
        assert row.digits == f"{(a >> 16) % 10**9:09d}{(b >> 16) % 10**3:03d}"
        assert row.uniform == -1.0 + (b >> 16) / 2**44 * 4.0


def test_digits_need_enough_draws():
    with pytest.raises(ValueError, match="10 digits"):
        draws.digits([None], 10)


def test_g6_schema(spark):
    made = synth_transactions(spark.range(1))
    assert made.columns == list(TRANSACTION_COLUMNS)
    assert [f.dataType for f in made.schema] == [f.dataType for f in TRANSACTION_SCHEMA]


def test_g1_digit_texts(made):
    for name, length in {
        "unique_transact_id": 9, "card_num": 18, "merchant_key": 4, "mcc_desc": 4
    }.items():
        assert all(re.fullmatch(rf"\d{{{length}}}", r[name]) for r in made)
        assert any(r[name].startswith("0") for r in made)
        figures = Counter(c for r in made for c in r[name])
        expected = ROWS * length / 10
        assert all(abs(n - expected) < 6 * expected**0.5 for n in figures.values())


def test_g2_amounts_are_uniform(made):
    for name, low, high in (("trans_amt", 10.0, 150.0), ("chrgbck_amt", 0.0, 50.0)):
        values = [float(r[name]) for r in made]
        assert low <= min(values) and max(values) < high
        mean, spread = (low + high) / 2, (high - low) / 12**0.5
        assert abs(sum(values) / ROWS - mean) < 6 * spread / ROWS**0.5


def test_g3_picks_cover_their_lists_evenly(made):
    for name, domain in DOMAINS.items():
        counts = Counter(r[name] for r in made)
        assert set(counts) == domain
        expected = ROWS / len(domain)
        assert all(abs(n - expected) < 6 * expected**0.5 for n in counts.values())


def test_g4_zip_belongs_to_the_city(made):
    assert all(r.zip in ZIPS[r.city] for r in made)
    assert {r.zip for r in made} == set().union(*ZIPS.values())


def test_g4_independent_zip(spark):
    rows = synth_transactions(spark.range(ROWS), independent_zip=True).collect()
    disagree = sum(r.zip not in ZIPS[r.city] for r in rows)
    assert abs(disagree / ROWS - 2 / 3) < 0.03


def test_g5_times_lie_in_the_configured_range(made):
    config = SynthConfig()
    start, end = config.millis("eventStartTimestamp"), config.millis("eventEndTimestamp")
    assert (start, end) == (1501545600000, 1504137600000)
    times = [int(r.trans_time) for r in made]
    assert start <= min(times) < start + (end - start) // 100
    assert end > max(times) > end - (end - start) // 100


def test_g5_time_column(spark):
    moment = datetime(2024, 5, 6, 7, 8, 9, 123999, tzinfo=timezone.utc)
    ids = spark.createDataFrame([(1, moment)], "id bigint, at timestamp")
    assert synth_transactions(ids, time_col="at").first().trans_time == "1714979289123"


def test_same_rows_whatever_the_partitioning(spark):
    one = synth_transactions(spark.range(0, 500, 1, 1))
    many = synth_transactions(spark.range(0, 500, 1, 7).repartition(3))
    assert bag(one) == bag(many)


def test_seed_changes_rows(spark):
    ids = spark.range(200)
    first, second = bag(synth_transactions(ids)), bag(synth_transactions(ids, seed=43))
    assert not first & second


def test_expected_flag_rates(spark):
    scored = flag(synth_transactions(spark.range(200_000)))
    warned, acted = scored.agg(F.avg("Upper_Warning"), F.avg("Upper_Action")).first()
    assert abs(warned - 69 / 140) < 0.005
    assert abs(acted - 36 / 140) < 0.005


def test_g7_properties(spark):
    config = SynthConfig.from_properties(
        "#lengths\ntransactionIdLength=5\nbaseTransactionAmount=1.0\n"
        "limitTransactionAmount=2.0\n\ncityList=Oslo,London\nzipcode.Oslo=0150\n"
        "cardTypeList=gold"
    )
    rows = synth_transactions(spark.range(300), config=config).collect()
    assert {len(r.unique_transact_id) for r in rows} == {5}
    assert all(1.0 <= float(r.trans_amt) < 2.0 for r in rows)
    assert {r.city for r in rows} == {"Oslo", "London"}
    assert {r.zip for r in rows if r.city == "Oslo"} == {"0150"}
    assert {r.card_type for r in rows} == {"gold"}
    assert {r.chargeback_res for r in rows} == DOMAINS["chargeback_res"]


@pytest.mark.parametrize("length", [0, 1, 9, 10, 19, 40])
def test_g7_digits_of_any_length(spark, length):
    config = SynthConfig.from_properties(
        "".join(f"{name}={length}\n" for name in (
            "transactionIdLength", "cardNumberLength", "merchantKeyLength", "mccDescLength"
        ))
    )
    names = ["unique_transact_id", "card_num", "merchant_key", "mcc_desc"]
    rows = synth_transactions(spark.range(200), config=config).select(names).collect()
    assert all(re.fullmatch(rf"\d{{{length}}}", r[name]) for r in rows for name in names)
    if length >= 9:
        assert len({r[name] for r in rows for name in names}) == 800
    if length == 40:
        # No part of a long text repeats another part of the same row.
        assert all(len({"".join(r)[i : i + 9] for i in range(0, 160, 9)}) == 18 for r in rows)


def test_g7_lists_follow_the_rules_of_split_list(spark):
    for text in ["a,b", " a , b", "a,,b", ",a,,", "abc", ",,"]:
        config = SynthConfig.from_properties(f"cardTypeList={text}")
        row = spark.createDataFrame([(text.strip(),)], "t string").select(split_list(F.col("t")))
        assert list(config.lists["cardTypeList"]) == row.first()[0]
    with pytest.raises(ValueError, match="values"):
        synth_transactions(spark.range(1), config=SynthConfig.from_properties("cityList=,"))


@pytest.mark.parametrize(
    "text",
    [
        "cardNumberLength=-1",
        "baseTransactionAmount=150.0",
        "limitChargebackAmount=-1",
        "eventEndTimestamp=2017-08-01 00:00:00",
    ],
)
def test_g7_impossible_settings_are_refused(spark, text):
    with pytest.raises(ValueError):
        synth_transactions(spark.range(1), config=SynthConfig.from_properties(text))


def test_g7_city_without_zips():
    with pytest.raises(ValueError, match="Oslo"):
        SynthConfig.from_properties("cityList=Oslo")


def test_g7_empty_properties_are_the_defaults():
    assert SynthConfig.from_properties("") == SynthConfig()


def test_g4_unlisted_city_has_no_zip(spark):
    made = synth_transactions(spark.range(5), given={"city": F.lit("Oslo")})
    assert bag(made, ["city", "zip"]) == {("Oslo", None): 5}


def test_kept_columns_come_first(spark):
    made = synth_transactions(spark.range(2), keep=["id"])
    assert made.columns == ["id", *TRANSACTION_COLUMNS]


def test_given_columns_must_be_known(spark):
    with pytest.raises(ValueError, match="colour"):
        synth_transactions(spark.range(1), given={"colour": F.lit("red")})


def test_adapter_expected_flag_counts(spark, data_dir):
    scored = flag(transactions(table(spark, data_dir, "events")))
    assert scored.count() == 1000
    counts = scored.agg(F.sum("Upper_Warning"), F.sum("Upper_Action")).first()
    assert tuple(counts) == (210, 96)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_adapter_times_do_not_depend_on_the_session_zone(spark, zone):
    # The second time does not exist in New York, the third one not on Lord Howe Island.
    texts = ["2024-01-01 00:00:07.179575", "2024-03-10 02:30:00.5", "2024-10-06 02:10:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = spark.createDataFrame(
            [(i, t) for i, t in enumerate(texts)], "event_id bigint, t string"
        ).select(
            "event_id",
            F.col("t").cast("timestamp_ntz").alias("ts"),
            F.lit(1).cast("bigint").alias("user_id"),
            F.lit("view").alias("event_type"),
            F.lit(1.5).alias("value"),
            F.lit('{"k": 7}').alias("props"),
        )
        got = [r.trans_time for r in transactions(events).orderBy("unique_transact_id").collect()]
        stamps = envelope(events).orderBy("offset", "partition")
        micros = [r[0] for r in stamps.select(F.unix_micros("timestamp")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    moments = [datetime.fromisoformat(t).replace(tzinfo=timezone.utc) for t in texts]
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    exact = [(m - epoch).days * 86_400_000_000 + (m - epoch).seconds * 1_000_000 + m.microsecond
             for m in moments]
    assert micros == exact
    assert got == [str(m // 1000) for m in exact]
