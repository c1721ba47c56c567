"""Registered queries of streams that keep something: ledgers, state, moments, metrics; and of checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.delivery import alerts_per_window, state_on_disk, without_repeats
from tidemark.operators.detect import flag
from tidemark.operators.messages import encode_csv, encode_json
from tidemark.operators.points import chart_points, thinned
from tidemark.operators.quarantine import RAW, REASON, Quarantine
from tidemark.operators.rules import RULES_SCHEMA, check, read_rules
from tidemark.plans.learning import latest_moments, scored_schema, start_learning, state_schema
from tidemark.plans.workspace import new_folder
from tidemark.schema import UPPER_ACTION, UPPER_WARNING
from tidemark.sources.deliveries import DELIVERED, Deliveries, deliver
from tidemark.sources.endpoint import Endpoint, files
from tidemark.sources.events import table, transactions
from tidemark.streaming.ledger import Ledger, start_once
from tidemark.streaming.observe import counted, observed, progress_messages, state_rows

Query = Callable[[SparkSession, str], DataFrame]

FLAGS = (UPPER_WARNING, UPPER_ACTION)
NOW = {"availableNow": True}
HOUR_MILLIS = 3_600_000
#: Coefficients of a key's mean and deviation.
KEY_COEFFICIENTS = {UPPER_WARNING: (1.0, 1.0), UPPER_ACTION: (1.0, 2.0)}
#: Rules for transactions, as a table holds them.
RULES = (
    ("amount", "trans_amt", "range", "[0, 200]"),
    ("card", "card_num", "length", "[18, 18]"),
    ("card_type", "card_type", "one_of", '["credit", "debit"]'),
    ("category", "chargeback_cat", "one_of",
     '["cancelled", "fraud", "non_receipt_goods", "processing_error", "request_for_info", "NA"]'),
    ("merchant", "merchant_key", "given", None),
    ("time", "trans_time", "pattern", "\"^[0-9]{13}$\""),
    ("zip", "zip", "goes_with",
     '["city", {"London": ["WC1V", "EC1R", "EC1M", "EC2A", "EC4Y"], '
     '"Manchester": ["M45", "M61", "M30", "M23"], "Cardiff": ["CF15", "CF14"]}]'),
)
#: Planted faults: the column, one row in how many has it, and what stands there.
FAULTS = (
    ("zip", 11, "XX1"), ("card_num", 13, "12"), ("chargeback_cat", 17, "odd"), ("trans_amt", 19, "abc"),
    ("merchant_key", 23, None), ("card_type", 29, "Credit"), ("trans_time", 31, "soon"),
)


class _Interrupted(Ledger):
    """A ledger whose writer dies after the rows of a batch and before its entry."""

    BATCH = 2

    def enter(self, spark: SparkSession, query: str, batch: int) -> None:
        if batch == self.BATCH:
            raise InterruptedError("between rows and entry")
        super().enter(spark, query, batch)


def _delivered(spark: SparkSession, data_dir: str, **how: bool) -> Deliveries:
    return deliver(table(spark, data_dir, "events"), new_folder(spark, "deliveries"), **how)


def _output(spark: SparkSession, schema: str) -> Endpoint:
    return files(new_folder(spark, "output"), schema=schema)


def stream_once(spark: SparkSession, data_dir: str) -> DataFrame:
    """A stream that dies between the rows and the entry of a batch, and is started again."""
    topic = _delivered(spark, data_dir).topic
    flagged = flag(topic.read_stream(spark))
    folder, checkpoint = new_folder(spark, "once"), new_folder(spark, "checkpoint")
    ledger = Ledger(folder, flagged.schema)
    try:
        start_once(flagged, _Interrupted(folder, flagged.schema), checkpoint, "scored", NOW).awaitTermination()
    except StreamingQueryException:
        start_once(flagged, ledger, checkpoint, "scored", NOW).awaitTermination()
    rows = ledger.read(spark, keep=("batch",))
    return rows.select("event_id", "trans_amt", *FLAGS, "batch")


def stream_deduplicated(spark: SparkSession, data_dir: str) -> DataFrame:
    """A topic in which one row in five comes twice, read as if each came once."""
    topic = _delivered(spark, data_dir, repeats=True)
    rows = without_repeats(topic.topic.read_stream(spark), ["event_id"], "timestamp", topic.delay)
    output = _output(spark, DELIVERED)
    with state_on_disk(spark):
        query = output.write_stream(rows, new_folder(spark, "checkpoint"), NOW)
    query.awaitTermination()
    return output.read(spark).select("event_id", "category_name", "trans_amt")


def stream_alerts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Closed hours of a topic with repeats and late rows, and how many rows were late."""
    topic = _delivered(spark, data_dir, repeats=True, late=True)
    rows = without_repeats(topic.topic.read_stream(spark), ["event_id"], "timestamp", topic.delay)
    hours = alerts_per_window(flag(rows), "timestamp", "1 hour", FLAGS)
    output = _output(spark, f"start timestamp, rows long, {UPPER_WARNING} long, {UPPER_ACTION} long")
    with state_on_disk(spark):
        query = output.write_stream(hours, new_folder(spark, "checkpoint"), NOW)
    query.awaitTermination()
    kept = state_rows(progress_messages(spark, query))
    late = kept.filter(F.col("operator").startswith("dedupe")).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    start = F.unix_millis("start").alias("start")
    return output.read(spark).select(start, "rows", *FLAGS, late.scalar().alias("late"))


def _learned(spark: SparkSession, data_dir: str) -> tuple[Ledger, Ledger]:
    topic = _delivered(spark, data_dir).topic
    rows, by = topic.read_stream(spark), ["category_name"]
    scored = Ledger(new_folder(spark, "scored"), scored_schema(rows))
    states = Ledger(new_folder(spark, "moments"), state_schema(rows, by))
    query = start_learning(
        rows,
        by,
        "trans_amt",
        scored,
        states,
        new_folder(spark, "checkpoint"),
        "learned",
        coefficients=KEY_COEFFICIENTS,
        trigger=NOW,
    )
    query.awaitTermination()
    return scored, states


def stream_thresholds(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every batch flagged by each category's moments over the batches before it."""
    scored, _ = _learned(spark, data_dir)
    return scored.read(spark).select("event_id", "category_name", "version", *FLAGS)


def stream_moments(spark: SparkSession, data_dir: str) -> DataFrame:
    """The moments by category after the last batch, folded batch by batch."""
    _, states = _learned(spark, data_dir)
    moments = latest_moments(spark, states, ["category_name"])
    return moments.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def stream_observed(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows and flags of every batch, counted inside its own progress event."""
    topic = _delivered(spark, data_dir).topic
    last = F.max("event_id").alias("last_id")
    rows = counted(flag(topic.read_stream(spark)), "flags", FLAGS, last)
    query = Endpoint("noop").write_stream(rows, new_folder(spark, "checkpoint"), NOW)
    query.awaitTermination()
    fields = f"rows: long, {UPPER_WARNING}: long, {UPPER_ACTION}: long, last_id: long"
    return observed(progress_messages(spark, query), "flags", fields).drop("id").filter("rows > 0")


def quarantined(spark: SparkSession, data_dir: str) -> DataFrame:
    """JSON messages, CSV lines and prose in one topic: records, and all else with its reason."""
    rows = transactions(table(spark, data_dir, "events"))
    texts = table(spark, data_dir, "documents").select(F.col("text").alias("value"))
    routed = Quarantine(new_folder(spark, "quarantine"))
    routed.write(encode_json(rows).union(encode_csv(rows)).union(texts))
    good = routed.good(spark).select(
        F.lit("good").alias("verdict"), "unique_transact_id", "trans_amt", *_nulls(REASON, "digest")
    )
    bad = routed.bad(spark).select(
        F.lit("bad").alias("verdict"), *_nulls("unique_transact_id", "trans_amt"), REASON, F.md5(RAW).alias("digest")
    )
    return good.union(bad)


def _nulls(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def chart_thinned(spark: SparkSession, data_dir: str) -> DataFrame:
    """At most four points for each hour of a chart."""
    return thinned(chart_points(transactions(table(spark, data_dir, "events"))), HOUR_MILLIS)


def rule_violations(spark: SparkSession, data_dir: str) -> DataFrame:
    """Transactions with planted faults, and the rules of a table that each breaks."""
    rows = transactions(table(spark, data_dir, "events"), keep=["event_id"])
    number = F.col("event_id")
    faulty = {c: F.when(number % k == 0, F.lit(v).cast("string")).otherwise(F.col(c)) for c, k, v in FAULTS}
    rules = read_rules(spark.createDataFrame(RULES, RULES_SCHEMA))
    checked = check(rows.withColumns(faulty), rules)
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


QUERIES: dict[str, Query] = {
    "stream_once": stream_once,
    "stream_deduplicated": stream_deduplicated,
    "stream_alerts": stream_alerts,
    "stream_thresholds": stream_thresholds,
    "stream_moments": stream_moments,
    "stream_observed": stream_observed,
    "quarantined": quarantined,
    "chart_thinned": chart_thinned,
    "rule_violations": rule_violations,
}
