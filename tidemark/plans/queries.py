"""The registered queries: each reads whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import split_list
from tidemark.operators.detect import (
    UPPER_ACTION_MODEL,
    UPPER_WARNING_MODEL,
    ThresholdModel,
    flag,
)
from tidemark.operators.fitting import alerts_per, fit_moments
from tidemark.operators.messages import (
    decode_csv,
    decode_json,
    decode_scored,
    encode_csv,
    encode_json,
    json_value,
)
from tidemark.operators.points import chart_points, chart_points_json
from tidemark.operators.progress import (
    input_lag,
    latest_offsets,
    offsets_by_time,
    offsets_json,
    progress_rows,
    with_field,
    with_latest_offset,
)
from tidemark.plans import stateful
from tidemark.plans.feeding import feed_messages
from tidemark.plans.scoring import score, score_messages
from tidemark.plans.workspace import new_folder
from tidemark.schema import POINT_SCHEMA, TRANSACTION_COLUMNS
from tidemark.sources.endpoint import INPUT_TOPIC, Endpoint, files
from tidemark.sources.events import (
    envelope,
    events_stream,
    progress_messages,
    table,
    transactions,
)
from tidemark.sources.footers import TOPIC_FOLDERS, stored_ends
from tidemark.streaming.observe import ALL_OFFSETS, ProgressLog
from tidemark.streaming.run import run_available, run_until_stopped

Query = Callable[[SparkSession, str], DataFrame]

_ORDER_MODELS = (
    ThresholdModel.of("o_totalprice", "high_total", 1.0, 0.5, mean=150_000.0, std=80_000.0),
    ThresholdModel.of("o_totalprice", "extreme_total", 1.0, 1.5, mean=150_000.0, std=80_000.0),
    ThresholdModel.of("high_total", "repeated_flag", 0.0, 0.25),
)
_LINE_MODELS = (
    ThresholdModel.of("l_extendedprice", "high_price", 2.0, 2.5, mean=20_000.0, std=8_000.0),
    ThresholdModel.of("l_quantity", "high_quantity", 1.0, 10.0, mean=20.0, std=1.5),
)
_ITEM_MODELS = (ThresholdModel.of("item", "high_item", 1.0, 0.5, mean=80.0, std=2.0),)


def _events(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "events")


def _transactions(spark: SparkSession, data_dir: str) -> DataFrame:
    return transactions(_events(spark, data_dir))


def _envelope(spark: SparkSession, data_dir: str) -> DataFrame:
    return envelope(_events(spark, data_dir))


def _scored(spark: SparkSession, data_dir: str) -> DataFrame:
    """Messages as the scored topic holds them."""
    return encode_json(flag(_transactions(spark, data_dir)))


def score_transactions(spark: SparkSession, data_dir: str) -> DataFrame:
    """The flagship: topic records decoded and flagged by both presets."""
    return score(_envelope(spark, data_dir))


def score_single_warning(spark: SparkSession, data_dir: str) -> DataFrame:
    return score(_envelope(spark, data_dir), [UPPER_WARNING_MODEL])


def score_single_action(spark: SparkSession, data_dir: str) -> DataFrame:
    return score(_envelope(spark, data_dir), [UPPER_ACTION_MODEL])


def score_csv(spark: SparkSession, data_dir: str) -> DataFrame:
    return score(encode_csv(_transactions(spark, data_dir)), wire="csv")


def score_orders(spark: SparkSession, data_dir: str) -> DataFrame:
    """A numeric amount, moments of its own, and a detector that reads another's flag."""
    orders = table(spark, data_dir, "orders").select("o_orderkey", "o_totalprice")
    return flag(orders, _ORDER_MODELS)


def score_lineitem(spark: SparkSession, data_dir: str) -> DataFrame:
    """Detectors on two different columns of one table."""
    lines = table(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    return flag(lines, _LINE_MODELS)


def score_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """Parts of lists as amounts: numbers above and below, and words."""
    line = F.concat_ws(
        ",", F.col("value").cast("string"), "event_type", F.get_json_object("props", "$.k")
    )
    items = F.posexplode(split_list(line)).alias("position", "item")
    return flag(_events(spark, data_dir).select("event_id", items), _ITEM_MODELS)


def _rounded(moments: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return moments.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def fit_global(spark: SparkSession, data_dir: str) -> DataFrame:
    return _rounded(fit_moments(_transactions(spark, data_dir), "trans_amt"))


def fit_by_category(spark: SparkSession, data_dir: str) -> DataFrame:
    return _rounded(fit_moments(_transactions(spark, data_dir), "trans_amt", ["category_name"]))


def alerts_per_hour(spark: SparkSession, data_dir: str) -> DataFrame:
    flagged = flag(transactions(_events(spark, data_dir), keep=["ts"]))
    hour = F.date_trunc("hour", "ts").cast("string")
    return alerts_per(flagged, hour, ["Upper_Warning", "Upper_Action"])


def decode_json_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    return decode_json(_envelope(spark, data_dir))


def encode_json_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    return encode_json(flag(_transactions(spark, data_dir)))


def encode_csv_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    return encode_csv(_transactions(spark, data_dir))


def decode_csv_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    return decode_csv(encode_csv(_transactions(spark, data_dir)))


def decode_scored_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    return decode_scored(_scored(spark, data_dir))


def misfed_csv(spark: SparkSession, data_dir: str) -> DataFrame:
    """A topic of CSV lines and JSON messages read as JSON: the lines become rows of nulls."""
    rows = _transactions(spark, data_dir)
    return score(encode_csv(rows).union(encode_json(rows)))


def misfed_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """Whole prose texts among JSON messages."""
    texts = table(spark, data_dir, "documents").select("text")
    return score(texts.union(encode_json(_transactions(spark, data_dir))), value="text")


def chart_points_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    return chart_points(decode_json(_scored(spark, data_dir), POINT_SCHEMA))


def chart_points_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    return chart_points_json(decode_json(_scored(spark, data_dir), POINT_SCHEMA))


def latest_offsets_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    return latest_offsets(_envelope(spark, data_dir))


def latest_offsets_stored(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same of a topic stored by topic and partition, from the footers of its files."""
    topic = files(new_folder(spark, "topic"), partition_by=TOPIC_FOLDERS)
    topic.write(_envelope(spark, data_dir))
    return stored_ends(spark, topic)


def progress_merge(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every progress message with the latest offsets of the input topic, all partitions."""
    latest = latest_offsets(_envelope(spark, data_dir))
    first = latest.filter((F.col("topic") == INPUT_TOPIC) & (F.col("partition") == 0))
    messages = progress_messages(_events(spark, data_dir))
    merged = with_latest_offset(messages, first.select("latest_offset").scalar())
    return with_field(merged, ALL_OFFSETS, offsets_json(latest).scalar())


def progress_table(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = progress_rows(progress_messages(_events(spark, data_dir)))
    source = F.get("sources", F.lit(0))
    return rows.select(
        *("id", "runId", "name", "timestamp", "batchId", "numInputRows"),
        *("inputRowsPerSecond", "processedRowsPerSecond"),
        F.try_element_at("durationMs", F.lit("triggerExecution")).alias("trigger_millis"),
        F.size("sources").alias("sources"),
        source.description.alias("description"),
        source.startOffset.alias("start_offset"),
        source.endOffset.alias("end_offset"),
        source.numInputRows.alias("source_rows"),
        source.inputRowsPerSecond.alias("source_rate"),
    )


def input_lag_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    messages = progress_messages(_events(spark, data_dir))
    lags = input_lag(messages, latest_offsets(_envelope(spark, data_dir)))
    return lags.drop("id", "runId")


def input_lag_as_of(spark: SparkSession, data_dir: str) -> DataFrame:
    """The lag when each event was made: batches that report at the time of their last record."""
    messages = progress_messages(_events(spark, data_dir), made=True)
    lags = input_lag(messages, offsets_by_time(_envelope(spark, data_dir)))
    return lags.drop("id", "runId")


def input_lag_reported(spark: SparkSession, data_dir: str) -> DataFrame:
    """The lag by the latest offsets that the progress itself reports."""
    return input_lag(progress_messages(_events(spark, data_dir), reported=True)).drop("id", "runId")


def feed_json(spark: SparkSession, data_dir: str) -> DataFrame:
    return feed_messages(_transactions(spark, data_dir), "json", key=None)


def feed_csv(spark: SparkSession, data_dir: str) -> DataFrame:
    return feed_messages(_transactions(spark, data_dir), "csv")


def feed_keyed(spark: SparkSession, data_dir: str) -> DataFrame:
    return feed_messages(_transactions(spark, data_dir))


def split_lists(spark: SparkSession, data_dir: str) -> DataFrame:
    """The comma-separated parts of every document's whole text."""
    items = F.posexplode(split_list(F.col("text"))).alias("position", "item")
    return table(spark, data_dir, "documents").select("doc_id", items)


def written_messages(spark: SparkSession, data_dir: str) -> DataFrame:
    """Messages written to a file-backed topic, read back and decoded."""
    topic = files(new_folder(spark, "written"), schema="key string, value string")
    topic.write(feed_messages(_transactions(spark, data_dir)))
    return decode_json(topic.read(spark))


def stream_score_transactions(spark: SparkSession, data_dir: str) -> DataFrame:
    """The flagship as a stream: file source, checkpoint, output topic read back."""
    topic = files(new_folder(spark, "scored"), schema="value string")
    scored = score_messages(envelope(events_stream(spark, data_dir)))
    run_available(scored, topic, new_folder(spark, "checkpoint"))
    return decode_scored(topic.read(spark))


def stream_chart_points(spark: SparkSession, data_dir: str) -> DataFrame:
    """A stream reads a stored scored topic and writes its points."""
    scored = files(new_folder(spark, "scored"), schema="value string")
    points = files(new_folder(spark, "points"), schema="value string")
    scored.write(_scored(spark, data_dir))
    decoded = decode_json(scored.read_stream(spark), POINT_SCHEMA)
    run_available(chart_points_json(decoded), points, new_folder(spark, "checkpoint"))
    return points.read(spark)


def _observed(spark: SparkSession, data_dir: str) -> tuple[Endpoint, Endpoint, str]:
    """The progress and the events of a stream with a micro-batch for each type of event."""
    topic = new_folder(spark, "topic")
    rows = _transactions(spark, data_dir)
    messages = rows.select("category_name", json_value(TRANSACTION_COLUMNS).alias("value"))
    # One file for each type, however large: a rebalance would split large ones.
    dealt = messages.repartition("category_name")
    dealt.write.partitionBy("category_name").parquet(topic)
    source = files(
        topic, schema="value string, category_name string", max_files_per_trigger=1
    )
    progress, events = (
        files(new_folder(spark, kind), schema="key string, value string")
        for kind in ("progress", "lifecycle")
    )
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        query = Endpoint("noop").write_stream(
            score_messages(source.read_stream(spark)),
            new_folder(spark, "checkpoint"),
            {"availableNow": True},
            name="counted",
        )
        run_until_stopped(spark, query, log, progress, events_sink=events)
    finally:
        spark.streams.removeListener(log)
    return progress, events, str(query.id)


def stream_progress(spark: SparkSession, data_dir: str) -> DataFrame:
    """What the listener wrote about a stream: one row for each of its batches."""
    progress, _, query_id = _observed(spark, data_dir)
    # The listener also hears of other streams of the session.
    events = progress_rows(progress.read(spark)).filter(F.col("id") == query_id)
    return events.filter("numInputRows > 0").select(
        "name", F.col("numInputRows").alias("rows_read"), F.size("sources").alias("sources")
    )


def stream_lifecycle(spark: SparkSession, data_dir: str) -> DataFrame:
    """Its start and end events, with the batches and rows that were reported between them."""
    progress, events, query_id = _observed(spark, data_dir)
    fields = F.from_json("value", "event string, id string")
    rows = events.read(spark).select(fields.alias("e")).select("e.*").filter(F.col("id") == query_id)
    reported = progress_rows(progress.read(spark)).filter(F.col("id") == query_id).filter("numInputRows > 0")
    batches = reported.agg(F.countDistinct("batchId")).scalar()
    read = reported.agg(F.coalesce(F.sum("numInputRows"), F.lit(0).cast("long"))).scalar()
    return rows.groupBy("event").agg(F.count("*").alias("events")).select(
        "event", "events", batches.alias("batches"), read.alias("rows_read")
    )


QUERIES: dict[str, Query] = {
    "score_transactions": score_transactions,
    "score_single_warning": score_single_warning,
    "score_single_action": score_single_action,
    "score_csv": score_csv,
    "score_orders": score_orders,
    "score_lineitem": score_lineitem,
    "score_items": score_items,
    "fit_global": fit_global,
    "fit_by_category": fit_by_category,
    "alerts_per_hour": alerts_per_hour,
    "decode_json": decode_json_messages,
    "encode_json": encode_json_messages,
    "encode_csv": encode_csv_messages,
    "decode_csv": decode_csv_messages,
    "decode_scored": decode_scored_messages,
    "misfed_csv": misfed_csv,
    "misfed_documents": misfed_documents,
    "chart_points": chart_points_rows,
    "chart_points_json": chart_points_messages,
    "latest_offsets": latest_offsets_rows,
    "latest_offsets_stored": latest_offsets_stored,
    "progress_merge": progress_merge,
    "progress_rows": progress_table,
    "input_lag": input_lag_rows,
    "input_lag_reported": input_lag_reported,
    "input_lag_as_of": input_lag_as_of,
    "feed_json": feed_json,
    "feed_csv": feed_csv,
    "feed_keyed": feed_keyed,
    "split_lists": split_lists,
    "written_messages": written_messages,
    "stream_score_transactions": stream_score_transactions,
    "stream_chart_points": stream_chart_points,
    "stream_progress": stream_progress,
    "stream_lifecycle": stream_lifecycle,
    **stateful.QUERIES,
}
