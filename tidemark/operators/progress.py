"""Stream progress as tables: offsets, merged progress messages, input lag."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import text_of
from tidemark.functions.offsets import lag, positions
from tidemark.schema import PROGRESS_SCHEMA

LATEST_OFFSET = "latestOffset"
LAG_SALTS = 16
_TEXT, _FIELD, _FIELDS, _OPTIONS, _OTHERS = "_text", "_field", "_fields", "_options", "_others"
_SPACES = " \t\r\n"
_EVENT = ("id", "runId", "batchId", "source")


def latest_offsets(envelope: DataFrame) -> DataFrame:
    """For every topic partition, the offset that the next record will get.

    Reads three columns. The maximum is combined within each task before the
    shuffle, so a partition that holds most of the records costs no more there
    than any other.
    """
    return envelope.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("latest_offset")
    )


def offsets_json(latest: DataFrame) -> DataFrame:
    """Offsets of all topics and partitions, a result of :func:`latest_offsets`, as one JSON text.

    One row, ``{"topic":{"partition":N}}``; it has an entry for each topic partition.
    """
    part = F.struct(F.col("partition"), F.col("latest_offset"))
    parts = latest.groupBy("topic").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    by_part = F.map_from_entries(
        F.transform("parts", lambda p: F.struct(p.partition.cast("string"), p.latest_offset))
    )
    # Without ``{"t":`` and ``}`` this is the topic as a JSON string.
    quoted = F.to_json(F.struct(F.col("topic").alias("t")))
    name = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    text = F.concat(name, F.lit(":"), F.to_json(by_part))
    listed = F.array_join(F.sort_array(F.collect_list(text)), ",")
    return parts.agg(F.concat(F.lit("{"), listed, F.lit("}")).alias("offsets"))


def with_latest_offset(progress: DataFrame, latest: Column, value: str = "value") -> DataFrame:
    """Progress messages with a top-level ``"latestOffset":{"latestOffset":N}``.

    Where ``latest`` is null the message stays as it is. See :func:`with_field`.
    """
    offset = F.to_json(F.struct(latest.cast("bigint").alias(LATEST_OFFSET)))
    return with_field(progress, LATEST_OFFSET, F.nullif(offset, F.lit("{}")), value)


def with_field(progress: DataFrame, name: str, json: Column, value: str = "value") -> DataFrame:
    """JSON objects with one more top-level field, whose text is ``json``.

    The field is put before the closing brace, so the text of all others stays as it
    is: numbers, order and spaces. An earlier top-level field of that name is taken out
    if it is a plain value or an object of plain values. A message stays unchanged where
    ``json`` is null or where the field can't be added: one that is no JSON object, has
    text after it, repeats a name, or has an earlier field that can't be taken out.
    """
    # Projections of their own, so that each text is parsed once and a subquery runs once.
    given = progress.withColumns({_TEXT: text_of(value), _FIELD: json})
    fields = given.withColumn(_FIELDS, _fields(F.col(_TEXT)))
    quoted = re.escape(f'"{name}"')
    plain = r'(?:"(?:[^"\\]|\\.)*+"|[-+.\w]++)'
    member = rf'{quoted}\s*+:\s*+(?:{plain}|\{{\s*+(?:{plain}\s*+:\s*+{plain}\s*+,?\s*+)*+\}})\s*+'
    found = F.map_contains_key(_FIELDS, F.lit(name))
    text = F.rtrim(F.col(_TEXT), F.lit(_SPACES))
    last = F.regexp_replace(text, rf"(?s)^(.*?),?\s*+{member}(?=\}}$)", "$1")
    first = F.regexp_replace(text, rf"(?s)^(\s*+\{{\s*+){member},?", "$1")
    middle = F.regexp_replace(text, rf"(?s)^(.*),\s*+{member}(?=,)", "$1")
    options = F.when(found, F.array(last, first, middle)).otherwise(F.array(text))
    added = F.transform(options, lambda option: _inserted(option, name, F.col(_FIELD)))
    others = F.map_filter(_FIELDS, lambda key, _: key != name)
    right = fields.withColumn(_OPTIONS, added).withColumn(_OTHERS, F.to_json(others))
    fits = F.filter(_OPTIONS, lambda option: _adds(option, name, F.col(_FIELD), F.col(_OTHERS)))
    merged = F.when(F.col(_FIELDS).isNotNull(), F.get(fits, F.lit(0)))
    result = right.withColumn(value, F.coalesce(merged, _TEXT))
    return result.drop(_TEXT, _FIELD, _FIELDS, _OPTIONS, _OTHERS)


def _fields(text: Column) -> Column:
    """A JSON object as a map of its fields; null if it is none or repeats a name."""
    object_ = F.when(F.ltrim(text, F.lit(_SPACES)).startswith("{"), F.try_parse_json(text))
    return object_.try_cast("map<string,variant>")


def _inserted(text: Column, name: str, json: Column) -> Column:
    body = F.rtrim(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(_SPACES))
    comma = F.when(F.ltrim(body, F.lit(_SPACES)) == "{", "").otherwise(",")
    whole = F.concat(body, comma, F.lit(f'"{name}":'), json, F.lit("}"))
    return F.when(text.endswith("}"), whole)


def _adds(text: Column, name: str, json: Column, others: Column) -> Column:
    """Whether ``text`` has the field and besides it the same fields as before."""
    fields = _fields(text)
    rest = F.to_json(F.map_filter(fields, lambda key, _: key != name))
    same = F.to_json(F.try_element_at(fields, F.lit(name))) == F.to_json(F.try_parse_json(json))
    return F.coalesce(same & (rest == others), F.lit(False))


def progress_rows(progress: DataFrame, value: str = "value") -> DataFrame:
    """Progress messages as typed columns, one row per event."""
    return progress.select(F.from_json(text_of(value), PROGRESS_SCHEMA).alias("p")).select("p.*")


def offsets_by_time(envelope: DataFrame) -> DataFrame:
    """S6 over time: for every topic partition, the next offset after each timestamp.

    Reads four columns. Records of the same time are combined before the shuffle.
    """
    return envelope.groupBy("topic", "partition", "timestamp").agg(
        (F.max("offset") + 1).alias("latest_offset")
    )


def input_lag(
    progress: DataFrame,
    latest: DataFrame | None = None,
    value: str = "value",
    salts: int = LAG_SALTS,
) -> DataFrame:
    """The lag of every source partition, one row for each progress event.

    The latest offset is the one in the event, as Kafka and rate sources report
    it, and otherwise that of ``latest``. A result of :func:`latest_offsets` tells today's
    end, so the lag is then that of the event's position as of now. One of
    :func:`offsets_by_time` tells the end when the event was made. A source that reports
    no offsets keeps one row with a null lag.

    Every event brings a row for the same few topic partitions, so the join key is
    salted and ``latest`` is repeated for each salt. There is no broadcast hint, because
    nothing bounds the number of topic partitions; adaptive execution broadcasts
    ``latest`` when its real size allows.
    """
    events = progress_rows(progress, value).select(
        "id", "runId", "timestamp", "batchId", F.posexplode_outer("sources").alias("source", "s")
    )
    offsets = positions(F.col("s.endOffset"), F.col("s.latestOffset"))
    rows = events.withColumn("at", F.explode_outer(offsets))
    rows = rows.select(*_EVENT, F.col("timestamp").try_cast("timestamp").alias("made"), "at.*")
    if latest is not None:
        salt = F.pmod(F.xxhash64(*_EVENT), F.lit(salts)).cast("int")
        every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        rows = rows.withColumn("salt", salt)
        columns = ["topic", "partition", F.col("latest_offset").alias("probed")]
        if "timestamp" in latest.columns:
            probed = _as_of(rows, latest.select(*columns, "timestamp"))
            rows = rows.join(probed, ["topic", "partition", "made"], "left")
        else:
            probed = latest.select(*columns, every_salt.alias("salt"))
            rows = rows.join(probed, ["topic", "partition", "salt"], "left")
        rows = rows.withColumn("latest_offset", F.coalesce("latest_offset", "probed"))
    return rows.select(
        *_EVENT,
        "topic",
        "partition",
        "end_offset",
        "latest_offset",
        lag(F.col("latest_offset"), F.col("end_offset")).alias("lag"),
    )


def _as_of(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """``topic, partition, made, probed``: the newest offset at or before each time of an event.

    A running maximum within each hour of a topic partition, and one over its hours, so
    that no window holds more than an hour of one partition.
    """
    key = ["topic", "partition"]
    made = rows.filter("made IS NOT NULL").select(*key, F.col("made").alias("timestamp")).distinct()
    nothing = F.lit(None).cast("bigint").alias("probed")
    points = latest.select(*key, "timestamp", "probed", F.lit(False).alias("event"))
    points = points.union(made.select(*key, "timestamp", nothing, F.lit(True).alias("event")))
    points = points.withColumn("hour", F.date_trunc("hour", "timestamp"))
    within = Window.partitionBy(*key, "hour").orderBy("timestamp")
    so_far = Window.partitionBy(*key).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = points.groupBy(*key, "hour").agg(F.max("probed").alias("top"))
    hours = hours.select(*key, "hour", F.max("top").over(so_far).alias("before"))
    events = points.withColumn("here", F.max("probed").over(within)).filter("event")
    return events.join(hours, [*key, "hour"]).select(
        *key, F.col("timestamp").alias("made"), F.greatest("here", "before").alias("probed")
    )
