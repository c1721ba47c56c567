"""Source offsets as they stand in progress JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART_OFFSETS = "map<string,bigint>"
_TOPIC_OFFSETS = f"map<string,{_PART_OFFSETS}>"
_POSITIONS = "array<struct<topic:string,partition:int,end_offset:bigint,latest_offset:bigint>>"


def positions(end_json: Column, latest_json: Column) -> Column:
    """Two offsets' JSON as one array of ``(topic, partition, end_offset, latest_offset)``.

    A Kafka offset gives one entry for each topic partition of the end offset. A
    plain number (rate source) and an object with ``logOffset`` (file source) give
    one entry without topic and partition. Null gives an empty array.

    Each text is parsed once and the two maps are zipped, so the work grows with
    the number of partitions and not with its square.
    """
    ends = F.from_json(end_json, _TOPIC_OFFSETS)
    latest = F.coalesce(
        F.from_json(latest_json, _TOPIC_OFFSETS), F.create_map().cast(_TOPIC_OFFSETS)
    )
    zipped = F.map_zip_with(
        ends,
        latest,
        lambda topic, end, known: F.map_zip_with(
            end,
            F.coalesce(known, F.create_map().cast(_PART_OFFSETS)),
            lambda partition, at, last: F.struct(at.alias("end"), last.alias("latest")),
        ),
    )
    topics = F.filter(F.map_entries(zipped), lambda topic: topic["value"].isNotNull())
    kafka = F.flatten(
        F.transform(
            topics,
            lambda topic: F.transform(
                F.filter(
                    F.map_entries(topic["value"]), lambda part: part["value"]["end"].isNotNull()
                ),
                lambda part: F.struct(
                    topic["key"], part["key"].try_cast("int"), part["value"]["end"],
                    part["value"]["latest"],
                ),
            ),
        )
    ).cast(_POSITIONS)
    end = F.coalesce(
        end_json.try_cast("bigint"),
        F.get_json_object(end_json, "$.logOffset").try_cast("bigint"),
    )
    single = F.array(
        F.struct(
            F.lit(None).cast("string"),
            F.lit(None).cast("int"),
            end,
            latest_json.try_cast("bigint"),
        )
    ).cast(_POSITIONS)
    return F.coalesce(kafka, F.when(end.isNotNull(), single), F.array().cast(_POSITIONS))


_LATEST_OF_SOURCES = "sources array<struct<latestOffset:string>>"


def _latest_texts(message: Column) -> Column:
    sources = F.from_json(message, _LATEST_OF_SOURCES).sources
    return F.transform(sources, lambda source: source.latestOffset)


def reported_latest(message: Column, topic: str, partition: int) -> Column:
    """The latest offset that a progress message reports for one topic partition.

    Taken from the first source that reports it; a source without topics reports a plain
    number, which counts where no source names the topic. Null where none reports.
    """
    texts = _latest_texts(message)

    def of_topic(text: Column) -> Column:
        parts = F.try_element_at(F.from_json(text, _TOPIC_OFFSETS), F.lit(topic))
        return F.try_element_at(parts, F.lit(str(partition)))

    named = F.filter(F.transform(texts, of_topic), lambda x: x.isNotNull())
    plain = F.filter(
        F.transform(texts, lambda text: text.try_cast("bigint")), lambda x: x.isNotNull()
    )
    return F.coalesce(F.get(named, F.lit(0)), F.get(plain, F.lit(0)))


def all_reported(message: Column) -> Column:
    """What every source reports as its latest offset, all topics and partitions, as a JSON list.

    Null where no source reports any.
    """
    texts = _latest_texts(message)
    listed = F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit("null"))), ",")
    known = F.exists(texts, lambda t: t.isNotNull())
    return F.when(known, F.concat(F.lit("["), listed, F.lit("]")))


def lag(latest: Column, end: Column) -> Column:
    """How far ``end`` is behind ``latest``, never negative; null where one is unknown."""
    return F.when(latest.isNotNull() & end.isNotNull(), F.greatest(latest - end, F.lit(0)))
