"""The registered queries once more, in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from tidemark.plans.stateful_oracle import oracle
from tidemark.schema import TRANSACTION_COLUMNS

_COLUMNS = ", ".join(TRANSACTION_COLUMNS)
_WARNING = "CASE WHEN TRY_CAST(trans_amt AS DOUBLE) > 81.0 THEN 1 ELSE 0 END AS Upper_Warning"
_ACTION = "CASE WHEN TRY_CAST(trans_amt AS DOUBLE) > 114.0 THEN 1 ELSE 0 END AS Upper_Action"
_FLAGS = f"{_WARNING}, {_ACTION}"


def _padded(text: str, width: int) -> str:
    return f"CASE WHEN length({text}) < {width} THEN lpad({text}, {width}, '0') ELSE {text} END"


def _double_text(value: str) -> str:
    """A double of at least zero in Spark's text form, which has exponents below 1e-3."""
    text = f"CAST({value} AS VARCHAR)"
    figures = f"ltrim({text}, '0.')"
    exponent = f"length({text}) - length({figures}) - 1"
    point = f"substr({figures}, 1, 1) || '.' || coalesce(nullif(substr({figures}, 2), ''), '0')"
    return f"""CASE WHEN {value} >= 0.001 OR {value} = 0 THEN {text}
      WHEN contains({text}, 'e') THEN regexp_replace(regexp_replace({text}, 'e-0?', 'E-'),
        '^([0-9])E', '\\1.0E')
      ELSE {point} || 'E-' || CAST({exponent} AS VARCHAR) END"""


def _one_of(values: str, number: str) -> str:
    listed = values.split(",")
    quoted = ", ".join(f"'{v}'" for v in listed)
    return f"([{quoted}])[CAST({number} % {len(listed)} + 1 AS INTEGER)]"


# The same lists as the fixture's.
_CITY = _one_of("London,Manchester,Cardiff", "user_id")

# Whole milliseconds; epoch_ms would round.
_EVENT_MILLIS = "CAST(epoch_us(ts) // 1000 AS VARCHAR)"

_FROM_EVENT = {
    "unique_transact_id": _padded("CAST(event_id AS VARCHAR)", 9),
    "card_num": _padded("CAST(user_id AS VARCHAR)", 18),
    "processing_flag": "CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END",
    "trans_amt": _double_text("value"),
    "trans_time": _EVENT_MILLIS,
    "card_type": _one_of("credit,debit", "user_id"),
    "merchant_key": _padded("json_extract_string(props, '$.k')", 4),
    "mcc_desc": _padded("CAST(user_id % 10000 AS VARCHAR)", 4),
    "category_name": "event_type",
    "city": _CITY,
    "zip": f"""CASE {_CITY}
      WHEN 'London' THEN {_one_of("WC1V,EC1R,EC1M,EC2A,EC4Y", "event_id")}
      WHEN 'Manchester' THEN {_one_of("M45,M61,M30,M23", "event_id")}
      WHEN 'Cardiff' THEN {_one_of("CF15,CF14", "event_id")} END""",
    "chrgbck_amt": _double_text("(value / 4)"),
    "chargeback_cat": _one_of(
        "cancelled,fraud,non_receipt_goods,processing_error,request_for_info,NA", "event_id"
    ),
    "chargeback_res": _one_of("charged_back,open,represented,NA", "event_id"),
}


def _rows(columns: dict[str, str]) -> str:
    listed = ",\n  ".join(f"{columns[c]} AS {c}" for c in TRANSACTION_COLUMNS)
    return f"SELECT\n  {listed}\nFROM events"


_TX = f"WITH tx AS ({_rows(_FROM_EVENT)})"
_PACKED = ", ".join(f"{c} := {c}" for c in TRANSACTION_COLUMNS)
_JSON = f"CAST(to_json(struct_pack({_PACKED})) AS VARCHAR) AS value"
_SCORED_JSON = (
    f"CAST(to_json(struct_pack({_PACKED}, Upper_Warning := Upper_Warning, "
    "Upper_Action := Upper_Action)) AS VARCHAR) AS value"
)
_POINT = (
    "CAST(to_json(struct_pack(x := [trans_time], y := [trans_amt])) AS VARCHAR) AS value"
)
_CSV = f"concat_ws(',', {_COLUMNS}) AS value"
_NULLS = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in TRANSACTION_COLUMNS)
_ALL_NULL = f"SELECT {_NULLS}, 0 AS Upper_Warning, 0 AS Upper_Action"
_SCORED_ROWS = f"SELECT {_COLUMNS}, {_FLAGS} FROM tx"

_OFFSETS = """offsets AS (
  SELECT 'input' AS topic, CAST(event_id % 4 AS INTEGER) AS partition,
    max(event_id // 4) + 1 AS latest_offset
  FROM events GROUP BY 2)"""
_BATCH_ENDS = """ends AS (
  SELECT event_id // 1000 AS batchId, CAST(event_id % 4 AS INTEGER) AS partition,
    max(event_id // 4) + 1 AS end_offset
  FROM events GROUP BY 1, 2),
sizes AS (SELECT event_id // 1000 AS batchId, count(*) AS n FROM events GROUP BY 1)"""
_BATCHES = """batches AS (
  SELECT event_id // 1000 AS batchId, count(*) AS n,
    max(CASE WHEN event_id % 4 = 0 THEN event_id // 4 END) + 1 AS e0,
    max(CASE WHEN event_id % 4 = 1 THEN event_id // 4 END) + 1 AS e1,
    max(CASE WHEN event_id % 4 = 2 THEN event_id // 4 END) + 1 AS e2,
    max(CASE WHEN event_id % 4 = 3 THEN event_id // 4 END) + 1 AS e3
  FROM events GROUP BY 1)"""

_SOURCE = """struct_pack(
            description := 'events',
            startOffset := struct_pack(input := struct_pack(
              "0" := greatest(e0 - 250, 0), "1" := greatest(e1 - 250, 0),
              "2" := greatest(e2 - 250, 0), "3" := greatest(e3 - 250, 0))),
            endOffset := struct_pack(
              input := struct_pack("0" := e0, "1" := e1, "2" := e2, "3" := e3)),
            numInputRows := n, inputRowsPerSecond := n / 8, processedRowsPerSecond := n / 4)"""

_ITEMS = """
  WITH items AS (
    SELECT doc_id, CAST(place AS INTEGER) AS position, parts[place + 1] AS item
    FROM (
      SELECT doc_id, parts, unnest(range(len(parts))) AS place
      FROM (
        SELECT doc_id, CASE WHEN text <> '' AND rtrim(text, ',') = '' THEN []
          ELSE string_split(rtrim(text, ','), ',') END AS parts
        FROM documents)))"""

ORACLE_SQL: dict[str, str] = {
    "score_transactions": f"{_TX} SELECT *, {_FLAGS} FROM tx",
    "score_single_warning": f"{_TX} SELECT *, {_WARNING} FROM tx",
    "score_single_action": f"{_TX} SELECT *, {_ACTION} FROM tx",
    "score_csv": f"{_TX} SELECT *, {_FLAGS} FROM tx",
    "score_orders": """
        SELECT o_orderkey, o_totalprice,
          CASE WHEN o_totalprice > 190000.0 THEN 1 ELSE 0 END AS high_total,
          CASE WHEN o_totalprice > 270000.0 THEN 1 ELSE 0 END AS extreme_total,
          CASE WHEN o_totalprice > 190000.0 THEN 1 ELSE 0 END AS repeated_flag
        FROM orders""",
    "score_lineitem": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
          CASE WHEN l_extendedprice > 60000.0 THEN 1 ELSE 0 END AS high_price,
          CASE WHEN l_quantity > 35.0 THEN 1 ELSE 0 END AS high_quantity
        FROM lineitem""",
    "fit_global": """
        SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
        FROM events""",
    "fit_by_category": """
        SELECT event_type AS category_name, count(value) AS n, round(avg(value), 6) AS mean,
          round(stddev_samp(value), 6) AS std
        FROM events GROUP BY event_type""",
    "alerts_per_hour": """
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS step, count(*) AS rows,
          CAST(sum(CASE WHEN value > 81.0 THEN 1 ELSE 0 END) AS BIGINT) AS Upper_Warning,
          CAST(sum(CASE WHEN value > 114.0 THEN 1 ELSE 0 END) AS BIGINT) AS Upper_Action
        FROM events GROUP BY 1""",
    "decode_json": f"{_TX} SELECT * FROM tx",
    "encode_json": f"{_TX} SELECT {_SCORED_JSON} FROM (SELECT *, {_FLAGS} FROM tx)",
    "encode_csv": f"{_TX} SELECT {_CSV} FROM tx",
    "decode_csv": f"{_TX} SELECT * FROM tx",
    "decode_scored": f"{_TX} SELECT *, {_FLAGS} FROM tx",
    "misfed_csv": f"{_TX} {_ALL_NULL} FROM events UNION ALL {_SCORED_ROWS}",
    "misfed_documents": f"{_TX} {_ALL_NULL} FROM documents UNION ALL {_SCORED_ROWS}",
    "chart_points": f"{_TX} SELECT trans_time AS x, trans_amt AS y FROM tx",
    "chart_points_json": f"{_TX} SELECT {_POINT} FROM tx",
    "latest_offsets": f"WITH {_OFFSETS} SELECT topic, partition, latest_offset FROM offsets",
    "latest_offsets_stored": f"WITH {_OFFSETS} SELECT topic, partition, latest_offset FROM offsets",
    "progress_merge": f"""
        WITH {_OFFSETS}, {_BATCHES}
        SELECT regexp_replace(CAST(to_json(struct_pack(
          id := '00000000-0000-0000-0000-000000000001',
          runId := '00000000-0000-0000-0000-000000000002',
          name := 'score', "timestamp" := '2024-01-01T00:00:00.000Z',
          batchId := batchId, numInputRows := n,
          inputRowsPerSecond := n / 8, processedRowsPerSecond := n / 4,
          durationMs := struct_pack(triggerExecution := batchId + 7),
          sources := [{_SOURCE}],
          sink := struct_pack(description := 'sink', b := 200.0::DOUBLE,
            a := '#' || CAST(1000000000000000000000000000000::HUGEINT + batchId AS VARCHAR) || '#'),
          latestOffset := struct_pack(latestOffset :=
            (SELECT latest_offset FROM offsets WHERE partition = 0)),
          latestOffsets := struct_pack(input := struct_pack(
            "0" := (SELECT latest_offset FROM offsets WHERE partition = 0),
            "1" := (SELECT latest_offset FROM offsets WHERE partition = 1),
            "2" := (SELECT latest_offset FROM offsets WHERE partition = 2),
            "3" := (SELECT latest_offset FROM offsets WHERE partition = 3)))
        )) AS VARCHAR), '"#([0-9]+)#"', '\\1') AS value
        FROM batches""",
    "progress_rows": f"""
        WITH {_BATCHES}, sources AS (SELECT *, {_SOURCE} AS source FROM batches)
        SELECT '00000000-0000-0000-0000-000000000001' AS id,
          '00000000-0000-0000-0000-000000000002' AS "runId",
          'score' AS name, '2024-01-01T00:00:00.000Z' AS timestamp, batchId, n AS numInputRows,
          n / 8 AS inputRowsPerSecond, n / 4 AS processedRowsPerSecond,
          batchId + 7 AS trigger_millis, 1 AS sources, source.description AS description,
          CAST(to_json(source.startOffset) AS VARCHAR) AS start_offset,
          CAST(to_json(source.endOffset) AS VARCHAR) AS end_offset,
          n AS source_rows, n / 8 AS source_rate
        FROM sources""",
    "input_lag": f"""
        WITH {_OFFSETS}, {_BATCH_ENDS}
        SELECT batchId, 0 AS source, topic, partition, end_offset, latest_offset,
          greatest(latest_offset - end_offset, 0) AS lag
        FROM ends LEFT JOIN offsets USING (partition)""",
    "input_lag_reported": f"""
        WITH {_BATCH_ENDS}
        SELECT batchId, 0 AS source, 'input' AS topic, partition, end_offset,
          end_offset + n // 4 AS latest_offset, n // 4 AS lag
        FROM ends JOIN sizes USING (batchId)""",
    "input_lag_as_of": f"""
        WITH {_BATCH_ENDS}, records AS (
          SELECT ts, CAST(event_id % 4 AS INTEGER) AS partition, event_id // 4 AS "offset" FROM events
        ), batch_times AS (
          SELECT event_id // 1000 AS batchId, max(ts) AS made FROM events GROUP BY 1
        )
        SELECT batchId, 0 AS source, 'input' AS topic, partition, end_offset, latest_offset,
          CASE WHEN latest_offset > end_offset THEN latest_offset - end_offset
            WHEN latest_offset IS NOT NULL THEN 0 END AS lag
        FROM (
          SELECT batchId, ends.partition, end_offset, max("offset") + 1 AS latest_offset
          FROM ends JOIN batch_times USING (batchId)
          LEFT JOIN records ON records.partition = ends.partition
            AND records.ts <= date_trunc('milliseconds', batch_times.made)
          GROUP BY ALL)""",
    "feed_json": f"{_TX} SELECT {_JSON} FROM tx",
    "feed_csv": f"{_TX} SELECT card_num AS key, {_CSV} FROM tx",
    "feed_keyed": f"{_TX} SELECT card_num AS key, {_JSON} FROM tx",
    "split_lists": f"{_ITEMS} SELECT doc_id, position, item FROM items",
    "score_items": f"""
        SELECT event_id, CAST(place AS INTEGER) AS position, parts[place + 1] AS item,
          CASE WHEN TRY_CAST(parts[place + 1] AS DOUBLE) > 81.0 THEN 1 ELSE 0 END AS high_item
        FROM (
          SELECT event_id, parts, unnest(range(len(parts))) AS place
          FROM (
            SELECT event_id,
              [{_double_text("value")}, event_type, json_extract_string(props, '$.k')] AS parts
            FROM events))""",
    "written_messages": f"{_TX} SELECT * FROM tx",
    "stream_score_transactions": f"{_TX} SELECT *, {_FLAGS} FROM tx",
    "stream_chart_points": f"{_TX} SELECT {_POINT} FROM tx",
    "stream_progress": """
        SELECT 'counted' AS name, count(*) AS rows_read, 1 AS sources FROM events GROUP BY event_type""",
    "stream_lifecycle": """
        SELECT event, 1 AS events, count(DISTINCT event_type) AS batches, count(*) AS rows_read
        FROM events, (VALUES ('started'), ('terminated')) AS seen(event) GROUP BY event""",
    **oracle(_TX, _JSON, _CSV),
}
