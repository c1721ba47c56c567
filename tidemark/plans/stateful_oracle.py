"""The queries of :mod:`tidemark.plans.stateful` in SQL."""

from __future__ import annotations

_FLAGS = """CASE WHEN value > 81.0 THEN 1 ELSE 0 END AS Upper_Warning,
  CASE WHEN value > 114.0 THEN 1 ELSE 0 END AS Upper_Action"""
_PARTS = """WITH bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
parts AS (SELECT *, (epoch_us(ts) - lo) * 8 // (hi - lo + 1) AS part FROM events, bounds)"""
_ZIPS = "(city = 'London' AND zip IN ('WC1V', 'EC1R', 'EC1M', 'EC2A', 'EC4Y')) OR (city = 'Manchester' " \
    "AND zip IN ('M45', 'M61', 'M30', 'M23')) OR (city = 'Cardiff' AND zip IN ('CF15', 'CF14'))"


def oracle(transactions: str, json: str, csv: str) -> dict[str, str]:
    """The SQL by query, given the WITH clause of the transactions ``tx`` and their wire forms."""
    return {
        "stream_once": f"""{transactions}, {_PARTS[5:]}
            SELECT event_id, trans_amt, {_FLAGS}, part AS batch
            FROM parts JOIN tx ON tx.unique_transact_id = CASE WHEN length(CAST(event_id AS VARCHAR)) < 9
              THEN lpad(CAST(event_id AS VARCHAR), 9, '0') ELSE CAST(event_id AS VARCHAR) END""",
        "stream_deduplicated": f"""{transactions}
            SELECT DISTINCT CAST(unique_transact_id AS BIGINT) AS event_id, category_name, trans_amt FROM tx""",
        "stream_alerts": f"""{_PARTS}, marked AS (
              SELECT *, {_FLAGS}, part <= 1 AND event_id % 97 = 5 AS late FROM parts
            ), hours AS (
              SELECT epoch_ms(date_trunc('hour', ts)) AS start, count(*) AS rows,
                sum(Upper_Warning)::BIGINT AS Upper_Warning, sum(Upper_Action)::BIGINT AS Upper_Action
              FROM marked WHERE NOT late GROUP BY 1)
            SELECT *, (SELECT count(*) FROM marked WHERE late) AS late FROM hours
            WHERE start + 3600000 <= (SELECT hi // 1000 - 2 * (hi - lo + 1) // 8 // 1000 FROM bounds)""",
        "stream_thresholds": f"""{_PARTS}, moments AS (
              SELECT versions.part AS version, p.event_type, avg(value) AS mean, stddev_samp(value) AS std
              FROM (SELECT DISTINCT part FROM parts) versions JOIN parts p ON p.part < versions.part
              GROUP BY ALL)
            SELECT event_id, p.event_type AS category_name, part AS version,
              CASE WHEN value > mean + std THEN 1 ELSE 0 END AS Upper_Warning,
              CASE WHEN value > mean + 2 * std THEN 1 ELSE 0 END AS Upper_Action
            FROM parts p LEFT JOIN moments m ON m.version = p.part AND m.event_type = p.event_type""",
        "stream_moments": """
            SELECT event_type AS category_name, count(value) AS n, round(avg(value), 6) AS mean,
              round(stddev_samp(value), 6) AS std
            FROM events GROUP BY event_type""",
        "stream_observed": f"""{_PARTS}
            SELECT part AS "batchId", count(*) AS rows, sum(Upper_Warning)::BIGINT AS Upper_Warning,
              sum(Upper_Action)::BIGINT AS Upper_Action, max(event_id) AS last_id
            FROM (SELECT *, {_FLAGS} FROM parts) GROUP BY part""",
        "quarantined": f"""{transactions}, other AS (
              SELECT {csv} FROM tx UNION ALL SELECT text FROM documents)
            SELECT 'good' AS verdict, unique_transact_id, trans_amt, NULL AS reason, NULL AS digest FROM tx
            UNION ALL
            SELECT 'bad', NULL, NULL, CASE WHEN value IS NULL THEN 'null' WHEN trim(value) = '' THEN 'empty'
              ELSE 'malformed' END, md5(value)
            FROM other""",
        "chart_thinned": """
            WITH points AS (
              SELECT epoch_us(ts) // 1000 AS x, value AS y, epoch_us(ts) // 1000 // 3600000 AS bucket
              FROM events WHERE value IS NOT NULL
            ), placed AS (
              SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY x, y) AS first,
                row_number() OVER (PARTITION BY bucket ORDER BY x DESC, y DESC) AS last,
                row_number() OVER (PARTITION BY bucket ORDER BY y, x) AS low,
                row_number() OVER (PARTITION BY bucket ORDER BY y DESC, x DESC) AS high
              FROM points)
            SELECT DISTINCT bucket, x, y FROM placed WHERE least(first, last, low, high) = 1""",
        "rule_violations": f"""{transactions}, faulty AS (
              SELECT CAST(unique_transact_id AS BIGINT) AS event_id, city,
                CASE WHEN event_id % 11 = 0 THEN 'XX1' ELSE zip END AS zip,
                CASE WHEN event_id % 13 = 0 THEN '12' ELSE card_num END AS card_num,
                CASE WHEN event_id % 17 = 0 THEN 'odd' ELSE chargeback_cat END AS chargeback_cat,
                CASE WHEN event_id % 19 = 0 THEN 'abc' ELSE trans_amt END AS trans_amt,
                CASE WHEN event_id % 23 = 0 THEN NULL ELSE merchant_key END AS merchant_key,
                CASE WHEN event_id % 29 = 0 THEN 'Credit' ELSE card_type END AS card_type,
                CASE WHEN event_id % 31 = 0 THEN 'soon' ELSE trans_time END AS trans_time
              FROM tx)
            SELECT event_id, concat_ws(',',
              CASE WHEN coalesce(TRY_CAST(trans_amt AS DOUBLE), -1) NOT BETWEEN 0 AND 200 THEN 'amount' END,
              CASE WHEN length(card_num) <> 18 THEN 'card' END,
              CASE WHEN card_type NOT IN ('credit', 'debit') THEN 'card_type' END,
              CASE WHEN chargeback_cat NOT IN ('cancelled', 'fraud', 'non_receipt_goods', 'processing_error',
                'request_for_info', 'NA') THEN 'category' END,
              CASE WHEN merchant_key IS NULL THEN 'merchant' END,
              CASE WHEN NOT regexp_matches(trans_time, '^[0-9]{{13}}$') THEN 'time' END,
              CASE WHEN NOT ({_ZIPS}) THEN 'zip' END) AS violations
            FROM faulty""",
    }
