"""Queue and event tables derived from the driver's tables, by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

DAY = 86_400_000_000
#: 2000-06-01 in microseconds.
AS_OF = 959_817_600_000_000

_SPARK_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"
_DUCK_US = "epoch_us({})"

INBOX = {
    "id": "o_orderkey",
    "scope": "CASE WHEN o_orderkey % 3 = 0 THEN 'alpha' ELSE 'beta' END",
    "message_id": "concat('m', CAST(o_orderkey AS STRING))",
    "ordering_key": "concat('k', CAST(o_custkey AS STRING))",
    "payload": "concat('{\"p\": ', CAST(o_orderkey % 50 AS STRING), '}')",
    "status": "CASE WHEN o_orderkey % 10 < 4 THEN 'pending' WHEN o_orderkey % 10 < 6 THEN 'processing' WHEN o_orderkey % 10 < 9 THEN 'completed' ELSE 'manual_review' END",
    "attempts": "CAST(o_orderkey % 5 AS INT)",
    "available_at": f"{{us:o_orderdate}} + (o_orderkey % 7) * {DAY}",
    "claim_token": "CASE WHEN o_orderkey % 10 IN (4, 5) THEN concat('t', CAST(o_orderkey % 13 AS STRING)) END",
    "lease_until": f"CASE WHEN o_orderkey % 10 IN (4, 5) THEN {{us:o_orderdate}} + (o_orderkey % 400) * {DAY} END",
    "terminal_at": f"CASE WHEN o_orderkey % 10 >= 6 THEN {{us:o_orderdate}} + {DAY} END",
    "terminal_reason": "CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 4 <> 1 THEN 'poison' WHEN o_orderkey % 10 = 6 AND o_orderkey % 3 = 0 THEN ' ' END",
    "created_at": f"{{us:o_orderdate}} - (o_orderkey % 3) * {DAY}",
}
OUTBOX = {
    "id": "l_orderkey * 100 + l_linenumber * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END",
    "scope": "CASE WHEN l_orderkey % 3 = 0 THEN 'alpha' ELSE 'beta' END",
    "message_id": "concat('m', CAST(l_orderkey AS STRING))",
    "phase": "l_returnflag",
    "ordinal": "l_linenumber",
    "room_id": "CASE WHEN (l_orderkey + l_linenumber) % 11 IN (4, 5, 6, 7, 8) THEN '' ELSE concat('r', CAST(l_orderkey % 37 AS STRING)) END",
    "client_request_id": "concat('request-', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING))",
    "payload": "CASE WHEN (l_orderkey + l_linenumber) % 11 IN (4, 5, 6, 7, 8) THEN NULL ELSE concat('{\"part\": ', CAST(part AS STRING), '}') END",
    "payload_hash": "md5(CAST(part AS STRING))",
    "status": "CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'submitting' WHEN 2 THEN 'retryable_pre_dispatch' WHEN 3 THEN 'outcome_unknown' WHEN 9 THEN 'pending' WHEN 10 THEN 'manual_review' WHEN 8 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'dead' ELSE 'permanent_conflict' END ELSE 'accepted' END",
    "attempts": "CAST(part % 6 AS INT)",
    "available_at": f"{{us:ship}} + (l_orderkey % 5) * {DAY}",
    "first_attempt_at": f"CASE WHEN part % 2 = 0 THEN {{us:ship}} + {DAY} END",
    "remote_request_id": "CASE WHEN part % 4 = 0 THEN concat('q', CAST(part AS STRING)) END",
    "claim_token": "CASE WHEN (l_orderkey + l_linenumber) % 11 IN (1, 3) THEN concat('c', CAST(l_orderkey % 17 AS STRING)) END",
    "lease_until": f"CASE WHEN (l_orderkey + l_linenumber) % 11 = 1 THEN {{us:ship}} + (l_orderkey % 300) * {DAY} END",
    "created_at": "{us:ship}",
    "expires_at": f"{{us:ship}} + 900 * {DAY}",
}
_OUTBOX_ROWS = "SELECT l_orderkey, l_returnflag, l_linenumber, min(l_partkey) AS part, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber"


def _us(text: str, form: str) -> str:
    import re

    return re.sub(r"\{us:(\w+)\}", lambda m: form.format(m[1]), text)


def _list(columns: dict[str, str], form: str) -> str:
    return ", ".join(f"{_us(e, form)} AS {c}" for c, e in columns.items())


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{_us(e, _SPARK_US)} AS {c}" for c, e in INBOX.items()])


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg({"l_partkey": "min", "l_shipdate": "min"})
    rows = rows.withColumnsRenamed({"min(l_partkey)": "part", "min(l_shipdate)": "ship"})
    return rows.selectExpr(*[f"{_us(e, _SPARK_US)} AS {c}" for c, e in OUTBOX.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, user_id, event_type, cents (value in hundredths) and k (of props)."""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_SPARK_US.format('ts')} AS us", "user_id", "event_type", "CAST(round(value * 100) AS BIGINT) AS cents", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")


#: The same as CTEs; they stand after WITH.
INBOX_SQL = f"inbox AS (SELECT {_list(INBOX, _DUCK_US)} FROM orders)"
OUTBOX_SQL = f"outbox AS (SELECT {_list(OUTBOX, _DUCK_US)} FROM ({_OUTBOX_ROWS}))"
EVENTS_SQL = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"
