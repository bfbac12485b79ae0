"""Queries over the reply outbox."""

from pyspark.sql import functions as F

from ..operators import outbox as ops
from .fixtures import AS_OF, DAY, OUTBOX_SQL, outbox
from .registry import query

_HORIZON, _TRIES = 400 * DAY, 4
_LIVE = "('pending', 'submitting', 'retryable_pre_dispatch', 'outcome_unknown')"
_PRED = "SELECT 1 FROM outbox p WHERE p.scope = c.scope AND p.message_id = c.message_id AND p.phase = c.phase AND p.ordinal < c.ordinal AND p.status"
_FREE = f"(claim_token IS NULL OR lease_until IS NULL OR lease_until <= {AS_OF})"
_ELIGIBLE = (
    f"c.scope = 'alpha' AND c.status IN {_LIVE} AND c.payload IS NOT NULL AND c.attempts < {_TRIES} AND c.available_at <= {AS_OF} AND c.expires_at > {AS_OF} AND {_FREE} "
    f"AND coalesce(c.first_attempt_at, c.created_at) > {AS_OF - _HORIZON} AND NOT EXISTS ({_PRED} <> 'accepted')"
)
_AT = "CASE WHEN claim_token IS NOT NULL AND lease_until IS NOT NULL THEN greatest(available_at, lease_until) ELSE available_at END"
_RETIRE = f"c.scope = 'alpha' AND c.status IN {_LIVE} AND {_FREE} AND (coalesce(c.first_attempt_at, c.created_at) <= {AS_OF - _HORIZON} OR (c.status <> 'submitting' AND (c.attempts >= {_TRIES} OR EXISTS ({_PRED} IN ('dead', 'permanent_conflict')))))"


def _eligible(spark, sf_dir):
    return ops.eligible_rows(outbox(spark, sf_dir), "alpha", AS_OF, _TRIES, _HORIZON)


@query(f"WITH {OUTBOX_SQL} SELECT id, message_id, phase, ordinal, status, {_AT} AS eligible_at FROM outbox c WHERE {_ELIGIBLE}")
def reply_eligible(spark, sf_dir):
    return _eligible(spark, sf_dir).select("id", "message_id", "phase", "ordinal", "status", "eligible_at")


@query(f"WITH {OUTBOX_SQL} SELECT count(*) AS ready, coalesce(greatest({AS_OF} - min({_AT}), 0), 0) AS oldest_us FROM outbox c WHERE {_ELIGIBLE}")
def reply_ready_snapshot(spark, sf_dir):
    from ..operators.queue import ready_snapshot

    return ready_snapshot(_eligible(spark, sf_dir), AS_OF)


@query(f"WITH {OUTBOX_SQL} SELECT id, message_id, phase, ordinal, room_id, client_request_id, payload, attempts FROM outbox c WHERE {_ELIGIBLE} ORDER BY created_at, id LIMIT 50")
def reply_redrive_topk(spark, sf_dir):
    return ops.redrive(outbox(spark, sf_dir), "alpha", AS_OF, _TRIES, _HORIZON, 50)


@query(f"WITH {OUTBOX_SQL} SELECT id, message_id, phase, ordinal, status, room_id, client_request_id, payload, attempts FROM outbox c WHERE {_RETIRE} ORDER BY created_at, id LIMIT 1000")
def reply_retire(spark, sf_dir):
    return ops.retire(outbox(spark, sf_dir), "alpha", AS_OF, _TRIES, _HORIZON, 1000)


@query(f"WITH {OUTBOX_SQL}, gone AS (SELECT id FROM outbox c WHERE {_RETIRE} ORDER BY created_at, id LIMIT 1000) SELECT status, count(*) AS n, count(payload) AS payloads, count(*) FILTER (WHERE room_id = '') AS scrubbed FROM (SELECT CASE WHEN id IN (SELECT id FROM gone) THEN 'dead' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM gone) THEN NULL ELSE payload END AS payload, CASE WHEN id IN (SELECT id FROM gone) THEN '' ELSE room_id END AS room_id FROM outbox) GROUP BY status")
def reply_retired_state(spark, sf_dir):
    rows = outbox(spark, sf_dir)
    after = ops.retired(rows, ops.retire(rows, "alpha", AS_OF, _TRIES, _HORIZON, 1000))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("payload").alias("payloads"), F.count_if(F.col("room_id") == "").alias("scrubbed"))


@query(f"WITH {OUTBOX_SQL} SELECT status, count(*) AS n FROM outbox WHERE scope = 'alpha' AND status IN {_LIVE} GROUP BY status")
def reply_status_counts(spark, sf_dir):
    return ops.status_counts(outbox(spark, sf_dir), "alpha")


@query(f"WITH {OUTBOX_SQL}, x AS (SELECT c.*, {_ELIGIBLE} AND c.ordinal <= 4 AS hit FROM outbox c) SELECT id, CASE WHEN hit THEN 'submitting' ELSE status END AS status, CASE WHEN hit THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN hit THEN coalesce(first_attempt_at, {AS_OF}) ELSE first_attempt_at END AS first_attempt_at, CASE WHEN hit THEN 'new' ELSE claim_token END AS claim_token, CASE WHEN hit THEN {AS_OF + DAY} ELSE lease_until END AS lease_until FROM x")
def reply_begin_attempt(spark, sf_dir):
    after = ops.begin_attempt(outbox(spark, sf_dir), "alpha", AS_OF, _TRIES, _HORIZON, "new", DAY, F.col("ordinal") <= 4)
    return after.select("id", "status", "attempts", "first_attempt_at", "claim_token", "lease_until")


def _settle(status: str, progressed: bool) -> str:
    final = status in ops.FINAL
    hit = "coalesce(scope = 'alpha' AND claim_token = 'c3', false)"
    sets = {"status": f"'{status}'", "remote_request_id": "coalesce('req-9', remote_request_id)", "payload": "NULL" if final else "payload", "room_id": "''" if final else "room_id", "attempts": "0" if progressed and not final else "attempts", "available_at": str(AS_OF + DAY), "claim_token": "NULL"}
    return f"WITH {OUTBOX_SQL} SELECT id, {', '.join(f'CASE WHEN {hit} THEN {v} ELSE {c} END AS {c}' for c, v in sets.items())}, {hit} AS changed FROM outbox"


_SETTLED = ("id", "status", "remote_request_id", "payload", "room_id", "attempts", "available_at", "claim_token", "changed")


@query(_settle("accepted", True))
def reply_settle_accepted(spark, sf_dir):
    return ops.settle(outbox(spark, sf_dir), "alpha", "c3", AS_OF, "accepted", DAY, True, "req-9").select(*_SETTLED)


@query(_settle("retryable_pre_dispatch", True))
def reply_settle_retry(spark, sf_dir):
    return ops.settle(outbox(spark, sf_dir), "alpha", "c3", AS_OF, "retryable_pre_dispatch", DAY, True, "req-9").select(*_SETTLED)


_STAGE = {"scope": "scope", "message_id": "message_id", "phase": "phase", "ordinal": "CASE WHEN id % 3 = 0 THEN ordinal + 2 WHEN id % 3 = 1 THEN ordinal - 1 ELSE ordinal END", "payload_hash": "CASE WHEN id % 2 = 0 THEN payload_hash ELSE md5('other') END"}
_STAGE_SQL = ", ".join(f"{e} AS {c}" for c, e in _STAGE.items())


@query(
    f"WITH {OUTBOX_SQL}, a AS (SELECT id AS seq, {_STAGE_SQL} FROM outbox), t AS (SELECT a.*, s.payload_hash AS stored, greatest((SELECT max(x.ordinal) FROM outbox x WHERE x.scope = a.scope AND x.message_id = a.message_id AND x.phase = a.phase), max(a.ordinal) OVER (PARTITION BY a.scope, a.message_id, a.phase ORDER BY a.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS top FROM a LEFT JOIN outbox s ON s.scope = a.scope AND s.message_id = a.message_id AND s.phase = a.phase AND s.ordinal = a.ordinal), "
    "f AS (SELECT *, row_number() OVER w AS n, first_value(payload_hash) OVER w AS first_hash, coalesce(first_value(top) OVER w <= ordinal, true) AS first_staged FROM t WINDOW w AS (PARTITION BY scope, message_id, phase, ordinal ORDER BY seq)), h AS (SELECT *, coalesce(stored, CASE WHEN n > 1 AND first_staged THEN first_hash END) AS known FROM f) "
    "SELECT seq, CASE WHEN known = payload_hash THEN 'already_staged' WHEN known IS NOT NULL THEN 'payload_diverged' WHEN top > ordinal THEN 'ordinal_superseded' ELSE 'staged' END AS outcome FROM h"
)
def reply_stage_outcome(spark, sf_dir):
    rows = outbox(spark, sf_dir)
    return ops.stage_outcomes(rows, rows.selectExpr("id AS seq", *[f"{e} AS {c}" for c, e in _STAGE.items()])).select("seq", "outcome")


@query(f"WITH {OUTBOX_SQL} SELECT id, expires_at FROM outbox WHERE scope = 'alpha' AND status <> 'manual_review' AND expires_at <= {AS_OF} ORDER BY expires_at, id LIMIT 400")
def reply_prune(spark, sf_dir):
    return ops.prune_replies(outbox(spark, sf_dir), "alpha", AS_OF, 400).select("id", "expires_at")


@query(f"WITH {OUTBOX_SQL} SELECT status, status IN ('dead', 'permanent_conflict') AS terminal, status IN ('pending', 'retryable_pre_dispatch', 'outcome_unknown') AS resendable, count(*) AS n FROM outbox GROUP BY ALL")
def reply_status_predicates(spark, sf_dir):
    rows = outbox(spark, sf_dir).select("status", ops.is_terminal(F.col("status")).alias("terminal"), ops.is_resendable(F.col("status")).alias("resendable"))
    return rows.groupBy("status", "terminal", "resendable").agg(F.count(F.lit(1)).alias("n"))
