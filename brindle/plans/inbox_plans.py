"""Queries over the inbox and nonce tables."""

from pyspark.sql import functions as F

from ..operators import queue, state
from .fixtures import AS_OF, DAY, EVENTS_SQL, INBOX_SQL, events, inbox
from .registry import query

_ELIGIBLE = f"available_at <= {AS_OF} AND (status = 'pending' OR (status = 'processing' AND lease_until <= {AS_OF}))"
_HEADS = "heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ordering_key ORDER BY id) AS rn FROM inbox WHERE scope = 'alpha' AND status IN ('pending', 'processing')) WHERE rn = 1)"
_READY = f"ready AS (SELECT *, CASE WHEN status = 'processing' THEN greatest(available_at, lease_until) ELSE available_at END AS eligible_at FROM heads WHERE {_ELIGIBLE})"
_CHOSEN = "chosen AS (SELECT * FROM ready ORDER BY available_at, created_at, id LIMIT 100)"
_TOKEN = "t4"
_FENCE = f"scope = 'alpha' AND status = 'processing' AND claim_token = '{_TOKEN}'"
_STATE = ("id", "status", "attempts", "payload", "available_at", "claim_token", "lease_until", "terminal_at", "terminal_reason")


@query(f"WITH {INBOX_SQL}, {_HEADS} SELECT id, ordering_key, status, created_at FROM heads")
def inbox_heads(spark, sf_dir):
    return queue.heads(inbox(spark, sf_dir), "alpha").select("id", "ordering_key", "status", "created_at")


@query(f"WITH {INBOX_SQL} SELECT DISTINCT scope, ordering_key, first_value(id) OVER w AS first_created_id, min(id) OVER (PARTITION BY scope, ordering_key) AS least_id FROM inbox WHERE status IN ('pending', 'processing') WINDOW w AS (PARTITION BY scope, ordering_key ORDER BY created_at, id) QUALIFY first_created_id <> least_id")
def inbox_head_mismatch(spark, sf_dir):
    return queue.head_mismatches(inbox(spark, sf_dir))


@query(f"WITH {INBOX_SQL}, {_HEADS}, {_READY}, {_CHOSEN} SELECT id, message_id, ordering_key, payload, 'token-1' AS claim_token, attempts + 1 AS attempts, created_at, eligible_at FROM chosen")
def inbox_claim_batch(spark, sf_dir):
    return queue.claim(inbox(spark, sf_dir), "alpha", AS_OF, DAY, "token-1", 100)[0]


@query(f"WITH {INBOX_SQL}, {_HEADS}, {_READY}, {_CHOSEN}, after AS (SELECT scope, CASE WHEN id IN (SELECT id FROM chosen) THEN 'processing' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM chosen) THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN id IN (SELECT id FROM chosen) THEN 'token-1' ELSE claim_token END AS claim_token FROM inbox) SELECT scope, status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (WHERE claim_token = 'token-1') AS claimed FROM after GROUP BY ALL")
def inbox_claim_after(spark, sf_dir):
    after = queue.claim(inbox(spark, sf_dir), "alpha", AS_OF, DAY, "token-1", 100)[1]
    return after.groupBy("scope", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"), F.count_if(F.col("claim_token") == "token-1").alias("claimed"))


@query(f"WITH {INBOX_SQL}, {_HEADS}, {_READY} SELECT count(*) AS ready, coalesce(greatest({AS_OF} - min(eligible_at), 0), 0) AS oldest_us FROM ready")
def inbox_ready_snapshot(spark, sf_dir):
    return queue.ready_snapshot(queue.ready(inbox(spark, sf_dir), "alpha", AS_OF), AS_OF)


@query(
    f"WITH {INBOX_SQL}, s AS (SELECT status, CASE status WHEN 'pending' THEN available_at WHEN 'processing' THEN lease_until END AS due_at FROM inbox WHERE scope = 'alpha' AND status <> 'completed') SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, "
    f"count(*) FILTER (WHERE status = 'manual_review') AS manual_review, count(*) FILTER (WHERE due_at <= {AS_OF}) AS due, coalesce(greatest({AS_OF} - min(due_at) FILTER (WHERE due_at <= {AS_OF}), 0), 0) AS oldest_due_us FROM s"
)
def inbox_runtime_snapshot(spark, sf_dir):
    return queue.runtime_snapshot(inbox(spark, sf_dir), "alpha", AS_OF)


_BLANK = "length(trim(coalesce(terminal_reason, ''))) = 0"


@query(
    f"WITH {INBOX_SQL} SELECT id, 'terminal_reason' AS rule FROM inbox WHERE NOT ((status = 'manual_review' AND NOT {_BLANK}) OR (status = 'completed' AND (terminal_reason IS NULL OR NOT {_BLANK})) OR (status NOT IN ('manual_review', 'completed') AND terminal_reason IS NULL)) "
    "UNION ALL SELECT id, 'lease' FROM inbox WHERE NOT coalesce((status = 'pending' AND claim_token IS NULL AND lease_until IS NULL AND terminal_at IS NULL) OR (status = 'processing' AND claim_token IS NOT NULL AND lease_until IS NOT NULL AND terminal_at IS NULL) OR (status IN ('completed', 'manual_review') AND claim_token IS NULL AND lease_until IS NULL AND terminal_at IS NOT NULL), false)"
)
def inbox_status_violations(spark, sf_dir):
    return queue.violations(inbox(spark, sf_dir))


def _after(cond: str, **to: str) -> str:
    """SQL of a transition of the inbox."""
    parts = [f"CASE WHEN coalesce({cond}, false) THEN {to[c]} ELSE {c} END AS {c}" if c in to else c for c in _STATE]
    return f"WITH {INBOX_SQL} SELECT {', '.join(parts)}, coalesce({cond}, false) AS changed FROM inbox"


@query(_after(f"{_FENCE} AND lease_until > {AS_OF}", status="'completed'", payload="'{}'", claim_token="NULL", lease_until="NULL", terminal_at=str(AS_OF), terminal_reason="'done'"))
def inbox_complete_fenced(spark, sf_dir):
    return queue.complete(inbox(spark, sf_dir), "alpha", _TOKEN, AS_OF, "done").select(*_STATE, "changed")


@query(_after(_FENCE, status="'pending'", claim_token="NULL", lease_until="NULL", available_at=str(AS_OF + DAY)))
def inbox_release(spark, sf_dir):
    return queue.release(inbox(spark, sf_dir), "alpha", _TOKEN, AS_OF, DAY).select(*_STATE, "changed")


@query(_after(_FENCE, status="'pending'", attempts="greatest(attempts - 1, 0)", claim_token="NULL", lease_until="NULL", available_at=str(AS_OF + 2 * DAY)))
def inbox_defer(spark, sf_dir):
    return queue.defer(inbox(spark, sf_dir), "alpha", _TOKEN, AS_OF, 2 * DAY).select(*_STATE, "changed")


@query(_after(_FENCE, lease_until=str(AS_OF + 3 * DAY)))
def inbox_renew_lease(spark, sf_dir):
    return queue.renew(inbox(spark, sf_dir), "alpha", _TOKEN, AS_OF, 3 * DAY).select(*_STATE, "changed")


@query(_after(_FENCE, status="'manual_review'", payload="'{}'", claim_token="NULL", lease_until="NULL", terminal_at=str(AS_OF), terminal_reason="'checked'"))
def inbox_manual_review(spark, sf_dir):
    return queue.manual_review(inbox(spark, sf_dir), "alpha", _TOKEN, AS_OF, "checked", scrub=True).select(*_STATE, "changed")


@query(_after(f"{_FENCE} AND id NOT IN (524, 914, 1434)", status="'pending'", attempts="greatest(attempts - 1, 0)", claim_token="NULL", lease_until="NULL"))
def inbox_release_token(spark, sf_dir):
    return queue.release_token(inbox(spark, sf_dir), "alpha", _TOKEN, [524, 914, 1434]).select(*_STATE, "changed")


_DECISIONS = {
    "id": "id", "message_id": "message_id", "claim_token": "CASE WHEN id % 20 = 4 THEN 'stale' ELSE coalesce(claim_token, '') END", "attempts": "CASE WHEN id % 7 = 0 THEN attempts + 1 ELSE attempts END", "lease_until": "lease_until",
    "status": "CASE id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'manual_review' END", "reason": "CASE WHEN id % 3 = 2 THEN 'recovered' ELSE '' END",
}
_D = ", ".join(f"{e} AS d_{c}" for c, e in _DECISIONS.items())
_HIT = "i.scope = 'beta' AND i.message_id = d_message_id AND i.attempts = d_attempts AND ((d_claim_token <> '' AND i.status = 'processing' AND i.claim_token = d_claim_token AND i.lease_until = d_lease_until) OR (d_claim_token = '' AND i.status = 'pending' AND i.claim_token IS NULL AND i.lease_until IS NULL))"


@query(
    f"WITH {INBOX_SQL}, d AS (SELECT {_D} FROM inbox WHERE id % 4 = 0), j AS (SELECT i.*, d.*, coalesce({_HIT}, false) AS changed FROM inbox i LEFT JOIN d ON i.id = d_id) "
    f"SELECT id, CASE WHEN changed THEN d_status ELSE status END AS status, CASE WHEN changed AND (d_status IN ('completed', 'manual_review')) THEN '{{}}' ELSE payload END AS payload, CASE WHEN changed THEN NULL ELSE claim_token END AS claim_token, "
    f"CASE WHEN changed AND d_status = 'pending' THEN NULL WHEN changed THEN {AS_OF} ELSE terminal_at END AS terminal_at, CASE WHEN changed THEN nullif(d_reason, '') ELSE terminal_reason END AS terminal_reason, CASE WHEN changed THEN {AS_OF} ELSE available_at END AS available_at, changed FROM j"
)
def inbox_recovery_apply(spark, sf_dir):
    rows = inbox(spark, sf_dir)
    decisions = rows.where("id % 4 = 0").selectExpr(*[f"{e} AS {c}" for c, e in _DECISIONS.items()])
    return queue.apply_recovery(rows, decisions, "beta", AS_OF, scrub=True).select("id", "status", "payload", "claim_token", "terminal_at", "terminal_reason", "available_at", "changed")


_PRUNE = "SELECT id, {k} AS stage, terminal_at FROM inbox WHERE scope = 'alpha' AND status = '{s}' AND terminal_at <= least({c}, {a} - {r})"
_OLD = {"c": AS_OF - 1000 * DAY, "a": AS_OF, "r": 900 * DAY}
_LIMIT = 700


@query(f"WITH {INBOX_SQL} SELECT id, stage, terminal_at FROM ({_PRUNE.format(k=0, s='completed', **_OLD)} UNION ALL {_PRUNE.format(k=1, s='manual_review', **_OLD)}) ORDER BY stage, terminal_at, id LIMIT {_LIMIT}")
def inbox_prune_two_stage(spark, sf_dir):
    return queue.prune_two_stage(inbox(spark, sf_dir), "alpha", AS_OF, _OLD["r"], _LIMIT, _OLD["c"]).select("id", "stage", "terminal_at")


@query(f"WITH {INBOX_SQL}, gone AS ({_PRUNE.format(k=0, s='completed', **_OLD)} ORDER BY terminal_at, id LIMIT 300) SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM inbox WHERE id NOT IN (SELECT id FROM gone) GROUP BY status")
def inbox_prune_survivors(spark, sf_dir):
    rows = inbox(spark, sf_dir)
    left = queue.survivors(rows, queue.prune(rows, "alpha", AS_OF, _OLD["r"], 300, _OLD["c"], "completed"), "id")
    return left.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_ARRIVE = "event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS scope, concat('m', CAST((user_id * 97 + k) % 30000 AS STRING)) AS message_id"


@query(f"WITH {EVENTS_SQL}, {INBOX_SQL}, a AS (SELECT {_ARRIVE} FROM ev) SELECT seq, scope, message_id, CASE WHEN row_number() OVER (PARTITION BY scope, message_id ORDER BY seq) = 1 AND NOT EXISTS (SELECT 1 FROM inbox i WHERE i.scope = a.scope AND i.message_id = a.message_id) THEN 'accepted' ELSE 'duplicate' END AS outcome FROM a")
def admit_outcomes(spark, sf_dir):
    arrivals = events(spark, sf_dir).selectExpr(*_ARRIVE.replace("CASE WHEN user_id", "CASE WHEN user_id").split(", ", 1)[:1], "CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS scope", "concat('m', CAST((user_id * 97 + k) % 30000 AS STRING)) AS message_id")
    return queue.admit(inbox(spark, sf_dir), arrivals).select("seq", "scope", "message_id", "outcome")


_NONCE_KEY = "concat('n', CAST(user_id % 40 AS STRING), event_type)"
_TTL = 3_600_000_000 * 6


@query(f"WITH {EVENTS_SQL}, n AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS scope, concat('n', CAST(event_id AS STRING)) AS nonce_key, us + (k % 10) * {DAY} AS expires_at FROM ev) SELECT scope, nonce_key, expires_at FROM n WHERE scope = 'alpha' AND expires_at <= {1704067200000000 + 20 * DAY} ORDER BY expires_at, nonce_key LIMIT 500")
def nonce_prune(spark, sf_dir):
    nonces = events(spark, sf_dir).selectExpr("CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS scope", "concat('n', CAST(event_id AS STRING)) AS nonce_key", f"us + (k % 10) * {DAY} AS expires_at")
    return queue.prune_nonces(nonces, "alpha", 1704067200000000 + 20 * DAY, 500)


@query(
    f"WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT event_id, {_NONCE_KEY} AS key, us, row_number() OVER (PARTITION BY {_NONCE_KEY} ORDER BY us, event_id) AS rn FROM ev), "
    f"walk AS (SELECT event_id, key, us, rn, us + {_TTL} AS expires, true AS accepted FROM s WHERE rn = 1 UNION ALL SELECT s.event_id, s.key, s.us, s.rn, CASE WHEN w.expires <= s.us THEN s.us + {_TTL} ELSE w.expires END, w.expires <= s.us FROM walk w JOIN s ON s.key = w.key AND s.rn = w.rn + 1) SELECT event_id, key, accepted, expires FROM walk"
)
def nonce_set_once(spark, sf_dir):
    keyed = events(spark, sf_dir).selectExpr("event_id", f"{_NONCE_KEY} AS key", "us")
    return state.set_once(keyed, "key", "us", "event_id", _TTL).select("event_id", "key", "accepted", "expires")
