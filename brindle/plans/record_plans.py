"""Queries of log records, requests, metric families, settings and the rest of the queue operators."""

from pyspark.sql import functions as F

from ..functions import records, wire
from ..operators import metrics, outbox as outbox_ops, queue, state, textguard, validate
from .fixtures import AS_OF, DAY, EVENTS_SQL, INBOX_SQL, OUTBOX_SQL, events, inbox, outbox
from .registry import query, table

# ---- queues

_WANTED = "SELECT scope, message_id, phase, ordinal + CAST(id % 2 AS INT) * 50 AS ordinal FROM {t} WHERE id % 7 = 0"


@query(f"WITH {OUTBOX_SQL}, w AS ({_WANTED.format(t='outbox')}) SELECT w.*, o.id IS NOT NULL AS found, o.status, o.client_request_id, o.attempts, CASE WHEN o.id IS NOT NULL THEN o.payload IS NOT NULL END AS has_payload FROM w LEFT JOIN outbox o USING (scope, message_id, phase, ordinal)")
def reply_lookup(spark, sf_dir):
    rows = outbox(spark, sf_dir)
    return outbox_ops.lookup(rows, rows.where("id % 7 = 0").selectExpr("scope", "message_id", "phase", "ordinal + CAST(id % 2 AS INT) * 50 AS ordinal"))


@query(f"WITH {OUTBOX_SQL}, w AS ({_WANTED.format(t='outbox')}) SELECT o.id, w.scope IS NOT NULL AS payload_divergence_seen, CASE WHEN w.scope IS NOT NULL THEN {AS_OF} ELSE created_at END AS updated_at FROM outbox o LEFT JOIN (SELECT DISTINCT * FROM w) w USING (scope, message_id, phase, ordinal)")
def reply_mark_diverged(spark, sf_dir):
    rows = outbox(spark, sf_dir).withColumn("payload_divergence_seen", F.lit(False)).withColumn("updated_at", F.col("created_at"))
    wanted = rows.where("id % 7 = 0").selectExpr("scope", "message_id", "phase", "ordinal + CAST(id % 2 AS INT) * 50 AS ordinal")
    return outbox_ops.mark_diverged(rows, wanted, AS_OF).select("id", "payload_divergence_seen", "updated_at")


#: The outbox with rows that break its rules in turn.
_BROKEN = {
    "message_id": "CASE WHEN id % 11 = 1 THEN '  ' ELSE message_id END", "phase": "CASE WHEN id % 11 = 2 THEN '' ELSE phase END", "ordinal": "CASE WHEN id % 11 = 3 THEN -1 ELSE ordinal END", "attempts": "CASE WHEN id % 11 = 4 THEN -1 ELSE attempts END",
    "payload_hash": "CASE WHEN id % 11 = 5 THEN payload_hash ELSE concat(payload_hash, payload_hash) END", "client_request_id": "CASE WHEN id % 11 = 6 THEN 'short' ELSE client_request_id END", "status": "CASE WHEN id % 11 = 7 THEN 'lost' ELSE status END",
    "payload": "payload", "room_id": "CASE WHEN id % 11 = 8 THEN ' ' ELSE room_id END", "terminal_reason": "CASE WHEN id % 11 = 9 THEN 'why' WHEN status = 'manual_review' AND id % 2 = 0 THEN 'poison' END",
}
_B = "b AS (SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in _BROKEN.items()) + " FROM outbox)"
_FINAL = "status IN ('accepted', 'dead', 'permanent_conflict')"
_REPLY_RULES = {
    "message_id": "length(trim(message_id)) > 0", "phase": "length(trim(phase)) > 0", "ordinal": "ordinal >= 0", "attempts": "attempts >= 0", "payload_hash": "regexp_matches(payload_hash, '^[0-9a-f]{64}$')", "client_request_id": "regexp_matches(client_request_id, '^[A-Za-z0-9._:-]{8,160}$')",
    "status": "status <> 'lost'", "payload_replayable": f"payload IS NOT NULL OR {_FINAL}", "room_scrub": f"length(trim(room_id)) > 0 OR {_FINAL}", "terminal_reason": "(status = 'manual_review' AND coalesce(terminal_reason, '') <> '') OR (status <> 'manual_review' AND terminal_reason IS NULL)",
}


@query(f"WITH {OUTBOX_SQL}, {_B} " + " UNION ALL ".join(f"SELECT id, '{rule}' AS rule FROM b WHERE NOT ({ok})" for rule, ok in _REPLY_RULES.items()))
def reply_violations(spark, sf_dir):
    return outbox_ops.violations(outbox(spark, sf_dir).selectExpr("id", *[f"{e} AS {c}" for c, e in _BROKEN.items()]))


#: Decisions on every row in processing of one scope, some of which saw something else.
_DECIDED = "id, message_id, claim_token, CASE WHEN id % 5 = 0 THEN attempts + 1 ELSE attempts END AS attempts, lease_until, 'pending' AS status, '' AS reason"


@query(f"WITH {INBOX_SQL}, d AS (SELECT {_DECIDED} FROM inbox WHERE scope = 'alpha' AND status = 'processing') SELECT count(*) AS asked, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM inbox i WHERE i.scope = 'alpha' AND i.id = d.id AND i.attempts = d.attempts)) AS affected, asked <> affected AS lost FROM d")
def inbox_recovery_claims(spark, sf_dir):
    rows = inbox(spark, sf_dir)
    return queue.recovery_claims(rows, rows.where("scope = 'alpha' AND status = 'processing'").selectExpr(*_DECIDED.split(", ", 3)[:3], "CASE WHEN id % 5 = 0 THEN attempts + 1 ELSE attempts END AS attempts", "lease_until", "'pending' AS status", "'' AS reason"), "alpha")


# ---- log records

_OPS = {"op": "event_id", "name": "CASE WHEN k % 5 = 0 THEN ' ' ELSE concat('job.', event_type) END", "started": "us", "ended": "CASE WHEN k % 7 = 3 THEN NULL ELSE us + cents * 1000 + 7 END", "error": "CASE WHEN k % 3 = 0 THEN 'boom' END", "quiet": "k % 4 = 0"}
_OPS_SQL = f"{EVENTS_SQL}, o AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _OPS.items())} FROM ev)"
_OP_NAME = "CASE WHEN trim(name) = '' THEN 'operation' ELSE name END"


@query(f"WITH {_OPS_SQL} SELECT op, started AS at, concat({_OP_NAME}, '.started') AS event, 'INFO' AS level, CAST(NULL AS BIGINT) AS duration_ms FROM o WHERE NOT quiet UNION ALL SELECT op, ended, concat({_OP_NAME}, CASE WHEN error IS NULL THEN '.succeeded' ELSE '.failed' END), CASE WHEN error IS NULL THEN 'INFO' ELSE 'ERROR' END, (ended - started) // 1000 FROM o WHERE ended IS NOT NULL")
def log_operation_events(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in _OPS.items()])
    return records.operation_events(rows, "name", "started", "ended", "error", "quiet").select("op", "at", "event", "level", "duration_ms")


@query(f"WITH {_OPS_SQL} SELECT op, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS outcome, ended - started AS duration_us FROM o WHERE ended IS NOT NULL AND NOT quiet")
def log_operation_durations(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in _OPS.items()])
    return records.operation_durations(records.operation_events(rows, "name", "started", "ended", "error", "quiet"), "op", "event", "at")


_PAIRS = "array_to_string([concat(e[1], '=', e[2]) FOR e IN [{}] IF e[2] IS NOT NULL], '|')"


def _joined(c):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 4 = 0 THEN '' ELSE " + _PAIRS.format("['error_type', event_type], ['error_message', CASE WHEN k % 3 = 0 THEN '' ELSE concat('m', CAST(k AS STRING)) END], ['error_code', nullif(CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE 'E1' END, '')], ['retryable', CASE k % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END]") + " END AS attrs FROM ev")
def error_attributes(spark, sf_dir):
    rows = events(spark, sf_dir)
    e = F.expr
    attrs = records.error_attributes(e("CASE WHEN k % 4 <> 0 THEN event_type END"), e("CASE WHEN k % 3 <> 0 THEN concat('m', CAST(k AS STRING)) END"), e("CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE 'E1' END"), e("CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false END"))
    return rows.select("event_id", _joined(attrs).alias("attrs"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, " + _PAIRS.format("['runtime', CASE WHEN k % 2 = 0 THEN 'go' END], ['request_id', CASE WHEN k % 3 = 0 THEN concat('r', CAST(k AS STRING)) END], ['job_id', CASE WHEN k % 6 <> 1 THEN CAST(event_id AS STRING) END], ['component', event_type]") + " AS attrs FROM ev")
def context_attributes(spark, sf_dir):
    e = F.expr
    attrs = records.with_context(F.create_map(F.lit("component"), F.col("event_type")), e("CASE WHEN k % 2 = 0 THEN ' go ' ELSE ' ' END"), F.lit("outer"), e("CASE WHEN k % 3 = 0 THEN concat('r', CAST(k AS STRING)) END"), e("CASE WHEN k % 6 <> 1 THEN CAST(event_id AS STRING) ELSE '' END"))
    return events(spark, sf_dir).select("event_id", _joined(attrs).alias("attrs"))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5 AS written FROM ev) SELECT count(*) FILTER (WHERE NOT written) AS stdout_dropped, count(*) FILTER (WHERE written AND cents > 40000) AS stdout_truncated, count(*) FILTER (WHERE k % 10 = 0) AS file_write_failed FROM s")
def log_losses(spark, sf_dir):
    rows = records.bounded_sink(events(spark, sf_dir), "user_id", "event_id", 5)
    return records.losses(rows, F.col("written"), F.col("cents") > 40000, F.col("k") % 10 == 0)


# ---- requests and forms

_BODY = "CASE event_id % 9 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN '{\"a\": ' WHEN 4 THEN concat('{\"a\": \"', repeat('x', 100), '\"}') WHEN 5 THEN '{\"b\": 1}' WHEN 6 THEN '[1, 2]' WHEN 7 THEN '{\"a\": 1} {}' ELSE '{\"a\": null}' END"
_TYPE = "CASE event_id % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'Application/JSON; charset=utf-8' WHEN 2 THEN 'text/plain' END"


@query("SELECT event_id, s.status, s.code FROM (SELECT event_id, CASE WHEN event_id % 9 = 2 THEN {'status': 400, 'code': 'invalid_request'} WHEN event_id % 4 IN (2, 3) THEN {'status': 415, 'code': 'unsupported_media_type'} WHEN event_id % 9 = 4 THEN {'status': 413, 'code': 'request_entity_too_large'} WHEN event_id % 9 = 1 THEN {'status': 400, 'code': 'invalid_request'} WHEN event_id % 9 IN (3, 5, 7) THEN {'status': 400, 'code': 'invalid_json'} END AS s FROM events)")
def request_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_BODY} AS body", f"{_TYPE} AS kind")
    s = wire.request_problem(F.col("body"), F.col("kind"), 64, True, ("a",))
    return rows.withColumn("s", s).select("event_id", "s.status", "s.code")


@query("SELECT event_id, CASE WHEN g = 0 THEN base WHEN g <= 4 THEN concat(base, ':r', CAST(g AS STRING)) END AS id, CASE WHEN g <= 4 THEN g END AS generation FROM (SELECT event_id, event_id % 7 AS g, concat('req-', CAST(user_id AS STRING)) AS base FROM events)")
def reissue_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 7 AS g", "concat('req-', CAST(user_id AS STRING)) AS base").withColumn("id", wire.reissue_id(F.col("base"), F.col("g"), 4))
    return rows.select("event_id", "id", wire.generation_of(F.col("base"), F.col("id"), 4).alias("generation"))


@query("SELECT event_id, event_id % 4 = 0 OR event_id % 5 IN (0, 1) AS open_chat FROM events")
def room_open_chats(spark, sf_dir):
    kind, link = F.expr("CASE event_id % 5 WHEN 0 THEN ' om' WHEN 1 THEN 'OD' WHEN 2 THEN 'MultiChat' WHEN 3 THEN '' END"), F.expr("CASE WHEN event_id % 4 = 0 THEN '77' WHEN event_id % 4 = 1 THEN '  ' END")
    return table(spark, sf_dir, "events").select("event_id", wire.open_chat(kind, link).alias("open_chat"))


@query("SELECT doc_id, concat('2024\\. 5. ', coalesce(text, ''), chr(10), '   1999\\.', chr(9), '12. x', chr(10), '12345. 6. y', chr(10), 'in 2024. 5. z') AS md FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[0-9]{4}\\.[ \\t]') UNION ALL SELECT doc_id, regexp_replace(concat('2024. 5. ', text, chr(10), '   1999.', chr(9), '12. x', chr(10), '12345. 6. y', chr(10), 'in 2024. 5. z'), '(?m)^([ \\t]{0,3}[0-9]{4})(\\.[ \\t]+[0-9]{1,2}\\.)', '\\1\\\\\\2', 'g') FROM documents WHERE regexp_matches(text, '[0-9]{4}\\.[ \\t]')")
def date_list_escape(spark, sf_dir):
    s = "concat('2024. 5. ', coalesce(text, ''), char(10), '   1999.', char(9), '12. x', char(10), '12345. 6. y', char(10), 'in 2024. 5. z')"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{s} AS s").select("doc_id", wire.escape_date_lists(F.col("s")).alias("md"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.2f', o_totalprice), '0+$', ''), '\\.$', '') AS price, CASE WHEN h > 0 THEN concat(CAST(h AS STRING), 'h', CAST(m AS STRING), 'm', CAST(s AS STRING), 's') WHEN m > 0 THEN concat(CAST(m AS STRING), 'm', CAST(s AS STRING), 's') ELSE concat(CAST(s AS STRING), 's') END AS took FROM (SELECT *, n // 3600 AS h, n % 3600 // 60 AS m, n % 60 AS s FROM (SELECT *, o_orderkey % 9000 AS n FROM orders)) WHERE o_totalprice < 1000000 AND o_totalprice >= 1 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE NOT (o_totalprice < 1000000 AND o_totalprice >= 1)")
def number_forms(spark, sf_dir):
    plain = F.expr("o_totalprice < 1000000 AND o_totalprice >= 1")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(plain, wire.float_text(F.col("o_totalprice"))).alias("price"), F.when(plain, wire.duration_text(F.col("o_orderkey") % 9000)).alias("took"))


# ---- metric families

_HOOK = "CASE event_id % 8 WHEN 0 THEN 'request' WHEN 1 THEN 'unauthorized' WHEN 2 THEN 'bad_request' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'enqueue_failure' WHEN 5 THEN 'accepted' WHEN 6 THEN 'handled' ELSE 'decoded' END"
_HOOKED = f"h AS (SELECT {_HOOK} AS kind, CASE WHEN event_id % 64 >= 56 THEN event_id % 5 * 0.25 END AS s FROM events)"


def _webhook_sql() -> str:
    parts, n = [], 0
    for suffix, kind, help_text in metrics.WEBHOOK_COUNTERS:
        name = f"stack_webhook_{suffix}"
        for line in (f"'# HELP {name} {help_text}'", f"'# TYPE {name} counter'", f"(SELECT concat('{name} ', CAST(count(*) FILTER (WHERE kind = '{kind}') AS STRING)) FROM h)"):
            parts.append(f"SELECT CAST({n} AS BIGINT) AS line_no, {line} AS line")
            n += 1
    for suffix, kind, help_text in metrics.WEBHOOK_HISTOGRAMS:
        name = f"stack_webhook_{suffix}"
        lines = [f"'# HELP {name} {help_text}'", f"'# TYPE {name} histogram'"]
        lines += [f"(SELECT concat('{name}_bucket{{le=\"{b:g}\"}} ', CAST(count(*) FILTER (WHERE kind = '{kind}' AND s <= {b}) AS STRING)) FROM h)" for b in metrics.WEBHOOK_BOUNDS]
        lines += [f"(SELECT concat('{name}_bucket{{le=\"+Inf\"}} ', CAST(count(s) FILTER (WHERE kind = '{kind}') AS STRING)) FROM h)"]
        lines += [f"(SELECT concat('{name}_sum ', regexp_replace(regexp_replace(printf('%.2f', coalesce(sum(s) FILTER (WHERE kind = '{kind}'), 0)::DOUBLE), '0+$', ''), '\\.$', '')) FROM h)"]
        lines += [f"(SELECT concat('{name}_count ', CAST(count(s) FILTER (WHERE kind = '{kind}') AS STRING)) FROM h)"]
        for line in lines:
            parts.append(f"SELECT CAST({n} AS BIGINT), {line}")
            n += 1
    return f"WITH {_HOOKED} " + " UNION ALL ".join(parts)


@query(_webhook_sql())
def webhook_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(f"{_HOOK} AS kind", "CAST(CASE WHEN event_id % 64 >= 56 THEN event_id % 5 * 0.25 END AS DOUBLE) AS s")
    return metrics.webhook_exposition(rows, "kind", "s", "stack")


_WORKERS = {
    "stack_service": "'s'", "stack_role": "concat('r', CAST(user_id % 2 AS STRING))", "worker": "concat('w', CAST(user_id AS STRING))", "runtime": "'go'", "queue_backend": "'postgres'", "queue_scope": "'shared'", "profile_id": "'p1'", "profile_hash": "'h1'", "file_match": "user_id % 2 = 0", "checked_ms": "CAST(5000 AS BIGINT)",
    "attempt_timeout_mode": "CASE WHEN user_id % 3 = 0 THEN 'fixed' ELSE 'unbounded' END", "queue_age_mode": "'unbounded'", "enabled": "user_id % 5 <> 0", "configured_workers": "n", "running_workers": "CASE WHEN user_id % 4 <> 0 THEN n END", "in_flight": "n % 3", "oldest_in_flight_ms": "n * 500", "attempt_timeout_ms": "CAST(1500 AS BIGINT)",
    "max_age_ms": "CAST(NULL AS BIGINT)", "bounded": "user_id % 2 = 1", "capacity": "CASE WHEN user_id % 2 = 1 THEN n END", "queue_depth": "n", "oldest_queued_ms": "n * 250", "snapshot_current": "user_id % 6 <> 0", "last_success_ms": "CASE WHEN user_id % 7 <> 0 THEN n * 1000 END",
}
_PER_USER = "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY user_id"


def _workers_sql() -> str:
    base = ", ".join(f"{e} AS {c}" for c, e in _WORKERS.items())
    own = {
        "policy_info": ("1", "true"), "enabled": ("CAST(enabled AS INT)", "true"), "configured_workers": ("configured_workers", "true"), "running_workers": ("running_workers", "running_workers IS NOT NULL"), "attempt_timeout_seconds": ("1.5", "attempt_timeout_mode = 'fixed'"), "queue_bounded": ("CAST(bounded AS INT)", "true"),
        "queue_capacity": ("capacity", "capacity IS NOT NULL"), "queue_depth": ("queue_depth", "snapshot_current"), "in_flight": ("in_flight", "running_workers IS NOT NULL"), "oldest_queued_age_seconds": ("oldest_queued_ms / 1000", "snapshot_current"), "oldest_in_flight_age_seconds": ("oldest_in_flight_ms / 1000", "running_workers IS NOT NULL"),
        "queue_snapshot_success": ("CAST(snapshot_current AS INT)", "true"), "queue_snapshot_last_success_timestamp_seconds": ("last_success_ms / 1000", "last_success_ms IS NOT NULL"),
    }
    parts = [f"SELECT 'stack_worker_{f}' AS family, 'gauge' AS type, worker, '' AS extra, CAST({v} AS DOUBLE) AS value FROM w WHERE {ok}" for f, (v, ok) in own.items()]
    for family, names, got in (("admissions_total", metrics.ADMISSIONS, {"accepted": "clicks", "failed": "n"}), ("attempts_total", metrics.ATTEMPTS, {"success": "n"}), ("discarded_total", metrics.DISCARDS, {})):
        parts += [f"SELECT 'stack_worker_{family}', 'counter', worker, '{x}', CAST({got.get(x, '0')} AS DOUBLE) FROM w" for x in names]
    one = "FROM (SELECT stack_role, min(user_id) AS user_id FROM w GROUP BY 1)"
    parts += [f"SELECT 'stack_worker_profile_info', 'gauge', '', '', CAST(1 AS DOUBLE) {one}", f"SELECT 'stack_worker_profile_file_match', 'gauge', '', '', CAST(CASE WHEN stack_role = 'r0' THEN 1 ELSE 0 END AS DOUBLE) {one}", f"SELECT 'stack_worker_profile_file_last_check_timestamp_seconds', 'gauge', '', '', CAST(5 AS DOUBLE) {one}"]
    return f"WITH w AS (SELECT user_id, n, clicks, {base} FROM ({_PER_USER})) " + " UNION ALL ".join(parts)


@query(_workers_sql())
def worker_families(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    rows = per.selectExpr(*[f"{e} AS {c}" for c, e in _WORKERS.items()], "map('accepted', clicks, 'failed', n) AS admissions", "map('success', n, 'odd', 5L) AS attempts", "CAST(map() AS map<string,bigint>) AS discarded")
    out = metrics.worker_families(rows, "stack")
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    return out.select("family", "type", label("worker").alias("worker"), F.concat(label("result"), label("outcome"), label("reason")).alias("extra"), "value")


_POOL = {"kind": "event_type", "enqueued": "us", "started": "CASE WHEN k % 4 <> 0 THEN us + 1000 END", "ended": "CASE WHEN k % 6 <> 1 THEN us + 5000 END", "outcome": "CASE WHEN k % 6 = 1 THEN '' WHEN k % 4 = 0 THEN 'stale' WHEN k % 5 = 0 THEN 'timeout' ELSE 'success' END"}


@query(
    f"WITH {EVENTS_SQL}, j AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _POOL.items())} FROM ev), c AS (SELECT kind, outcome, count(*) FILTER (WHERE ended IS NOT NULL AND started IS NOT NULL) AS a, count(*) FILTER (WHERE ended IS NOT NULL AND started IS NULL) AS d FROM j GROUP BY ALL), t AS (SELECT kind, coalesce(string_agg(concat(outcome, '=', CAST(a AS STRING)), ',' ORDER BY outcome) FILTER (WHERE a > 0), '') AS attempts, coalesce(string_agg(concat(outcome, '=', CAST(d AS STRING)), ',' ORDER BY outcome) FILTER (WHERE d > 0), '') AS discarded FROM c GROUP BY kind) "
    f"SELECT kind, count(*) FILTER (WHERE started IS NULL AND ended IS NULL) AS queue_depth, count(*) FILTER (WHERE started IS NOT NULL AND ended IS NULL) AS in_flight, coalesce({AS_OF + 9000 * DAY} - min(enqueued) FILTER (WHERE started IS NULL AND ended IS NULL), 0) AS oldest_queued, coalesce({AS_OF + 9000 * DAY} - min(started) FILTER (WHERE started IS NOT NULL AND ended IS NULL), 0) AS oldest_in_flight, any_value(attempts) AS attempts, any_value(discarded) AS discarded FROM j JOIN t USING (kind) GROUP BY kind"
)
def pool_snapshot(spark, sf_dir):
    return state.pool_snapshot(events(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in _POOL.items()]), "kind", AS_OF + 9000 * DAY)


@query(
    f"WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT user_id % 10 AS pool, CASE WHEN k % 97 = 96 THEN 'close' WHEN k % 3 = 0 THEN 'reserve' WHEN k % 3 = 1 THEN 'claim' ELSE 'done' END AS kind, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn FROM ev), walk AS (SELECT pool, 0::BIGINT AS rn, 0::BIGINT AS r, 0::BIGINT AS c, 0::BIGINT AS d, 0::BIGINT AS x, 0::BIGINT AS o, false AS closed FROM (SELECT DISTINCT pool FROM s) UNION ALL "
    "SELECT s.pool, s.rn, CASE WHEN kind = 'reserve' AND NOT closed AND r < 4 THEN r + 1 WHEN kind = 'done' THEN greatest(r - 1, 0) ELSE r END, c + CAST(kind = 'claim' AS INT), d + CAST(kind = 'done' AS INT), x + CAST(kind = 'reserve' AND (closed OR r >= 4) AS INT), o + CAST(kind = 'reserve' AND NOT closed AND r >= 4 AS INT), closed OR kind = 'close' FROM walk w JOIN s ON s.pool = w.pool AND s.rn = w.rn + 1) SELECT pool, r AS reservations, c AS claimed, d AS completed, x AS rejected, o AS overloaded FROM walk QUALIFY rn = max(rn) OVER (PARTITION BY pool)"
)
def finalizer_totals(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", "user_id % 10 AS pool", "CASE WHEN k % 97 = 96 THEN 'close' WHEN k % 3 = 0 THEN 'reserve' WHEN k % 3 = 1 THEN 'claim' ELSE 'done' END AS kind")
    return state.finalizers(rows, "pool", "event_id", "kind", 4)


# ---- validation

_SETTINGS = "CASE page_id % 6 WHEN 0 THEN '{\"rate\": 1, \"limits\": {\"low\": 0, \"high\": null}}' WHEN 1 THEN '{\"rate\": null, \"limits\": {\"low\": 0, \"high\": 9}}' WHEN 2 THEN '{\"rate\": 1}' WHEN 3 THEN '{\"rate\": 1, \"limits\": {\"low\": null}}' WHEN 4 THEN 'no json' ELSE '{\"rate\": 1, \"limits\": {\"low\": null, \"high\": 1}, \"x\": 2}' END"


@query("SELECT page_id AS id, CASE page_id % 6 WHEN 1 THEN 'settings.rate' WHEN 3 THEN 'settings.limits' ELSE 'settings' END AS path, CASE page_id % 6 WHEN 1 THEN 'null' ELSE 'keys' END AS problem FROM pages WHERE page_id % 6 <> 0")
def settings_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_SETTINGS} AS doc")
    return validate.settings_problems(rows, "page_id", "doc", {"rate": "value", "limits": {"low": "value", "high": "optional"}})


@query("SELECT concat('n', CAST(n AS STRING)) AS worker, 'missing' AS problem FROM range(30) t(n) WHERE n NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT '', 'mixed_runtimes' FROM nation HAVING count(DISTINCT n_regionkey % 2) > 1")
def registration_seal(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr("concat('n', CAST(n_nationkey AS STRING)) AS worker", "CASE WHEN n_regionkey % 2 = 0 THEN 'go' ELSE 'jvm' END AS runtime")
    return validate.sealed_problems(rows, [f"n{i}" for i in range(30)])


@query("SELECT filename, min(t) AS applied_at FROM (SELECT concat('f', CAST(n_nationkey % 20 AS STRING), '.sql') AS filename, n_nationkey * 10 AS t FROM nation UNION ALL SELECT concat('f', CAST(n_nationkey AS STRING), '.sql'), 5 + n_nationkey FROM nation WHERE n_nationkey % 3 = 0) GROUP BY filename")
def ledger_record(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    ledger = nations.selectExpr("concat('f', CAST(n_nationkey % 20 AS STRING), '.sql') AS filename", "n_nationkey * 10 AS applied_at")
    applied = nations.where("n_nationkey % 3 = 0").selectExpr("concat('f', CAST(n_nationkey AS STRING), '.sql') AS filename", "5 + n_nationkey AS applied_at")
    return validate.record(ledger, applied)


_FROM = "CASE event_id % 5 WHEN 0 THEN 'user_prompt' WHEN 1 THEN 'chat_log' WHEN 2 THEN 'elsewhere' WHEN 3 THEN NULL ELSE 'image_prompt' END"
_HOW = "CASE event_id % 4 WHEN 0 THEN 'observe' WHEN 1 THEN 'persistent' WHEN 2 THEN '' ELSE 'interactive' END"


@query("SELECT event_id, CASE WHEN event_id % 5 IN (2, 3) THEN 'source' WHEN event_id % 4 = 2 THEN 'enforcement' END AS problem FROM events")
def guard_request_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_FROM} AS source", f"{_HOW} AS how")
    return rows.select("event_id", textguard.request_problem(F.col("source"), F.col("how")).alias("problem"))


@query("WITH r AS (SELECT event_id, list_sort(list_distinct([concat('r', CAST((event_id * j) % 23 AS STRING)) FOR j IN range(0, 1 + event_id % 25)] || [event_type])) AS x FROM events) SELECT event_id, array_to_string(x[1:16], ',') AS rules, CAST(greatest(len(x) - 16, 0) AS INT) AS truncated FROM r")
def guard_log_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "array(event_type) AS families", "transform(sequence(0, CAST(event_id % 25 AS INT)), j -> concat('r', CAST((event_id * j) % 23 AS STRING))) AS ids")
    shown, more = textguard.blocked_rules(F.col("families"), F.col("ids"))
    return rows.select("event_id", F.array_join(shown, ",").alias("rules"), more.alias("truncated"))


@query("SELECT event_id, CASE WHEN l >= 8 THEN concat('ERROR', CASE WHEN l > 8 THEN concat('+', CAST(l - 8 AS STRING)) ELSE '' END) WHEN l >= 4 THEN concat('WARN', CASE WHEN l > 4 THEN concat('+', CAST(l - 4 AS STRING)) ELSE '' END) WHEN l >= 0 THEN concat('INFO', CASE WHEN l > 0 THEN concat('+', CAST(l AS STRING)) ELSE '' END) ELSE concat('DEBUG', CASE WHEN l > -4 THEN concat('+', CAST(l + 4 AS STRING)) WHEN l < -4 THEN CAST(l + 4 AS STRING) ELSE '' END) END AS level, least(200 * CAST(pow(2, least(greatest(l + 5, 0), 8)) AS BIGINT), 20000) AS delay FROM (SELECT event_id, event_id % 19 - 6 AS l FROM events)")
def log_levels_and_delays(spark, sf_dir):
    level = F.col("event_id") % 19 - 6
    return table(spark, sf_dir, "events").select("event_id", records.level_text(level).alias("level"), state.store_backoff(F.lit(200).cast("long"), F.lit(20000).cast("long"), level + 6).alias("delay"))


_ATTRS = "concat('{\"user\": \"u', CAST(event_id AS STRING), '\", \"api_key\": \"k\", \"key\": \"', CASE WHEN event_id % 2 = 0 THEN 'sk_1' ELSE 'plain' END, '\", \"in\": {\"password\": {\"a\": 1}, \"n\": ', CAST(event_id AS STRING), ', \"url\": \"http://u:p@h/x\"}}')"


@query("SELECT event_id, concat('user=u', CAST(event_id AS STRING), '|api_key=***REDACTED***|key=', CASE WHEN event_id % 2 = 0 THEN '***REDACTED***' ELSE 'plain' END, '|in.password=***REDACTED***|in.n=', CAST(event_id AS STRING), '|in.url=http://***REDACTED***@h/x') AS attrs FROM events")
def masked_attributes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_ATTRS} AS doc")
    return rows.select("event_id", _joined(records.masked_json(F.col("doc"), 3)).alias("attrs"))
