"""Queries over events: metrics, keyed state, jobs."""

from pyspark.sql import functions as F

from ..operators import metrics, state
from .fixtures import EVENTS_SQL, events
from .registry import query

_DAY0 = 1_704_067_200_000_000
_HOUR = 3_600_000_000
_NOW = _DAY0 + 20 * 24 * _HOUR
_LABELS = "map('type', event_type, 'shard', CAST(user_id % 4 AS STRING))"
_SERIES = "'5:shard' || length(CAST(user_id % 4 AS STRING)) || ':' || CAST(user_id % 4 AS STRING) || '4:type' || length(event_type) || ':' || event_type"
_BOUNDS = (5.0, 25.0, 100.0, 250.0)


def _labels():
    return F.create_map(F.lit("type"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 4).cast("string"))


@query(f"WITH {EVENTS_SQL} SELECT {_SERIES} AS series, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY 1")
def metric_counter_series(spark, sf_dir):
    return metrics.counters(events(spark, sf_dir), _labels(), F.col("cents"))


@query(f"WITH {EVENTS_SQL} SELECT {_SERIES} AS series, arg_max(cents, us * 1000 + event_id % 1000) AS value FROM ev GROUP BY 1")
def metric_gauge_last(spark, sf_dir):
    return metrics.gauges(events(spark, sf_dir), _labels(), F.col("cents"), F.col("us") * 1000 + F.col("event_id") % 1000)


@query(
    f"WITH {EVENTS_SQL}, b AS (SELECT unnest([500.0, 2500.0, 10000.0, 25000.0, NULL]::DOUBLE[]) AS le), s AS (SELECT {_SERIES} AS series, cents FROM ev) "
    "SELECT series, le, count(*) FILTER (WHERE le IS NULL OR cents <= le) AS cumulative, count(*) AS total, CAST(sum(cents) AS BIGINT) AS sum FROM s CROSS JOIN b GROUP BY series, le"
)
def metric_histogram(spark, sf_dir):
    return metrics.histograms(events(spark, sf_dir), _labels(), F.col("cents"), [b * 100 for b in _BOUNDS])


@query(
    f"WITH {EVENTS_SQL}, s AS (SELECT event_id, CAST(user_id AS STRING) AS u FROM ev), f AS (SELECT u FROM s WHERE length(u) <= 256 GROUP BY u ORDER BY min(event_id), '4:user' || length(u) || ':' || u LIMIT 40) SELECT u IN (SELECT u FROM f) AS kept, count(*) AS n FROM s GROUP BY 1"
)
def metric_series_cap(spark, sf_dir):
    rows = metrics.capped(events(spark, sf_dir), F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.col("event_id"), 40)
    return rows.groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {EVENTS_SQL}, s AS (SELECT '{{shard=\"' || CAST(user_id % 4 AS STRING) || '\",type=\"' || event_type || '\"}}' AS lbl, count(*) AS n FROM ev GROUP BY 1), l AS (SELECT 0 AS part, '' AS lbl, '# HELP events_total Events seen.' AS line UNION ALL SELECT 1, '', '# TYPE events_total counter' UNION ALL SELECT 2, lbl, 'events_total' || lbl || ' ' || n FROM s) "
    "SELECT row_number() OVER (ORDER BY part, lbl, line) - 1 AS line_no, line FROM l"
)
def metric_exposition_text(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("s", metrics.label_key(_labels())).groupBy("event_type", (F.col("user_id") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    samples = rows.select(F.create_map(F.lit("type"), F.col("event_type"), F.lit("shard"), F.col("shard").cast("string")).alias("labels"), F.col("n").cast("string").alias("value"))
    return metrics.exposition("events_total", "counter", "Events seen.", samples)


#: Outcomes that worker totals count.
_OUTCOMES = {"admission": ("accepted", "duplicate", "rejected", "failed", "outcome_unknown"), "attempt": ("success", "failed", "timeout", "canceled", "panic", "outcome_unknown"), "discard": ("stale", "shutdown")}
_KIND = "CASE event_id % 3 WHEN 0 THEN 'admission' WHEN 1 THEN 'attempt' ELSE 'discard' END"
_PICK = {"admission": "CASE k % 6 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' WHEN 3 THEN 'outcome_unknown' WHEN 4 THEN 'other' ELSE 'accepted' END", "attempt": "CASE k % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'canceled' WHEN 3 THEN 'panic' WHEN 4 THEN 'outcome_unknown' ELSE 'success' END", "discard": "CASE k % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'shutdown' ELSE 'other' END"}
_OUTCOME = f"CASE event_id % 3 WHEN 0 THEN {_PICK['admission']} WHEN 1 THEN {_PICK['attempt']} ELSE {_PICK['discard']} END"
_WORKER = "concat('w', CAST(user_id % 6 AS STRING)) AS worker"


def _worker_events(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(_WORKER, f"{_KIND} AS kind", f"{_OUTCOME} AS outcome")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}' AND outcome = '{o}') AS {k}_{o}" for k, os in _OUTCOMES.items() for o in os)
_WE = f"we AS (SELECT {_WORKER}, {_KIND} AS kind, {_OUTCOME} AS outcome FROM ev)"


@query(f"WITH {EVENTS_SQL}, {_WE} SELECT worker, {_COUNTS} FROM we GROUP BY worker")
def worker_totals_pivot(spark, sf_dir):
    return metrics.pivoted_totals(_worker_events(spark, sf_dir), "worker", "kind", "outcome", _OUTCOMES)


_KNOWN = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{o}' AS outcome" for k, os in _OUTCOMES.items() for o in os)


@query(f"WITH {EVENTS_SQL}, {_WE}, known AS ({_KNOWN}), w AS (SELECT DISTINCT worker FROM we) SELECT w.worker, known.kind, known.outcome, count(we.worker) AS n FROM w CROSS JOIN known LEFT JOIN we ON we.worker = w.worker AND we.kind = known.kind AND we.outcome = known.outcome GROUP BY ALL")
def worker_totals_long(spark, sf_dir):
    wide = metrics.pivoted_totals(_worker_events(spark, sf_dir), "worker", "kind", "outcome", _OUTCOMES)
    return metrics.long_totals(wide, "worker", _OUTCOMES)


_ENDED = f"CASE WHEN k % 9 = 0 THEN NULL ELSE us + cents * {_HOUR // 100} END"


@query(f"WITH {EVENTS_SQL}, a AS (SELECT {_WORKER}, us AS started, {_ENDED} AS ended FROM ev) SELECT worker, count(*) FILTER (WHERE started <= {_NOW} AND (ended IS NULL OR ended > {_NOW})) AS in_flight, coalesce({_NOW} - min(started) FILTER (WHERE started <= {_NOW} AND (ended IS NULL OR ended > {_NOW})), 0) AS oldest_age FROM a GROUP BY worker")
def worker_executor_snapshot(spark, sf_dir):
    return metrics.in_flight(events(spark, sf_dir).selectExpr(_WORKER, "us AS started", f"{_ENDED} AS ended"), "worker", "started", "ended", _NOW)


_SECONDS = 1_000_000
_FAILED = "event_type = 'error'"


@query(
    f"WITH {EVENTS_SQL}, s AS (SELECT user_id, max(us) FILTER (WHERE NOT {_FAILED}) AS last_success, arg_max({_FAILED}, us) AS last_failed FROM ev WHERE us <= {_NOW} GROUP BY user_id) "
    f"SELECT user_id, CASE WHEN last_success IS NULL OR last_failed THEN 'unavailable' WHEN {_NOW} - last_success > {2 * 3 * _HOUR + 2 * _SECONDS} THEN 'stale' ELSE 'ok' END AS status, last_success, {_NOW} - last_success AS age FROM s"
)
def queue_sampler_status(spark, sf_dir):
    return state.sampler_status(events(spark, sf_dir), "user_id", "us", F.col("event_type") == "error", _NOW, 3 * _HOUR, 2 * _SECONDS)


def _walk(key: str, ttl: int) -> str:
    """CTEs s and walk: the opener of each event of a key."""
    return (
        f"s AS (SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM ev), "
        f"walk AS (SELECT event_id, key, us, rn, us AS opened FROM s WHERE rn = 1 UNION ALL SELECT s.event_id, s.key, s.us, s.rn, CASE WHEN s.us >= w.opened + {ttl} THEN s.us ELSE w.opened END FROM walk w JOIN s ON s.key = w.key AND s.rn = w.rn + 1)"
    )


@query(f"WITH RECURSIVE {EVENTS_SQL}, {_walk('user_id', 36 * _HOUR)}, n AS (SELECT event_id, opened, row_number() OVER (PARTITION BY key, opened ORDER BY us, event_id) AS n FROM walk) SELECT event_id, opened AS window_start, n, n <= 3 AS allowed FROM n")
def limiter_fixed_window(spark, sf_dir):
    return state.fixed_window(events(spark, sf_dir), "user_id", "us", "event_id", 36 * _HOUR, 3).select("event_id", "window_start", "n", "allowed")


@query(f"WITH RECURSIVE {EVENTS_SQL}, {_walk('sha256(CAST(user_id % 30 AS STRING) || event_type)', 10 * _HOUR + 1)} SELECT event_id, row_number() OVER (PARTITION BY key, opened ORDER BY us, event_id) > 1 AS hit FROM walk")
def cache_hits_ttl(spark, sf_dir):
    keyed = events(spark, sf_dir).withColumn("key", F.sha2(F.concat((F.col("user_id") % 30).cast("string"), "event_type"), 256))
    return state.cache_hits(keyed, "key", "us", "event_id", 10 * _HOUR).select("event_id", "hit")


@query(
    f"WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT concat('q', CAST(user_id % 8 AS STRING)) AS queue, CASE WHEN k % 5 < 3 THEN 'put' ELSE 'take' END AS kind, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS rn FROM ev), "
    "walk AS (SELECT queue, 0::BIGINT AS rn, 0::BIGINT AS offered, 0::BIGINT AS accepted, 0::BIGINT AS taken, 0::BIGINT AS depth FROM (SELECT DISTINCT queue FROM s) UNION ALL "
    "SELECT s.queue, s.rn, offered + CASE WHEN kind = 'put' THEN 1 ELSE 0 END, accepted + CASE WHEN kind = 'put' AND depth < 16 THEN 1 ELSE 0 END, taken + CASE WHEN kind = 'take' AND depth > 0 THEN 1 ELSE 0 END, depth + CASE WHEN kind = 'put' AND depth < 16 THEN 1 WHEN kind = 'take' AND depth > 0 THEN -1 ELSE 0 END FROM walk w JOIN s ON s.queue = w.queue AND s.rn = w.rn + 1) "
    "SELECT queue, offered, accepted, offered - accepted AS rejected, taken, depth FROM walk QUALIFY rn = max(rn) OVER (PARTITION BY queue)"
)
def bounded_queue_rejects(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", "concat('q', CAST(user_id % 8 AS STRING)) AS queue", "CASE WHEN k % 5 < 3 THEN 'put' ELSE 'take' END AS kind")
    return state.bounded_queue(rows, "queue", "event_id", "kind", 16)


_JOB = {
    "kind": "event_type", "enqueued": "us", "max_age": f"CASE WHEN k % 4 = 0 THEN 0 ELSE {_HOUR} END", "started": f"CASE WHEN k % 11 = 0 THEN NULL ELSE us + (k % 90) * {60 * _SECONDS} END", "timeout": f"CASE WHEN k % 5 = 0 THEN 0 ELSE {2 * _HOUR} END",
    "ended": f"us + (k % 90) * {60 * _SECONDS} + cents * {_SECONDS}", "canceled": "event_id % 17 = 0", "panicked": "event_id % 23 = 0",
}


@query(
    f"WITH {EVENTS_SQL}, j AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _JOB.items())} FROM ev) SELECT kind, CASE WHEN max_age > 0 AND started >= enqueued + max_age THEN 'stale' WHEN started IS NULL THEN 'pending' WHEN panicked THEN 'panic' WHEN canceled THEN 'canceled' WHEN timeout > 0 AND ended - started >= timeout THEN 'timeout' ELSE 'success' END AS outcome, count(*) AS n FROM j GROUP BY ALL"
)
def job_outcomes(spark, sf_dir):
    jobs = events(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in _JOB.items()])
    outcome = state.job_outcome(*[F.col(c) for c in ("enqueued", "max_age", "started", "timeout", "ended", "canceled", "panicked")])
    return jobs.withColumn("outcome", outcome).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, attempt, delay, CAST(sum(delay) OVER (PARTITION BY event_id ORDER BY attempt) AS BIGINT) AS waited FROM (SELECT event_id, unnest(range(1, 2 + event_id % 7)) AS attempt, CASE WHEN attempt = 1 THEN 0 ELSE least(200 * CAST(pow(2, attempt - 2) AS BIGINT), 5000) END AS delay FROM events)")
def backoff_schedule(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id")
    return state.retries(rows, (F.col("event_id") % 7 + 1), F.lit(200).cast("long"), F.lit(5000).cast("long"))


@query(f"WITH {EVENTS_SQL}, f AS (SELECT event_type AS grp, us, concat('log-', CAST(event_id AS STRING)) AS name FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY us DESC, name DESC) AS rk FROM f) SELECT grp, name, CASE WHEN us < {_NOW - 240 * _HOUR} THEN 'age' ELSE 'count' END AS reason FROM r WHERE rk > 800 OR us < {_NOW - 240 * _HOUR}")
def retention_prune(spark, sf_dir):
    files = events(spark, sf_dir).selectExpr("event_type AS grp", "us", "concat('log-', CAST(event_id AS STRING)) AS name")
    return state.retention(files, "grp", "us", "name", _NOW, 240 * _HOUR, 800).select("grp", "name", "reason")


@query(
    f"WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT user_id % 10 AS executor, k % 9 - 4 AS delta, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn FROM ev), walk AS (SELECT executor, 0::BIGINT AS rn, 0::BIGINT AS value, 0::BIGINT AS rejected FROM (SELECT DISTINCT executor FROM s) UNION ALL "
    "SELECT s.executor, s.rn, CASE WHEN value + delta >= 0 THEN value + delta ELSE value END, rejected + CASE WHEN value + delta >= 0 THEN 0 ELSE 1 END FROM walk w JOIN s ON s.executor = w.executor AND s.rn = w.rn + 1) SELECT executor, value, rejected FROM walk QUALIFY rn = max(rn) OVER (PARTITION BY executor)"
)
def worker_gauge_fold(spark, sf_dir):
    return state.gauge_fold(events(spark, sf_dir).selectExpr("event_id", "user_id % 10 AS executor", "k % 9 - 4 AS delta"), "executor", "event_id", "delta")


@query("SELECT bool_and(NOT (event_type = 'error' AND value > 480)) AS ready, count(*) FILTER (WHERE event_type = 'error' AND value > 480) AS failing, user_id % 5 AS component FROM events GROUP BY 3")
def readiness_all(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("user_id % 5 AS component", "event_type = 'error' AND cents > 48000 AS bad")
    return rows.groupBy("component").agg(F.bool_and(~F.col("bad")).alias("ready"), F.count_if("bad").alias("failing"))
