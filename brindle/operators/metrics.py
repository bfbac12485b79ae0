"""Metrics of labelled events: counters, gauges, cumulative histograms, series caps, exposition text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wire import float_text

#: Fixed limits of a vector.
MAX_SERIES, MAX_LABELS, MAX_NAME_BYTES, MAX_VALUE_BYTES = 1024, 16, 128, 256


def label_key(labels: Column) -> Column:
    """A map of labels in a form that is alike for equal maps and apart for others."""
    return F.concat_ws("", F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(F.octet_length(e["key"]).cast("string"), F.lit(":"), e["key"], F.octet_length(e["value"]).cast("string"), F.lit(":"), e["value"])))


def valid_labels(labels: Column, most: int = MAX_LABELS) -> Column:
    """Within the limits on labels and their sizes."""
    return (F.size(labels) <= most) & F.forall(F.map_entries(labels), lambda e: (F.octet_length(e["key"]).between(1, MAX_NAME_BYTES)) & (F.octet_length(e["value"]) <= MAX_VALUE_BYTES))


def counters(df: DataFrame, labels: Column, value: Column) -> DataFrame:
    """Sum of each series; a negative or null value adds nothing."""
    rows = df.select(label_key(labels).alias("series"), F.when(value > 0, value).otherwise(F.lit(0)).alias("v"))
    return rows.groupBy("series").agg(F.sum("v").alias("total"))


def gauges(df: DataFrame, labels: Column, value: Column, order: Column) -> DataFrame:
    """Last value of each series."""
    rows = df.select(label_key(labels).alias("series"), value.alias("v"), order.alias("o"))
    return rows.groupBy("series").agg(F.max_by("v", "o").alias("value"))


def histograms(df: DataFrame, labels: Column, value: Column, bounds: Sequence[float]) -> DataFrame:
    """One row for each series and bound (null: all): cumulative count, total and sum.  NaN is in the total only."""
    rows = df.select(label_key(labels).alias("series"), value.alias("v"))
    per = rows.groupBy("series").agg(*[F.count_if((F.col("v") <= b) & ~F.isnan(F.col("v").cast("double"))).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("v").alias("total"), F.sum("v").alias("sum"))
    parts = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("cumulative"))]
    return per.select("series", F.explode(F.array(*parts)).alias("p"), "total", "sum").select("series", "p.*", "total", "sum")


def capped(df: DataFrame, labels: Column, order: Column, limit: int = MAX_SERIES) -> DataFrame:
    """Adds kept: the observation's series is among the first `limit` to appear, and its labels are valid.

    Ranks series, not observations, so what is sorted is one row a series.
    """
    rows = df.withColumn("_series", F.when(valid_labels(labels), label_key(labels))).withColumn("_order", order)
    first = rows.where("_series IS NOT NULL").groupBy("_series").agg(F.min("_order").alias("_first")).orderBy("_first", "_series").limit(limit).select(F.col("_series").alias("_in"))
    return rows.join(F.broadcast(first), F.col("_series") == F.col("_in"), "left").withColumn("kept", F.col("_in").isNotNull()).drop("_series", "_order", "_in")


def escape_label(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def escape_help(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def label_text(labels: Column) -> Column:
    """{a="b",...} with names in order, or nothing for no labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))


def exposition(name: str, kind: str, help_text: str, samples: DataFrame) -> DataFrame:
    """(line_no, line) of a family of samples (labels, value text): its header, then samples in order of labels."""
    head = samples.sparkSession.createDataFrame([(0, "", f"# HELP {name} " + help_text.replace("\\", "\\\\").replace("\n", "\\n")), (1, "", f"# TYPE {name} {kind}")], "part int, at string, line string")
    lines = samples.select(F.lit(2).alias("part"), label_text(F.col("labels")).alias("at"), F.concat(F.lit(name), label_text(F.col("labels")), F.lit(" "), F.col("value")).alias("line"))
    # one row a series, of which a family has a capped number
    return head.union(lines).select((F.row_number().over(Window.orderBy("part", "at", "line")) - 1).cast("long").alias("line_no"), "line")


def histogram_lines(name: str, help_text: str, bounds: Sequence[float], buckets: Sequence[Column], total: Column, sum_: Column) -> Column:
    """The exposition of one histogram as an array of lines: cumulative buckets, the whole as +Inf, sum and count."""
    head = [F.lit(f"# HELP {name} {help_text}"), F.lit(f"# TYPE {name} histogram")]
    lines = [F.concat(F.lit(f'{name}_bucket{{le="{_bound(b)}"}} '), c.cast("string")) for b, c in zip(bounds, buckets)]
    return F.array(*head, *lines, F.concat(F.lit(f'{name}_bucket{{le="+Inf"}} '), total.cast("string")), F.concat(F.lit(f"{name}_sum "), float_text(sum_.cast("double"))), F.concat(F.lit(f"{name}_count "), total.cast("string")))


def _bound(b: float) -> str:
    return str(int(b)) if b == int(b) else repr(float(b))


def summary_lines(name: str, help_text: str, quantiles: Sequence[float], values: Sequence[Column], total: Column, sum_: Column) -> Column:
    """The exposition of one summary as an array of lines: quantiles, sum and count."""
    head = [F.lit(f"# HELP {name} {help_text}"), F.lit(f"# TYPE {name} summary")]
    lines = [F.concat(F.lit(f'{name}{{quantile="{_bound(q)}"}} '), float_text(v.cast("double"))) for q, v in zip(quantiles, values)]
    return F.array(*head, *lines, F.concat(F.lit(f"{name}_sum "), float_text(sum_.cast("double"))), F.concat(F.lit(f"{name}_count "), total.cast("string")))


#: Bounds of webhook latencies in seconds, and the families of a webhook: (suffix, kind of event, help).
WEBHOOK_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120)
WEBHOOK_COUNTERS = (
    ("requests_total", "request", "Total number of inbound webhook requests."), ("unauthorized_total", "unauthorized", "Total number of webhook requests rejected due to token mismatch."),
    ("bad_request_total", "bad_request", "Total number of webhook requests rejected due to invalid JSON."), ("duplicates_total", "duplicate", "Total number of duplicate webhook requests short-circuited by deduplication."),
    ("enqueue_failures_total", "enqueue_failure", "Total number of webhook requests rejected because durable admission failed."), ("accepted_total", "accepted", "Total number of webhook requests accepted for asynchronous processing."),
)
WEBHOOK_HISTOGRAMS = (("handler_duration_seconds", "handled", "Webhook durable admission duration in seconds."), ("decode_latency_seconds", "decoded", "Webhook request JSON decode latency in seconds."))


def webhook_exposition(df: DataFrame, kind: str, seconds: str, prefix: str) -> DataFrame:
    """(line_no, line): six counters and two histograms of webhook events, from one pass of aggregation; no events give zeros."""
    k, v = F.col(kind), F.col(seconds)
    of = lambda what, c: F.when(k == what, c)
    aggs = [F.count_if(k == what).alias(f"c{i}") for i, (_, what, _) in enumerate(WEBHOOK_COUNTERS)]
    for i, (_, what, _) in enumerate(WEBHOOK_HISTOGRAMS):
        aggs += [F.count_if((k == what) & (v <= b) & ~F.isnan(v)).alias(f"h{i}_{j}") for j, b in enumerate(WEBHOOK_BOUNDS)]
        aggs += [F.count(of(what, v)).alias(f"h{i}_n"), F.coalesce(F.sum(of(what, v)), F.lit(0.0)).alias(f"h{i}_s")]
    one = df.agg(*aggs)
    name = lambda suffix: f"{prefix}_webhook_{suffix}"
    parts = [F.array(F.lit(f"# HELP {name(s)} {h}"), F.lit(f"# TYPE {name(s)} counter"), F.concat(F.lit(f"{name(s)} "), F.col(f"c{i}").cast("string"))) for i, (s, _, h) in enumerate(WEBHOOK_COUNTERS)]
    parts += [histogram_lines(name(s), h, WEBHOOK_BOUNDS, [F.col(f"h{i}_{j}") for j in range(len(WEBHOOK_BOUNDS))], F.col(f"h{i}_n"), F.col(f"h{i}_s")) for i, (s, _, h) in enumerate(WEBHOOK_HISTOGRAMS)]
    return one.select(F.posexplode(F.concat(*parts)).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")


#: Results, outcomes and reasons that a worker's totals have, in order.
ADMISSIONS, ATTEMPTS, DISCARDS = ("accepted", "duplicate", "rejected", "failed", "outcome_unknown"), ("success", "failed", "timeout", "canceled", "panic", "outcome_unknown"), ("stale", "shutdown")
WORKER_LABELS = ("stack_service", "stack_role", "worker", "runtime", "queue_backend", "queue_scope")


def worker_families(df: DataFrame, prefix: str) -> DataFrame:
    """(family, type, labels, value) of workers, one row a sample.

    df has a row a worker: the columns of WORKER_LABELS, profile_id, profile_hash, file_match, checked_ms,
    attempt_timeout_mode, queue_age_mode, enabled, configured_workers, running_workers, in_flight,
    oldest_in_flight_ms, attempt_timeout_ms, max_age_ms, bounded, capacity, queue_depth,
    oldest_queued_ms, snapshot_current, last_success_ms, and maps admissions, attempts and
    discarded by name.  What is null has no sample; counts that a map lacks are 0.  A process
    has its own three families once, by its service and role.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seconds, flag = (lambda c: F.col(c) / 1000.0), (lambda c: F.col(c).cast("int").cast("double"))
    every = F.create_map(*[x for c in WORKER_LABELS for x in (F.lit(c), text(c))])
    with_more = lambda **more: F.map_concat(every, F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v)]))

    def sample(family: str, kind: str, labels: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(f"{prefix}_worker_{family}").alias("family"), F.lit(kind).alias("type"), labels.alias("labels"), value.cast("double").alias("value")))

    gauge = lambda family, value, cond=None: sample(family, "gauge", every, value if cond is None else F.when(cond, value))
    ran = F.col("running_workers").isNotNull()
    own = [
        sample("policy_info", "gauge", with_more(attempt_timeout_mode=text("attempt_timeout_mode"), queue_age_mode=text("queue_age_mode")), F.lit(1)), gauge("enabled", flag("enabled")), gauge("configured_workers", F.col("configured_workers")),
        gauge("running_workers", F.col("running_workers")), gauge("attempt_timeout_seconds", seconds("attempt_timeout_ms"), F.col("attempt_timeout_mode") == "fixed"), gauge("max_queue_age_seconds", seconds("max_age_ms"), F.col("queue_age_mode") == "fixed"),
        gauge("queue_bounded", flag("bounded")), gauge("queue_capacity", F.col("capacity")), gauge("queue_depth", F.col("queue_depth"), F.col("snapshot_current")), gauge("in_flight", F.col("in_flight"), ran),
        gauge("oldest_queued_age_seconds", seconds("oldest_queued_ms"), F.col("snapshot_current")), gauge("oldest_in_flight_age_seconds", seconds("oldest_in_flight_ms"), ran), gauge("queue_snapshot_success", flag("snapshot_current")),
        gauge("queue_snapshot_last_success_timestamp_seconds", seconds("last_success_ms")),
    ]
    for family, label, column, names in (("admissions_total", "result", "admissions", ADMISSIONS), ("attempts_total", "outcome", "attempts", ATTEMPTS), ("discarded_total", "reason", "discarded", DISCARDS)):
        own += [sample(family, "counter", with_more(**{label: F.lit(n)}), F.coalesce(F.try_element_at(column, F.lit(n)), F.lit(0))) for n in names]
    process = F.create_map(F.lit("stack_service"), text("stack_service"), F.lit("stack_role"), text("stack_role"))
    info = F.map_concat(process, F.create_map(F.lit("profile_id"), text("profile_id"), F.lit("profile_hash"), text("profile_hash")))
    whole = [sample("profile_info", "gauge", info, F.lit(1)), sample("profile_file_match", "gauge", process, flag("file_match")), sample("profile_file_last_check_timestamp_seconds", "gauge", process, seconds("checked_ms"))]
    # one row a process: the three families don't differ among its workers
    first = df.groupBy("stack_service", "stack_role").agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("stack_service", "stack_role")]), "worker").alias("_r")).select("stack_service", "stack_role", "_r.*")
    rows = lambda table, parts: table.select(F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.*")
    return rows(first, whole).union(rows(df, own))


def pivoted_totals(df: DataFrame, key: str, kind: str, outcome: str, known: dict[str, Sequence[str]]) -> DataFrame:
    """One row a key with a count of each known (kind, outcome); others are ignored."""
    return df.groupBy(key).agg(*[F.count_if((F.col(kind) == k) & (F.col(outcome) == o)).alias(f"{k}_{o}") for k, outcomes in known.items() for o in outcomes])


def long_totals(wide: DataFrame, key: str, known: dict[str, Sequence[str]]) -> DataFrame:
    """The pivoted totals as rows (key, kind, outcome, n), zeros too."""
    parts = [F.struct(F.lit(k).alias("kind"), F.lit(o).alias("outcome"), F.col(f"{k}_{o}").alias("n")) for k, outcomes in known.items() for o in outcomes]
    return wide.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")


def in_flight(df: DataFrame, key: str, started: str, ended: str, as_of: int) -> DataFrame:
    """One row a key: attempts running at as_of, and the age of the oldest."""
    running = (F.col(started) <= as_of) & (F.col(ended).isNull() | (F.col(ended) > as_of))
    return df.groupBy(key).agg(F.count_if(running).alias("in_flight"), F.coalesce(F.lit(as_of) - F.min(F.when(running, F.col(started))), F.lit(0)).alias("oldest_age"))
