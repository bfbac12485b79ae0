"""Keyed event-time state over batches: set-once keys, limiters, caches, bounded queues, jobs, samplers, retries.

Times are integers (microseconds).  A key's events are folded in order by a state that goes
from row to row, so a key's history is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds


def openers(df: DataFrame, key: str, ts: str, seq: str, ttl: int) -> DataFrame:
    """Adds opened_at: the time of the event that opened the span an event falls into.

    A key's first event opens a span of ttl; the first event at its end or later opens the next.
    """

    def step(opened, t):
        opened = t if opened < 0 or t >= opened + ttl else opened
        return opened, (opened,)

    return folds.running(df, key, (ts, seq), (ts,), "opened_at bigint", lambda: -1, step)


def set_once(df: DataFrame, key: str, ts: str, seq: str, ttl: int) -> DataFrame:
    """Adds accepted (no unexpired entry of the key was there) and expires (of the entry after the event)."""
    rows = openers(df, key, ts, seq, ttl)
    first = F.row_number().over(Window.partitionBy(key, "opened_at").orderBy(ts, seq)) == 1
    return rows.withColumn("accepted", first).withColumn("expires", F.col("opened_at") + ttl).drop("opened_at")


def fixed_window(df: DataFrame, key: str, ts: str, seq: str, window: int, limit: int) -> DataFrame:
    """Adds window_start, n (the event's number in its window) and allowed (n <= limit)."""
    rows = openers(df, key, ts, seq, window).withColumnRenamed("opened_at", "window_start")
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, seq)).cast("long")
    return rows.withColumn("n", n).withColumn("allowed", F.col("n") <= limit)


def cache_hits(df: DataFrame, key: str, ts: str, seq: str, ttl: int) -> DataFrame:
    """Adds hit: an entry stored at most ttl ago is there.  Entries expire by the time they were stored."""
    return set_once(df, key, ts, seq, ttl + 1).withColumn("hit", ~F.col("accepted")).drop("accepted", "expires")


def bounded_queue(df: DataFrame, key: str, seq: str, kind: str, capacity: int) -> DataFrame:
    """One row a key: offered, accepted, rejected, taken, depth of a FIFO that holds at most `capacity`; kind is put or take."""

    def step(state, what):
        depth, offered, accepted, taken = state
        if what == "put":
            fits = depth < capacity
            return depth + fits, offered + 1, accepted + fits, taken
        got = what == "take" and depth > 0
        return depth - got, offered, accepted, taken + got

    return folds.totals(df, key, (seq,), (kind,), "offered bigint, accepted bigint, rejected bigint, taken bigint, depth bigint", lambda: (0, 0, 0, 0), step, lambda s: (s[1], s[2], s[1] - s[2], s[3], s[0]))


def job_outcome(enqueued: Column, max_age: Column, started: Column, timeout: Column, ended: Column, canceled: Column, panicked: Column) -> Column:
    """stale before it started, panic, canceled, timeout or success of a job's times; pending without a start."""
    return (
        F.when((max_age > 0) & (started >= enqueued + max_age), "stale").when(started.isNull(), "pending").when(panicked, "panic").when(canceled, "canceled").when((timeout > 0) & (ended - started >= timeout), "timeout").otherwise("success")
    )


def sampler_status(df: DataFrame, key: str, ts: str, failed: Column, as_of: int, interval: int, grace: int) -> DataFrame:
    """One row a key of its samples up to as_of: status (ok, stale or unavailable), last_success, age.

    Stale after two intervals and the grace; unavailable without a success.
    """
    seen = df.where(F.col(ts) <= as_of).groupBy(key).agg(F.max(F.when(~failed, F.col(ts))).alias("last_success"), F.max_by(failed, F.struct(ts)).alias("last_failed"))
    age = F.lit(as_of) - F.col("last_success")
    status = F.when(F.col("last_success").isNull() | F.col("last_failed"), "unavailable").when(age > 2 * interval + grace, "stale").otherwise("ok")
    return seen.select(key, status.alias("status"), "last_success", age.alias("age"))


def backoff(base: Column, limit: Column, attempt: Column) -> Column:
    """base doubled `attempt` times, at most limit, without overflow."""
    doublings = F.least(F.greatest(attempt, F.lit(0)), F.lit(62))
    return F.when((base <= 0) | (limit <= 0), F.lit(0).cast("long")).when(base >= F.call_function("shiftright", limit, doublings.cast("int")), limit).otherwise(F.call_function("shiftleft", base, doublings.cast("int")))


def store_backoff(base: Column, limit: Column, attempts: Column, most_doublings: int = 8) -> Column:
    """The delay before a stored row is tried again: base doubled with each attempt, at most `most_doublings` times, at most limit."""
    return backoff(base, limit, F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(most_doublings)))


def retries(df: DataFrame, attempts: Column, base: Column, limit: Column) -> DataFrame:
    """One row for each attempt of a row: attempt (from 1), delay before it and waited so far."""
    delays = F.transform(F.sequence(F.lit(1), F.greatest(attempts, F.lit(1))), lambda i: F.struct(i.alias("attempt"), F.when(i == 1, F.lit(0).cast("long")).otherwise(backoff(base, limit, i - 2)).alias("delay")))
    rows = df.withColumn("_d", delays)
    waited = F.transform("_d", lambda x: F.struct(x["attempt"].alias("attempt"), x["delay"].alias("delay"), F.aggregate(F.slice("_d", F.lit(1), x["attempt"]), F.lit(0).cast("long"), lambda a, y: a + y["delay"]).alias("waited")))
    return rows.select(*df.columns, F.explode(waited).alias("r")).select(*df.columns, "r.*")


def retention(df: DataFrame, group: str, ts: str, name: str, as_of: int, max_age: int, keep: int) -> DataFrame:
    """Rows to remove: older than max_age, or beyond the newest `keep` of their group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(ts), F.desc(name)))
    by_count, by_age = F.col("_rank") > keep, F.col(ts) < as_of - max_age
    return df.withColumn("_rank", rank).where(by_count | by_age).withColumn("reason", F.when(by_age, "age").otherwise("count")).drop("_rank")


def gauge_fold(df: DataFrame, key: str, seq: str, delta: str) -> DataFrame:
    """One row a key: value after its deltas in order, and how many were rejected; one that would go below 0 is rejected whole."""

    def step(state, d):
        value, rejected = state
        return (value + d, rejected) if value + d >= 0 else (value, rejected + 1)

    return folds.totals(df, key, (seq,), (delta,), "value bigint, rejected bigint", lambda: (0, 0), step, lambda s: s)


def finalizers(df: DataFrame, key: str, seq: str, kind: str, capacity: int) -> DataFrame:
    """One row a key of a finalizer's events in order (reserve, claim, done, close): reservations still held, claimed, completed, rejected, overloaded (of these while open).

    A reservation is taken while the finalizer is open and fewer than `capacity` are held; done gives one back.
    """

    def step(state, what):
        held, claimed, done, rejected, overloaded, closed = state
        if what == "reserve":
            if closed or held >= capacity:
                return held, claimed, done, rejected + 1, overloaded + (not closed), closed
            return held + 1, claimed, done, rejected, overloaded, closed
        if what == "claim":
            return held, claimed + 1, done, rejected, overloaded, closed
        if what == "done":
            return max(held - 1, 0), claimed, done + 1, rejected, overloaded, closed
        return held, claimed, done, rejected, overloaded, closed or what == "close"

    return folds.totals(df, key, (seq,), (kind,), "reservations bigint, claimed bigint, completed bigint, rejected bigint, overloaded bigint", lambda: (0, 0, 0, 0, 0, False), step, lambda s: s[:5])


def pool_snapshot(jobs: DataFrame, group: str, as_of: int) -> DataFrame:
    """One row a group of jobs (enqueued, started, ended, outcome; times null where not yet): queue depth, in flight, ages of the oldest of both, and counts by outcome of what started (attempts) and what didn't (discarded)."""
    waiting = F.col("started").isNull() & F.col("ended").isNull()
    flying = F.col("started").isNotNull() & F.col("ended").isNull()
    over = F.col("ended").isNotNull()
    age = lambda c, cond: F.coalesce(F.greatest(F.lit(as_of) - F.min(F.when(cond, F.col(c))), F.lit(0)), F.lit(0)).cast("long")
    per = jobs.groupBy(group, "outcome").agg(F.count_if(waiting).alias("w"), F.count_if(flying).alias("f"), age("enqueued", waiting).alias("wa"), age("started", flying).alias("fa"), F.count_if(over & F.col("started").isNotNull()).alias("a"), F.count_if(over & F.col("started").isNull()).alias("d"))
    counts = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.concat(F.col("outcome"), F.lit("="), F.col(c).cast("string"))))))
    return per.groupBy(group).agg(F.sum("w").alias("queue_depth"), F.sum("f").alias("in_flight"), F.max("wa").alias("oldest_queued"), F.max("fa").alias("oldest_in_flight"), counts("a").alias("attempts"), counts("d").alias("discarded"))
