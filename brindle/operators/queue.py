"""Durable-queue operators over snapshots of a table: each is a pure function of rows and an as-of time.

Times are microseconds since the epoch.  An inbox has id, scope, message_id, ordering_key,
payload, status, attempts, available_at, claim_token, lease_until, terminal_at,
terminal_reason and created_at; a nonce table scope, nonce_key and expires_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("pending", "processing")
STATUSES = ("pending", "processing", "completed", "manual_review")


def eligible(as_of: int, explicit: bool = False) -> Column:
    """Due, and pending or (unless recovery is explicit) processing with an expired lease."""
    reclaimable = (F.col("status") == "processing") & (F.col("lease_until") <= as_of) & F.lit(not explicit)
    return (F.col("available_at") <= as_of) & ((F.col("status") == "pending") | reclaimable)


def eligible_at() -> Column:
    """When a row became due: for one in processing not before its lease ran out."""
    return F.when(F.col("status") == "processing", F.greatest("available_at", "lease_until")).otherwise(F.col("available_at"))


def heads(inbox: DataFrame, scope: str) -> DataFrame:
    """The live row of least id of each ordering key: one aggregation that carries the whole row."""
    live = inbox.where((F.col("scope") == scope) & F.col("status").isin(*LIVE))
    row = F.struct(*[F.col(c) for c in inbox.columns])
    return live.groupBy("ordering_key").agg(F.min_by(row, "id").alias("r")).select("r.*")


def ready(inbox: DataFrame, scope: str, as_of: int, explicit: bool = False) -> DataFrame:
    return heads(inbox, scope).where(eligible(as_of, explicit)).withColumn("eligible_at", eligible_at())


def candidates(inbox: DataFrame, scope: str, as_of: int, limit: int, explicit: bool = False) -> DataFrame:
    """The ready heads first due; a top-k, so no full sort."""
    return ready(inbox, scope, as_of, explicit).orderBy("available_at", "created_at", "id").limit(limit)


def transition(df: DataFrame, when: Column, **to) -> DataFrame:
    """Rows for which `when` holds take the values of `to`; `changed` tells which."""
    df = df.withColumn("changed", F.coalesce(when, F.lit(False)))
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.col("changed"), (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in to.items()})


def claim(inbox: DataFrame, scope: str, as_of: int, lease: int, token: str, limit: int, explicit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(claims, inbox after): the first due heads go to processing under a token and a lease."""
    chosen = candidates(inbox, scope, as_of, limit, explicit)
    claims = chosen.select("id", "message_id", "ordering_key", "payload", F.lit(token).alias("claim_token"), (F.col("attempts") + 1).alias("attempts"), "created_at", "eligible_at")
    marks = F.broadcast(chosen.select(F.col("id").alias("_chosen")))  # at most `limit` rows
    after = transition(inbox.join(marks, F.col("id") == F.col("_chosen"), "left"), F.col("_chosen").isNotNull(), status="processing", attempts=F.col("attempts") + 1, claim_token=token, lease_until=as_of + lease)
    return claims, after.drop("_chosen")


def _fence(scope: str, token: str) -> Column:
    return (F.col("scope") == scope) & (F.col("status") == "processing") & (F.col("claim_token") == token)


_FREE = {"claim_token": None, "lease_until": None}


def complete(inbox: DataFrame, scope: str, token: str, as_of: int, reason: str = "", only: Column | None = None) -> DataFrame:
    """Rows held by the token under a live lease end, without their payload."""
    cond = _fence(scope, token) & (F.col("lease_until") > as_of)
    return transition(inbox, cond if only is None else cond & only, status="completed", payload="{}", terminal_at=as_of, terminal_reason=F.nullif(F.lit(reason), F.lit("")), **_FREE)


def release(inbox: DataFrame, scope: str, token: str, as_of: int, delay: int, at: int | None = None, only: Column | None = None) -> DataFrame:
    """Back to pending after a delay; the attempt counts."""
    cond = _fence(scope, token)
    return transition(inbox, cond if only is None else cond & only, status="pending", available_at=as_of + delay if at is None else at, **_FREE)


def defer(inbox: DataFrame, scope: str, token: str, as_of: int, delay: int, at: int | None = None, only: Column | None = None) -> DataFrame:
    """Back to pending after a delay; the attempt is given back."""
    cond = _fence(scope, token)
    return transition(inbox, cond if only is None else cond & only, status="pending", attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), available_at=as_of + delay if at is None else at, **_FREE)


def renew(inbox: DataFrame, scope: str, token: str, as_of: int, lease: int, only: Column | None = None) -> DataFrame:
    cond = _fence(scope, token)
    return transition(inbox, cond if only is None else cond & only, lease_until=as_of + lease)


def manual_review(inbox: DataFrame, scope: str, token: str, as_of: int, reason: str, scrub: bool = False, only: Column | None = None) -> DataFrame:
    cond = _fence(scope, token)
    return transition(inbox, cond if only is None else cond & only, status="manual_review", payload=F.lit("{}") if scrub else F.col("payload"), terminal_at=as_of, terminal_reason=reason, **_FREE)


def release_token(inbox: DataFrame, scope: str, token: str, keep: list[int] = ()) -> DataFrame:
    """All rows of a token but those kept go back to pending with their attempt refunded."""
    kept = F.array_contains(F.array(*[F.lit(int(k)) for k in keep]), F.col("id")) if keep else F.lit(False)
    return transition(inbox, _fence(scope, token) & ~kept, status="pending", attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), **_FREE)


def _fenced(decisions: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Decisions under names of their own, the condition that joins them to rows, and the fence beyond it."""
    d = decisions.select(*[F.col(c).alias(f"d_{c}") for c in ("id", "message_id", "claim_token", "attempts", "lease_until", "status", "reason")])
    held = (F.col("d_claim_token") != "") & (F.col("status") == "processing") & (F.col("claim_token") == F.col("d_claim_token")) & (F.col("lease_until") == F.col("d_lease_until"))
    waiting = (F.col("d_claim_token") == "") & (F.col("status") == "pending") & F.col("claim_token").isNull() & F.col("lease_until").isNull()
    on = (F.col("id") == F.col("d_id")) & (F.col("message_id") == F.col("d_message_id")) & (F.col("attempts") == F.col("d_attempts"))
    return d, on, held | waiting


def apply_recovery(inbox: DataFrame, decisions: DataFrame, scope: str, as_of: int, scrub: bool = False) -> DataFrame:
    """Bulk decisions (id, message_id, claim_token, attempts, lease_until, status, reason), each fenced by what it saw.

    Of several decisions that saw the same of a row, the least by status and reason applies.
    """
    seen = ("id", "message_id", "claim_token", "attempts", "lease_until")
    one = decisions.groupBy(*seen).agg(F.min(F.struct("status", "reason")).alias("_d")).select(*seen, "_d.status", "_d.reason")
    d, on, fence = _fenced(one)
    joined = inbox.join(d, on, "left")
    blank = (F.col("d_status") == "completed") | ((F.col("d_status") == "manual_review") & F.lit(scrub))
    out = transition(
        joined, (F.col("scope") == scope) & fence, status=F.col("d_status"), payload=F.when(blank, F.lit("{}")).otherwise(F.col("payload")),
        terminal_at=F.when(F.col("d_status") != "pending", F.lit(as_of)), terminal_reason=F.nullif(F.col("d_reason"), F.lit("")), available_at=as_of, **_FREE,
    )
    return out.drop(*d.columns)


def recovery_claims(inbox: DataFrame, decisions: DataFrame, scope: str) -> DataFrame:
    """One row: how many decisions were asked for, how many rows they still hold, and lost, whether that is fewer: the claim is lost and nothing must be applied."""
    d, on, fence = _fenced(decisions)
    held = inbox.where(F.col("scope") == scope).join(d, on).where(fence).agg(F.lit(0).cast("long").alias("asked"), F.count_distinct("id").alias("affected"))
    asked = decisions.agg(F.count(F.lit(1)).alias("asked"), F.lit(0).cast("long").alias("affected"))
    return asked.union(held).agg(F.sum("asked").alias("asked"), F.sum("affected").alias("affected")).withColumn("lost", F.col("affected") != F.col("asked"))


def runtime_snapshot(inbox: DataFrame, scope: str, as_of: int) -> DataFrame:
    """Counts by status, how many are due, and the age of the oldest due, in one filtered aggregation."""
    due_at = F.when(F.col("status") == "pending", F.col("available_at")).when(F.col("status") == "processing", F.col("lease_until"))
    rows = inbox.where((F.col("scope") == scope) & F.col("status").isin("pending", "processing", "manual_review")).withColumn("due_at", due_at)
    due = F.col("due_at") <= as_of
    return rows.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "manual_review")], F.count_if(due).alias("due"),
        F.coalesce(F.greatest(F.lit(as_of) - F.min(F.when(due, F.col("due_at"))), F.lit(0)), F.lit(0)).alias("oldest_due_us"),
    )


def ready_snapshot(rows: DataFrame, as_of: int) -> DataFrame:
    """Count and greatest age of rows with eligible_at."""
    return rows.agg(F.count(F.lit(1)).alias("ready"), F.coalesce(F.greatest(F.lit(as_of) - F.min("eligible_at"), F.lit(0)), F.lit(0)).alias("oldest_us"))


def head_mismatches(inbox: DataFrame) -> DataFrame:
    """Keys whose live row first by creation isn't the one of least id."""
    live = inbox.where(F.col("status").isin(*LIVE))
    per_key = live.groupBy("scope", "ordering_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("first_created_id"), F.min("id").alias("least_id"))
    return per_key.where("first_created_id <> least_id")


def violations(inbox: DataFrame) -> DataFrame:
    """One row (id, rule) for each state rule a row breaks."""
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    none = lambda *cs: [F.col(c).isNull() for c in cs]
    every = lambda *xs: reduce(lambda a, b: a & b, xs)
    s = F.col("status")
    lease = (
        ((s == "pending") & every(*none("claim_token", "lease_until", "terminal_at")))
        | ((s == "processing") & F.col("claim_token").isNotNull() & F.col("lease_until").isNotNull() & F.col("terminal_at").isNull())
        | (s.isin("completed", "manual_review") & every(*none("claim_token", "lease_until")) & F.col("terminal_at").isNotNull())
    )
    reason = ((s == "manual_review") & ~blank("terminal_reason")) | ((s == "completed") & (F.col("terminal_reason").isNull() | ~blank("terminal_reason"))) | (~s.isin("manual_review", "completed") & F.col("terminal_reason").isNull())
    rules = {"message_id": ~blank("message_id"), "ordering_key": ~blank("ordering_key"), "payload": F.col("payload").rlike(r"^\s*\{"), "attempts": F.col("attempts") >= 0, "status": s.isin(*STATUSES), "terminal_reason": reason, "lease": lease}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return inbox.select("id", F.explode(broken).alias("rule"))


def prune(inbox: DataFrame, scope: str, as_of: int, retention: int, limit: int, cutoff: int, status: str) -> DataFrame:
    """The rows of a terminal status to delete: the oldest `limit` past retention and cutoff."""
    gone = inbox.where((F.col("scope") == scope) & (F.col("status") == status) & (F.col("terminal_at") <= min(cutoff, as_of - retention)))
    return gone.orderBy("terminal_at", "id").limit(limit)


def prune_two_stage(inbox: DataFrame, scope: str, as_of: int, retention: int, limit: int, cutoff: int) -> DataFrame:
    """Completed rows first; what is left of the limit goes to manual_review."""
    both = prune(inbox, scope, as_of, retention, limit, cutoff, "completed").withColumn("stage", F.lit(0)).unionByName(prune(inbox, scope, as_of, retention, limit, cutoff, "manual_review").withColumn("stage", F.lit(1)))
    return both.orderBy("stage", "terminal_at", "id").limit(limit)


def survivors(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return df.join(gone.select(*keys), list(keys), "left_anti")


def admit(existing: DataFrame, arrivals: DataFrame, seq: str = "seq") -> DataFrame:
    """arrivals (scope, message_id, seq, ...) with outcome: accepted if new and first of its identity, else duplicate."""
    first = F.row_number().over(Window.partitionBy("scope", "message_id").orderBy(seq)) == 1
    known = existing.select("scope", "message_id").distinct().withColumn("_known", F.lit(True))
    return arrivals.withColumn("_first", first).join(known, ["scope", "message_id"], "left").withColumn("outcome", F.when(F.col("_first") & F.col("_known").isNull(), "accepted").otherwise("duplicate")).drop("_first", "_known")


def prune_nonces(nonces: DataFrame, scope: str, as_of: int, limit: int) -> DataFrame:
    return nonces.where((F.col("scope") == scope) & (F.col("expires_at") <= as_of)).orderBy("expires_at", "nonce_key").limit(limit)
