"""Reply-outbox operators over snapshots: ordered delivery per (scope, message_id, phase).

An outbox has id, scope, message_id, phase, ordinal, room_id, client_request_id,
payload, payload_hash, status, attempts, available_at, first_attempt_at, remote_request_id,
claim_token, lease_until, created_at and expires_at (microseconds since the epoch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .queue import transition

LIVE = ("pending", "submitting", "retryable_pre_dispatch", "outcome_unknown")
FAILED = ("dead", "permanent_conflict")
#: Statuses that keep neither payload nor room.
FINAL = ("accepted", "dead", "permanent_conflict")
RESENDABLE = ("pending", "retryable_pre_dispatch", "outcome_unknown")


def is_terminal(c: Column) -> Column:
    return c.isin(*FAILED)


def is_resendable(c: Column) -> Column:
    return c.isin(*RESENDABLE)


def with_predecessors(outbox: DataFrame) -> DataFrame:
    """Adds whether an earlier reply of the sequence isn't accepted, and whether one has failed for good."""
    before = Window.partitionBy("scope", "message_id", "phase").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    return outbox.withColumns({
        "blocked": F.coalesce(F.max(F.col("status") != "accepted").over(before), F.lit(False)),
        "broken": F.coalesce(F.max(F.col("status").isin(*FAILED)).over(before), F.lit(False)),
    })


def lease_free(as_of: int) -> Column:
    return F.col("claim_token").isNull() | F.col("lease_until").isNull() | (F.col("lease_until") <= as_of)


def since() -> Column:
    return F.coalesce("first_attempt_at", "created_at")


def eligible_rows(outbox: DataFrame, scope: str, as_of: int, max_attempts: int, horizon: int) -> DataFrame:
    rows = with_predecessors(outbox.where(F.col("scope") == scope))
    return rows.where(
        F.col("status").isin(*LIVE) & F.col("payload").isNotNull() & (F.col("attempts") < max_attempts) & (F.col("available_at") <= as_of) & (F.col("expires_at") > as_of)
        & lease_free(as_of) & (since() > as_of - horizon) & ~F.col("blocked")
    ).withColumn("eligible_at", F.when(F.col("claim_token").isNotNull() & F.col("lease_until").isNotNull(), F.greatest("available_at", "lease_until")).otherwise(F.col("available_at")))


def redrive(outbox: DataFrame, scope: str, as_of: int, max_attempts: int, horizon: int, limit: int) -> DataFrame:
    rows = eligible_rows(outbox, scope, as_of, max_attempts, horizon)
    return rows.orderBy("created_at", "id").limit(limit).select("id", "message_id", "phase", "ordinal", "room_id", "client_request_id", "payload", "attempts")


def retire(outbox: DataFrame, scope: str, as_of: int, max_attempts: int, horizon: int, limit: int) -> DataFrame:
    """Rows to retire, as they were: too old, or (unless submitting) out of attempts or behind a failed one."""
    rows = with_predecessors(outbox.where(F.col("scope") == scope))
    spent = (F.col("status") != "submitting") & ((F.col("attempts") >= max_attempts) | F.col("broken"))
    gone = rows.where(F.col("status").isin(*LIVE) & lease_free(as_of) & ((since() <= as_of - horizon) | spent))
    return gone.orderBy("created_at", "id").limit(limit).select("id", "message_id", "phase", "ordinal", "status", "room_id", "client_request_id", "payload", "attempts")


def retired(outbox: DataFrame, gone: DataFrame) -> DataFrame:
    """The outbox after retiring."""
    marks = gone.select(F.col("id").alias("_gone"))
    out = transition(outbox.join(marks, F.col("id") == F.col("_gone"), "left"), F.col("_gone").isNotNull(), status="dead", payload=None, room_id="", claim_token=None, lease_until=None)
    return out.drop("_gone")


def status_counts(outbox: DataFrame, scope: str) -> DataFrame:
    return outbox.where((F.col("scope") == scope) & F.col("status").isin(*LIVE)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def begin_attempt(outbox: DataFrame, scope: str, as_of: int, max_attempts: int, horizon: int, token: str, lease: int, only: Column) -> DataFrame:
    ok = eligible_rows(outbox, scope, as_of, max_attempts, horizon).where(only).select(F.col("id").alias("_ok"))
    out = transition(
        outbox.join(ok, F.col("id") == F.col("_ok"), "left"), F.col("_ok").isNotNull(), status="submitting", attempts=F.col("attempts") + 1, first_attempt_at=F.coalesce(F.col("first_attempt_at"), F.lit(as_of)),
        claim_token=token, lease_until=as_of + lease,
    )
    return out.drop("_ok")


def settle(outbox: DataFrame, scope: str, token: str, as_of: int, status: str, delay: int, progressed: bool, request_id: str = "", only: Column | None = None) -> DataFrame:
    """Rows held by the token take a status; a terminal one scrubs payload and room, progress resets attempts."""
    final = status in FINAL
    cond = (F.col("scope") == scope) & (F.col("claim_token") == token)
    return transition(
        outbox, cond if only is None else cond & only, status=status, remote_request_id=F.coalesce(F.nullif(F.lit(request_id), F.lit("")), F.col("remote_request_id")),
        payload=F.lit(None) if final else F.col("payload"), room_id=F.lit("") if final else F.col("room_id"), attempts=F.lit(0) if progressed and not final else F.col("attempts"),
        available_at=as_of + delay, claim_token=None, lease_until=None,
    )


def stage_outcomes(outbox: DataFrame, arrivals: DataFrame, seq: str = "seq") -> DataFrame:
    """arrivals (scope, message_id, phase, ordinal, payload_hash, seq) with outcome, each as if those before it in seq had been stored.

    An identity already stored is already_staged, or payload_diverged if its hash differs; a
    new one is ordinal_superseded behind a greater stored ordinal, else staged.
    """
    key = ["scope", "message_id", "phase"]
    top = outbox.groupBy(*key).agg(F.max("ordinal").alias("_top"))
    same = outbox.select(*key, "ordinal", F.col("payload_hash").alias("_hash"))
    rows = arrivals.join(top, key, "left").join(same, [*key, "ordinal"], "left")
    # an arrival leaves a stored ordinal of at least its own behind, its own or the one that supersedes it
    before = F.max("ordinal").over(Window.partitionBy(*key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_top", F.greatest("_top", before))
    identity = Window.partitionBy(*key, "ordinal").orderBy(seq)
    staged_first = F.coalesce(F.first(F.col("_top") <= F.col("ordinal")).over(identity), F.lit(True))
    rows = rows.withColumn("_n", F.row_number().over(identity)).withColumn("_own", F.when(staged_first, F.first("payload_hash").over(identity)))
    stored = F.coalesce("_hash", F.when(F.col("_n") > 1, F.col("_own")))
    outcome = F.when(stored == F.col("payload_hash"), "already_staged").when(stored.isNotNull(), "payload_diverged").when(F.col("_top") > F.col("ordinal"), "ordinal_superseded").otherwise("staged")
    return rows.withColumn("outcome", outcome).drop("_top", "_hash", "_n", "_own")


def lookup(outbox: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (scope, message_id, phase, ordinal) with found, and status, client_request_id, attempts and has_payload of the stored reply."""
    key = ["scope", "message_id", "phase", "ordinal"]
    stored = outbox.select(*key, F.lit(True).alias("_found"), "status", "client_request_id", "attempts", F.col("payload").isNotNull().alias("has_payload"))
    return wanted.join(stored, key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def mark_diverged(outbox: DataFrame, wanted: DataFrame, as_of: int) -> DataFrame:
    """The outbox with payload_divergence_seen and updated_at set where wanted has the identity."""
    key = ["scope", "message_id", "phase", "ordinal"]
    marks = wanted.select(*key).distinct().withColumn("_mark", F.lit(True))
    out = transition(outbox.join(marks, key, "left"), F.col("_mark").isNotNull(), payload_divergence_seen=True, updated_at=as_of)
    return out.drop("_mark")


#: The statuses of a reply, and the forms of a payload's hash and of a client's request id.
STATUSES = ("pending", "submitting", "accepted", "retryable_pre_dispatch", "outcome_unknown", "dead", "permanent_conflict", "manual_review")
PAYLOAD_HASH, CLIENT_REQUEST_ID = "^[0-9a-f]{64}$", "^[A-Za-z0-9._:-]{8,160}$"


def violations(outbox: DataFrame) -> DataFrame:
    """One row (id, rule) for each state rule a reply breaks."""
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    scrubbed, reviewed = F.col("status").isin(*FINAL), F.col("status") == "manual_review"
    rules = {
        "message_id": filled("message_id"), "phase": filled("phase"), "ordinal": F.col("ordinal") >= 0, "attempts": F.col("attempts") >= 0, "payload_hash": F.col("payload_hash").rlike(PAYLOAD_HASH), "client_request_id": F.col("client_request_id").rlike(CLIENT_REQUEST_ID),
        "status": F.col("status").isin(*STATUSES), "payload_replayable": F.col("payload").isNotNull() | scrubbed, "room_scrub": filled("room_id") | scrubbed, "terminal_reason": F.when(reviewed, filled("terminal_reason")).otherwise(F.col("terminal_reason").isNull()),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return outbox.select("id", F.explode(broken).alias("rule"))


def prune_replies(outbox: DataFrame, scope: str, as_of: int, limit: int) -> DataFrame:
    return outbox.where((F.col("scope") == scope) & (F.col("status") != "manual_review") & (F.col("expires_at") <= as_of)).orderBy("expires_at", "id").limit(limit)
