"""Chat messages: roles, instruction profiles, instruction adaptation, completion text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Fixed labels of instruction sections.
INVARIANTS, DEVELOPER = "[APPLICATION INVARIANTS]", "[DEVELOPER INSTRUCTIONS]"


def completion_role(c: Column) -> Column:
    role = F.lower(trimmed(c))
    return F.when(role.isin("developer", "assistant", "system"), role).otherwise("user")


def instruction_profile(model: Column) -> Column:
    return F.when(F.startswith(F.lower(trimmed(model)), F.lit("grok-")), "single_developer").otherwise("openai")


def adapt(messages: DataFrame, profile: str = "openai", conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", breakpoint_: str = "cache_breakpoint") -> DataFrame:
    """One row a conversation: conv, error and messages (array of role, content, cache_breakpoint).

    System messages (invariants) come first, developer ones next, then the history; an
    instruction out of that order is an error.  The openai profile makes labelled developer
    segments, each up to a cache breakpoint; the single profiles flatten all into one.
    """
    if profile not in ("openai", "single_developer", "single_system"):
        raise ValueError(f"unknown profile {profile}")
    part = F.struct(F.col(turn).alias("turn"), F.lower(trimmed(F.col(role))).alias("key"), F.col(role).alias("role"), F.col(content).alias("content"), F.col(breakpoint_).alias("cut"))
    rows = messages.groupBy(conv).agg(F.array_sort(F.collect_list(part)).alias("m"))
    instruction = lambda x: x["key"].isin("system", "developer")
    full = lambda x: trimmed(x["content"]) != ""
    rows = rows.withColumns({
        "inv": F.filter("m", lambda x: (x["key"] == "system") & full(x)), "dev": F.filter("m", lambda x: (x["key"] == "developer") & full(x)), "history": F.filter("m", lambda x: ~instruction(x)),
    })
    turns = lambda c: F.transform(c, lambda x: x["turn"])
    first_dev, first_hist = F.array_min(turns("dev")), F.array_min(turns("history"))
    late_inv = F.filter("inv", lambda x: F.coalesce(x["turn"] > first_hist, F.lit(False)) | F.coalesce(x["turn"] > first_dev, F.lit(False)))
    late_dev = F.filter("dev", lambda x: x["turn"] > first_hist)
    at_inv, at_dev = F.array_min(turns(late_inv)), F.array_min(turns(late_dev))
    why_inv = F.when(F.coalesce(first_hist < at_inv, F.lit(False)), "invariant_after_history").otherwise("invariant_after_developer")
    error = F.when(at_inv.isNotNull() & (at_dev.isNull() | (at_inv < at_dev)), why_inv).when(at_dev.isNotNull(), "developer_after_history")
    text = lambda c: F.array_join(F.transform(c, lambda x: x["content"]), "\n\n")
    made = lambda r, t, b: F.struct(r.alias("role"), t.alias("content"), b.alias("cache_breakpoint"))

    def segments(c: str, label: str) -> Column:
        # positions (from 1) at which a segment ends: each breakpoint, and the last part
        numbers = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c))).otherwise(F.array().cast("array<int>"))
        ends = F.filter(numbers, lambda i: F.element_at(c, i)["cut"] | (i == F.size(c)))
        starts = F.concat(F.array(F.lit(0)), ends)

        def one(e: Column, i: Column) -> Column:
            s = F.element_at(starts, i + 1)
            body = text(F.slice(c, s + 1, e - s))
            return made(F.lit("developer"), F.when(i == 0, F.concat(F.lit(label + "\n"), body)).otherwise(body), F.element_at(c, e)["cut"])

        return F.transform(ends, one)

    if profile == "openai":
        head = F.concat(segments("inv", INVARIANTS), segments("dev", DEVELOPER))
    else:
        section = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(label + "\n"), text(c)))
        cut = F.exists("inv", lambda x: x["cut"]) | F.exists("dev", lambda x: x["cut"])
        flat = made(F.lit(profile.removeprefix("single_")), F.concat_ws("\n\n", section("inv", INVARIANTS), section("dev", DEVELOPER)), cut)
        head = F.filter(F.array(flat), lambda x: x["content"] != "")
    rest = F.transform("history", lambda x: made(x["role"], x["content"], x["cut"]))
    return rows.select(conv, error.alias("error"), F.when(error.isNull(), F.concat(head, rest)).alias("messages"))


def tool_call_envelope(c: Column) -> Column:
    """A JSON object with a member tool_calls, function_call or tool_call."""
    text = trimmed(c)
    keys = F.json_object_keys(text)
    named = F.arrays_overlap(keys, F.array(F.lit("tool_calls"), F.lit("function_call"), F.lit("tool_call")))
    broken = text.rlike(r'^\{\s*"(?:tool_calls|function_call|tool_call)"')
    return F.startswith(text, F.lit("{")) & F.coalesce(named, broken)


def preferred_text(items: DataFrame, response: str, order: str, status: str, phase: str, text: str) -> DataFrame:
    """One row a response: the first completed final answer, else the last completed text; tool envelopes and blanks don't count."""
    t = trimmed(F.col(text))
    ok = items.where((F.col(status) == "completed") & (t != "") & ~tool_call_envelope(F.col(text))).withColumn("_t", t)
    final = F.min_by(F.when(F.col(phase) == "final_answer", F.col("_t")), F.when(F.col(phase) == "final_answer", F.col(order)))
    return ok.groupBy(response).agg(F.coalesce(final, F.max_by("_t", order)).alias("text"))


def usage(items: DataFrame, model: str, *counters: str) -> DataFrame:
    return items.groupBy(model).agg(*[F.sum(c).alias(c) for c in counters])
