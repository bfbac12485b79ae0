"""Structured Streaming forms of the keyed state operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Events with a watermark that follows ts (microseconds) at a distance of `late`."""
    return events.withColumn("_at", F.timestamp_micros(F.col(ts))).withWatermark("_at", late)


def _until(state: GroupState, micros: int) -> None:
    """State is to go once the watermark has passed a time."""
    state.setTimeoutTimestamp(max(micros // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def set_once_stream(events: DataFrame, key: str, ts: str, seq: str, ttl: int, late: str = "1 hour") -> DataFrame:
    """(key, seq, accepted, expires) of a stream: as state.set_once, one number of state a key.

    A micro-batch's events of a key are taken in order of ts and seq; earlier ones that come
    later are judged against the state as it is.  A key's state goes once
    the watermark, `late` behind the latest event, has passed its expiry; events that are later
    than that are left out.
    """
    import pandas as pd

    kinds = dict(events.dtypes)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, seq])
        accepted, until = [], []
        for t in rows[ts]:
            fresh = expires is None or expires <= t
            if fresh:
                expires = int(t) + ttl
            accepted.append(fresh)
            until.append(expires)
        if expires is not None:
            state.update((expires,))
            _until(state, expires)
        yield pd.DataFrame({key: name[0], seq: rows[seq], "accepted": accepted, "expires": until})

    return _timed(events, ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {seq} {kinds[seq]}, accepted boolean, expires bigint", "expires bigint", "append", GroupStateTimeout.EventTimeTimeout)


def limiter_stream(events: DataFrame, key: str, ts: str, seq: str, window: int, limit: int, late: str = "1 hour") -> DataFrame:
    """(key, seq, window_start, n, allowed) of a stream: as state.fixed_window; a key's state goes once the watermark, `late` behind the latest event, has passed its window; events that are later than that are left out."""
    import pandas as pd

    kinds = dict(events.dtypes)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([ts, seq])
        out = []
        for t, s in zip(rows[ts], rows[seq]):
            if start is None or t >= start + window:
                start, n = int(t), 0
            n += 1
            out.append((name[0], s, start, n, n <= limit))
        state.update((start, n))
        _until(state, start + window)
        yield pd.DataFrame(out, columns=[key, seq, "window_start", "n", "allowed"])

    return _timed(events, ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {seq} {kinds[seq]}, window_start bigint, n bigint, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
