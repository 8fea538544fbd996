"""Keyed state with a timer: an eligible event expires when its end has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "event_key long, status string, ends_at timestamp"
STATE = "status string, ends_ms long, seen_ms long"


def _millis(x) -> int | None:
    return None if pd.isna(x) else int(pd.Timestamp(x).value // 1_000_000)


def expiring(observations: DataFrame) -> DataFrame:
    """observations: event_key, status, ends_at, observed_at (instants). One row per event whenever its status changes; an
    eligible event becomes expired at the first batch or timer after its end.

    The latest observation counts, of one instant the last status by name; one older than what is known is ignored. The
    state of an event goes when it has expired, so an observation that comes later is told again. Timers make batches of
    their own: such a query runs until it is stopped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, ends, seen = state.get if state.exists else (None, None, None)
        before = status
        for p in parts:
            for r in p.sort_values(["observed_at", "status"], na_position="first").tail(1).itertuples():
                at = _millis(r.observed_at)
                if seen is None or (at is not None and at >= seen):
                    status, ends, seen = r.status, _millis(r.ends_at), at
        now = state.getCurrentProcessingTimeMs()
        if status == "eligible" and ends is not None and ends < now:
            status = "expired"
        if status == "expired":
            state.remove()
        else:
            state.update((status, ends, seen))
            if status == "eligible" and ends is not None:
                state.setTimeoutDuration(max(1, ends - now))
        if status != before:
            yield pd.DataFrame({"event_key": [key[0]], "status": [status], "ends_at": [pd.NaT if ends is None else pd.Timestamp(ends, unit="ms")]})

    return observations.groupBy("event_key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
