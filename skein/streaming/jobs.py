"""The job state machine over a stream of job events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Which event moves a job from which state to which.
MOVES = {
    ("", "submit"): "queued",
    ("queued", "start"): "running",
    ("queued", "cancel"): "canceled",
    ("running", "finish"): "done",
    ("running", "fail"): "error",
    ("running", "cancel"): "canceling",
    ("canceling", "finish"): "canceled",
    ("canceling", "fail"): "canceled",
}
FINAL = ("done", "error", "canceled")
RETENTION_MS = 3_600_000

OUTPUT = "job_id string, state string, percent double, rate double, at timestamp"
STATE = "state string, percent double, rate double, amount double, at double"


def step(state: tuple, kind: str, at: float, percent: float, amount: float) -> tuple:
    """(state, percent, rate, amount, at) after one event. Progress never
    falls; the rate is an average with weight 0.35 on the newest sample; events
    that don't apply to the state change nothing but the clock."""
    name, done, rate, before, seen = state
    to = MOVES.get((name, kind), name)
    if kind == "progress" and name == "running":
        done = max(done, min(percent, 100.0))
        if at > seen and amount > before:
            sample = (amount - before) / (at - seen)
            rate = sample if rate == 0 else 0.65 * rate + 0.35 * sample
        before = max(before, amount)
    if to == "done":
        done = 100.0
    return to, done, rate, before, max(at, seen)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state, retain_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    now = tuple(state.get) if state.exists else ("", 0.0, 0.0, 0.0, 0.0)
    for batch in batches:
        for r in batch.sort_values("at").itertuples():
            now = step(now, r.kind, r.at.timestamp(), float(r.percent or 0), float(r.amount or 0))
    state.update(now)
    if now[0] in FINAL and retain_ms:
        state.setTimeoutDuration(retain_ms)
    yield pd.DataFrame([{"job_id": key[0], "state": now[0], "percent": now[1], "rate": now[2], "at": pd.Timestamp(now[4], unit="s")}])


def job_states(events: DataFrame, retain_ms: int = RETENTION_MS) -> DataFrame:
    """The state of each job after every micro-batch of events (job_id, kind,
    at, percent, amount). A finished job's state is dropped `retain_ms` after
    its last event; 0 keeps it (a run over what is there now then ends, while
    timeouts keep a stream going)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout = GroupStateTimeout.ProcessingTimeTimeout if retain_ms else GroupStateTimeout.NoTimeout
    advance = lambda key, batches, state: _advance(key, batches, state, retain_ms)
    return events.groupBy("job_id").applyInPandasWithState(advance, OUTPUT, STATE, "update", timeout)
