"""Spark jobs watched while they run: stage rows, and job events for tracking."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from skein.session import job_group
from skein.streaming.tracking import EVENTS

STAGE_ROWS = "job_id string, at timestamp, stage_id long, name string, tasks long, active long, done long, failed long"


@dataclass
class Observed:
    """What was seen of a job so far. `events` are rows of tracking.EVENTS,
    `stages` of STAGE_ROWS; both may be read while the job runs."""

    job_id: str
    cancel: Callable[[], None]
    events: list[tuple] = field(default_factory=list)
    stages: list[tuple] = field(default_factory=list)
    canceled: bool = False

    def event(self, kind: str, fraction: float = 0.0, model_eta: float = 0.0, model_confidence: float = 0.0) -> None:
        self.events.append((self.job_id, len(self.events), datetime.now(UTC), kind, fraction, model_eta, model_confidence))

    def event_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.events), EVENTS)

    def stage_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.stages), STAGE_ROWS)


def _look(spark: SparkSession, group: str, seen: Observed, known: dict[int, tuple]) -> None:
    """One look at the job's stages: a row for each that has moved, and a
    progress event if the share of finished tasks has. Stages come to light as
    adaptive plans unfold; progress never falls, as tracking sees to."""
    tracker, now = spark.sparkContext.statusTracker(), datetime.now(UTC)
    moved = False
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            state = s and (s.numTasks, s.numActiveTasks, s.numCompletedTasks, s.numFailedTasks)
            if s and known.get(stage) != state:
                known[stage] = state
                moved = True
                seen.stages.append((seen.job_id, now, stage, s.name, *state))
    tasks = sum(k[0] for k in known.values())
    if moved and tasks:
        seen.event("progress", sum(k[2] for k in known.values()) / tasks)


@contextmanager
def observed(spark: SparkSession, name: str, every: float = 0.2) -> Iterator[Observed]:
    """Watches the Spark jobs that are run inside: a thread asks Spark's status
    tracker every so many seconds. `cancel` ends them from any thread; the
    block's error is then swallowed if it comes of that. The events end with
    finish, fail, or cancel and finish."""
    group = f"{name}-{uuid.uuid4().hex}"
    known: dict[int, tuple] = {}
    over = threading.Event()
    with job_group(spark, group, name) as stop:

        def cancel() -> None:
            if not seen.canceled:
                seen.canceled = True
                seen.event("cancel")
            stop()

        seen = Observed(group, cancel)

        def poll() -> None:
            while not over.wait(every):
                _look(spark, group, seen, known)

        watcher = threading.Thread(target=poll, daemon=True)
        seen.event("submit")
        seen.event("start")
        watcher.start()
        failed = False
        try:
            yield seen
        except Exception:
            failed = True
            if not seen.canceled:
                raise
        finally:
            over.set()
            watcher.join()
            _look(spark, group, seen, known)
            seen.event("fail" if failed and not seen.canceled else "finish")
