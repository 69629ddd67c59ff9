"""Watch mode: every scan of a target is compared with the one before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from skein.operators import history
from skein.streaming.tracking import PROVIDER

ROWS = "scan_id long, fingerprint string, finding_id string, severity string, confidence string, title string, file string, detail string, observation boolean, ordinal long"


def watch(
    spark: SparkSession,
    source: str,
    state: str,
    checkpoint: str,
    on_cycle: Callable[[int, DataFrame, int], None],
    fail_on: str = "HIGH",
) -> StreamingQuery:
    """Starts a stream over finding rows written as Parquet below `source`.

    Each micro-batch is one cycle: its rows are compared with the last cycle's
    rows, kept in `state`/cycle=<n>; `on_cycle` gets the number, the verdicts
    and the gate's exit code. A batch that is run again after a failure
    overwrites its own cycle and compares with the same earlier one.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        path = f"{state}/cycle={number}"
        rows.write.mode("overwrite").parquet(path)
        before = spark.read.schema(ROWS).parquet(f"{state}/cycle={number - 1}") if number else spark.createDataFrame([], ROWS)
        verdicts = history.revalidate(before, rows)
        gate = history.gate(rows, fail_on).first()
        on_cycle(number, verdicts, gate["exit_code"] if gate else 0)
        rows.unpersist()

    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", "1").parquet(source)
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of scans: those without a fingerprint only say that a target was
#: scanned, so that a scan without findings resolves what was there.
CYCLE_ROWS = "target string, scan_id long, at timestamp, fingerprint string, severity string, confidence string, title string, file string, observation boolean, ordinal long"
_FINDING = "severity string, confidence string, title string, file string, observation boolean"
_PAIRS = f"target string, scan_id long, at timestamp, fingerprint string, o struct<{_FINDING.replace(' ', ':').replace(',:', ',')}>, n struct<{_FINDING.replace(' ', ':').replace(',:', ',')}>"
_SHOWN = len(history.SHOWN)


class _Cycles(StatefulProcessor):
    """The findings of one part of a target, by fingerprint, and the rows of
    scans that are not over. A timer at a scan's time ends it: its rows are
    compared with what was there, and what it did not find is resolved."""

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "fingerprint string", f"{_FINDING}, at long")
        self.waiting = handle.getListState("waiting", f"at long, scan_id long, ordinal long, fingerprint string, {_FINDING}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The last record of a finding counts, so that only one of each scan is
        # kept; every value and timer costs a call.
        came: dict[tuple, tuple] = {}
        for batch in rows:
            for r in batch.sort_values("ordinal", kind="stable").drop_duplicates(["at", "scan_id", "fingerprint"], keep="last").itertuples(index=False):
                at, found = r.at.value // 1000, None if pd.isna(r.fingerprint) else r.fingerprint
                if (one := (at, int(r.scan_id), found)) not in came or came[one][2] <= r.ordinal:
                    came[one] = (*one[:2], int(r.ordinal), found, *((r.severity, r.confidence, r.title, r.file, bool(r.observation)) if found else (None,) * _SHOWN))
        self.waiting.appendList(list(came.values()))
        for at in {one[0] for one in came}:
            self.handle.registerTimer(max(1, at // 1000 - 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:3]) if self.waiting.exists() else []
        over = [r for r in rows if r[0] // 1000 <= mark]
        left = rows[len(over) :]
        if over:
            self.waiting.put(left) if left else self.waiting.clear()
        elif rows and expiredTimerInfo.getExpiryTimeInMs() <= mark:
            self.handle.registerTimer(max(1, rows[0][0] // 1000))  # rang a little early
        out = []
        for scan in sorted({r[:2] for r in over}):
            now = {r[3]: tuple(r[4:]) for r in over if r[:2] == scan and r[3] is not None}
            pairs = [(f, tuple(self.known.getValue((f,)))[:_SHOWN] if self.known.containsKey((f,)) else None, new) for f, new in now.items()]
            gone = [(f, tuple(old)[:_SHOWN], None) for (f,), old in list(self.known.iterator()) if f not in now] if self.known.exists() else []
            for f, _, _ in gone:
                self.known.removeKey((f,))
            for f, new in now.items():
                self.known.updateValue((f,), (*new, scan[0]))
            out += [self._row(key[0], scan, *pair) for pair in pairs + gone]
        yield pd.DataFrame(out)

    @staticmethod
    def _row(target: str, scan: tuple[int, int], fingerprint: str, old: tuple | None, new: tuple | None) -> dict:
        named = lambda v: None if v is None else dict(zip(history.SHOWN, v, strict=True))
        return {"target": target, "scan_id": scan[1], "at": pd.Timestamp(scan[0], unit="us", tz="UTC"), "fingerprint": fingerprint, "o": named(old), "n": named(new)}

    def close(self) -> None:
        pass


#: Parts that a target's findings are dealt to, so that no task holds a large target.
PARTS = 32


def watched(rows: DataFrame, late: str = "0 seconds", parts: int = PARTS) -> DataFrame:
    """Verdicts as a stream over a stream of CYCLE_ROWS of many targets: for
    every scan, what is new, worsened, improved, persisted or resolved against
    the scan of its target before it. A scan's rows have one time, later than
    its predecessor's; it is over when the watermark reaches it, also where
    several scans come in one micro-batch, or one in several."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = [c.split(" ")[0] for c in CYCLE_ROWS.split(", ")]
    own = F.pmod(F.xxhash64("fingerprint"), F.lit(parts))
    # A row without a fingerprint tells every part that the scan took place.
    part = F.explode(F.when(F.col("fingerprint").isNull(), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(own)))
    dealt = rows.select(*columns, part.alias("part")).withWatermark("at", late)
    pairs = dealt.groupBy("target", "part").transformWithStateInPandas(_Cycles(), _PAIRS, "Append", "EventTime")
    return pairs.select("target", "scan_id", "at", "fingerprint", *history.verdict_columns(F.col("o"), F.col("n")))


def marked(rows: DataFrame) -> DataFrame:
    """CYCLE_ROWS of finding rows: the last record of each finding of a scan, and
    one row a scan that has no fingerprint."""
    columns = [c.split(" ")[0] for c in CYCLE_ROWS.split(", ")]
    found = history.last_of(rows.select(*columns), ["target", "scan_id", "at", "fingerprint"], "ordinal")
    scans = rows.select("target", "scan_id", "at").distinct().withColumn("ordinal", F.lit(-1).cast("long"))
    return found.unionByName(scans, allowMissingColumns=True)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by event type in event-time windows; rows later than `late` are
    left out. Runs on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
