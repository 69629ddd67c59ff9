"""Command line: analyze folders of scripts, export, and gate on severity.

Exit codes: 0 passed, 1 the gate closed, 2 the input can't be used.
"""

from __future__ import annotations

import argparse
import csv
import io
import sys
import tempfile
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vocab import SEVERITIES
from skein.operators import detectors, history, report
from skein.plans.analysis import PROFILES, analyze_folder
from skein.session import local_session
from skein.sinks import exports
from skein.streaming import watch as watching


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser("skein", description=__doc__)
    args.add_argument("targets", nargs="+", metavar="target")
    args.add_argument("--format", choices=["txt", "html", "csv", "sarif", "json", "openapi"], default="txt")
    args.add_argument("--output")
    args.add_argument("--profile", choices=list(PROFILES), default="balanced")
    args.add_argument("--fail-on", choices=[s.lower() for s in SEVERITIES])
    args.add_argument("--baseline")
    args.add_argument("--save-baseline")
    args.add_argument("--triage", help="JSON lines of fingerprint, status, note; false positives neither count nor close the gate")
    args.add_argument("--watch", type=int, help="scan again every so many seconds (10 at least) until the gate closes, and show what changed")
    args.add_argument("--cycles", type=int, help="with --watch: stop after so many scans")
    args.add_argument("--state", help="with --watch: the folder that keeps what was found, so that a later watch goes on from there")
    args.add_argument("--workers", default="8")
    o = args.parse_args(argv)
    for target in o.targets:
        if not Path(target).is_dir():
            print(f"{target} is no folder", file=sys.stderr)
            return 2
    spark = local_session(o.workers)
    return watch(spark, o) if o.watch else scan(spark, o)


def _counted(spark: SparkSession, rows: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Rows that count: not in the baseline, nor false positives by triage."""
    if o.baseline:
        rows = history.against_baseline(rows, exports.read_baseline(spark, o.baseline)).filter("state <> 'known'")
    if o.triage:
        states = spark.read.schema("fingerprint string, status string, note string").json(o.triage)
        rows = history.with_triage(rows, states).filter("triage_status IS NULL OR triage_status <> 'false_positive'")
    return rows


def _gate(rows: DataFrame, fail_on: str | None) -> int:
    closed = history.gate(rows, fail_on).first() if fail_on else None
    return closed["exit_code"] if closed else 0


def scan(spark: SparkSession, o: argparse.Namespace) -> int:
    done = analyze_folder(spark, o.targets)
    found = done.findings.persist()
    rows = _counted(spark, done.rows(), o)
    if o.save_baseline:
        exports.write_baseline(done.rows(), o.save_baseline)
    if o.format in ("txt", "html", "json"):
        sized = done.documents.withColumn("skip_reason", F.lit(None).cast("string"))
        model = report.dashboard(spark, sized, found, detectors.long(done.documents))
        text = {"txt": exports.text_report, "html": exports.html_report, "json": exports.json_report}[o.format](model)
    elif o.format == "csv" and o.output:
        exports.write_csv(found, o.output)
        text = None
    elif o.format == "csv":
        names = exports.CSV_COLUMNS
        buffer = io.StringIO()
        out = csv.writer(buffer)
        out.writerow(names)
        out.writerows([r[c] for c in names] for r in exports.csv_rows(found).toLocalIterator())
        text = buffer.getvalue()
    elif o.format == "sarif":
        text = exports.sarif(found)
    else:
        from skein.operators import surface

        text = exports.openapi(surface.openapi_paths(done.endpoints))
    if text is not None:
        Path(o.output).write_text(text) if o.output else print(text)
    code = _gate(rows, o.fail_on)
    found.unpersist()
    done.release()
    return code


# How a verdict is shown.
MARKS = {"new": "+ new", "worsened": "! worse", "improved": "- improved", "resolved": "x no longer detected"}


def _show(batch: DataFrame, _: int) -> None:
    """What changed, worst first, and how many findings each verdict has."""
    if batch.isEmpty():
        return
    kept = batch.persist()
    changed = kept.filter(F.col("verdict").isin(*MARKS))
    for r in history.verdict_order(changed).collect():
        was = f" [{r['old_severity']} to {r['severity']}]" if r["verdict"] in ("worsened", "improved") and r["old_severity"] != r["severity"] else ""
        print(f"    {MARKS[r['verdict']]}: {r['title']} ({r['target']}: {r['file']}){was}")
    counts = {r["verdict"]: r["count"] for r in kept.groupBy("verdict").count().collect()}
    if set(counts) <= {"persisted"}:
        print("    (no changes since the previous cycle)")
    print("    " + ", ".join(f"{counts[v]} {v}" for v in history.VERDICTS if v in counts))
    kept.unpersist()


def watch(spark: SparkSession, o: argparse.Namespace) -> int:
    """Scans all targets again and again, and shows what each cycle changed;
    ends with the first exit code above 0. What was found is kept by a stream
    (watch.watched), which goes on from its checkpoint."""
    state = o.state or tempfile.mkdtemp(prefix="skein-watch-")
    source, code, cycle = f"{state}/rows", 0, 0
    print(f"[watch] {len(o.targets)} target(s) every {max(10, o.watch)} s")
    while not code and (o.cycles is None or cycle < o.cycles):
        if cycle:
            time.sleep(max(10, o.watch))
        cycle += 1
        at = datetime.now(UTC)
        seen = spark.createDataFrame([(t, None, at, -1) for t in o.targets], "target string, fingerprint string, at timestamp, ordinal long")
        done = [analyze_folder(spark, [target]) for target in o.targets]
        for target, one in zip(o.targets, done, strict=True):
            found = _counted(spark, one.rows(), o)
            seen = seen.unionByName(found.select("fingerprint", "severity", "confidence", "title", "file", "observation", "ordinal").withColumns({"target": F.lit(target), "at": F.lit(at)}), allowMissingColumns=True)
        rows = seen.withColumn("scan_id", F.lit(int(at.timestamp())).cast("long")).persist()
        n = rows.filter("fingerprint IS NOT NULL AND NOT observation").count()
        print(f"[watch {at:%H:%M:%S}] cycle {cycle}: {n} actionable finding(s)")
        columns = [c.split(" ")[0] for c in watching.CYCLE_ROWS.split(", ")]
        rows.select(*columns).coalesce(1).write.mode("append").parquet(source)
        verdicts = watching.watched(spark.readStream.schema(watching.CYCLE_ROWS).parquet(source))
        verdicts.writeStream.foreachBatch(_show).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        code = _gate(rows.filter("fingerprint IS NOT NULL"), o.fail_on)
        for held in (rows, *[one.documents for one in done]):
            held.unpersist()
    return code


if __name__ == "__main__":
    sys.exit(main())
