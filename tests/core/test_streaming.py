"""Watch mode and the job state machine."""

import random
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pytest

from skein.streaming import jobs, tracking
from skein.streaming import watch as watching
from skein.streaming.watch import ROWS, watch


def test_watch_compares_cycles(spark, tmp_path):
    source = str(tmp_path / "rows")
    row = lambda fp, sev: (1, fp, "id", sev, "high", "t", "x.js", "", False, 0)
    for rows in ([row("a", "LOW"), row("b", "LOW")], [row("a", "HIGH")]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
    seen = []
    keep = lambda n, verdicts, code: seen.append((n, {r["fingerprint"]: r["verdict"] for r in verdicts.collect()}, code))
    for _ in range(2):  # a restarted watch goes on where it stopped
        assert watch(spark, source, str(tmp_path / "state"), str(tmp_path / "checkpoint"), keep).awaitTermination(120)
    assert seen == [(0, {"a": "new", "b": "new"}, 0), (1, {"a": "worsened", "b": "resolved"}, 1)]


def test_steps():
    state = ("", 0.0, 0.0, 0.0, 0.0)
    for kind, at, percent, amount in [("submit", 1, 0, 0), ("finish", 2, 0, 0), ("start", 3, 0, 0), ("progress", 5, 40, 10), ("progress", 6, 30, 10), ("cancel", 7, 0, 0), ("finish", 8, 0, 0)]:
        state = jobs.step(state, kind, at, percent, amount)
    assert state[:3] == ("canceled", 40, 5.0)


def test_jobs_stream(spark, tmp_path):
    schema = "job_id string, kind string, at timestamp, percent double, amount double"
    events = [("j", k, datetime(2024, 1, 1, 0, 0, i + 1), 0.0, 0.0) for i, k in enumerate(["submit", "start", "finish"])] + [("k", "submit", datetime(2024, 1, 1), 0.0, 0.0)]
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events"))
    stream = jobs.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), retain_ms=0)
    q = stream.writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    assert {(r["job_id"], r["state"]) for r in spark.table("jobs").collect()} == {("j", "done"), ("k", "queued")}


def job_events(rng, jobs=6, n=60):
    kinds = ["submit", "start", *["progress"] * 12, "finish", "cancel", "fail"]
    rows = []
    for j in range(jobs):
        at = 1_700_000_000.0 + j
        for k in range(n):
            at += rng.choice([0.3, 1, 2, 5, 20, 45])
            kind = ["submit", "start"][k % 30] if k % 30 < 2 else rng.choice(kinds[2:] if k % 30 < 25 else kinds)
            rows.append((f"j{j}", k, datetime.fromtimestamp(at, UTC), kind, rng.random() / 3 + k % 30 / 45, float(rng.randint(1, 400)), rng.random()))
    return rows


def test_job_stream_equals_the_table_whatever_the_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = job_events(rng)
    newest = max(r[2] for r in rows)
    want = {tuple(r) for r in tracking.job_table(spark.createDataFrame(rows, tracking.EVENTS), 30.0, 60.0).collect()}
    assert {r[3] for r in want} >= {"queued", "running", "done"} and any(r[8] for r in want) and len({r[7] for r in want}) >= 3
    rows.sort(key=lambda r: r[2].timestamp() + rng.uniform(-60, 60))  # out of order, within files and between
    for late, cuts, files in (("150 seconds", 6, "1"), ("0 seconds", 3, "100")):
        source, out = str(tmp_path / f"events{files}"), str(tmp_path / f"out{files}")
        size = len(rows) // cuts
        for k in range(cuts):
            part = rows[k * size : (k + 1) * size if k < cuts - 1 else None]
            spark.createDataFrame(part, tracking.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = tracking.job_stream(spark.readStream.schema(tracking.EVENTS).option("maxFilesPerTrigger", files).parquet(source), late, 30.0, 60.0)
        write = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append")
        for _ in range(2):  # a restarted stream goes on from its state
            write.trigger(availableNow=True).start().awaitTermination(200)
        got = [tuple(r) for r in spark.read.schema(tracking.ROWS).parquet(out).collect()]
        upto = (newest - timedelta(seconds=int(late.split()[0]))).replace(tzinfo=None)
        # Later rows wait for the watermark.
        assert len(got) == len(set(got)) and set(got) == {r for r in want if r[2] < upto or late == "0 seconds"}
        assert len(got) > len(want) // 2


def test_a_scan_keeps_one_record_of_a_finding(spark):
    """However often a scan tells of a finding, its last record is kept, and
    one timer a scan is set."""
    import pandas as pd

    at = pd.Timestamp("2024-01-01", tz="UTC")
    rows = [("t", k % 2, at + pd.Timedelta(minutes=k % 2), f"f{k % 4}", "LOW", "low", f"title {k}", "a.js", False, k) for k in (*range(400), 3, 2)]
    rows += [("t", 0, at, None, None, None, None, None, None, -1)]
    names = [c.split(" ")[0] for c in watching.CYCLE_ROWS.split(", ")]
    kept, timers = [], []
    cycles = watching._Cycles()
    cycles.waiting, cycles.handle = SimpleNamespace(appendList=kept.extend), SimpleNamespace(registerTimer=timers.append)
    list(cycles.handleInputRows(("t", 0), iter([pd.DataFrame(rows[:250], columns=names), pd.DataFrame(rows[250:], columns=names)]), None))
    assert sorted((r[1], r[2], r[3]) for r in kept if r[3]) == [(0, 396, "f0"), (0, 398, "f2"), (1, 397, "f1"), (1, 399, "f3")]
    assert [r for r in kept if not r[3]] == [(at.value // 1000, 0, -1, None, *[None] * 5)] and len(timers) == 2
    plain = [(*r[:2], r[2].to_pydatetime(), *r[3:]) for r in rows[:-1]]
    made = watching.marked(spark.createDataFrame(plain, watching.CYCLE_ROWS))
    assert sorted((r["fingerprint"] or "", r["ordinal"]) for r in made.collect()) == [("", -1), ("", -1), ("f0", 396), ("f1", 397), ("f2", 398), ("f3", 399)]


def test_state_values_of_a_job_do_not_grow_with_its_events():
    """Every value of the state costs a call and its own encoding."""
    import pandas as pd

    class State(list):
        written, update = 0, None

        def appendList(self, values):
            self.extend(values)
            self.written += len(values)

    state, timers = State(), []
    tracker = tracking.JobTracker(30.0, 60.0)
    tracker.waiting, tracker.handle = state, SimpleNamespace(registerTimer=timers.append)
    batch = pd.DataFrame([(f"j{k % 3}", k, pd.Timestamp(1_700_000_000 - k, unit="s", tz="UTC"), "progress", 0.5, 1.0, 0.5) for k in range(500)], columns=[c.split(" ")[0] for c in tracking.EVENTS.split(", ")])
    assert list(tracker.handleInputRows(("j",), iter([batch]), None)) == []
    assert state.written == 1 and [len(c) for c in state[0]] == [500] * 6
    assert timers == [(1_700_000_000 - 499) * 1000 - 1]


def test_estimates_follow_their_rules():
    job = tracking.Job()
    for at, kind, f in [(0, "submit", 0), (1, "start", 0), (3, "progress", 0.1), (6, "progress", 0.2), (9, "progress", 0.15)]:
        job = tracking.moved(job, at, at, kind, f, 100.0, 0.5, 60.0)
    assert job.state == "running" and job.fraction == 0.2 and job.samples == ((3, 0.1), (6, 0.2)) and job.advanced == 6
    # The first rate is that since the start, later ones those of the window.
    first = 0.1 / 2
    second = first + 0.35 * (0.1 / 3 - first)
    assert job.rate == pytest.approx(second + 0.35 * (0.1 / 3 - second))
    later, row = tracking.told_quiet("j", job, 30.0)
    assert row["quiet"] == 30.0 and later.quiet_told and not tracking.quiet_due(later, 30.0, 1e9)
    done = tracking.moved(job, 50, 9, "finish", 0, 0, 0, 60.0)
    assert (done.state, done.eta, done.confidence, done.samples) == ("done", 0.0, 1.0, ())
    assert tracking.moved(done, 109, 10, "submit", 0, 0, 0, 60.0).state == "done"
    assert tracking.moved(done, 110, 11, "submit", 0, 0, 0, 60.0).state == "queued"


def test_job_table_of_no_events(spark):
    assert tracking.job_table(spark.createDataFrame([], tracking.EVENTS)).count() == 0


def scan_rows(scans):
    """CYCLE_ROWS of (target, scan, [(fingerprint, severity, confidence)])."""
    out = []
    for target, scan, found in scans:
        at = datetime.fromtimestamp(1_700_000_000 + scan * 60, UTC)
        out.append((target, scan, at, None, None, None, None, None, None, -1))
        out += [(target, scan, at, f, s, c, f"title {f}", f"{f}.js", False, i) for i, (f, s, c) in enumerate(found)]
    return out


def plain_verdicts(scans):
    known, out = {}, set()
    rank = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "low": 0, "medium": 1, "high": 2}
    for target, scan, found in scans:
        old, new = known.get(target, {}), {f: (s, c) for f, s, c in found}
        for f in old | new:
            if f not in old or f not in new:
                verdict = "new" if f in new else "resolved"
            else:
                moves = [rank[new[f][i]] - rank[old[f][i]] for i in (0, 1)]
                verdict = "worsened" if max(moves) > 0 else "improved" if min(moves) < 0 else "persisted"
            out.add((target, scan, f, verdict))
        known[target] = new
    return out


def test_watched_targets_whatever_the_batches(spark, tmp_path):
    rng = random.Random(4)
    scans = []
    for scan in range(1, 9):
        for target in ("a", "b", "quiet"):
            if rng.random() < 0.75:  # a target is not scanned in every cycle
                n = 0 if target == "quiet" and scan % 3 else 12
                scans.append((target, scan, [(f"f{rng.randint(0, 20)}", rng.choice(["LOW", "MEDIUM", "HIGH"]), rng.choice(["low", "medium", "high"])) for _ in range(n)]))
    rows = scan_rows(scans)
    for cuts in (1, 4):
        source, out = str(tmp_path / f"rows{cuts}"), str(tmp_path / f"out{cuts}")
        for k in range(cuts):
            mine = [r for r in rows if r[1] * cuts // 9 == k]
            spark.createDataFrame(mine, watching.CYCLE_ROWS).repartition(2).write.mode("append").parquet(source)
            stream = watching.watched(spark.readStream.schema(watching.CYCLE_ROWS).parquet(source), parts=5)
            write = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append")
            write.trigger(availableNow=True).start().awaitTermination(200)
        got = [(r["target"], r["scan_id"], r["fingerprint"], r["verdict"]) for r in spark.read.schema(stream.schema).parquet(out).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_verdicts(scans)


def test_watch_on_the_command_line_shows_differences(spark, tmp_path, capsys, monkeypatch):
    from skein import __main__ as cli

    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    script = tmp_path / "one" / "a.js"
    script.write_text("el.innerHTML = location.hash;")
    (tmp_path / "two" / "b.js").write_text("var quiet = 1;")
    monkeypatch.setattr(cli, "time", SimpleNamespace(sleep=lambda _: script.write_text("var fine = 1;")))
    code = cli.main([str(tmp_path / "one"), str(tmp_path / "two"), "--watch=30", "--cycles=3", f"--state={tmp_path}/state"])
    said = capsys.readouterr().out
    assert code == 0 and said.count("[watch ") == 3
    first, second, third = said.split("cycle ")[1:]
    assert "+ new" in first and "x no longer detected" in second and "+ new" not in second and "x no" not in third
    assert cli.main([str(tmp_path / "nowhere")]) == 2


def test_running_jobs_are_observed(spark):
    import threading
    import time

    from skein.streaming.observe import observed

    def slow(rows):
        for b in rows:
            time.sleep(0.4)
            yield b

    work = spark.range(0, 4000, 1, 24).mapInArrow(slow, "id long")
    with observed(spark, "steps", 0.1) as seen:
        assert work.groupBy().count().first()["count"] == 4000
    kinds = [e[3] for e in seen.events]
    assert kinds[:2] == ["submit", "start"] and kinds[-1] == "finish" and kinds.count("progress") > 1
    states = [(r["state"], r["percent"]) for r in tracking.job_table(seen.event_table(spark)).orderBy("seq").collect()]
    assert states[-1] == ("done", 100.0) and any(0 < p < 100 for _, p in states)
    assert seen.stage_table(spark).filter("done > 0").count()

    with observed(spark, "stopped", 0.1) as seen:
        threading.Timer(1.5, seen.cancel).start()
        spark.range(0, 4000, 1, 400).mapInArrow(slow, "id long").groupBy().count().first()
        raise AssertionError("was not stopped")
    assert seen.canceled and [e[3] for e in seen.events][-1] == "finish"
    assert tracking.job_table(seen.event_table(spark)).orderBy("seq").collect()[-1]["state"] == "canceled"

    with pytest.raises(ZeroDivisionError), observed(spark, "failing", 0.1) as seen:
        1 / 0  # noqa: B018
    assert [e[3] for e in seen.events] == ["submit", "start", "fail"]
