"""Chart tables against plain counts."""

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta

from skein.operators import model


def test_file_diagnostics_equal_plain_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a.js", "b.js", None]), rng.choice(["x", "y", "other", None]), rng.choice([" v1", "v1 ", "", None, *[f"w{k}" for k in range(12)]]), i) for i in range(400)]
    rows += [("only.js", "other", "z", 1000), ("hot.js", "x", "same", 1001)] + [("hot.js", "x", "same", 1002 + i) for i in range(500)]
    table = spark.createDataFrame(rows, "file string, kind string, value string, at long").repartition(4)
    found = {r["file"]: r for r in model.file_diagnostics(table, ["file"], "kind", "value", "at", ["x", "y", "never"]).collect()}
    lists = defaultdict(lambda: defaultdict(list))
    for file, kind, value, _ in sorted(rows, key=lambda r: r[3]):
        if kind in ("x", "y") and (value or "").strip() and value.strip() not in lists[file][kind]:
            lists[file][kind].append(value.strip())
    n, kinds = Counter(r[0] for r in rows), Counter((r[0], r[1]) for r in rows)
    assert set(found) == set(n)
    for file, r in found.items():
        assert (r["n"], r["n_x"], r["n_y"], r["n_never"]) == (n[file], kinds[file, "x"], kinds[file, "y"], 0)
        assert r["lists"] == {k: v[:8] for k, v in lists[file].items()}
    assert model.file_diagnostics(table.limit(0), ["file"], "kind", "value", "at", ["x"]).count() == 0


def test_rollup_keeps_sources_without_findings(spark):
    originals = spark.createDataFrame([(1, "a.ts", "é"), (1, "b.ts", None), (2, "a.ts", "xyz"), (1, "a.ts", "x")], "doc_id long, source string, content string")
    findings = spark.createDataFrame([(1, "a.ts", "high"), (1, "a.ts", None), (1, "a.ts", ""), (9, "gone.ts", "LOW")], "doc_id long, source string, severity string")
    got = {(r["doc_id"], r["source"]): (r["bytes"], r["findings"], r["severities"]) for r in model.source_rollup(originals, findings).collect()}
    assert got == {(1, "a.ts"): (3, 3, {"HIGH": 1, "MEDIUM": 2}), (1, "b.ts"): (None, 0, {}), (2, "a.ts"): (3, 0, {})}


def test_timeline_has_no_holes(spark):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(start + timedelta(minutes=m), k) for m, k in [(0, "a"), (1, "a"), (190, "b"), (61, "c")]] + [(None, "a")]
    found = model.timeline(spark.createDataFrame(rows, "at timestamp, kind string"), "at", 3600, "kind", ["a", "b"]).collect()
    assert len(found) == 8 and sum(r["n"] for r in found) == 3
    assert sorted(r["n"] for r in found if r["kind"] == "a") == [0, 0, 0, 2]
    assert model.timeline(spark.createDataFrame([], "at timestamp, kind string"), "at", 60, "kind", ["a"]).count() == 0


def test_severity_table(spark):
    table = spark.createDataFrame([("a", "LOW"), ("a", "HIGH"), ("b", "odd"), ("a", "LOW")], "file string, severity string")
    got = {r["file"]: (r["n"], r["n_LOW"], r["n_HIGH"], r["worst"]) for r in model.severity_table(table, ["file"]).collect()}
    assert got == {"a": (3, 2, 1, "HIGH"), "b": (1, 0, 0, None)}
