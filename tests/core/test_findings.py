import random

import pytest

from skein.operators import findings, risk
from tests.reference_model import merged, normal


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        rows.append(
            {
                "ordinal": i, "scan_id": 1, "id": rng.choice("abc"), "file": rng.choice(["x.js", "y.js"]), "line": rng.choice([1, 2]),
                "severity": rng.choice(["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]), "confidence": rng.choice([None, "low", "medium", "high", "confirmed"]),
                "status": rng.choice([None, None, "open", "false_positive", "confirmed"]), "kind": rng.choice(["static_pattern", "source_to_sink", "heuristic", "runtime_browser"]),
                "flow": rng.choice([[], [], ["s"]]), "sanitized": rng.random() < 0.1, "observation": rng.random() < 0.1, "sink": rng.choice(["k = 1", "K=1", "m"]), "source": "q",
            }
        )
    return rows


def frame(spark, rows):
    schema = "ordinal long, scan_id long, id string, file string, line int, severity string, confidence string, status string, evidence_type string, flow array<string>, sanitization_detected boolean, observation boolean, sink string, source string"
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def test_normalize_follows_the_rules(spark, records):
    got = {r["ordinal"]: (r["confidence"], r["status"], r["observation"]) for r in findings.normalize(frame(spark, records)).collect()}
    for r in records:
        want = normal(dict(r))
        assert got[r["ordinal"]] == (want["confidence"], want["status"], want["observation"]), r


def test_merge_is_the_ordered_fold(spark, records):
    groups = {}
    for r in records:
        sink = "".join(c for c in r["sink"].lower() if c.isalnum() or c == ".")
        groups.setdefault((r["id"], r["file"], r["line"], sink, tuple(r["flow"])), []).append(normal(dict(r)))
    want = {k: (lambda m: (m["confidence"], m["severity"], m["status"], m["observation"]))(merged(v)) for k, v in groups.items()}
    firsts = {k: v[0]["ordinal"] for k, v in groups.items()}
    got = {r["ordinal"]: (r["confidence"], r["severity"], r["status"], r["observation"]) for r in findings.deduplicate(frame(spark, records), ["scan_id"]).collect()}
    assert got == {firsts[k]: v for k, v in want.items()}


@pytest.mark.parametrize(("text", "line"), [(None, 0), ("7", 7), (" 12 ", 12), ("-3", 0), ("L42:9", 429), ("none", 0), ("", 0)])
def test_lines_are_read_from_anything(spark, text, line):
    df = spark.createDataFrame([(1, "a", text)], "ordinal long, id string, line string")
    assert findings.normalize(df).first()["line"] == line


def overall(spark, rows):
    return risk.overall(findings.normalize(frame(spark, rows)), ["scan_id"]).first()


def row(i=0, **over):
    base = {"ordinal": i, "scan_id": 1, "id": "dom_injection", "file": f"f{i}.js", "line": 1, "severity": "HIGH", "confidence": "high", "status": None, "kind": "source_to_sink", "flow": ["a"], "sanitized": False, "observation": False, "sink": "s", "source": "q"}
    return base | over


def test_floors_and_half_even_points(spark):
    assert overall(spark, [row()])["score"] == 18
    assert overall(spark, [row(i) for i in range(4)])["score"] == 72
    critical = overall(spark, [row(severity="CRITICAL", confidence="confirmed", status="confirmed")])
    assert critical["score"] >= 75 and critical["label"] == "CRITICAL"
    assert any("severity floor" in c["label"] for c in critical["contributors"])
    assert sum(c["points"] for c in critical["contributors"]) == critical["score"]
    high = overall(spark, [row(confidence="confirmed", status="confirmed")])
    assert 50 <= high["score"] < 75 and high["label"] == "HIGH"


def test_third_party_scripts_are_capped(spark):
    scripts = spark.createDataFrame([(1, i, "third_party", 90, 1, 1) for i in range(20)], "scan_id long, ordinal long, party string, score int, n_reads int, n_external int")
    out = risk.overall(findings.normalize(frame(spark, [row()]).limit(0)), ["scan_id"], scripts).first()
    assert out["score"] <= 30 and out["third_party_points"] == 30 and out["third_party_exfil"] == 20 and out["label"] not in ("HIGH", "CRITICAL")


def test_correlation_drops_signals_that_flows_explain(spark):
    schema = "doc_id long, ordinal long, id string, severity string, evidence_type string, flow array<string>"
    flows = spark.createDataFrame([(1, 0, "dom_injection", "HIGH", "source_to_sink", ["a", "b"])], schema)
    rules = spark.createDataFrame([(1, 0, "react_html", "MEDIUM", "framework_pattern", [])], schema)
    weak = spark.createDataFrame([(1, 0, "dom_injection", "MEDIUM", "static_pattern", []), (1, 1, "obfuscation", "LOW", "static_pattern", [])], schema)
    got = [r["id"] for r in findings.correlate(flows, rules, weak).orderBy("ordinal").collect()]
    assert got == ["dom_injection", "react_html", "obfuscation"]
