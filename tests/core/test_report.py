"""Reports, policies, runtime evidence, structure and the history store."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import policy
from skein.functions import text as X
from skein.operators import detectors, history, report, runtime, structure, taint
from skein.sinks.store import HistoryStore
from tests.core.test_detectors import docs

FINDING = "id string, severity string, confidence string, observation boolean, file string, line int, ordinal long, type string, status string, source string, sink string, evidence_type string, evidence_list array<string>"


def found(spark, *rows):
    full = [(i, s, c, o, f, n, k, i, "open", "src", "snk", "source_to_sink", None) for k, (i, s, c, o, f, n) in enumerate(rows)]
    return spark.createDataFrame(full, FINDING)


@pytest.mark.parametrize(
    ("url", "fault"),
    [
        ("https://example.com/a", ""), ("ftp://example.com", "scheme"), ("https:///x", "no host"), ("https://u:p@example.com/", "credentials"), ("http://LOCALHOST:80/", "local network"),
        ("http://10.1.2.3/", "local network"), ("http://172.31.0.1", "local network"), ("http://172.32.0.1", ""), ("http://[::1]/", "local network"), ("http://8.8.8.8", ""), (None, "scheme"),
    ],
)
def test_url_faults(spark, url, fault):
    assert spark.createDataFrame([(url,)], "u string").select(policy.url_fault(F.col("u")).alias("f")).first()["f"] == fault


def test_predicates(spark):
    row = spark.range(1).select(
        *[policy.allowed_origin(F.lit(o)).alias(f"o{i}") for i, o in enumerate([None, "null", "http://localhost:3000", "https://127.0.0.1", "https://a.github.io", "https://github.io.evil.com", "https://localhost"])],
        *[policy.sensitive_key(F.lit(k)).alias(f"k{i}") for i, k in enumerate(["authToken", "theme", None])],
        *[policy.real_crypto_key(F.lit(k)).alias(f"r{i}") for i, k in enumerate(['"k9#mQ2$vL8pZ4wXt"', "aaaaaaaa", "my-router-component-1"])],
        *[policy.category_severity(F.lit(c), F.lit(n)).alias(f"s{i}") for i, (c, n) in enumerate([("secrets", 2), ("secrets", 1), ("storage", 9), ("crypto", 1), ("other", 3), ("secrets", 0)])],
    ).first()
    assert list(row) == [True, True, True, True, True, False, False, True, False, False, True, False, False, "CRITICAL", "HIGH", "HIGH", "MEDIUM", "INFO", "INFO"]


def test_needles_are_needed():
    assert X.needles(r"(?i)\b(?:fetch|axios)\s*\(") == ("axios", "fetch") and X.needles("[a-z]{40,}") == () and X.needles(r"(?:ab)?x") == ()
    assert X.needles(r"pass(?:word|phrase)") in (("pass",), ("phrase", "word")) and X.needles(r"a(?:bcd|x*)") == ()


def test_summary_mixes_and_steps(spark):
    d = spark.createDataFrame([("a", None), ("bb", None), ("c" * 9, "too_large")], "content string, skip_reason string")
    row = report.scan_summary(d).first()
    assert (row["discovered"], row["analyzed"], row["skipped"], row["reasons"], row["bytes"], row["coverage_percent"]) == (3, 2, 1, ["too_large"], 3, 66.7)
    assert report.scan_summary(d.limit(0)).first()["coverage_percent"] == 100.0
    f = found(spark, ("dom_injection", "HIGH", "high", False, "a.js", 3), ("dom_injection", "HIGH", "medium", False, "b.js", 0), ("obfuscation", "LOW", "medium", True, "a.js", 1))
    assert [(r["confidence"], r["n"]) for r in report.confidence_mix(f).collect()] == [("medium", 2), ("high", 1)]
    assert [r["step"] for r in report.remediation(f).collect()] == [report.STEPS[2][1], report.STEPS[5][1]]
    assert [r["step"] for r in report.remediation(f.limit(0)).collect()] == [report.NOTHING_TO_DO]
    assert [(r["id"], r["where"]) for r in report.plain_findings(f).collect()] == [("dom_injection", "a.js (line 3)")]
    assert report.executive(f, 40, "MEDIUM", 2)["words"] == "2 to look at and 1 observations in 2 scripts; rated MEDIUM (40/100)."
    lines = dict(report.reliability(row.asDict(), {"medium": 2, "confirmed": 1}))
    assert lines["Coverage"] == "2 of 3 scripts analyzed (66.7%)" and lines["Skipped"] == "1: too large" and lines["Confidence"] == "medium 2, confirmed 1" and lines["Proof"].startswith("1 ")


def test_legacy_scores(spark):
    wide = spark.createDataFrame([(1, ["k"], ["i"], ["s"], ["d"], True), (2, [], None, [], ["d"], False), (3, None, None, None, None, None)], "doc_id int, keys array<string>, ivs array<string>, storage array<string>, dom_risks array<string>, credible_secrets boolean")
    assert [tuple(r) for r in report.legacy_risk(wide).orderBy("doc_id").collect()] == [(1, 11, "CRITICAL"), (2, 2, "MEDIUM"), (3, 0, "LOW")]


def test_dashboard(spark):
    d = docs(spark, "box.innerHTML = location.hash", "x").withColumn("skip_reason", F.lit(None).cast("string"))
    flows = taint.flows(d).withColumns({"file": F.lit("f0.js"), "evidence_list": F.array("evidence")})
    payload = report.dashboard(spark, d, flows, detectors.long(d))
    assert payload["score"] > 0 and payload["categories"]["dom_risks"] == {"n": 1, "severity": "HIGH"} and payload["summary"]["analyzed"] == 2
    assert payload["severities"] == {"HIGH": 1} and payload["executive"]["findings"][0]["where"] == "f0.js (line 1)"
    json.dumps(payload)


def test_joins_of_scripts_urls_maps_and_surfaces(spark):
    inv = spark.createDataFrame([(1, "src/a.js", "first_party", 5), (2, "b.js", "third_party", 40)], "doc_id long, name string, party string, score int")
    d = spark.createDataFrame([("src/a.js",), ("x/b.js",), ("c.js",)], "name string")
    assert {r["name"]: r["score"] for r in report.with_script(d, inv).collect()} == {"src/a.js": 5, "x/b.js": 40, "c.js": None}
    urls = spark.createDataFrame([("a.js", "https://h/a.js")], "file string, url string")
    assert {r["file"]: r["url"] for r in report.with_url(spark.createDataFrame([("a.js",), ("z.js",)], "file string"), urls).collect()} == {"a.js": "https://h/a.js", "z.js": "z.js"}
    originals = spark.createDataFrame([(1, "aa"), (1, "b"), (2, "c")], "doc_id long, content string")
    hits = spark.createDataFrame([(1, i) for i in range(50)], "doc_id long, ordinal long")
    totals, merged = report.source_map_totals(originals, hits)
    assert sorted(map(tuple, totals.collect())) == [(1, 2, 3, 50), (2, 1, 1, 0)] and merged.count() == 40
    a = spark.createDataFrame([("/x", None), ("/y", "post")], "url string, method string")
    b = spark.createDataFrame([("/x", "GET")], "url string, method string")
    assert {(r["url"], r["method"]): r["seen"] for r in report.merge_surface(a, b).collect()} == {("/x", "GET"): ["runtime", "static"], ("/y", "POST"): ["static"]}


def test_runtime_evidence(spark):
    seen = {
        "captured": True, "url": "https://app.example.com/", "eval_calls": [{"text": "1"}], "string_timers": [{"text": "x"}], "dom_sinks": [{"text": "innerHTML"}],
        "storage_writes": [{"key": "authToken"}], "cookie_names": ["sid", "session"], "console": [{"type": "error", "text": "e"}, {"type": "log", "text": "l"}],
        "websockets": ["wss://x"], "failed_requests": [], "requests": [{"method": "GET", "url": "https://t.example.net/c", "resource_type": "xhr"}, {"method": "GET", "url": "https://app.example.com/a", "resource_type": "fetch"}],
    }
    rows = [(1, json.dumps(seen)), (2, json.dumps({**seen, "captured": False})), (3, "not json"), (4, None), (5, json.dumps({"captured": True, "string_timers": [{"text": "x"}]}))]
    counted = runtime.counts(spark.createDataFrame(rows, "scan_id long, evidence string"))
    one = counted.filter("scan_id = 1").first()
    assert (one["n_eval"], one["n_console_errors"], one["n_api_calls"], one["sensitive_keys"], one["external_hosts"]) == (1, 1, 2, ["authToken", "session"], ["t.example.net"])
    got = {}
    for r in runtime.findings(counted).collect():
        got.setdefault(r["scan_id"], {})[r["id"]] = (r["severity"], r["confidence"], r["status"], r["observation"])
    assert set(got) == {1, 5} and set(got[5]) == {"runtime_string_timer"} and "runtime_string_timer" not in got[1]
    assert got[1]["runtime_eval"] == ("HIGH", "confirmed", "confirmed", False) and got[1]["runtime_dom_sink"][:3] == ("HIGH", "high", "open")
    assert got[1]["runtime_websocket"] == ("LOW", "high", "informational", True) and "runtime_data_exfiltration_candidate" in got[1]


def test_structure(spark):
    code = "import a from 'a';\nexport const f = (x) => { let y = {k: 1, 'm': 2}; return g(h.i(x)); };\nclass C {}\nfunction z() { if (a) z(); }"
    (row,) = structure.script_structure(docs(spark, code)).collect()
    want = {"imports": 1, "exports": 1, "declarations": 2, "functions": 2, "classes": 1, "calls": 3, "literals": 4, "properties": 2, "names_called": 3, "lines": 4}
    assert {k: row[k] for k in want} == want and row["module_system"] == "ES modules" and row["complexity"] == 2 * (4 + 6 + 2 + 2 + 3)
    assert structure.script_structure(docs(spark, None, "")).select("complexity", "module_system").distinct().first() == (0, "none detected")


def test_history_store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    assert store.newest() == [] and store.get(1) is None
    a = found(spark, ("dom_injection", "HIGH", "high", False, "a.js", 3), ("open_redirect", "HIGH", "high", False, "a.js", 9))
    b = found(spark, ("dom_injection", "HIGH", "high", False, "a.js", 30))
    first = store.record(a, target="t", created_at=1.0, report="{}")
    assert first == {"scan_id": 1, "previous_id": None, "new": 2, "resolved": 0, "unchanged": 0}
    assert store.record(a, target="other", created_at=2.0)["previous_id"] is None
    assert store.record(b, target="t", created_at=3.0) == {"scan_id": 3, "previous_id": 1, "new": 0, "resolved": 1, "unchanged": 1}
    assert store.get(1, report=True)["report_json"] == "{}" and "report_json" not in store.get(1) and [r["scan_id"] for r in store.newest(2)] == [3, 2]
    store.export(str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["scan_id"], len(x["findings"])) for x in lines) == [(1, 2), (2, 2), (3, 1)]
    assert store.delete(2) and not store.delete(2) and store.scans().count() == 2
    assert store.wipe() == {"deleted_scans": 2, "deleted_findings": 3} and store.scans().count() == 0


def test_a_failing_detector_is_isolated(spark):
    detectors.register("broken", lambda t: F.col("no_such_column"))
    detectors.register("raising", lambda t: 1 / 0)
    try:
        got, errors = detectors.run_each(docs(spark, "fetch('/a')"), ["transport", "broken", "raising"])
        assert [r["value"] for r in got.collect()] == ["fetch"] and [n for n, _ in errors] == ["broken", "raising"]
    finally:
        del detectors.DETECTORS["broken"], detectors.DETECTORS["raising"]


def test_jobs_that_are_kept(spark):
    from skein.streaming import progress

    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = [(i, f"2024-01-01 11:{i % 60:02d}:00") for i in range(100)] + [(200, None), (201, "2024-01-01 09:00:00")]
    jobs = spark.createDataFrame(rows, "job_id long, finished_at string").withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    kept = {r["job_id"] for r in progress.retained_jobs(jobs, now).collect()}
    assert len(kept) == 64 and 200 in kept and 201 not in kept and 59 in kept
    age = progress.heartbeat_age(jobs.filter("job_id = 30"), "job_id", "finished_at", now).first()["age"]
    assert age == 1800.0


def test_requests_with_their_parts():
    from skein.operators.requests import requests_of

    code = "fetch('/api/a?x=1&token=2#z', {method: 'post', headers: {Authorization: t, 'X-A': 1}, body: JSON.stringify({email, name: n})});\naxios.post('/b', {u: 1, v}, {headers: {'X-Key': k}})"
    assert requests_of(code) == [
        ("endpoint", "POST", "/api/a?x=1&token=2#z", ["token", "x"], ["Authorization", "X-A"], ["email", "name"], True, 1),
        ("endpoint", "POST", "/b", [], ["X-Key"], ["u", "v"], False, 2),
    ]
    assert requests_of("const base='https://h/api'; fetch(base + '/u', {credentials: 'include'}); fetch(unknown)")[0][1:3] == ("GET", "https://h/api/u")
    assert requests_of("") == [] and requests_of("fetch(") == [] and requests_of("axios") == []


def test_marks_have_evidence(spark):
    rows = detectors.mark_evidence(docs(spark, "x = CryptoJS.AES; firebase.auth()", "plain")).filter("detector = 'crypto'").collect()
    assert [(r["doc_id"], r["name"], r["evidence"]) for r in rows] == [(0, "AES", "AES"), (0, "CryptoJS", "CryptoJS")]


def test_parties_and_runtime_of_scripts(spark):
    from skein.operators import scripts
    from tests.core.test_detectors import DOCS

    d = spark.createDataFrame([(1, 1, "app.js", None, "x"), (2, 2, "inline-1-0.js", "https://h.io/", "x"), (3, 3, "v.js", "https://cdn.net/v.js", "x")], DOCS)
    seen = spark.createDataFrame([(3, 20, 1)], "doc_id long, n_requests long, n_eval long")
    rows = {r["doc_id"]: r for r in scripts.inventory(d, "https://h.io/", seen).collect()}
    assert [rows[i]["party"] for i in (1, 2, 3)] == ["first_party", "inline", "third_party"] and rows[2]["load_method"] == "inline"
    assert rows[3]["score"] == 25 + 15


def test_assets_of_pages(spark):
    from skein.sources import pages

    html = "<script src=/a.js></script><link rel=preload as=script href=/p.js><script>import('./c.mjs'); load('https://h.io/a.js'); System.import('d')</script>"
    p = spark.createDataFrame([(1, "https://h.io/x/", html)], "page_id long, url string, html string")
    assert {(r["src"], r["via"]) for r in pages.script_assets(p).collect()} == {("https://h.io/a.js", "element"), ("https://h.io/p.js", "preload"), ("https://h.io/x/c.mjs", "inline"), ("https://h.io/x/d", "inline")}
    low = spark.createDataFrame([("x" * 5000 + "<!DOCTYPE html>",), ("var a",)], "c string")
    assert [r[0] for r in low.select(pages.soft_404(low.c)).collect()] == [True, False]


def test_split_literals_are_secrets(spark):
    from skein.operators import detectors as D

    codes = [
        "const key = Buffer.concat([Buffer.from('kx9'), Buffer.from('vQm2LpTn8Rb4Wc6Yd3Zf7Hj5')]);", "const a = 'AKIA';\nconst b = 'IOSFODNN7EXAMPLE';\nconst awsKey = a + b;",
        "let a = 'AKIA';\na += 'xyz';\nconst key = a + 'IOSFODNN7EXAMPLE';", "const hello = 'Hello';\nconst world = 'World';\nconst msg = hello + world;", "const k = 'sk_live_' + '0123456789abcdefABCD';",
    ]
    rows = D.secret_table(docs(spark, *codes)).filter("credible").collect()
    assert {(r["doc_id"], r["line"]) for r in rows} == {(0, 1), (1, 3), (4, 1)}


def test_keys_and_confidence(spark):
    from skein.operators import offsets

    far = " " * 500
    d = docs(spark, f'CryptoJS.AES.encrypt(m, "k9#mQ2$vL8pZ4wXt", {{iv: "abcdef0123456789"}});{far}x = "Zq8$wXt#mQ2vL8pZ"', 'EncryptionKey; x = "Zq8$wXt#mQ2vL8pZ"', "nothing")
    rows = offsets.crypto_material(d).filter("kind = 'key'").collect()
    assert {(r["doc_id"], r["value"]) for r in rows} == {(0, "k9#mQ2$vL8pZ4wXt"), (0, "abcdef0123456789"), (1, "Zq8$wXt#mQ2vL8pZ")}
    assert {r["doc_id"]: r["confidence"] for r in offsets.crypto_confidence(offsets.crypto_material(d)).collect()}[0] == "HIGH"
    assert not offsets.plausible_key("responseurl-tooltip-chart") and not offsets.plausible_key("a1B2#" * 40)


@pytest.mark.parametrize("code", ["a" * 500_000, "'" + "a" * 500_000, "x=1;" * 100_000, "(" * 100_000, "{" * 100_000, "".join(f"var a{i}='b{i}'+'c';" for i in range(8_000)), "x.innerHTML = location.hash; " * 4_000])
def test_adversarial_texts_take_linear_time(code):
    import time

    from skein.operators import offsets

    began = time.perf_counter()
    taint.analyze(code)
    offsets.folded_of(code)
    assert time.perf_counter() - began < 20


def test_batches_hooks_kinds_and_groups(spark):
    from skein.session import job_group
    from skein.sources import documents as sources

    good, bad = sources.batch(spark, [("a.js", b"caf\xe9()"), ("b.js", None), ("c.js", " "), ("d.js", "x" * 50)], max_bytes=20)
    assert [(r["name"], r["content"]) for r in good.collect()] == [("a.js", "café()")]
    assert sorted(map(tuple, bad.collect())) == [("b.js", "missing"), ("c.js", "blank"), ("d.js", "oversized_script")]
    assert sources.beautified(good).first()["content"] == "café()" and sources.beautified(good, lambda c: F.upper(c)).first()["content"] == "CAFÉ()"
    table = detectors.secret_table(docs(spark, 'password = "hunter22XYZ!!"; user: "someone"', 'k = "ghp_abcdefghij0123456789ABCD"', 'token = "your_token_here"'))
    kinds = {(r["doc_id"], r["kind"], r["classification"]) for r in detectors.secret_kinds(table).collect()}
    assert {(0, "password", "credible"), (1, "github", "credible"), (2, "token", "candidate")} <= kinds and len(kinds) == 3
    with job_group(spark, "g", "a group") as cancel:
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "g"
        cancel()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    codes = spark.createDataFrame([([101, 118, 0x1F600],), ([0xD800],), ([],)], "c array<int>")
    assert [r[0] for r in codes.select(X.from_char_codes(codes.c)).collect()] == ["ev\U0001F600", None, ""]


def test_writers_share_no_number_and_stopped_ones_leave_nothing(spark, tmp_path, monkeypatch):
    store = HistoryStore(spark, str(tmp_path / "h"))
    a = found(spark, ("dom_injection", "HIGH", "high", False, "a.js", 3))
    other = HistoryStore(spark, store.path)
    assert other._claimed(0) == 1  # another writer has begun, and not ended
    assert store.record(a, target="t", created_at=1.0)["scan_id"] == 2
    # A writer that stops between a scan's rows and its own row.
    monkeypatch.setattr(history, "set_diff", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.record(a, target="t", created_at=2.0)
    monkeypatch.undo()
    assert store.rows().count() == 1 and store.scans().count() == 1
    assert store.record(a, target="t", created_at=3.0) == {"scan_id": 4, "previous_id": 2, "new": 0, "resolved": 0, "unchanged": 1}


def test_cleared_decisions_are_gone(spark):
    triage = spark.createDataFrame([("a", "open", "n", 1.0), ("b", "false_positive", "", 2.0)], "fingerprint string, status string, note string, updated_at double")
    cleared = spark.createDataFrame([(" b ",), ("zzz",), (None,)], "fingerprint string")
    assert [tuple(r) for r in history.clear_triage(triage, cleared).collect()] == [("a", "open", "n", 1.0)]


def test_uncapped_rows_are_all_rows(spark):
    many = found(spark, *[("x", "LOW", "low", False, "a.js", i) for i in range(30)]).withColumn("scan_id", F.lit(1).cast("long"))
    assert history.finding_rows(many, cap=None).count() == 30 and history.finding_rows(many, cap=7).count() == 7
