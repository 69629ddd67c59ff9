"""The whole plan over a folder, and the command line."""

import json

import pytest

from skein.__main__ import main
from skein.plans import catalog
from skein.plans.analysis import analyze, analyze_content, analyze_folder
from skein.sources import documents as sources


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Compiling the whole plan takes longer than running it on three files."""
    keys = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def folder(tmp_path):
    (tmp_path / "a.js").write_text("const q = location.search;\nbox.innerHTML = q;\n")
    (tmp_path / "b.js").write_text('const sk = "sk_live_0123456789abcdefABCD"; fetch("/api/x");\n')
    (tmp_path / "c.js").write_text("const q = location.search;\nbox.innerHTML = q;\n")
    return str(tmp_path)


def test_folder(spark, tmp_path):
    done = analyze_folder(spark, folder(tmp_path))
    assert [r["name"] for r in done.documents.orderBy("ordinal").collect()] == ["a.js", "b.js"]
    real = {(r["file"], r["id"], r["line"]) for r in done.findings.filter("NOT observation").collect()}
    assert ("a.js", "dom_injection", 2) in real and ("b.js", "hardcoded_secret", 1) in real
    by_file = {r["doc_id"]: r["label"] for r in done.file_risk().collect()}
    assert len(by_file) == 2 and done.overall().first()["score"] > 0
    assert analyze_content(spark, "let a = 1").findings.count() == 0


def test_command_line(tmp_path, capsys):
    (tmp_path / "src").mkdir()
    src, out = folder(tmp_path / "src"), tmp_path / "report"
    assert main([src, "--format", "sarif", "--output", str(out), "--fail-on", "high"]) == 1
    assert json.loads(out.read_text())["version"] == "2.1.0"
    assert main([src, "--format", "txt", "--save-baseline", str(tmp_path / "base")]) == 0
    assert "RISK" in capsys.readouterr().out
    assert main([src, "--format", "openapi", "--output", str(out), "--baseline", str(tmp_path / "base"), "--fail-on", "high"]) == 0
    assert main([str(tmp_path / "nowhere")]) == 2


def test_every_oracle_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_browser_evidence_counts_in_the_score(spark):
    import json

    from skein.plans.analysis import analyze
    from skein.sources import documents as sources

    d = sources.inline(spark, [("a.js", "const q = location.hash;\nbox.innerHTML = q;")])
    seen = json.dumps({"captured": True, "url": "https://h.io/", "eval_calls": [{"text": "1"}], "dom_sinks": [{"text": "innerHTML"}]})
    plain = analyze(d).overall().first()
    with_browser = analyze(d, "https://h.io/", spark.createDataFrame([(7, seen)], "scan_id long, evidence string"))
    row = with_browser.overall().first()
    assert row["score"] > plain["score"] and row["runtime_effects"] == 1 and row["confirmed"] == 1
    assert {r["id"] for r in with_browser.runtime_findings().collect()} == {"runtime_eval", "runtime_dom_sink"}
    assert analyze(d).runtime_findings().count() == 0


def test_planning_runs_nothing_and_texts_are_read_once(spark, tmp_path):
    context = spark.sparkContext
    read = context.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, i, f"f{i}.js", None, f"el.innerHTML = location.hash; // {i % 30}") for i in range(40)]
    spark.createDataFrame(rows, sources.SCHEMA).write.parquet(str(tmp_path / "docs"))
    documents = spark.read.parquet(str(tmp_path / "docs")).mapInArrow(counted, sources.SCHEMA)
    context.setJobGroup("planning", "")
    try:
        done = analyze(documents)
        assert not context.statusTracker().getJobIdsForGroup("planning")
        assert done.findings.count() and done.endpoints.count() == 0 and done.inventory.count()
        assert done.file_risk().count() == 30
        # Once to find the first copies, once to keep them; no table reads them again.
        assert read.value == 2 * len(rows)
    finally:
        done.release()
        context.setLocalProperty("spark.jobGroup.id", None)
