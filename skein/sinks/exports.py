"""Exports of findings: CSV, SARIF, JSON, OpenAPI, baselines and text."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vocab

# SARIF levels, ranks and severities, and weakness numbers.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
RANKS = {"low": 25.0, "medium": 50.0, "high": 75.0, "confirmed": 100.0}
SECURITY = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0", "INFO": "1.0"}
CWE = {
    "dom_injection": 79, "dom_injection_document_write": 79, "dom_xss": 79, "jquery_dom_manipulation": 79, "hardcoded_secret": 798, "secret": 798,
    "data_exfiltration_flow": 200, "data_exfiltration_candidate": 200, "open_redirect": 601, "dangerous_dynamic_code": 95, "unsafe_runtime": 95,
    "vulnerable_dependency": 1104, "exposed_key_iv_pair": 321, "static_crypto_key": 321, "insecure_postmessage": 359, "prototype_pollution": 1321, "sensitive_storage": 922,
}
CSV_COLUMNS = ("id", "type", "severity", "confidence", "status", "origin", "file", "line", "source", "sink", "flow", "evidence", "sanitization_detected", "framework", "evidence_type", "analysis_quality", "limitations", "observation", "triage_status", "triage_note")


def cell(text: Column) -> Column:
    """A spreadsheet cell that no program takes for a formula."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.substring(t, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), t)).otherwise(t)


def csv_rows(findings: DataFrame) -> DataFrame:
    """The columns of the CSV export, lists joined and cells guarded."""
    have = dict(findings.dtypes)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    joined = {
        "flow": F.array_join("flow", " -> "),
        "limitations": F.array_join("limitations", "; "),
        "evidence": F.coalesce(F.array_join("evidence_list", " | "), F.col("evidence")) if "evidence_list" in have else get("evidence"),
        "origin": F.coalesce(F.nullif(get("origin"), F.lit("")), F.col("file")),
    }
    plain = ("line", "sanitization_detected", "observation")
    return findings.select(*[(get(c) if c in plain else cell(joined.get(c, get(c)))).alias(c) for c in CSV_COLUMNS])


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def rule_id(id: Column) -> Column:
    return F.substring_index(id, ":", 1)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result for each finding."""
    conf, state = vocab.confidence(F.col("confidence")), F.col("status")
    kind = F.when(F.col("observation") | state.isin("informational", "false_positive"), "informational").when(conf == "confirmed", "fail").otherwise("open")
    cwe = vocab.choose(rule_id(F.col("id")), CWE, F.lit(None).cast("int"))
    return findings.select(
        "ordinal",
        F.col("id").alias("ruleId"),
        vocab.choose(F.col("severity"), LEVELS, "warning").alias("level"),
        vocab.choose(conf, RANKS, 25.0).alias("rank"),
        kind.alias("kind"),
        vocab.choose(F.col("severity"), SECURITY, "5.5").alias("security_severity"),
        cwe.alias("cwe"),
        F.array_compact(F.array(F.lower("severity"), F.lit("security"), F.lit("javascript"), F.concat(F.lit("cwe-"), cwe.cast("string")))).alias("tags"),
        "file",
        F.greatest(F.col("line"), F.lit(1)).alias("start_line"),
        F.col("type").alias("message"),
        (state == "false_positive").alias("suppressed"),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule for each id: of its first finding."""
    first = sarif_results(findings).groupBy("ruleId").agg(F.min_by(F.struct("message", "level", "security_severity", "cwe", "tags"), "ordinal").alias("f"))
    return first.select("ruleId", "f.*")


def sarif(findings: DataFrame, tool: str = "skein", limit: int = 25_000) -> str:
    """A SARIF 2.1.0 log of the distinct findings as one text; it is a report
    to read, so it is put together on the driver. Readers take no more than
    `limit` results; where some are left out, the run's properties say how many."""
    key = [c for c in ("id", "file", "line", "sink", "source") if c in findings.columns]
    order = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    distinct = findings.withColumn("__nth", order).filter("__nth = 1").drop("__nth")
    rules = [
        {"id": r["ruleId"], "name": r["ruleId"], "shortDescription": {"text": r["message"]}, "defaultConfiguration": {"level": r["level"]},
         "properties": {"security-severity": r["security_severity"], "tags": r["tags"]}}
        for r in sarif_rules(distinct).orderBy("ruleId").limit(limit).collect()
    ]
    rows = sarif_results(distinct).orderBy("ordinal").limit(limit).collect()
    results = [
        {"ruleId": r["ruleId"], "level": r["level"], "rank": r["rank"], "kind": r["kind"], "message": {"text": r["message"]},
         "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["start_line"]}}}],
         **({"suppressions": [{"kind": "external"}]} if r["suppressed"] else {})}
        for r in rows
    ]
    left_out = distinct.count() - len(rows) if len(rows) == limit else 0
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results, **({"properties": {"resultsLeftOut": left_out}} if left_out else {})}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, ensure_ascii=False)


def diagnostics(spark, sarif_text: str) -> DataFrame:
    """A SARIF log as flat rows for an editor: rule, level, file, line, message."""
    schema = "struct<runs: array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>>"
    log = spark.createDataFrame([(sarif_text,)], "log string").select(F.from_json("log", schema).alias("log"))
    each = log.select(F.explode("log.runs").alias("run")).select(F.posexplode("run.results").alias("ordinal", "r"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    return each.select("ordinal", F.col("r.ruleId").alias("id"), F.col("r.level").alias("level"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), F.col("r.message.text").alias("message"))


def resolved_paths(found: DataFrame, files: DataFrame) -> DataFrame:
    """Each reported file's workspace path: equal, else the only one of its
    name, else the only one it is a suffix of."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    want = found.select("file").distinct()
    paths = files.select("path").distinct()
    exact = want.join(paths, want["file"] == paths["path"]).select("file", "path", F.lit(0).alias("rank"))
    named = want.withColumn("base", base(F.col("file"))).join(paths.withColumn("base", base(F.col("path"))), "base")
    unique = named.groupBy("file").agg(F.count("*").alias("n"), F.first("path").alias("path")).filter("n = 1").select("file", "path", F.lit(1).alias("rank"))
    suffix = named.filter(F.col("path").endswith(F.concat(F.lit("/"), F.col("file")))).groupBy("file").agg(F.count("*").alias("n"), F.first("path").alias("path")).filter("n = 1").select("file", "path", F.lit(2).alias("rank"))
    best = exact.union(unique).union(suffix).groupBy("file").agg(F.min_by("path", "rank").alias("path"))
    return want.join(best, "file", "left")


def openapi(paths: DataFrame, title: str = "Recovered API") -> str:
    """An OpenAPI 3.1 document of surface.openapi_paths (a bounded list)."""
    spec: dict = {"openapi": "3.1.0", "info": {"title": title, "version": "1.0.0"}, "servers": [], "paths": {}}
    for r in paths.collect():
        if r["host"] and {"url": f"https://{r['host']}"} not in spec["servers"]:
            spec["servers"].append({"url": f"https://{r['host']}"})
        spec["paths"].setdefault(r["path"], {})[r["method"]] = {
            "responses": {"default": {"description": "not observed"}},
            "parameters": [{"name": p, "in": "query", "schema": {"type": "string"}} for p in sorted(r["parameters"] or [])],
        }
    return json.dumps(spec, ensure_ascii=False)


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("*")).alias("value"))


def write_baseline(rows: DataFrame, path: str) -> None:
    """The baseline as one sorted JSON file without times, so that equal scans
    write equal files."""
    keep = ["fingerprint", "finding_id", "severity", "observation", "title", "file"]
    rows.select(*keep).dropDuplicates(["fingerprint"]).orderBy("fingerprint").coalesce(1).write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame:
    """A written baseline; none where the path holds none."""
    schema = "fingerprint string, finding_id string, severity string, observation boolean, title string, file string"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_report(model: dict) -> str:
    """A plain report of a dashboard payload (report.dashboard)."""
    listed = lambda items, none: [f"  {x}" for x in items] or [f"  {none}"]
    steps = model["executive"]["first_steps"]
    sections = {
        f"RISK {model['score']}/100 ({model['label']})": [f"  {model['executive']['words']}"],
        "WHY": listed([f"+{c['points']:>3}  {c['label']} (x{c['count']})" for c in model.get("contributors") or []], "nothing found"),
        "INVESTIGATE FIRST": listed([f"{p['severity']:<8} {p['type']} at {p['location']}" for p in model["priorities"]], "nothing open"),
        "FINDINGS IN PLAIN WORDS": listed([f"{f['severity']:<8} {f['id']} in {f['where']}" for f in model["executive"]["findings"]], "none"),
        "WHAT TO DO": listed(steps, "nothing"),
        "CATEGORIES": listed([f"{k}: {v['n']} ({v['severity']})" for k, v in sorted(model["categories"].items())], "none"),
        "SEVERITIES": listed([f"{k}: {n}" for k, n in sorted(model["severities"].items())], "none"),
        "CONFIDENCE": listed([f"{k}: {n}" for k, n in sorted(model["confidence"].items(), key=lambda x: (-x[1], x[0]))], "none"),
        "FILES": listed([f"{f['name']}: {f['n']} finds; {', '.join(f'{k} ({len(v)})' for k, v in sorted(f['lists'].items()))}" for f in model.get("files") or []], "none"),
        "RELIABILITY": listed([f"{k}: {v}" for k, v in model["reliability"]], "unknown"),
        "SCAN": listed([f"{k}: {v}" for k, v in model["summary"].items()], "unknown"),
    }
    return "\n\n".join("\n".join([title, *lines]) for title, lines in sections.items()) + "\n"


def html_report(model: dict) -> str:
    """The same report as a page; all text is escaped."""
    head, *rest = text_report(model).strip().split("\n\n")
    parts = [f"<h1>{html.escape(head.splitlines()[0])}</h1><p>{html.escape(head.splitlines()[1].strip())}</p>"]
    for section in rest:
        title, *lines = section.splitlines()
        items = "".join(f"<li>{html.escape(line.strip())}</li>" for line in lines)
        parts.append(f"<h2>{html.escape(title.capitalize())}</h2><ul>{items}</ul>")
    return "<!doctype html><meta charset=utf-8><title>Report</title>" + "".join(parts)


def json_report(model: dict) -> str:
    return json.dumps(model, ensure_ascii=False, indent=1, default=str)
