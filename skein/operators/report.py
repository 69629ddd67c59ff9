"""What a report says: totals, mixes, reliability, summary and steps.

Each part is a small table; `dashboard` puts them together on the driver,
where every one of them is bounded by its kind, not by the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import policy
from skein.operators import findings as findings_
from skein.operators import model, risk
from skein.operators.detectors import DETECTORS

#: What to do, by the findings that ask for it, in our words.
STEPS = (
    (("hardcoded_secret", "static_crypto_key", "static_iv", "exposed_key_iv_pair"), "Keep keys, IVs and secrets on the server; rotate those that were shipped."),
    (("sensitive_storage",), "Hold sessions in httpOnly cookies or on the server instead of browser storage."),
    (("dom_injection",), "Write text with textContent, and sanitize what must be markup."),
    (("unsafe_runtime",), "Replace eval and Function by fixed logic."),
    (("client_side_crypto",), "Decide nothing by cryptography in the browser; check on the server."),
    (("obfuscation",), "Read decoded and obfuscated code before trusting it."),
    (("runtime_eval", "runtime_string_timer"), "Remove code that runs text, timers with text included."),
    (("runtime_dom_sink",), "Check each place that writes markup while the page runs."),
    (("runtime_sensitive_storage",), "Move session data that appears at run time out of the browser."),
    (("data_exfiltration_candidate", "runtime_data_exfiltration_candidate"), "Limit third-party scripts, and what they may send where."),
    (("api_surface",), "Authorize and rate-limit every address that the code names."),
)
NOTHING_TO_DO = "Nothing asks for action at once; the signals give context."
# What an additive score adds for which columns, and its labels.
LEGACY_POINTS = (
    (("credible_secrets",), 3), (("storage",), 2), (("dom_risks",), 2), (("crypto_flows", "real_crypto_detected", "crypto"), 2), (("api_calls", "endpoints"), 1),
    (("hardcoded_configs",), 1), (("decoded_strings",), 1), (("suspicious_calls",), 1), (("obfuscation",), 1),
)
LEGACY_PAIR = {"both": 4, "keys": 3, "ivs": 2}
LEGACY_LABELS = ((9, "CRITICAL"), (5, "HIGH"), (2, "MEDIUM"), (0, "LOW"))


def category_totals(finds: DataFrame) -> DataFrame:
    """category, n, severity over the finds (doc_id, detector, value)."""
    totals = finds.groupBy(F.col("detector").alias("category")).agg(F.count("*").alias("n"))
    return totals.withColumn("severity", policy.category_severity(F.col("category"), F.col("n")))


def mix(findings: DataFrame, column: str, scope: list[str] | None = None) -> DataFrame:
    """How many findings have which value of a column."""
    return findings.groupBy(*(scope or []), column).agg(F.count("*").alias("n"))


def confidence_mix(findings: DataFrame) -> DataFrame:
    """confidence, n, most frequent first, then by name."""
    level = F.lower(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("low")))
    return mix(findings.withColumn("confidence", level), "confidence").orderBy(F.desc("n"), "confidence")


def scan_summary(documents: DataFrame) -> DataFrame:
    """One row over sized documents (content, skip_reason): discovered,
    analyzed, skipped, why, bytes and coverage in percent (100 of nothing)."""
    kept = F.col("skip_reason").isNull()
    row = documents.agg(
        F.count("*").alias("discovered"), F.count_if(kept).alias("analyzed"), F.count_if(~kept).alias("skipped"),
        F.array_sort(F.collect_set("skip_reason")).alias("reasons"), F.coalesce(F.sum(F.when(kept, F.octet_length("content"))), F.lit(0)).alias("bytes"),
    )
    return row.withColumn("coverage_percent", coverage_percent(F.col("analyzed"), F.col("discovered")))


def coverage_percent(analyzed: Column, discovered: Column) -> Column:
    return F.when(discovered > 0, F.round(analyzed / discovered * 100, 1)).otherwise(100.0)


def remediation(findings: DataFrame) -> DataFrame:
    """nth, step: the steps that the findings' ids ask for, in order."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(n, i, step) for n, (ids, step) in enumerate(STEPS) for i in ids], "nth int, id string, step string")
    asked = F.broadcast(rules).join(findings.select("id").distinct(), "id", "left_semi").select("nth", "step").distinct()
    none = spark.createDataFrame([(len(STEPS), NOTHING_TO_DO)], "nth int, step string")
    return asked.unionByName(none.join(asked.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left_anti")).orderBy("nth")


def legacy_risk(wide: DataFrame) -> DataFrame:
    """doc_id, score, label by the additive rule: each category adds once;
    keys and IVs together count more than either."""
    have = dict(wide.dtypes)

    def some(name: str) -> Column:
        if name not in have:
            return F.lit(False)
        return F.coalesce(F.size(name) > 0 if have[name].startswith("array") else F.col(name).cast("boolean"), F.lit(False))

    keys, ivs = some("keys"), some("ivs")
    pair = F.when(keys & ivs, LEGACY_PAIR["both"]).when(keys, LEGACY_PAIR["keys"]).when(ivs, LEGACY_PAIR["ivs"]).otherwise(0)
    score = reduce(lambda a, b: a + b, [F.when(reduce(or_, [some(c) for c in columns]), points).otherwise(0) for columns, points in LEGACY_POINTS], pair)
    label = F.lit(None).cast("string")
    for least, name in reversed(LEGACY_LABELS):
        label = F.when(F.col("score") >= least, name).otherwise(label)
    return wide.select("doc_id", score.cast("int").alias("score")).withColumn("label", label)


def plain_findings(findings: DataFrame, limit: int = 5) -> DataFrame:
    """For a reader in a hurry: the first actionable finding of each id."""
    open_ = findings.filter(~F.col("observation"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))
    where = F.concat(F.col("file"), F.when(F.col("line") > 0, F.format_string(" (line %d)", F.col("line"))).otherwise(""))
    kept = open_.withColumn("__nth", first).filter("__nth = 1")
    return kept.select("ordinal", "id", F.upper("severity").alias("severity"), where.alias("where")).orderBy("ordinal").limit(limit)


def reliability(summary: dict, confidence: dict[str, int], runtime: str = "not_run", parser: bool = False) -> list[tuple[str, str]]:
    """How much was seen, and how far to trust it, as named lines."""
    lines = [("Coverage", f"{summary['analyzed']} of {summary['discovered']} scripts analyzed ({summary['coverage_percent']:g}%)")]
    if summary["skipped"]:
        lines.append(("Skipped", f"{summary['skipped']}: {', '.join(r.replace('_', ' ') for r in summary['reasons'])}"))
    lines.append(("Engine", "syntax tree" if parser else "statements and patterns, no syntax tree"))
    told = {"captured": "captured in a browser", "disabled": "turned off", "missing_dependency": "no browser available", "browser_failed": "the browser failed", "error": "failed"}
    lines.append(("Runtime", told.get(runtime, "not run")))
    if confidence:
        lines.append(("Confidence", ", ".join(f"{k} {n}" for k, n in sorted(confidence.items(), key=lambda x: (-x[1], x[0])))))
    proven = confidence.get("confirmed", 0)
    lines.append(("Proof", f"{proven} proven at run time" if proven else "none: nothing was proven by an unsafe effect"))
    return lines


def executive(findings: DataFrame, score: int, label: str, files: int) -> dict:
    """The result in a few sentences, what was found, and what to do first."""
    counts = findings.agg(F.count_if(~F.col("observation")).alias("open"), F.count_if("observation").alias("seen")).first()
    first = [r.asDict() for r in plain_findings(findings).collect()]
    words = f"{counts['open']} to look at and {counts['seen']} observations in {files} scripts" if counts["open"] or counts["seen"] else f"Nothing found in {files} scripts"
    steps = [r["step"] for r in remediation(findings.filter(~F.col("observation"))).limit(3).collect()]
    return {"label": label, "words": f"{words}; rated {label} ({score}/100).", "findings": first, "first_steps": steps}


#: Files that a dashboard shows.
FILES = 50


def file_rows(documents: DataFrame, finds: DataFrame, limit: int = FILES) -> DataFrame:
    """name, n, lists: what the detectors found in each document, by detector,
    the documents with most finds first."""
    found = model.file_diagnostics(finds, ["doc_id"], "detector", "value", "ordinal", sorted(DETECTORS))
    most = found.select("doc_id", "n", "lists").orderBy(F.desc("n"), "doc_id").limit(limit)
    return most.join(documents.select("doc_id", "name"), "doc_id").orderBy(F.desc("n"), "doc_id").select("name", "n", "lists")


def dashboard(spark: SparkSession, documents: DataFrame, findings: DataFrame, finds: DataFrame, limit: int = 6) -> dict:
    """The payload of a dashboard: score with reasons, priorities, totals,
    mixes, files, reliability and summary of one scan. Findings carry `file`."""
    one = findings_.normalize(findings).withColumn("scan_id", F.lit(1))
    score = next(iter(risk.overall(one, ["scan_id"]).collect()), None)
    row = score.asDict(recursive=True) if score else {}
    total = {"score": row.get("score", 0), "label": row.get("label", "INFO"), "contributors": row.get("contributors", [])}
    summary = scan_summary(documents).first().asDict()
    confidence = {r["confidence"]: r["n"] for r in confidence_mix(findings).collect()}
    return {
        **total,
        "priorities": [r.asDict(recursive=True) for r in risk.priorities(one, ["scan_id"], limit=limit).collect()],
        "categories": {r["category"]: {"n": r["n"], "severity": r["severity"]} for r in category_totals(finds).collect()},
        "severities": {r["severity"]: r["n"] for r in mix(findings, "severity").collect()},
        "confidence": confidence,
        "files": [r.asDict() for r in file_rows(documents, finds).collect()],
        "summary": summary,
        "reliability": reliability(summary, confidence),
        "executive": executive(one, total["score"], total["label"], summary["analyzed"]),
    }


def with_script(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """Documents with the score and party of the first script of their name,
    or else of their file name."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    scripts = inventory.select(F.col("name").alias("script"), "party", "score", F.col("doc_id").alias("at"))
    exact = scripts.groupBy(F.col("script").alias("name")).agg(F.min_by(F.struct("party", "score"), "at").alias("exact"))
    named = scripts.groupBy(base(F.col("script")).alias("base")).agg(F.min_by(F.struct("party", "score"), "at").alias("named"))
    joined = documents.join(exact, "name", "left").withColumn("base", base(F.col("name"))).join(named, "base", "left")
    found = F.coalesce("exact", "named")
    return joined.select(*documents.columns, found["party"].alias("party"), found["score"].alias("score"))


def with_url(findings: DataFrame, urls: DataFrame) -> DataFrame:
    """Findings with the URL that their file (file, url) was loaded from; the
    file itself where none is known."""
    known = urls.groupBy("file").agg(F.min("url").alias("__url"))
    return findings.join(known, "file", "left").withColumn("url", F.coalesce("__url", "file")).drop("__url")


def source_map_totals(originals: DataFrame, findings: DataFrame, cap: int = 40) -> tuple[DataFrame, DataFrame]:
    """Per document: how many original sources were expanded, how large, with
    how many findings; and the findings to merge into it, the first `cap`."""
    size = originals.groupBy("doc_id").agg(F.count("*").alias("sources"), F.sum(F.octet_length("content")).alias("bytes"))
    found = findings.groupBy("doc_id").agg(F.count("*").alias("findings"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    merged = findings.withColumn("__nth", nth).filter(F.col("__nth") <= cap).drop("__nth")
    return size.join(found, "doc_id", "left").fillna(0, ["findings"]), merged


def merge_surface(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """Endpoints seen in code and while running (url, method), each once, with
    where they were seen; a method that is not known counts as GET."""
    side = lambda df, name: df.select("url", F.upper(F.coalesce("method", F.lit("GET"))).alias("method"), F.lit(name).alias("seen"))
    both = side(static, "static").unionByName(side(runtime, "runtime"))
    return both.groupBy("url", "method").agg(F.array_sort(F.collect_set("seen")).alias("seen"))


