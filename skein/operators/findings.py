"""Findings: normalization, identity, merging, correlation and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vocab

#: Columns of a finding with their types; inputs may lack any of them.
SCHEMA = {
    "id": "string", "type": "string", "severity": "string", "confidence": "string", "status": "string",
    "file": "string", "line": "string", "source": "string", "sink": "string", "flow": "array<string>",
    "evidence": "string", "evidence_list": "array<string>", "sanitization_detected": "boolean",
    "framework": "string", "evidence_type": "string", "analysis_quality": "string",
    "limitations": "array<string>", "observation": "boolean",
}
EMPTY = "cast(array() as array<string>)"


def normalize(findings: DataFrame, fallback_file: str = "") -> DataFrame:
    """All columns of a finding, with defaults and controlled vocabularies.

    Confidence follows the evidence type where none is given; status follows
    the quality of evidence. Other columns pass through.
    """
    have = dict(findings.dtypes)
    raw = {c: F.col(c).cast(t) if c in have else F.lit(None).cast(t) for c, t in SCHEMA.items()}
    text = lambda c: F.nullif(raw[c], F.lit(""))
    name = F.coalesce(raw["id"], text("type"), F.lit("finding"))
    out = findings.withColumns(
        {
            "id": name,
            "type": F.coalesce(raw["type"], name),
            "severity": vocab.severity(raw["severity"]),
            "evidence_type": F.coalesce(text("evidence_type"), F.lit("static_pattern")),
            "file": F.coalesce(text("file"), F.lit(fallback_file)),
            "line": vocab.line_number(raw["line"]),
            "flow": F.coalesce(raw["flow"], F.expr(EMPTY)),
            "limitations": F.coalesce(raw["limitations"], F.expr(EMPTY)),
            "evidence_list": raw["evidence_list"],
            "sanitization_detected": F.coalesce(raw["sanitization_detected"], F.lit(False)),
            "observation": F.coalesce(raw["observation"], F.lit(False)),
            "analysis_quality": vocab.quality(raw["analysis_quality"]),
            **{c: F.coalesce(raw[c], F.lit("")) for c in ("source", "sink", "evidence", "framework")},
            "confidence": raw["confidence"],
            "status": raw["status"],
        }
    )
    out = out.withColumn("confidence", vocab.confidence(F.coalesce(F.nullif(F.col("confidence"), F.lit("")), vocab.confidence_of_evidence(F.col("evidence_type")))))
    derived = vocab.derived_status(F.col("confidence"), F.col("evidence_type"), F.col("sanitization_detected"), F.col("severity"), F.col("observation"))
    out = out.withColumn("status", F.when(F.coalesce(F.col("status"), F.lit("")) != "", vocab.status(F.col("status"))).otherwise(derived))
    return out.withColumn("observation", _observation())


def _observation() -> Column:
    return vocab.observation(
        F.col("observation"), F.col("status"), F.col("sanitization_detected"), F.col("evidence_type"), F.col("flow"), F.col("severity")
    )


def identity() -> list[Column]:
    """What makes two findings of one scan the same: id, file, source, sink
    without punctuation, line, and the set of flow steps."""
    low = lambda c: F.substring(F.lower(F.trim(c)), 1, 160)
    sink = F.substring(F.regexp_replace(low(F.coalesce(F.nullif("sink", F.lit("")), F.col("evidence"))), r"[^\p{L}\p{N}.]", ""), 1, 120)
    steps = F.filter(F.transform("flow", lambda s: F.lower(F.trim(s))), lambda s: s != "")
    return [
        F.col("id").alias("k_id"),
        F.col("file").alias("k_file"),
        low(F.col("source")).alias("k_source"),
        sink.alias("k_sink"),
        F.col("line").alias("k_line"),
        F.substring(F.array_join(F.array_sort(F.array_distinct(steps)), "|"), 1, 200).alias("k_flow"),
    ]


_MERGED = ["severity", "confidence", "status", "source", "sink", "flow", "evidence", "evidence_list", "sanitization_detected", "framework", "evidence_type", "analysis_quality", "limitations", "observation", "type"]


def _merge(kept: Column, new: Column) -> Column:
    """Blends a later record into the one that was there. Both are normalized
    and carry `rank`, 10 * confidence + severity, so nothing is mapped anew."""
    wins = new["rank"] > kept["rank"]
    pick = lambda c: F.when(wins & (new[c] != ""), new[c]).otherwise(kept[c])
    chosen = pick("source")
    conf, kind, sev, before = pick("confidence"), pick("evidence_type"), pick("severity"), pick("status")
    sanitized = kept["sanitization_detected"] | new["sanitization_detected"]
    high = sev.isin("HIGH", "CRITICAL")
    derived = (
        F.when(sanitized | kept["observation"], "informational")
        .when((kind == "runtime_effect") | (conf == "confirmed"), "confirmed")
        .when(conf == "high", "open")
        .when((conf == "medium") | high, "needs_review")
        .otherwise("informational")
    )
    state = F.when(before == "confirmed", before).otherwise(derived)
    bare = (kind == "static_pattern") & (F.size(kept["flow"]) == 0) & (F.size(new["flow"]) == 0) & ~high
    listed = kept["evidence_list"].isNotNull() | new["evidence_list"].isNotNull()
    items = lambda r: F.coalesce(r["evidence_list"], F.filter(F.array(r["evidence"]), lambda x: x != ""))
    return F.struct(
        sev.alias("severity"),
        conf.alias("confidence"),
        state.alias("status"),
        F.when(chosen == "", new["source"]).otherwise(chosen).alias("source"),
        F.when(kept["sink"] == "", new["sink"]).otherwise(kept["sink"]).alias("sink"),
        F.array_union(kept["flow"], new["flow"]).alias("flow"),
        F.when(kept["evidence"] == "", new["evidence"]).otherwise(kept["evidence"]).alias("evidence"),
        F.when(listed, F.array_union(items(kept), items(new))).alias("evidence_list"),
        sanitized.alias("sanitization_detected"),
        pick("framework").alias("framework"),
        kind.alias("evidence_type"),
        pick("analysis_quality").alias("analysis_quality"),
        F.array_union(kept["limitations"], F.filter(new["limitations"], lambda x: x != "")).alias("limitations"),
        # Once an observation, always one while records are blended.
        (kept["observation"] | sanitized | bare | state.isin("informational", "false_positive")).alias("observation"),
        kept["type"].alias("type"),
        F.greatest(kept["rank"], new["rank"]).alias("rank"),
    )


def deduplicate(findings: DataFrame, scope: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row for each identity within `scope`, later records blended into
    earlier ones in order of `ordinal`. Status and observation depend on that
    order, so records of one identity are folded one after another. Rows that
    repeat a record (all merged columns equal) are summed up first: blending
    one again changes nothing, but that any record was blended at all makes
    the status follow from the evidence."""
    keyed = normalize(findings).select("*", *identity())
    keys = [*scope, "k_id", "k_file", "k_source", "k_sink", "k_line", "k_flow"]
    records = keyed.groupBy(*keys, *_MERGED).agg(F.min(ordinal).alias(ordinal), F.count("*").alias("repeats"))
    rank = vocab.confidence_rank(F.col("confidence")) * 10 + vocab.severity_rank(F.col("severity"))
    each = F.struct(F.col(ordinal).alias("o"), F.struct(*_MERGED, rank.alias("rank")).alias("r"))
    groups = records.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("all"), F.sum("repeats").alias("records"))
    rows = groups.withColumn("first", F.col("all")[0]["r"]).withColumn(ordinal, F.col("all")[0]["o"])
    again = (F.size("all") == 1) & (F.col("records") > 1)
    rest = F.when(again, F.col("all")).otherwise(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))))
    merged = rows.withColumn("m", F.aggregate(rest, F.col("first"), lambda kept, new: _merge(kept, new["r"])))
    return merged.select(
        *scope, ordinal, F.col("k_id").alias("id"), F.col("k_file").alias("file"), F.col("k_line").alias("line"),
        *[F.col(f"m.{c}").alias(c) for c in _MERGED], "records",
    )


def correlate(flows: DataFrame, framework: DataFrame, signals: DataFrame, cap: int = 80) -> DataFrame:
    """Findings of each document: flows, then framework rules, then those
    signals whose id neither has; merged, the first `cap` kept. Inputs have
    doc_id and ordinal."""
    strong = flows.withColumn("precedence", F.lit(0)).unionByName(framework.withColumn("precedence", F.lit(1)), allowMissingColumns=True)
    weak = signals.withColumn("precedence", F.lit(2)).join(strong.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")
    both = strong.unionByName(weak, allowMissingColumns=True)
    order = F.col("precedence").cast("long") * F.lit(1 << 40) + F.col("ordinal")
    merged = deduplicate(both.withColumn("ordinal", order), ["doc_id"])
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return merged.withColumn("nth", nth).filter(F.col("nth") <= cap).drop("nth")


def split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actionable, observations)."""
    return findings.filter(~F.col("observation")), findings.filter("observation")


def matching(findings: DataFrame, *, status: str = "", severity: str = "", text: str = "", limit: int | None = None) -> DataFrame:
    """The list filter of the findings view: status, severity, and free text
    in type, file, source or sink."""
    out = findings
    if status:
        out = out.filter(F.col("status") == status)
    if severity:
        out = out.filter(F.upper("severity") == severity.upper())
    if text:
        blob = F.lower(F.concat_ws(" ", "type", "file", "source", "sink"))
        out = out.filter(blob.contains(text.lower()))
    return out if limit is None else out.orderBy("ordinal").limit(limit)
