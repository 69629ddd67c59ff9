"""Controlled vocabularies of findings, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and their ranks.
SEVERITIES = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CONFIDENCES = {"low": 0, "medium": 1, "high": 2, "confirmed": 3}
CONFIDENCE_SYNONYMS = {"conf": "confirmed", "certain": "confirmed", "proven": "confirmed", "verified": "confirmed"}
STATUSES = ("open", "needs_review", "confirmed", "false_positive", "informational", "potential")
STATUS_SYNONYMS = {
    "info": "informational",
    "informative": "informational",
    "observation": "informational",
    "falsepositive": "false_positive",
    "fp": "false_positive",
    "review": "needs_review",
    "triage": "needs_review",
}
QUALITIES = ("high", "medium", "low", "heuristic")
CONFIDENCE_OF_EVIDENCE = {
    "runtime_browser": "high",
    "runtime_effect": "confirmed",
    "source_to_sink": "high",
    "framework_pattern": "medium",
    "behavioral_correlation": "medium",
    "static_pattern": "low",
    "heuristic": "low",
}
SEVERITY_WEIGHTS = {0: 1, 1: 2, 2: 4, 3: 7, 4: 10}
TIER_MULTIPLIERS = {3: 1.0, 2: 0.75, 1: 0.45, 0: 0.2}


def choose(value: Column, table: dict, otherwise: Column | object) -> Column:
    """table[value], or `otherwise` where value is not a key (or null). A map
    holds `value` once, so that choices of choices don't multiply their code."""
    key = value.cast("int") if all(isinstance(k, int) for k in table) else value
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return F.coalesce(found, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def _word(value: Column) -> Column:
    return F.trim(F.lower(F.coalesce(value, F.lit(""))))


def severity(value: Column) -> Column:
    up = F.upper(F.when(value == "", None).otherwise(value))
    return F.when(up.isin(list(SEVERITIES)), up).otherwise("MEDIUM")


def severity_rank(value: Column, unknown: int = 0) -> Column:
    return choose(F.upper(F.coalesce(value, F.lit(""))), SEVERITIES, unknown)


def confidence(value: Column) -> Column:
    v = _word(value)
    return F.when(v.isin(list(CONFIDENCES)), v).otherwise(choose(v, CONFIDENCE_SYNONYMS, "low"))


def confidence_rank(value: Column) -> Column:
    return choose(confidence(value), CONFIDENCES, 0)


def status(value: Column) -> Column:
    v = F.replace(F.replace(_word(value), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.when(v.isin(list(STATUSES)), v).otherwise(choose(v, STATUS_SYNONYMS, "needs_review"))


def quality(value: Column) -> Column:
    v = _word(value)
    return F.when(v.isin(list(QUALITIES)), v).otherwise("medium")


def confidence_of_evidence(evidence_type: Column) -> Column:
    return choose(evidence_type, CONFIDENCE_OF_EVIDENCE, "low")


def derived_status(conf: Column, evidence_type: Column, sanitized: Column, sev: Column, observation: Column) -> Column:
    """Initial triage status; the first rule that holds decides."""
    return (
        F.when(sanitized | observation, "informational")
        .when((evidence_type == "runtime_effect") | (conf == "confirmed"), "confirmed")
        .when(conf == "high", "open")
        .when(conf == "medium", "needs_review")
        .when(severity_rank(sev) >= SEVERITIES["HIGH"], "needs_review")
        .otherwise("informational")
    )


def observation(flag: Column, status_: Column, sanitized: Column, evidence_type: Column, flow: Column, sev: Column) -> Column:
    """Whether a finding is posture information rather than a defect."""
    quiet = status(status_).isin("informational", "false_positive")
    bare = (evidence_type == "static_pattern") & (F.coalesce(F.size(flow), F.lit(0)) <= 0) & ~F.upper(sev).isin("CRITICAL", "HIGH")
    return F.coalesce(flag, F.lit(False)) | quiet | F.coalesce(sanitized, F.lit(False)) | F.coalesce(bare, F.lit(False))


def line_number(value: Column) -> Column:
    """A line from any text: an integer, else its digits, else 0; never below 0."""
    text = value.cast("string")
    plain = F.when(F.trim(text).rlike(r"^[+-]?\d{1,9}$"), F.trim(text).cast("int"))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.greatest(F.lit(0), F.coalesce(plain, F.when(F.length(digits).between(1, 9), digits.cast("int")), F.lit(0)))


def tier(conf: Column, evidence_type: Column, status_: Column) -> Column:
    """0 to 3: how proven a finding is."""
    rank = confidence_rank(conf)
    return (
        F.when((status(status_) == "confirmed") | (evidence_type == "runtime_effect") | (rank >= 3), 3)
        .when((evidence_type == "runtime_browser") | (rank >= 2), 2)
        .when(rank >= 1, 1)
        .otherwise(0)
    )


def severity_weight(sev: Column) -> Column:
    return choose(severity_rank(sev, unknown=1), SEVERITY_WEIGHTS, 2)


def base_points(sev: Column, tier_: Column) -> Column:
    """Half-even rounding, as bround does: 10.5 counts 10."""
    return F.bround(severity_weight(sev).cast("double") * choose(tier_, TIER_MULTIPLIERS, 0.2) * 2.0, 0).cast("int")
