"""Browser evidence of a scan as JSON, to counts and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import policy
from skein.functions import text as X

_URL = "array<struct<method: string, url: string, status: int, resource_type: string>>"
_NOTE = "array<struct<type: string, text: string, url: string, line: int>>"
SCHEMA = (
    f"struct<captured: boolean, status: string, url: string, final_url: string, requests: {_URL}, responses: {_URL}, failed_requests: {_URL}, console: {_NOTE}, page_errors: array<string>, "
    "websockets: array<string>, local_storage_keys: array<string>, session_storage_keys: array<string>, cookie_names: array<string>, "
    f"eval_calls: {_NOTE}, string_timers: {_NOTE}, dom_sinks: {_NOTE}, storage_writes: array<struct<key: string, store: string>>>"
)
# Resource types of requests that call an API, and console entries that tell of faults.
API_TYPES, FAULTS = ("xhr", "fetch"), ("error", "assert", "warning")
# Id, severity, confidence, status, evidence type, observation.
RULES = {
    "n_eval": ("runtime_eval", "HIGH", "confirmed", "confirmed", "runtime_effect", False),
    "n_string_timers": ("runtime_string_timer", "MEDIUM", "medium", "needs_review", "runtime_browser", True),
    "n_dom_sinks": ("runtime_dom_sink", "HIGH", "high", "open", "runtime_browser", False),
    "n_sensitive_storage": ("runtime_sensitive_storage", "HIGH", "medium", "needs_review", "runtime_browser", False),
    "n_console_errors": ("runtime_console_errors", "MEDIUM", "medium", "needs_review", "runtime_browser", True),
    "n_failed": ("runtime_failed_requests", "LOW", "medium", "needs_review", "runtime_browser", True),
    "n_websockets": ("runtime_websocket", "LOW", "high", "informational", "runtime_browser", True),
    "n_api_calls": ("runtime_api_calls", "LOW", "medium", "informational", "runtime_browser", True),
    "n_sent_out": ("runtime_data_exfiltration_candidate", "HIGH", "medium", "needs_review", "runtime_browser", False),
}


def counts(evidence: DataFrame, json: str = "evidence") -> DataFrame:
    """scan_id, url, captured, a count for each rule, the sensitive keys and
    the external hosts, from rows (scan_id, evidence as JSON). What can't be
    read counts as not captured."""
    e = evidence.select("scan_id", F.from_json(json, SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("scan_id", "e.*")
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)) if isinstance(c, Column) else F.greatest(F.size(c), F.lit(0))
    some = lambda c: F.coalesce(c, F.expr("cast(array() as array<string>)"))
    names = F.concat(some(F.transform("storage_writes", lambda w: w["key"])), some(F.col("local_storage_keys")), some(F.col("session_storage_keys")), some(F.col("cookie_names")))
    keys = F.array_distinct(F.filter(names, lambda k: k.isNotNull() & policy.sensitive_key(k)))
    page = F.coalesce("url", "final_url", F.lit(""))
    hosts = F.filter(some(F.transform("requests", lambda r: X.url_host(F.coalesce(r["url"], F.lit(""))))), lambda h: h != "")
    base = e.select(
        "scan_id", page.alias("url"), F.coalesce("captured", F.lit(False)).alias("captured"),
        n("eval_calls").alias("n_eval"), n("string_timers").alias("n_string_timers"), n("dom_sinks").alias("n_dom_sinks"), keys.alias("sensitive_keys"),
        (n(F.filter("console", lambda c: F.lower(c["type"]).isin(*FAULTS))) + n("page_errors")).alias("n_console_errors"),
        n("failed_requests").alias("n_failed"), n("websockets").alias("n_websockets"),
        n(F.array_distinct(F.transform(F.filter("requests", lambda r: r["resource_type"].isin(*API_TYPES)), lambda r: r["url"]))).alias("n_api_calls"),
        F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != X.url_host(page)))).alias("external_hosts"),
    )
    base = base.withColumn("n_sensitive_storage", F.size("sensitive_keys"))
    return base.withColumn("n_sent_out", F.when((F.size("sensitive_keys") > 0) & (F.size("external_hosts") > 0), F.size("external_hosts")).otherwise(0))


def findings(counted: DataFrame) -> DataFrame:
    """scan_id, file, ordinal and the fields of RULES for every count above
    zero of captured evidence; a timer with text only where no eval was seen."""
    each = []
    for column, (id, severity, confidence, status, kind, observation) in RULES.items():
        when = F.coalesce(F.col(column), F.lit(0)) > 0 if column in counted.columns else F.lit(False)
        if column == "n_string_timers":
            when = when & (F.coalesce("n_eval", F.lit(0)) == 0)
        values = {"id": id, "severity": severity, "confidence": confidence, "status": status, "evidence_type": kind, "observation": observation}
        each.append(F.when(when, F.struct(*[F.lit(v).alias(k) for k, v in values.items()])))
    rows = counted.filter("captured").select("scan_id", F.col("url").alias("file"), F.posexplode(F.array_compact(F.array(*each))).alias("ordinal", "f"))
    return rows.select("scan_id", "file", F.col("ordinal").cast("long").alias("ordinal"), "f.*")
