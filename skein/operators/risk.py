"""The bounded, explainable risk score and what to look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vocab

# Ceilings, floors and the ids that are flows by themselves.
OBSERVATION_CAP, THIRD_PARTY_CAP = 15, 30
FLOORS = {4: (75, "CRITICAL"), 3: (50, "HIGH")}
FLOW_IDS = ("dom_injection", "open_redirect", "data_exfiltration_flow", "dangerous_dynamic_code")
L_CONFIRMED = "Confirmed/demonstrated dangerous behavior"
L_FLOW = "High-confidence source-to-sink flow"
L_RUNTIME = "High-confidence runtime observation"
L_HIGH = "High-confidence finding"
L_EXFIL = "Sensitive data → external destination correlation"
L_REVIEW = "Needs-review finding (medium confidence)"
L_LOW = "Low-confidence signal on a high-impact pattern"
L_OBSERVED = "Security observations (API surface, obfuscation, inventory)"
L_THIRD_READS = "Third-party script reads sensitive data and sends data externally"
L_THIRD_HIGH = "High-risk third-party script"
L_EVAL = "Runtime eval / dynamic execution observed"
L_SINKS = "Runtime DOM sink writes observed"


def scored(findings: DataFrame, scope: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Each distinct finding of a scope with tier, bucket (label) and points.

    The first of several with one id, file, line, sink[:80] and source[:80]
    counts. Input: normalized findings."""
    key = [*scope, "id", "file", "line", F.substring("sink", 1, 80), F.substring("source", 1, 80)]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))
    f = findings.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    f = f.withColumn("tier", vocab.tier(F.col("confidence"), F.col("evidence_type"), F.col("status")))
    base = vocab.base_points(F.col("severity"), F.col("tier"))
    kind, proven = F.col("evidence_type"), (vocab.status(F.col("status")) == "confirmed") | (F.col("evidence_type") == "runtime_effect")
    flow = F.col("id").isin(*FLOW_IDS) | (kind == "source_to_sink")
    rules = [
        (F.col("observation"), L_OBSERVED, F.lit(1), 0),
        (proven, L_CONFIRMED, base + 10, 3),
        ((F.col("tier") >= 2) & flow, L_FLOW, base + 8, 2),
        ((F.col("tier") >= 2) & kind.contains("runtime"), L_RUNTIME, base + 4, 2),
        (F.col("tier") >= 2, L_HIGH, base + 4, 2),
        ((F.col("id") == "data_exfiltration_candidate") | (kind == "behavioral_correlation"), L_EXFIL, base + 5, 1),
        (F.col("tier") == 1, L_REVIEW, base + 2, 1),
        (F.lit(True), L_LOW, F.greatest(F.lit(3), base), 0),
    ]

    def decide(what: int) -> Column:
        out = None
        for rule in rules:
            value = rule[what] if isinstance(rule[what], Column) else F.lit(rule[what])
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out

    return f.withColumns({"label": decide(1), "points": decide(2).cast("int"), "label_tier": decide(3)})


def third_party(scripts: DataFrame, scope: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Points of third-party scripts under their common ceiling.

    `scripts`: party, score, n_reads, n_external. A script is paid what is
    left of the ceiling when its turn comes; with non-negative points that is
    the growth of min(ceiling, running sum)."""
    reads = (F.col("n_reads") > 0) & (F.col("n_external") > 0)
    third = scripts.filter(F.col("party") == "third_party").filter(reads | (F.col("score") >= 40))
    due = F.when(reads, F.least(F.lit(18), F.lit(6) + F.floor(F.col("score") / 6))).otherwise(F.least(F.lit(12), F.lit(4) + F.floor(F.col("score") / 10)))
    paid = third.withColumns({"due": due.cast("int"), "label": F.when(reads, L_THIRD_READS).otherwise(L_THIRD_HIGH), "exfil": reads})
    run = F.sum("due").over(Window.partitionBy(*scope).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    paid = paid.withColumn("run", run)
    cap = F.lit(THIRD_PARTY_CAP)
    return paid.withColumn("points", (F.least(cap, F.col("run")) - F.least(cap, F.col("run") - F.col("due"))).cast("int")).drop("run")


def overall(findings: DataFrame, scope: list[str], scripts: DataFrame | None = None, runtime: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """One row for each scope: score (0 to 100), label, contributors (by
    points, then first appearance) and counts.

    Input: normalized findings; optionally scripts (see third_party) and
    runtime (captured, n_eval, n_dom_sinks) with the scope's columns."""
    f = scored(findings, scope, ordinal)
    flags = lambda c: F.count_if(c).cast("long")
    proven = (vocab.status(F.col("status")) == "confirmed") | (F.col("evidence_type") == "runtime_effect")
    real = ~F.col("observation")
    severe = vocab.severity_rank(F.col("severity"), unknown=1)
    # Points and counts by label in one pass; a scope has few labels.
    counted = {
        "confirmed": flags(real & proven), "high_confidence_flows": flags(F.col("label") == L_FLOW), "findings": flags(real), "observations": flags(F.col("observation")),
        "runtime_effects": flags(real & proven & F.col("evidence_type").contains("runtime")), "high_or_critical": flags(real & (severe >= 3)),
        "proven_rank": F.coalesce(F.max(F.when(real & proven, severe)), F.lit(0)).cast("long"),
    }
    behaved = {"third_party_exfil": flags(F.col("exfil")), "third_party_risky": flags(~F.col("exfil")), "third_party_points": F.sum("points").cast("long")}
    totals = [*counted, *behaved]

    def part(rows: DataFrame, at: Column, tier: Column, mine: dict[str, Column]) -> DataFrame:
        row = rows.groupBy(*scope, "label").agg(F.sum("points").cast("long").alias("points"), F.count("*").alias("count"), tier.cast("int").alias("tier"), at.alias("at"), *[c.alias(n) for n, c in mine.items()])
        return row.select(*scope, "label", "points", "count", "tier", "at", *[F.col(n) if n in mine else F.lit(0).cast("long").alias(n) for n in totals])

    seen_last = F.col("label") == L_OBSERVED
    buckets = part(f, F.min(ordinal), F.max("label_tier"), counted).withColumns(
        {"points": F.when(seen_last, F.least("points", F.lit(OBSERVATION_CAP))).otherwise(F.col("points")), "at": F.when(seen_last, F.lit(1 << 60)).otherwise(F.col("at"))}
    )
    scopes = None
    if scripts is not None:
        buckets = buckets.union(part(third_party(scripts, scope, ordinal), F.min(ordinal) + F.lit((1 << 60) + 1), F.lit(1), behaved))
        scopes = scripts.select(*scope)
    if runtime is not None:
        seen = runtime.filter("captured")
        for column, label, points, tier, at_ in (("n_eval", L_EVAL, 8, 3, 1), ("n_dom_sinks", L_SINKS, 5, 2, 2)):
            one = seen.filter(F.col(column) > 0).select(*scope, F.lit(label).alias("label"), F.lit(points).cast("long").alias("points"), F.col(column).cast("long").alias("count"), F.lit(tier).alias("tier"), F.lit((1 << 62) + at_).alias("at"))
            buckets = buckets.union(one.select("*", *[F.lit(0).cast("long").alias(n) for n in totals]))
        scopes = runtime.select(*scope) if scopes is None else scopes.union(runtime.select(*scope))
    bucket = F.struct((-F.col("points")).alias("by"), "at", "label", F.col("points").cast("int").alias("points"), F.col("count").cast("long").alias("count"), F.col("tier").cast("int").alias("tier"))
    sums = [(F.max(n) if n == "proven_rank" else F.sum(n)).alias(n) for n in totals]
    # Scripts that the ceiling leaves nothing count, but contribute nothing.
    paid = (F.col("points") > 0) | ~F.col("label").isin(L_THIRD_READS, L_THIRD_HIGH)
    out = buckets.groupBy(*scope).agg(F.sum("points").alias("raw"), F.collect_list(F.when(paid, bucket)).alias("all"), *sums)
    if scopes is not None:
        out = scopes.distinct().join(out, scope, "full")
    out = out.fillna(0, ["raw", *totals])
    floor = F.when(F.col("proven_rank") >= 4, FLOORS[4][0]).when(F.col("proven_rank") >= 3, FLOORS[3][0]).otherwise(0)
    lift = F.greatest(floor - F.col("raw"), F.lit(0))
    name = F.concat(F.lit("Demonstrated "), F.when(F.col("proven_rank") >= 4, FLOORS[4][1]).otherwise(FLOORS[3][1]), F.lit(" effect (severity floor)"))
    lifted = F.struct((-lift).alias("by"), F.lit((1 << 62) + 9).alias("at"), name.alias("label"), lift.cast("int").alias("points"), F.lit(1).cast("long").alias("count"), F.lit(3).alias("tier"))
    kind = "array<struct<by:bigint,at:bigint,label:string,points:int,count:bigint,tier:int>>"
    buckets_ = F.coalesce(F.col("all").cast(kind), F.expr(f"cast(array() as {kind})"))
    every = F.array_sort(F.when(lift > 0, F.concat(buckets_, F.array(lifted).cast(kind))).otherwise(buckets_))
    out = out.withColumns({"score": F.least(F.lit(100), F.greatest(F.lit(0), F.col("raw") + lift)).cast("int"), "contributors": every})
    score, sure, flows = F.col("score"), F.col("confirmed"), F.col("high_confidence_flows")
    label = (
        F.when((score >= 75) | (sure >= 2), "CRITICAL")
        .when((score >= 50) | (sure >= 1) | (flows >= 2), "HIGH")
        .when((score >= 25) | (flows >= 1) | (F.col("findings") >= 3) | (F.col("high_or_critical") >= 1), "MEDIUM")
        .otherwise("LOW")
    )
    shown = F.transform("contributors", lambda c: F.struct(c["label"].alias("label"), c["points"].alias("points"), c["count"].alias("count"), c["tier"].alias("tier")))
    return out.select(
        *scope, "score", label.alias("label"), shown.alias("contributors"), "confirmed", "high_confidence_flows", "findings", "observations",
        "runtime_effects", "high_or_critical", "third_party_exfil", "third_party_risky", "third_party_points",
        F.least("observations", F.lit(OBSERVATION_CAP)).cast("int").alias("observation_points"),
    )


def priorities(findings: DataFrame, scope: list[str], limit: int = 5, ordinal: str = "ordinal") -> DataFrame:
    """The `limit` findings of each scope to look at first: highest
    10 * tier + severity, earlier ones first among equals."""
    real = findings.filter(~F.col("observation"))
    rank = vocab.tier(F.col("confidence"), F.col("evidence_type"), F.col("status")) * 10 + vocab.severity_rank(F.col("severity"), unknown=1)
    order = Window.partitionBy(*scope).orderBy(F.desc("rank"), ordinal)
    top = real.withColumn("rank", rank).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    where = F.when(F.col("line") > 0, F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise(F.col("file"))
    return top.withColumn("location", where)
