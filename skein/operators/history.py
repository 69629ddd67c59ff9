"""Scan history: fingerprints, diffs, verdicts, baselines, triage and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vocab

VERDICTS = ("new", "worsened", "improved", "persisted", "resolved")


def fingerprint(id: Column, file: Column, sink: Column, title: Column, source_label: Column) -> Column:
    """A key of a finding that outlives moved lines."""
    parts = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (id, file, sink, title, source_label)]
    return F.sha1(F.concat_ws("|", *parts))


def evidence_ends(evidence_list: Column) -> tuple[Column, Column]:
    """(source label, sink) of the first evidence item that holds " -> "."""
    item = F.get(F.filter(evidence_list, lambda x: x.contains(" -> ")), F.lit(0))
    return F.trim(F.substring_index(item, " -> ", 1)), F.trim(F.substring_index(item, " -> ", -1))


def finding_rows(findings: DataFrame, scan_id: str = "scan_id", cap: int | None = 2000) -> DataFrame:
    """The stored rows of a scan's findings, the first `cap` of each scan; all,
    and nothing sorted, where it is None."""
    label, sink = evidence_ends(F.coalesce("evidence_list", F.expr("cast(array() as array<string>)")))
    title = F.col("title") if "title" in findings.columns else F.lit(None).cast("string")
    rows = findings.withColumn("fingerprint", fingerprint(F.col("id"), F.col("file"), F.coalesce(sink, F.col("sink")), title, label))
    if cap is not None:
        nth = F.row_number().over(Window.partitionBy(scan_id).orderBy("ordinal"))
        rows = rows.withColumn("__nth", nth).filter(F.col("__nth") <= cap)
    shown = F.coalesce(F.nullif(title, F.lit("")), F.col("type"))
    detail = F.coalesce(sink, F.col("sink")).alias("detail")
    return rows.select(scan_id, "fingerprint", F.col("id").alias("finding_id"), "severity", "confidence", shown.alias("title"), "file", detail, "observation", "ordinal")


def previous_scan(scans: DataFrame) -> DataFrame:
    """Each scan with the scan of the same target before it."""
    return scans.withColumn("previous_id", F.lag("scan_id").over(Window.partitionBy("target").orderBy("scan_id")))


def set_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """new, resolved and unchanged fingerprints of two sets of rows (n each)."""
    a = current.select("fingerprint").distinct().withColumn("now", F.lit(True))
    b = previous.select("fingerprint").distinct().withColumn("before", F.lit(True))
    both = a.join(b, "fingerprint", "full")
    return both.agg(
        F.count_if(F.col("before").isNull()).alias("new"),
        F.count_if(F.col("now").isNull()).alias("resolved"),
        F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull()).alias("unchanged"),
    )


def chain_diff(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """For every scan the numbers of new, resolved and unchanged fingerprints
    against the scan of its target before it, in one pass over all scans."""
    linked = previous_scan(scans.select("scan_id", "target"))
    mine = rows.select("scan_id", "fingerprint").distinct()
    now = linked.join(mine, "scan_id").select("scan_id", "fingerprint").withColumn("now", F.lit(1))
    old = mine.withColumnRenamed("scan_id", "previous_id")
    before = linked.filter("previous_id IS NOT NULL").join(old, "previous_id").select("scan_id", "fingerprint").withColumn("before", F.lit(1))
    both = now.join(before, ["scan_id", "fingerprint"], "full").groupBy("scan_id").agg(
        F.count_if(F.col("before").isNull()).alias("new"),
        F.count_if(F.col("now").isNull()).alias("resolved"),
        F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull()).alias("unchanged"),
    )
    return linked.join(both, "scan_id", "left").fillna(0, ["new", "resolved", "unchanged"])


def last_of(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), ordinal).alias("r")).select(*keys, "r.*")


def verdict(old: Column, new: Column) -> Column:
    """What became of a finding from one scan to the next: `old` and `new` are
    structs with severity, confidence and observation, null where the scan did
    not have it. Worse is tested before better: a finding whose severity fell
    while its confidence rose is worsened."""
    step = lambda f, c: f(new[c]) - f(old[c])
    sev, conf = step(vocab.severity_rank, "severity"), step(vocab.confidence_rank, "confidence")
    was, is_ = old["observation"], new["observation"]
    return (
        F.when(old.isNull(), "new")
        .when(new.isNull(), "resolved")
        .when((sev > 0) | (was & ~is_) | (conf > 0), "worsened")
        .when((sev < 0) | (~was & is_) | (conf < 0), "improved")
        .otherwise("persisted")
    )


SHOWN = ("severity", "confidence", "title", "file", "observation")


def chain_verdicts(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """A verdict for every fingerprint of every scan (scan_id, target) and of
    the scan of its target before it, in one pass over all scans."""
    linked = previous_scan(scans.select("scan_id", "target"))
    last = last_of(rows, ["scan_id", "fingerprint"]).select("scan_id", "fingerprint", F.struct(*SHOWN).alias("n"))
    now = linked.select("scan_id", "target").join(last, "scan_id")
    before = linked.filter("previous_id IS NOT NULL").join(last.withColumnRenamed("scan_id", "previous_id").withColumnRenamed("n", "o"), "previous_id")
    both = now.join(before.select("scan_id", "target", "fingerprint", "o"), ["scan_id", "target", "fingerprint"], "full")
    return both.select("target", "scan_id", "fingerprint", *verdict_columns(F.col("o"), F.col("n")))


def verdict_columns(old: Column, new: Column) -> list[Column]:
    return [
        verdict(old, new).alias("verdict"),
        *[F.coalesce(new[c], old[c]).alias(c) for c in SHOWN],
        old["severity"].alias("old_severity"),
        old["confidence"].alias("old_confidence"),
    ]


def revalidate(old: DataFrame, new: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """A verdict for every fingerprint of two scans (the last row counts).

    Adds coverage_gap: resolved in a file that the new scan didn't see."""
    keys = [*(scope or []), "fingerprint"]
    o = last_of(old, keys).select(*keys, F.struct(*SHOWN).alias("o"))
    n = last_of(new, keys).select(*keys, F.struct(*SHOWN).alias("n"))
    seen = new.select(*(scope or []), "file").distinct().withColumn("seen", F.lit(True))
    out = o.join(n, keys, "full").select(*keys, *verdict_columns(F.col("o"), F.col("n")))
    out = out.join(seen, [*(scope or []), "file"], "left")
    return out.withColumn("coverage_gap", (F.col("verdict") == "resolved") & F.col("seen").isNull()).drop("seen")


def verdict_order(verdicts: DataFrame, limit: int = 100) -> DataFrame:
    rank = vocab.choose(F.col("verdict"), {v: i for i, v in enumerate(VERDICTS)}, 9)
    return verdicts.orderBy(F.desc(vocab.severity_rank(F.col("severity"))), rank, "file", "fingerprint").limit(limit)


def coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many files of the old scan the new one saw again; `partial` if not all."""
    a, b = old.select("file").distinct(), new.select("file").distinct().withColumn("seen", F.lit(1))
    got = a.join(b, "file", "left").agg(F.count("*").alias("files"), F.count("seen").alias("covered"))
    return got.withColumn("coverage", F.when(F.col("files") == F.col("covered"), "full").otherwise("partial"))


def against_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each finding row as new, worse (severity rose) or known."""
    known = baseline.groupBy("fingerprint").agg(F.max(vocab.severity_rank(F.col("severity"))).alias("known_rank"))
    state = (
        F.when(F.col("known_rank").isNull(), "new").when(vocab.severity_rank(F.col("severity")) > F.col("known_rank"), "worse").otherwise("known")
    )
    return rows.join(known, "fingerprint", "left").withColumn("state", state).drop("known_rank")


def gate(rows: DataFrame, threshold: str, scope: list[str] | None = None) -> DataFrame:
    """Whether findings at or above `threshold` exist: worst severity, how many
    have it, and the exit code (1 if the gate closes)."""
    rank = vocab.severity_rank(F.col("severity"))
    least = vocab.SEVERITIES[threshold.upper()]
    real = rows.filter(~F.col("observation")).withColumn("rank", rank)
    by = real.groupBy(*(scope or []), "rank").agg(F.count("*").alias("n"))
    worst = by.groupBy(*(scope or [])).agg(F.max(F.struct("rank", "n")).alias("w"), F.sum(F.when(F.col("rank") >= least, F.col("n")).otherwise(0)).alias("at_or_above"))
    names = {v: k for k, v in vocab.SEVERITIES.items()}
    return worst.select(
        *(scope or []), vocab.choose(F.col("w.rank"), names, "INFO").alias("worst"), F.col("w.n").alias("n_worst"), "at_or_above",
        F.when(F.col("at_or_above") > 0, 1).otherwise(0).alias("exit_code"),
    )


def with_triage(rows: DataFrame, triage: DataFrame) -> DataFrame:
    """Analyst's states joined in by fingerprint."""
    t = triage.select("fingerprint", F.col("status").alias("triage_status"), F.col("note").alias("triage_note"))
    return rows.join(t, "fingerprint", "left").withColumn("triage_fp", F.col("fingerprint"))


def upsert_triage(triage: DataFrame, changes: DataFrame) -> DataFrame:
    """The triage table after changes (fingerprint, status, note, updated_at):
    later ones win, unknown states are refused, notes are cut at 500."""
    good = changes.filter(F.col("status").isin(*vocab.STATUSES)).withColumn("note", F.substring("note", 1, 500))
    newest = last_of(good, ["fingerprint"], "updated_at").select("fingerprint", "status", "note", "updated_at")
    kept = triage.join(newest.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "status", "note", "updated_at")
    return kept.unionByName(newest)


def clear_triage(triage: DataFrame, cleared: DataFrame) -> DataFrame:
    """Decisions without those whose fingerprint is in `cleared`, trimmed."""
    gone = cleared.select(F.trim("fingerprint").alias("fingerprint")).distinct()
    return triage.join(gone, "fingerprint", "left_anti").select("fingerprint", "status", "note", "updated_at")


def newest(scans: DataFrame, limit: int) -> DataFrame:
    return scans.orderBy(F.desc("scan_id")).limit(max(1, min(200, limit)))


def retained(scans: DataFrame, keep: int = 200) -> DataFrame:
    """The newest max(10, keep) scans of all."""
    return scans.join(scans.select("scan_id").orderBy(F.desc("scan_id")).limit(max(10, keep)), "scan_id", "left_semi")


def storage_stats(scans: DataFrame) -> DataFrame:
    size = F.octet_length(F.coalesce("report_json", F.lit("")))
    return scans.agg(F.count("*").alias("scans"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.sum(size).alias("report_bytes"))
