"""From documents to findings, risk and inventories: the whole batch plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import dependencies, detectors, findings, history, offsets, risk, runtime, scripts, surface, taint
from skein.sources import documents as sources
from skein.sources import source_maps

# Profiles of a scan (depth, seconds, files).
PROFILES = {"balanced": (5, 15, 50), "strict": (7, 20, 100), "fast": (3, 10, 25)}


@dataclass(frozen=True)
class Analysis:
    """Lazy tables of one analysis; nothing runs until one of them is used. The
    documents that are kept are then stored once for all tables, on the
    executors (a lost one's are computed again), until release()."""

    documents: DataFrame
    findings: DataFrame
    inventory: DataFrame
    endpoints: DataFrame
    dependencies: DataFrame
    #: Counts of browser evidence (runtime.counts), if there is any.
    evidence: DataFrame | None = None

    def runtime_findings(self) -> DataFrame:
        """What the browser evidence shows, normalized; none without evidence."""
        if self.evidence is None:
            return findings.normalize(self.findings.limit(0))
        return findings.normalize(runtime.findings(self.evidence))

    def file_risk(self) -> DataFrame:
        return risk.overall(self.findings, ["doc_id"])

    def overall(self) -> DataFrame:
        scope = ["scan_id"]
        one = lambda df: df.withColumn("scan_id", F.lit(1))
        third = one(self.inventory).withColumn("ordinal", F.col("doc_id"))
        every = one(self.findings).withColumn("ordinal", F.col("doc_id") * 1000 + F.row_number().over(_by_doc()))
        if self.evidence is None:
            return risk.overall(every, scope, third)
        seen = self.runtime_findings().withColumns({"scan_id": F.lit(1), "ordinal": F.col("ordinal") + (1 << 40)})
        return risk.overall(every.unionByName(seen, allowMissingColumns=True), scope, third, self.evidence.withColumn("scan_id", F.lit(1)))

    def release(self) -> None:
        self.documents.unpersist()

    def rows(self) -> DataFrame:
        return history.finding_rows(self.findings.withColumn("scan_id", F.lit(1).cast("long")))


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("ordinal")


def analyze(documents: DataFrame, page_url: str = "", evidence: DataFrame | None = None) -> Analysis:
    """Documents (doc_id, ordinal, name, url, content) to an Analysis;
    `evidence` (scan_id, evidence as JSON) is what a browser saw of the page.

    Oversized documents and copies of earlier ones are left out; original
    sources behind inline maps are scanned for flows like documents; flows,
    framework rules and signals are correlated for each document."""
    kept = sources.spread(sources.first_copies(sources.sized(documents).filter("skip_reason IS NULL").drop("skip_reason"))).persist()
    named = kept.select("doc_id", F.col("name").alias("file"))
    mapped = source_maps.originals(kept).select("doc_id", "content", F.lit("source_map").alias("via"))
    every = kept.select("doc_id", "content")
    flows = taint.flows(every).unionByName(taint.flows(mapped.select("doc_id", "content")).withColumn("ordinal", F.col("ordinal") + (1 << 20)))
    weak = detectors.signals(every).unionByName(dependencies.vulnerable_dependencies(every), allowMissingColumns=True)
    inventory = scripts.inventory(kept, page_url)
    behaviour = scripts.exfiltration(inventory).withColumn("ordinal", F.lit(1 << 30).cast("long"))
    strong = flows.unionByName(behaviour.drop("file"), allowMissingColumns=True)
    found = findings.correlate(strong.join(named, "doc_id"), offsets.framework_findings(every).join(named, "doc_id"), weak.join(named, "doc_id"))
    return Analysis(kept, found, inventory, surface.endpoints(every), dependencies.dependency_scan(every), None if evidence is None else runtime.counts(evidence))


def analyze_content(spark: SparkSession, code: str, name: str = "inline.js") -> Analysis:
    return analyze(sources.inline(spark, [(name, code)]))


def analyze_folder(spark: SparkSession, path: str | list[str]) -> Analysis:
    return analyze(sources.folder(spark, path))
