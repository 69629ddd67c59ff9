"""Scan history in a folder of Parquet: one part a scan, nothing rewritten."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import history

SCANS = (
    "scan_id long, created_at double, target string, mode string, duration_ms long, files_total long, bytes_total long, findings_total long, "
    "previous_id long, new long, resolved long, unchanged long, report_json string, report_stored boolean"
)
ROWS = "scan_id long, fingerprint string, finding_id string, severity string, confidence string, title string, file string, detail string, observation boolean, ordinal long"
#: Reports beyond so many bytes are not kept.
LARGEST_REPORT = 16_000_000


class HistoryStore:
    """Scans and their finding rows under `path`. A scan is written as parts of
    its own and deleted with them. Its number is claimed by creating a file,
    which only one of several writers can; its row is written last, and rows of
    scans without one, left by a writer that stopped, are not seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, at = self._fs(f"{self.path}/{name}")
        if not fs.exists(at) or not list(fs.listStatus(at)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def scans(self) -> DataFrame:
        return self._table("scans", SCANS)

    def rows(self) -> DataFrame:
        """Rows of recorded scans."""
        return self._table("rows", ROWS).join(self.scans().select("scan_id"), "scan_id", "left_semi")

    def _claimed(self, last: int) -> int:
        """The first number after `last` that no writer has taken."""
        while True:
            last += 1
            fs, at = self._fs(f"{self.path}/claims/{last}")
            if fs.createNewFile(at):
                return last

    def record(self, findings: DataFrame, *, target: str, created_at: float, mode: str = "url", duration_ms: int | None = None, files: int = 0, size: int = 0, report: str = "", keep: int = 200) -> dict:
        """Writes a scan and its difference to the last one of its target, and
        drops what retention leaves behind. Returns the scan's summary."""
        known = self.scans()
        last = known.agg(F.max("scan_id")).first()[0] or 0
        previous = known.filter(F.col("target") == target).agg(F.max("scan_id")).first()[0]
        scan_id = self._claimed(last)
        mine = history.finding_rows(findings.withColumn("scan_id", F.lit(scan_id).cast("long")))
        mine.select(*[c.split()[0] for c in ROWS.split(", ")]).write.parquet(f"{self.path}/rows/scan_id={scan_id}")
        mine = self.spark.read.schema(ROWS).parquet(f"{self.path}/rows/scan_id={scan_id}")
        before = self.rows().filter(F.col("scan_id") == (previous or -1))
        diff = history.set_diff(mine, before).first()
        stored = len(report.encode()) <= LARGEST_REPORT
        row = (scan_id, float(created_at), target, mode, duration_ms, files, size, mine.count(), previous, diff["new"], diff["resolved"], diff["unchanged"], report if stored else "", stored)
        self.spark.createDataFrame([row], SCANS).coalesce(1).write.parquet(f"{self.path}/scans/scan_id={scan_id}")
        self.prune(keep)
        return {"scan_id": scan_id, "previous_id": previous, "new": diff["new"], "resolved": diff["resolved"], "unchanged": diff["unchanged"]}

    def get(self, scan_id: int, report: bool = False) -> dict | None:
        found = self.scans().filter(F.col("scan_id") == scan_id)
        row = (found if report else found.drop("report_json")).first()
        return row.asDict() if row else None

    def delete(self, scan_id: int) -> bool:
        gone = False
        for name in ("scans", "rows"):
            fs, at = self._fs(f"{self.path}/{name}/scan_id={scan_id}")
            gone = bool(fs.delete(at, True)) or gone
        return gone

    def prune(self, keep: int = 200) -> int:
        """Keeps the newest max(10, keep) scans."""
        ids = sorted((r[0] for r in self.scans().select("scan_id").collect()), reverse=True)
        return sum(self.delete(i) for i in ids[max(10, keep) :])

    def wipe(self) -> dict:
        counts = {"deleted_scans": self.scans().count(), "deleted_findings": self.rows().count()}
        fs, at = self._fs(self.path)
        fs.delete(at, True)
        return counts

    def export(self, path: str, reports: bool = False) -> None:
        """All scans with their rows as JSON lines, one scan a line."""
        scans = self.scans() if reports else self.scans().drop("report_json")
        rows = self.rows().groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c.split()[0] for c in ROWS.split(", ")[1:-1]]))).alias("findings"))
        scans.join(rows, "scan_id", "left").orderBy("scan_id").write.mode("overwrite").json(path)

    def newest(self, limit: int = 50) -> list[dict]:
        return [json.loads(r) for r in history.newest(self.scans().drop("report_json"), limit).toJSON().collect()]
