"""Tables of the data directory in the shapes that the operators read.

Each view has a DataFrame form and the same rule as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import documents as sources
from skein.sources.tables import table

#: events as findings: our own fixed mapping.
FINDINGS_SQL = """
  SELECT event_id AS ordinal, CAST(extract(day FROM ts) AS BIGINT) AS scan_id, event_type AS id,
    CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'signup' THEN 'LOW' WHEN 'click' THEN 'LOW' ELSE 'INFO' END AS severity,
    CASE WHEN value < 5 THEN 'low' WHEN value < 40 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'confirmed' END AS confidence,
    CASE WHEN event_type = 'error' AND value >= 40 THEN 'source_to_sink' WHEN event_type = 'purchase' THEN 'behavioral_correlation' WHEN event_type = 'signup' THEN 'runtime_browser' ELSE 'static_pattern' END AS evidence_type,
    'user' || CAST(user_id % 20 AS VARCHAR) AS file,
    CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS line,
    'source' || CAST(user_id % 3 AS VARCHAR) AS source,
    'sink' || CAST(event_id % 4 AS VARCHAR) AS sink,
    event_type = 'view' AS observation
  FROM events
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return e.select(
        F.col("event_id").alias("ordinal"),
        F.dayofmonth("ts").cast("long").alias("scan_id"),
        kind.alias("id"),
        F.when(kind == "error", "HIGH").when(kind == "purchase", "MEDIUM").when(kind.isin("signup", "click"), "LOW").otherwise("INFO").alias("severity"),
        F.when(value < 5, "low").when(value < 40, "medium").when(value < 150, "high").otherwise("confirmed").alias("confidence"),
        F.when((kind == "error") & (value >= 40), "source_to_sink").when(kind == "purchase", "behavioral_correlation").when(kind == "signup", "runtime_browser").otherwise("static_pattern").alias("evidence_type"),
        text("user", F.col("user_id") % 20).alias("file"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("line"),
        text("source", F.col("user_id") % 3).alias("source"),
        text("sink", F.col("event_id") % 4).alias("sink"),
        (kind == "view").alias("observation"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".js")).alias("name"), F.lit(None).cast("string").alias("url"), F.col("text").alias("content"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread for work on their texts."""
    return sources.spread(documents(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as third-party script scores: scope, party, score, reads, externals."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.dayofmonth("ts").cast("long").alias("scan_id"), F.col("event_id").alias("ordinal"),
        F.when(F.col("user_id") % 3 == 0, "third_party").otherwise("first_party").alias("party"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("score"),
        (F.col("event_id") % 3).cast("int").alias("n_reads"), (F.col("event_id") % 2).cast("int").alias("n_external"),
    )


SCRIPTS_SQL = """
  SELECT CAST(extract(day FROM ts) AS BIGINT) AS scan_id, event_id AS ordinal,
    CASE WHEN user_id % 3 = 0 THEN 'third_party' ELSE 'first_party' END AS party,
    CAST(least(100, floor(value)) AS INTEGER) AS score, event_id % 3 AS n_reads, event_id % 2 AS n_external
  FROM events
"""
