"""Source maps as a source of further documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X

MAX_SOURCES, SCANNED, PER_SOURCE, TOTAL = 120, 12, 400_000, 3_000_000
INLINE = r"sourceMappingURL\s*=\s*data:application/json[^,]*;base64,([A-Za-z0-9+/=]+)"
MAP = "STRUCT<version: INT, sources: ARRAY<STRING>, sourcesContent: ARRAY<STRING>, sourceRoot: STRING>"


def clean_name(name: Column) -> Column:
    """Without loader prefixes, pseudo schemes, queries and leading dots."""
    out = F.regexp_replace(name, r"^.*!", "")
    out = F.regexp_replace(out, r"^[a-z][a-z0-9+.-]*:/*", "")
    return F.regexp_replace(F.regexp_replace(out, r"[?#].*$", ""), r"^(?:\.{0,2}/)+", "")


def inline_maps(documents: DataFrame) -> DataFrame:
    """doc_id, map (parsed) of documents with an inline map that can be read."""
    code = F.element_at(X.find_all(F.col("content"), INLINE, 1), -1)
    json = F.try_validate_utf8(F.try_to_binary(code, F.lit("base64")).cast("string"))
    return documents.filter(F.col("content").contains("sourceMappingURL")).filter(F.size(X.find_all(F.col("content"), INLINE, 1)) > 0).select("doc_id", F.from_json(json, MAP).alias("map")).filter("map IS NOT NULL")


def originals(documents: DataFrame) -> DataFrame:
    """doc_id, pos, name, content of the original sources behind each bundle.

    Sources that equal the bundle are left out; at most SCANNED sources and
    PER_SOURCE characters each; the running total stops at the first source
    that would pass TOTAL."""
    maps = inline_maps(documents)
    pairs = F.slice(F.arrays_zip(F.col("map.sources").alias("name"), F.col("map.sourcesContent").alias("content")), 1, MAX_SOURCES)
    rows = maps.select("doc_id", F.posexplode(pairs).alias("pos", "s")).select("doc_id", "pos", clean_name(F.col("s.name")).alias("name"), F.col("s.content").alias("content"))
    rows = rows.filter(F.coalesce(F.trim("content"), F.lit("")) != "").filter(F.length("content") <= PER_SOURCE)
    bundle = documents.select("doc_id", F.sha2("content", 256).alias("hash"))
    rows = rows.withColumn("hash", F.sha2("content", 256)).join(bundle, ["doc_id", "hash"], "left_anti")
    first = rows.groupBy("doc_id", "hash").agg(F.min("pos").alias("pos"))
    rows = rows.join(first, ["doc_id", "hash", "pos"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"total": F.sum(F.length("content")).over(order), "nth": F.count("*").over(order)})
    return rows.filter((F.col("total") <= TOTAL) & (F.col("nth") <= SCANNED)).select("doc_id", "pos", "name", "content").withColumn("via", F.lit("source_map"))
