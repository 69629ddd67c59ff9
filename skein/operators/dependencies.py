"""Libraries of a document, their versions, and advisories that apply."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import patterns as P
from skein.functions import text as X
from skein.operators.detectors import imports, with_text


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(P.ADVISORIES)], "nth int, library string, ranges string, severity string, cve string, summary string")


def dependency_scan(documents: DataFrame, cap: int = 40) -> DataFrame:
    """doc_id, source, name, kind, evidence, ordinal: imported packages first,
    then bundle markers of frameworks, libraries and crypto, then aliases. Each
    source once, as it is first seen; all within the document's row."""
    base, text = with_text(documents)
    entry = lambda source, how: F.struct(source.alias("source"), F.lit(how).alias("how"))
    marked = [F.when(text.holds(k), entry(F.lit(k), "bundle marker")) for k, _, kind in P.PACKAGES if kind in ("framework", "library", "crypto")]
    hinted = []
    for k, hints in P.ALIASES:
        seen = reduce(or_, [text.holds(h) for h in hints])
        hinted.append(F.when(seen | text.content.rlike(P.JQUERY_CHAIN) if k == "jquery" else seen, entry(F.lit(k), "bundle alias")))
    every = F.concat(F.transform(imports(text), lambda s: entry(s, "import")), F.array_compact(F.array(*marked)), F.array_compact(F.array(*hinted)))
    rows = base.select("doc_id", every.alias("every"))
    sources = F.slice(F.array_distinct(F.transform("every", lambda e: e["source"])), 1, cap)
    first = F.transform(sources, lambda s: F.struct(s.alias("source"), F.element_at(F.filter("every", lambda e: e["source"] == s), 1)["how"].alias("how")))
    each = rows.select("doc_id", F.posexplode(first).alias("ordinal", "d")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "d.*")
    name = F.create_map(*[F.lit(x) for k, n, _ in P.PACKAGES for x in (k, n)])[F.col("source")]
    kind = F.create_map(*[F.lit(x) for k, _, kind in P.PACKAGES for x in (k, kind)])[F.col("source")]
    how = F.when(F.col("how") == "import", F.concat(F.lit("import/require "), "source")).otherwise(F.col("how"))
    return each.select("doc_id", "ordinal", "source", F.coalesce(name, "source").alias("name"), F.coalesce(kind, F.lit("node/npm")).alias("kind"), how.alias("evidence"))


def library_versions(content: Column) -> Column:
    """array<struct<library, version>>: the first banner of each library."""
    first: dict[str, Column] = {}
    for library, pattern in P.VERSIONS:
        test = X.may_match(F.lower(content), [pattern])
        found = F.when(F.lit(True) if test is None else test, F.nullif(F.regexp_extract(content, pattern, 1), F.lit("")))
        first[library] = F.coalesce(first[library], found) if library in first else found
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("library"), v.alias("version"))) for k, v in first.items()]))


def vulnerable_dependencies(documents: DataFrame) -> DataFrame:
    """Findings for libraries of the dependency scan whose version lies in an
    advisory's range."""
    spark = documents.sparkSession
    deps = dependency_scan(documents).select("doc_id", "ordinal", F.lower("source").alias("library"), "name")
    versions = documents.select("doc_id", F.explode(library_versions(F.col("content"))).alias("v")).select("doc_id", "v.library", "v.version")
    hit = deps.join(versions, ["doc_id", "library"]).join(F.broadcast(advisories(spark)), "library")
    hit = hit.filter(X.version_in(F.col("version"), F.col("ranges")))
    title = F.concat(F.lit("Vulnerable library: "), F.col("name"), F.lit(" "), F.col("version"), F.lit(" ("), F.col("cve"), F.lit(")"))
    return hit.select(
        "doc_id", F.concat(F.lit("vulnerable_dependency:"), "library").alias("id"), "severity", title.alias("title"),
        F.array(F.concat("name", F.lit(" "), "version", F.lit(": "), "summary")).alias("evidence_list"),
        F.lit("medium").alias("confidence"), F.lit("version_fingerprint").alias("evidence_type"), F.lit(False).alias("observation"),
        "cve", "library", "version", (F.col("ordinal") * 100 + F.col("nth")).cast("long").alias("ordinal"),
    )
