"""Attack surface: calls, routes, literals, and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import patterns as P
from skein.functions import text as X


def internal(url: Column) -> Column:
    """Whether a URL's text hints at an internal place."""
    low = F.lower(url)
    out = F.lit(False)
    for hint in P.INTERNAL:
        out = out | low.contains(hint)
    return out


def _calls(content: Column) -> Column:
    """array<struct<kind, method, url>> of request calls by pattern."""
    parts = []
    for kind, pattern, method, url in P.CALLS:
        urls = X.find_some(content, F.lower(content), pattern, url)
        if isinstance(method, int):
            methods = F.transform(X.find_some(content, F.lower(content), pattern, method), lambda m: F.upper(m))
        else:
            methods = F.transform(urls, _constant(method or None))
        parts.append(F.zip_with(methods, urls, _call(kind)))
    return F.concat(*parts)


def _constant(value: str | None):
    return lambda _: F.lit(value).cast("string")


def _call(kind: str):
    return lambda m, u: F.struct(F.lit(kind).alias("kind"), m.alias("method"), u.alias("url"))


def calls(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, method, url, internal: request calls by pattern."""
    rows = documents.select("doc_id", F.posexplode(_calls(F.col("content"))).alias("ordinal", "c")).select("doc_id", "ordinal", "c.*")
    return rows.withColumn("internal", internal(F.col("url")))


def _url_literals(content: Column) -> Column:
    return F.array_distinct(F.filter(X.find_all(content, P.URL_LITERAL, 1), lambda u: ~X.canonical_url(u).rlike(P.ASSET)))


def url_literals(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, url: quoted absolute or root-relative URLs that are no assets."""
    return documents.select("doc_id", F.posexplode(_url_literals(F.col("content"))).alias("ordinal", "url"))


def endpoints(documents: DataFrame, cap: int = 120) -> DataFrame:
    """Calls, then URL literals that no call names, each (url, method) once;
    the first `cap` of a document. All within the document's row: nothing is
    shuffled."""
    rows = documents.select("doc_id", F.filter(_calls(F.col("content")), lambda c: c["kind"] == "endpoint").alias("called"), _url_literals(F.col("content")).alias("literals"))
    named = F.transform("called", lambda c: F.struct(c["method"].alias("method"), c["url"].alias("url")))
    unseen = F.array_except("literals", F.transform("called", lambda c: c["url"]))
    points = F.array_distinct(F.concat(named, F.transform(unseen, lambda u: F.struct(F.lit("GET").alias("method"), u.alias("url")))))
    each = rows.select("doc_id", F.posexplode(F.slice(points, 1, cap)).alias("ordinal", "p"))
    return each.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "p.method", "p.url", internal(F.col("p.url")).alias("internal"))


def query_parameters(url: Column) -> Column:
    """map<name, sorted distinct values> of a query string; repeated names are
    joined, empty values kept."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+"))
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.regexp_extract(p, "^[^=]*=?(.*)$", 1)
    names = F.array_distinct(F.transform(pairs, name))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: name(p) == n), value)))))


def rollup(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sorted distinct domains, methods and parameter names of endpoints."""
    named = points.withColumn("names", F.map_keys(query_parameters(F.col("url")))).withColumn("host", F.nullif(X.url_host(F.col("url")), F.lit("")))
    return named.groupBy(*(by or [])).agg(
        F.array_sort(F.collect_set("host")).alias("domains"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("parameters"),
        F.count("*").alias("endpoints"),
        F.count_if(F.col("internal")).alias("internal"),
    )


def openapi_paths(points: DataFrame, cap: int = 300) -> DataFrame:
    """path, method, host, parameters: the first endpoint of each (path, method)."""
    path = F.regexp_replace(X.canonical_url(F.col("url")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*", "")
    rows = points.withColumns({"path": F.when(path == "", "/").otherwise(path), "method": F.lower(F.coalesce("method", F.lit("GET"))), "host": X.url_host(F.col("url")), "parameters": F.map_keys(query_parameters(F.col("url")))})
    first = rows.groupBy("path", "method").agg(F.min_by(F.struct("host", "parameters"), F.struct("doc_id", "ordinal")).alias("f"))
    return first.select("path", "method", "f.host", "f.parameters").orderBy("path", "method").limit(cap)
