"""Which known script a module reference means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.sources import frontier
from skein.sources.pages import resolve


def site_of(url: Column) -> Column:
    """The last two labels of an address's host: scripts of other sites are
    never taken for a reference's, as many sites have an app.js."""
    return F.substring_index(X.url_host(url), ".", -2)


def plain_address(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def path_suffixes(url: Column) -> Column:
    """The last segment of an address's path, the last two, and so on."""
    path = F.regexp_replace(plain_address(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    n = F.size(parts)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    return F.transform(places, lambda i: F.array_join(F.slice(parts, n - i + 1, i), "/"))


def resolved_references(references: DataFrame, scripts: DataFrame) -> DataFrame:
    """Adds target, via and segments to `references` (url, ordinal, ref): the
    script of `scripts` (url) that each means, in this order: `exact`, the
    address that it gives on its page; `extension`, the same with .js; or
    `suffix`, the script of the same site whose path shares most of its last
    segments, `segments` of them. Of equally good ones the smallest address is
    meant. What means no script has null; null references mean none; repeated
    rows each keep theirs.

    Scripts are summed up by (site, suffix) first, so that a reference meets
    one row for each of its own suffixes, however many scripts share a name.
    """
    keyed = references.withColumn("__row", F.monotonically_increasing_id()).withColumn("__at", plain_address(resolve(F.col("url"), F.col("ref"))))
    known = scripts.select(F.col("url").alias("target")).filter("target IS NOT NULL").distinct()
    exact = known.groupBy(plain_address(F.col("target")).alias("__at")).agg(F.min("target").alias("exact"))
    both = keyed.join(exact, "__at", "left").join(exact.withColumnRenamed("__at", "__js").withColumnRenamed("exact", "extended"), F.concat("__at", F.lit(".js")) == F.col("__js"), "left")
    ends = known.select(site_of(F.col("target")).alias("__site"), "target", F.explode(path_suffixes(F.col("target"))).alias("__suffix"))
    ends = ends.groupBy("__site", "__suffix").agg(F.min("target").alias("target"))
    absolute = F.col("ref").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    site = site_of(F.when(absolute, F.col("__at")).otherwise(F.col("url")))
    open_ = both.filter("exact IS NULL AND extended IS NULL").select("__row", site.alias("__site"), F.posexplode(path_suffixes(F.col("ref"))).alias("pos", "__suffix"))
    best = open_.join(ends, ["__site", "__suffix"]).groupBy("__row").agg(F.max_by(F.struct("target", (F.col("pos") + 1).alias("n")), "pos").alias("best"))
    out = both.join(best, "__row", "left")
    via = F.when(F.col("exact").isNotNull(), "exact").when(F.col("extended").isNotNull(), "extension").when(F.col("best").isNotNull(), "suffix")
    target = F.coalesce("exact", "extended", "best.target")
    return out.select(*references.columns, target.alias("target"), via.alias("via"), F.col("best.n").alias("segments"))


def reachable(references: DataFrame, scripts: DataFrame, seeds: DataFrame, **limits: int) -> DataFrame:
    """frontier.crawl over what the references mean."""
    links = resolved_references(references, scripts).filter("target IS NOT NULL").select("url", "ordinal", "target")
    return frontier.crawl(links, scripts, seeds, **limits)


def first_chunks(imports: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, nth, chunk: the first different chunk files that a document's
    imports (doc_id, ordinal, path) name."""
    chunk = F.regexp_extract("path", r"(chunk-[A-Za-z0-9]+\.js)", 1)
    first = imports.select("doc_id", "ordinal", chunk.alias("chunk")).filter("chunk <> ''").groupBy("doc_id", "chunk").agg(F.min("ordinal").alias("ordinal"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "chunk"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= most).select("doc_id", "nth", "chunk")
