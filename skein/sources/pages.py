"""Web pages as a source: scripts, links, metadata, sitemaps, crawl replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.detectors import Text, module_references
from skein.sources import frontier

# What marks script elements and links in HTML.
SCRIPT = r"(?is)<script([^>]*)>(.*?)</script\s*>"
SRC = r"""(?is)\bsrc\s*=\s*["']?([^"'\s>]+)"""
LINK = r"""(?is)<link\b([^>]*)>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
SITEMAP = r"(?im)^\s*sitemap:\s*(\S+)"


def resolve(base: Column, ref: Column) -> Column:
    """A reference against its page: absolute, scheme-relative, rooted or
    relative; ./ and ../ are folded once per step."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), ref)
    path = F.aggregate(
        F.split(joined, "/"),
        F.expr("cast(array() as array<string>)"),
        lambda acc, part: F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(part == ".", acc).otherwise(F.concat(acc, F.array(part))),
    )
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .otherwise(F.concat(origin, F.array_join(path, "/")))
    )


def script_elements(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, src (null for inline), body (null for external)."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)).alias("attrs"), F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(2)).alias("body"))
    rows = pages.select("page_id", "url", F.posexplode(both).alias("ordinal", "s"))
    src = F.nullif(F.regexp_extract("s.attrs", SRC, 1), F.lit(""))
    body = F.nullif(F.trim("s.body"), F.lit(""))
    return rows.select("page_id", "url", "ordinal", resolve(F.col("url"), src).alias("src"), F.when(src.isNull(), body).alias("body")).filter("src IS NOT NULL OR body IS NOT NULL")


#: Script references in inline code: imports, bundler hints, absolute addresses.
INLINE_REFS = (
    r"""(?:import\s*\(\s*|from\s+|import\s+)["']([^"']+\.m?js(?:\?[^"']*)?)["']""",
    r"""(?:importScripts|__webpack_require__\.e|System\.import)\s*\(\s*["']([^"']+)["']""",
    r"""["'](https?://[^"'\s]+\.m?js(?:\?[^"']*)?)["']""",
    r"""["']((?:\.{0,2}/)?(?:static|assets|_next|dist|build|chunks?)/[^"'\s]+\.m?js)["']""",
)


def inline_references(pages: DataFrame) -> DataFrame:
    """page_id, src: scripts that inline code imports, names as bundler chunks
    or addresses absolutely; each once a page."""
    bodies = script_elements(pages).filter("body IS NOT NULL")
    found = F.array_distinct(F.concat(*[X.find_some(F.col("body"), F.lower("body"), p, 1) for p in INLINE_REFS]))
    each = bodies.select("page_id", "url", F.explode(found).alias("ref"))
    return each.select("page_id", resolve(F.col("url"), F.col("ref")).alias("src")).distinct()


def script_assets(pages: DataFrame) -> DataFrame:
    """page_id, src, via: every script a page refers to, each once, by the
    first of: element, preload, inline."""
    parts = [
        script_elements(pages).filter("src IS NOT NULL").select("page_id", "src", F.lit(0).alias("rank")),
        preloaded_scripts(pages).select("page_id", "src", F.lit(1).alias("rank")),
        inline_references(pages).select("page_id", "src", F.lit(2).alias("rank")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("page_id", "src").agg(F.min("rank").alias("rank"))
    return every.select("page_id", "src", F.element_at(F.array(F.lit("element"), F.lit("preload"), F.lit("inline")), F.col("rank") + 1).alias("via"))


def preloaded_scripts(pages: DataFrame) -> DataFrame:
    """page_id, src: modulepreload, prefetch and script preload links."""
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("a"))
    rel = F.lower(F.regexp_extract("a", r"""(?is)\brel\s*=\s*["']?([^"'\s>]+)""", 1))
    kind = F.lower(F.regexp_extract("a", r"""(?is)\bas\s*=\s*["']?([^"'\s>]+)""", 1))
    wanted = rel.isin("modulepreload", "prefetch") | ((rel == "preload") & (kind == "script"))
    href = F.regexp_extract("a", HREF, 1)
    return links.filter(wanted & (href != "")).select("page_id", resolve(F.col("url"), href).alias("src")).distinct()


def documents(pages: DataFrame) -> DataFrame:
    """Inline scripts as documents: doc_id, ordinal, name, url, content."""
    inline = script_elements(pages).filter("body IS NOT NULL")
    name = F.concat(F.lit("inline-"), F.col("page_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string"), F.lit(".js"))
    return inline.select((F.col("page_id") * 1000 + F.col("ordinal")).alias("doc_id"), (F.col("page_id") * 1000 + F.col("ordinal")).alias("ordinal"), name.alias("name"), F.col("url"), F.col("body").alias("content"))


def page_metadata(pages: DataFrame) -> DataFrame:
    inline = script_elements(pages).groupBy("page_id").agg(F.count("body").alias("inline_count"), F.count("src").alias("external_count"))
    return pages.select("page_id", F.octet_length("html").cast("long").alias("page_bytes")).join(inline, "page_id", "left").fillna(0, ["inline_count", "external_count"])


def sitemap_pages(sitemaps: DataFrame, limit: int = 10) -> DataFrame:
    """base, page: pages that sitemaps (base, ordinal, body) list on the base's
    own host, no assets, the first `limit` of each base."""
    rows = sitemaps.select("base", "ordinal", F.posexplode(F.regexp_extract_all("body", F.lit(LOC), F.lit(1))).alias("pos", "page"))
    same = (X.url_host(F.col("page")) == X.url_host(F.col("base"))) & ~X.canonical_url(F.col("page")).rlike(r"(?i)\.(?:js|css|png|jpe?g|gif|svg|ico|xml|json|pdf|zip|woff2?)$")
    first = rows.filter(same).groupBy("base", "page").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("at"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= limit).select("base", "page", "nth")


def robots_sitemaps(robots: DataFrame, limit: int = 3) -> DataFrame:
    found = F.slice(F.array_distinct(F.regexp_extract_all("body", F.lit(SITEMAP), F.lit(1))), 1, limit)
    return robots.select("base", F.posexplode(found).alias("ordinal", "sitemap"))


def soft_404(content: Column) -> Column:
    """HTML where a script was expected, wherever in the text it begins."""
    low = F.lower(content)
    return low.contains("<html") | low.contains("<!doctype")


def script_links(scripts: DataFrame) -> DataFrame:
    """url, ordinal, target: what scripts (url, content) refer to, in order;
    queries and fragments do not tell scripts apart."""
    refs = scripts.select("url", F.posexplode(module_references(Text(F.col("content"), F.lower("content")))).alias("ordinal", "ref"))
    return refs.select("url", "ordinal", F.regexp_replace(resolve(F.col("url"), F.col("ref")), r"[?#].*$", "").alias("target"))


def followed(scripts: DataFrame, seeds: DataFrame, max_depth: int = 5, max_files: int = 1000) -> DataFrame:
    """url, depth of the scripts (url, content) that references reach from
    `seeds` (url) in at most `max_depth` steps, in order of arrival up to
    `max_files` (frontier.crawl, which also tells what was left out and why)."""
    started = seeds.select("url", F.lit(0).alias("ordinal"))
    met = frontier.crawl(script_links(scripts), scripts, started, max_depth=max_depth, per_host=max_files, total=max_files)
    return met.filter(F.col("outcome") == frontier.VISITED).select("url", "depth")
