"""Script inventory: parties, capabilities, destinations, loaders and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import detectors, surface

# What tells a browser capability, and sensitive reads.
CAPABILITIES = (
    ("camera_microphone", ("getusermedia", "mediadevices")), ("geolocation", ("geolocation",)), ("clipboard", ("clipboard", "execcommand('copy')")),
    ("notifications", ("notification.requestpermission", "new notification")), ("storage", ("localstorage", "sessionstorage", "document.cookie", ".cookie")),
    ("indexeddb", ("indexeddb",)), ("service_worker", ("serviceworker", "service_worker")), ("websocket", ("websocket",)), ("post_message", ("postmessage",)),
    ("dynamic_code", ("eval(", "new function", 'settimeout("', 'setinterval("')), ("dom_access", ("innerhtml", "insertadjacenthtml", "outerhtml", "document.write")),
    ("network", ("fetch(", "axios", "xmlhttprequest", "sendbeacon", "websocket")),
)
READS = (("cookies", ("cookie",)), ("browser_storage", ("localstorage", "sessionstorage")), ("url_parameters", ("location.search", "urlsearchparams")), ("form_input", (".value", "formdata")), ("referrer", ("document.referrer",)))


def party(url: Column, page_url: Column) -> Column:
    """inline, file, first_party (same host or below it), third_party or unknown."""
    host, page = X.url_host(url), X.url_host(page_url)
    absolute = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "inline")
        .when(url.startswith("file://"), "file")
        .when(host == "", "inline")
        .when(F.coalesce(page, F.lit("")) == "", F.when(absolute, "third_party").otherwise("unknown"))
        .when((host == page) | host.endswith(F.concat(F.lit("."), page)), "first_party")
        .otherwise("third_party")
    )


def load_method(name: Column, url: Column) -> Column:
    """How a script came into its page. The url of an inline script is that of
    its page, so its name decides first."""
    named = F.coalesce(name, F.lit(""))
    return (
        F.when(named.rlike("^(?:runtime|url)://"), "runtime_dynamic")
        .when(named.rlike(r"^inline(?:-[0-9]+)*(?:\.js)?$"), "inline")
        .when((named == "") | (F.coalesce(url, F.lit("")) != ""), "external")
        .when(named.isin("inline.js", "inline"), "inline")
        .when(named.contains("chunk-"), "dynamic_import")
        .when(named.contains("://"), "external")
        .otherwise("inline")
    )


def _found(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _named(low: Column, table: tuple) -> Column:
    return F.array_compact(F.array(*[F.when(_found(low, words), F.lit(name)) for name, words in table]))


def script_party(name: Column, url: Column, page_url: str) -> Column:
    """The party of a script: that of its URL; a script of a page whose own URL
    is not known belongs to the page, an inline one is inline."""
    inline = F.coalesce(name, F.lit("")).startswith("inline")
    by_url = party(F.when(~inline, url), F.lit(page_url))
    known = F.coalesce(F.nullif(url, F.lit("")), name).rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(~inline & ~known, "first_party").otherwise(by_url) if page_url else by_url


def inventory(documents: DataFrame, page_url: str = "", runtime: DataFrame | None = None) -> DataFrame:
    """One row for each document (doc_id, name, url, content): party, load
    method, hash, capabilities, sensitive reads, destinations, risk score.
    `runtime` (doc_id, n_requests, n_eval) adds what a browser saw of a script."""
    low = F.lower("content")
    base = documents.select(
        "doc_id", "name", "url", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("bytes"),
        load_method(F.col("name"), F.col("url")).alias("load_method"), script_party(F.col("name"), F.col("url"), page_url).alias("party"),
        _named(low, CAPABILITIES).alias("capabilities"), _named(low, READS).alias("reads"),
        detectors.imports(detectors.Text(F.col("content"), F.lower("content"))).alias("imports"),
    )
    hosts = surface.endpoints(documents).withColumn("host", X.url_host(F.col("url"))).filter("host <> ''")
    to = hosts.groupBy("doc_id").agg(F.array_sort(F.collect_set("host")).alias("destinations"))
    joined = base.join(to, "doc_id", "left").withColumn("destinations", F.coalesce("destinations", F.expr("cast(array() as array<string>)")))
    own = X.url_host(F.lit(page_url))
    joined = joined.withColumn("external_destinations", F.filter("destinations", lambda h: (own == "") | ((h != own) & ~h.endswith(F.concat(F.lit("."), own)))))
    has = lambda c: F.array_contains("capabilities", c)
    points = lambda when, n: F.when(when, n).otherwise(0)
    score = (
        F.when(F.col("party") == "third_party", 25).when(F.col("party") == "first_party", 5).otherwise(0)
        + points(has("dynamic_code"), 20) + points(has("dom_access"), 15) + points(F.size("reads") > 0, 15)
        + F.when(F.size("external_destinations") > 0, 15).when(has("network"), 8).otherwise(0)
        + points(has("websocket"), 10) + points(has("post_message"), 8) + points(F.size("imports") > 0, 8)
        + points(has("geolocation") | has("camera_microphone") | has("notifications") | has("clipboard"), 10)
    )
    if runtime is not None:
        seen = runtime.groupBy("doc_id").agg(F.sum("n_requests").alias("__requests"), F.sum("n_eval").alias("__eval"))
        joined = joined.join(seen, "doc_id", "left")
        score = score + points(F.coalesce("__requests", F.lit(0)) > 10, 5) + points(F.coalesce("__eval", F.lit(0)) > 0, 10)
    return joined.withColumn("score", F.least(F.lit(100), score)).drop("__requests", "__eval").withColumns({"n_reads": F.size("reads"), "n_external": F.size("external_destinations")})


def exfiltration(inventory_: DataFrame) -> DataFrame:
    """Scripts that read sensitive data and name external destinations."""
    both = inventory_.filter((F.col("n_reads") > 0) & (F.col("n_external") > 0))
    return both.select(
        "doc_id", F.lit("data_exfiltration_candidate").alias("id"), F.lit("MEDIUM").alias("severity"), F.lit("medium").alias("confidence"), F.col("name").alias("file"),
        F.array_join("reads", ", ").alias("source"), F.array_join("external_destinations", ", ").alias("sink"), F.lit("behavioral_correlation").alias("evidence_type"),
    )


def loaders(scripts: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, loaded_by: where an edge's target is a script's URL, or has its
    file name. Two equi joins instead of one with OR."""
    e = edges.select(F.col("from").alias("loaded_by"), X.canonical_url(F.col("to")).alias("to_url"), X.basename(F.col("to")).alias("to_name")).distinct()
    by_url = scripts.select("doc_id", X.canonical_url(F.col("url")).alias("to_url")).filter("to_url <> ''").join(e, "to_url")
    by_name = scripts.select("doc_id", X.basename(F.col("name")).alias("to_name")).filter("to_name <> ''").join(e, "to_name")
    both = by_url.select("doc_id", "loaded_by").union(by_name.select("doc_id", "loaded_by")).distinct()
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_set("loaded_by")).alias("loaded_by"))


def initiated(scripts: DataFrame, requests: DataFrame) -> DataFrame:
    """doc_id, requests: runtime requests that a script started, by its URL,
    name or file name."""
    keys = F.array_distinct(F.array(X.canonical_url(F.col("url")), X.canonical_url(F.col("name")), X.basename(F.col("name"))))
    names = scripts.select("doc_id", F.explode(keys).alias("initiator")).filter("initiator <> ''")
    return requests.select(X.canonical_url(F.col("initiator")).alias("initiator"), "method", "url").join(names, "initiator").groupBy("doc_id").agg(F.count_distinct("method", "url").alias("requests"))


def requests_with_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests and responses by (method, url), the last of each; either may miss."""
    from skein.operators.history import last_of

    a, b = last_of(requests, ["method", "url"]), last_of(responses, ["method", "url"])
    return a.join(b.withColumnRenamed("ordinal", "response_ordinal") if "ordinal" in b.columns else b, ["method", "url"], "full")
