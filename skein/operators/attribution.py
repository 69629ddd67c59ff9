"""Who started a request: nested initiator stacks, and the merge of what a
browser's log says of requests, responses and initiators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Initiators kept of a request, and requests kept of a scan.
INITIATORS, REQUESTS = 8, 300


def initiator_urls(payload: Column) -> Column:
    """The addresses in an event's initiator, in order and each once: its own,
    then those of its stack's frames, then those of the stack's parents, however
    many there are. The JSON stays a VARIANT; the chain is folded link by link,
    at most as often as the text names a parent. What is no JSON gives none."""
    event = F.try_parse_json(payload)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    some = lambda urls: F.filter(urls, lambda u: u.isNotNull() & (u != ""))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    links = F.floor((F.length(payload) - F.length(F.replace(payload, F.lit('"parent'), F.lit("")))) / 7).cast("int")

    def follow(state: Column, _: Column) -> Column:
        stack = state["stack"]
        frames = F.transform(F.coalesce(get(stack, "$.callFrames", "array<variant>"), F.expr("CAST(array() AS ARRAY<VARIANT>)")), lambda f: get(f, "$.url", "string"))
        parent = get(stack, "$.parent", "variant")
        # An empty parent is none.
        onward = F.when(F.coalesce(F.to_json(parent), F.lit("null")).isin("{}", "null", '""', "[]", "0", "false"), get(stack, "$.parentStack", "variant")).otherwise(parent)
        return F.struct(onward.alias("stack"), F.concat(state["urls"], some(frames)).alias("urls"))

    start = F.struct(get(event, "$.initiator.stack", "variant").alias("stack"), some(F.array(get(event, "$.initiator.url", "string"))).alias("urls"))
    found = F.aggregate(F.sequence(F.lit(0), links), start, follow, lambda state: state["urls"])
    return F.slice(F.array_distinct(F.coalesce(found, none)), 1, INITIATORS)


def merged_requests(log: DataFrame, limit: int = REQUESTS) -> DataFrame:
    """scan_id, place, method, url, fields, initiated_by: a log's rows (scan_id,
    ordinal, kind, payload as JSON) by request.

    Of several requests, or responses, of one method and address the last
    counts; a response's fields take the place of its request's, which stay
    otherwise; initiators are those of all its initiator events in order, the
    first INITIATORS that differ. Requests come in the order of their first
    event, responses without a request after them; the first `limit` of each
    scan are kept. Initiators without request or response say nothing. Nulls
    are values of their own; what is no JSON object is left out.

    Everything is summed up by (scan, method, address) before it is ordered, so
    an address of any number of events meets no single task.
    """
    keys = ["scan_id", "method", "url"]
    fields = F.from_json("payload", "map<string,string>", {"mode": "PERMISSIVE"})
    events = log.withColumn("fields", fields).filter("fields IS NOT NULL")
    events = events.select("scan_id", "ordinal", "kind", "payload", "fields", F.col("fields")["method"].alias("method"), F.col("fields")["url"].alias("url"))
    told = events.filter(F.col("kind").isin("request", "response"))
    of = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("fields")), F.when(F.col("kind") == kind, F.col("ordinal")))
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ordinal")))
    both = told.groupBy(*keys).agg(of("request").alias("a"), of("response").alias("b"), at("request").alias("first_a"), at("response").alias("first_b"))
    empty = F.expr("CAST(map() AS MAP<STRING, STRING>)")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    merged = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    order = F.struct(F.col("first_a").isNull().alias("late"), F.coalesce("first_a", "first_b").alias("first"))
    rows = both.select(*keys, merged.alias("fields"), order.alias("__at"))
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("__at", "method", "url"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= limit).drop("__at")
    return kept.join(_initiators(events, keys), [kept[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left").select(
        "scan_id", "place", "method", "url", "fields", F.coalesce("initiated_by", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("initiated_by")
    )


def _initiators(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first INITIATORS different addresses of each request, in order."""
    each = events.filter(F.col("kind") == "initiator").select(*keys, "ordinal", F.posexplode(initiator_urls(F.col("payload"))).alias("pos", "by"))
    first = each.groupBy(*keys, "by").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    few = first.withColumn("nth", nth).filter(F.col("nth") <= INITIATORS)
    gathered = few.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("nth", "by"))).alias("found"))
    return gathered.select(*[f"__{k}" for k in keys], F.transform("found", lambda f: f["by"]).alias("initiated_by"))
