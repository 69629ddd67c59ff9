"""Tables behind a report's charts: files, categories, original sources, time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vocab import SEVERITIES

# Fixed value: entries of a file's list.
LISTED = 8


def counts_by(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], prefix: str = "n_") -> DataFrame:
    """One row for each key with a count for each of `values`, zeros included,
    and `n` for all rows. The values are given, so nothing is asked of the data
    before it is summed up; other values count in `n` only."""
    each = [F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(f"{prefix}{v}") for v in values]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *each)


def first_values(rows: DataFrame, keys: Sequence[str], category: str, value: str, ordinal: str, most: int = LISTED) -> DataFrame:
    """keys, category, values: the first `most` different values of each
    category, trimmed, blanks left out, in order of first appearance. Repeats
    are summed up before values are ordered, and the rest is cut before it is
    shuffled, so a file or category of any size meets no single task whole."""
    clean = rows.withColumn("__value", F.trim(value)).filter("__value <> ''")
    first = clean.groupBy(*keys, category, "__value").agg(F.min(ordinal).alias("__at"))
    nth = F.row_number().over(Window.partitionBy(*keys, category).orderBy("__at", "__value"))
    few = first.withColumn("__nth", nth).filter(F.col("__nth") <= most)
    gathered = few.groupBy(*keys, category).agg(F.array_sort(F.collect_list(F.struct("__nth", "__value"))).alias("__all"))
    return gathered.select(*keys, category, F.transform("__all", lambda x: x["__value"]).alias("values"))


def file_diagnostics(rows: DataFrame, keys: Sequence[str], category: str, value: str, ordinal: str, categories: Sequence[str]) -> DataFrame:
    """One row a file: counts of `categories` (counts_by) and `lists`, a map
    from each category that the file has to its first values."""
    listed = first_values(rows.filter(F.col(category).isin(*categories)), keys, category, value, ordinal)
    lists = listed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "values")))).alias("lists"))
    counted = counts_by(rows, keys, category, categories)
    same = [counted[k].eqNullSafe(lists[f"__{k}"]) for k in keys]
    none = F.expr("CAST(map() AS MAP<STRING, ARRAY<STRING>>)")
    return counted.join(lists, same, "left").withColumn("lists", F.coalesce("lists", none)).drop(*[f"__{k}" for k in keys])


def severity_table(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by severity for each key, and the worst severity that occurs."""
    counted = counts_by(findings, keys, "severity", SEVERITIES)
    worst = F.lit(None).cast("string")
    for severity in SEVERITIES:
        worst = F.when(F.col(f"n_{severity}") > 0, severity).otherwise(worst)
    return counted.withColumn("worst", worst)


def source_rollup(originals: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, source, bytes, findings, severities: every original source behind
    a source map (doc_id, source, content), also without findings, with a map of
    its findings (doc_id, source, severity) by severity; findings without one
    are MEDIUM. Sources of one name in a document are one."""
    size = originals.groupBy("doc_id", "source").agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))
    level = F.upper(F.coalesce(F.nullif("severity", F.lit("")), F.lit("MEDIUM")))
    each = findings.groupBy("doc_id", "source", level.alias("severity")).agg(F.count("*").alias("n"))
    held = each.groupBy("doc_id", "source").agg(F.sum("n").alias("findings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"))
    none = F.expr("CAST(map() AS MAP<STRING, BIGINT>)")
    return size.join(held, ["doc_id", "source"], "left").select("doc_id", "source", "bytes", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("severities", none).alias("severities"))


def timeline(rows: DataFrame, at: str, width_s: int, column: str, values: Sequence[str], amount: Column | None = None) -> DataFrame:
    """start, column, n, total: counts (and sums of `amount`) of each of
    `values` in time buckets of `width_s` seconds, from the first bucket with a
    row to the last, empty ones included. Rows without a time are left out."""
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (width_s * 1_000_000)).cast("long")
    timed = rows.filter(F.col(at).isNotNull()).withColumn("__bucket", bucket)
    counted = timed.groupBy("__bucket", column).agg(F.count("*").alias("n"), F.sum(amount if amount is not None else F.lit(0)).alias("total"))
    span = timed.agg(F.min("__bucket").alias("a"), F.max("__bucket").alias("b")).filter("a IS NOT NULL")
    grid = span.select(F.explode(F.sequence("a", "b")).alias("__bucket")).select("__bucket", F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
    start = F.timestamp_seconds(F.col("__bucket") * width_s)
    return grid.join(counted, ["__bucket", column], "left").select(start.alias("start"), column, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
