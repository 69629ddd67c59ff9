"""Documents from code, files and folders; names, sizes and copies."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What counts as a script file, and what folders are skipped.
EXTENSIONS = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx")
SKIPPED = ("node_modules", ".git", ".hg", ".svn")
MAX_BYTES = 2_000_000
SCHEMA = "doc_id long, ordinal long, name string, url string, content string"


def inline(spark: SparkSession, files: Iterable[tuple[str, str]]) -> DataFrame:
    """Documents from (name, code); blank code is skipped."""
    rows = [(i, i, name, None, code) for i, (name, code) in enumerate(files) if (code or "").strip()]
    return unique_names(spark.createDataFrame(rows, SCHEMA))


def batch(spark: SparkSession, files: Iterable[tuple[str, bytes | str | None]], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents of files that can be read, and (name, reason) of the others:
    missing, blank or oversized. Bytes that are no UTF-8 count as Latin-1."""
    good, bad = [], []
    for name, raw in files:
        if raw is None:
            bad.append((name, "missing"))
            continue
        data = raw.encode() if isinstance(raw, str) else raw
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        if len(data) > max_bytes:
            bad.append((name, "oversized_script"))
        elif not text.strip():
            bad.append((name, "blank"))
        else:
            good.append((name, text))
    return inline(spark, good), spark.createDataFrame(bad, "name string, reason string")


def beautified(documents: DataFrame, hook: Callable[[Column], Column] | None = None) -> DataFrame:
    """Documents with their content rewritten by an expression; without one, as they are."""
    return documents if hook is None else documents.withColumn("content", hook(F.col("content")))


def folder(spark: SparkSession, path: str | list[str], limit: int = 1000) -> DataFrame:
    """Script files below a folder, or some, in order of their paths."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{js,mjs,cjs,jsx,ts,tsx}").load(path)
    skipped = F.lit(False)
    for name in SKIPPED:
        skipped = skipped | F.col("path").contains(f"/{name}/")
    kept = raw.filter(~skipped).orderBy("path").limit(limit)
    content = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    rows = kept.select("path", content.alias("content"))
    nth = F.row_number().over(Window.orderBy("path")) - 1
    return rows.select(nth.cast("long").alias("doc_id"), nth.cast("long").alias("ordinal"), F.regexp_replace("path", r"^.*/", "").alias("name"), F.col("path").alias("url"), "content")


def safe(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"(^|/)\.\.(?=/|$)", "$1_"), r"[^A-Za-z0-9._/-]", "_")


def unique_names(documents: DataFrame) -> DataFrame:
    """Names made safe; the second of one name becomes x-2.js, and so on."""
    named = documents.withColumn("name", safe(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ordinal"))
    suffixed = F.concat(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""), F.lit("-"), F.col("nth").cast("string"), F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1))
    return named.withColumn("nth", nth).withColumn("name", F.when(F.col("nth") > 1, suffixed).otherwise(F.col("name"))).drop("nth")


def planned_bytes(documents: DataFrame) -> int:
    """The size that the optimizer expects, from its sources' sizes; runs nothing."""
    return int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(documents: DataFrame) -> DataFrame:
    """Documents in as many partitions as there are cores, if their scan would
    make fewer; a scan that feeds the cluster is left alone, unshuffled. Decided
    by the sizes that the plan knows, so that planning runs no job. For those
    who build plans on texts; operators take documents as they come."""
    spark = documents.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return documents.repartition(cores) if planned_bytes(documents) < cores * split else documents


def first_copies(documents: DataFrame) -> DataFrame:
    """The first document of each content. Contents are compared by hash, so
    the texts themselves are shuffled once and never sorted against each other."""
    hashed = documents.withColumn("content_sha256", F.sha2("content", 256))
    first = hashed.groupBy("content_sha256").agg(F.min("ordinal").alias("ordinal"))
    return hashed.join(first, ["content_sha256", "ordinal"], "left_semi")


def sized(documents: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Documents with skip_reason (null, or oversized_script)."""
    return documents.withColumn("skip_reason", F.when(F.octet_length("content") > limit, "oversized_script"))


def uploads(files: DataFrame, max_files: int = 20, max_bytes: int = 3 << 20) -> DataFrame:
    """name, accepted, reason for uploaded files (ordinal, name, content)."""
    ok = F.lit(False)
    for ext in EXTENSIONS:
        ok = ok | F.lower("name").endswith(ext)
    nth = F.row_number().over(Window.orderBy("ordinal"))
    reason = F.when(nth > max_files, "too_many_files").when(~ok, "extension").when(F.octet_length("content") > max_bytes, "too_large")
    return files.select("name", reason.alias("reason")).withColumn("accepted", F.col("reason").isNull())
