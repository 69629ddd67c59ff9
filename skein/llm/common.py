"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the token queries: any run without ASCII controls, blanks or
#: punctuation; digits and letters, and all of non-ASCII, belong to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the blank-separated queries.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir. A local
    master without one (tests) gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir()


#: Rows of one file where materialize() is told how many there may be.
FILE_ROWS = 1_000_000


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives
    lost executors, and computes its input a single time. `rows`: at most so
    many narrow rows come, and go to few files instead of one a partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(rows // FILE_ROWS + 1)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote for `frames`; nothing may read them later."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._skein_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one Arrow batch, so that a worker holds a few MB of texts at once.
BATCH_ROWS = 1024
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batches to `rows`; texts can be very long."""
    now = int(spark.conf.get(_BATCH_KEY))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH_KEY, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` for what is computed inside."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Where no other upper-case letter occurs, the
    built-in lower() gives the same at a fraction of translate()'s cost."""
    other_upper = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
    return F.when(text.rlike(other_upper), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


#: What stands between the words of the token queries.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(lowered: Column) -> Column:
    """The words of a lower-cased text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), GAP), "")


#: Bits of draw().
DRAW_BITS = 60


def draw(*parts: Column) -> Column:
    """A seeded number of DRAW_BITS bits: the head of the MD5 sum of the parts,
    so that any engine can draw the same. Null parts are left out."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def unit(drawn: Column) -> Column:
    """A draw as a fraction of [0, 1), in the same order."""
    return F.least(drawn.cast("double") / F.lit(2.0**DRAW_BITS), F.lit(1.0 - 2.0**-52))


def running_total(
    df: DataFrame,
    *,
    group: Sequence[str],
    fraction: Column,
    order: Sequence[Column],
    value: Column,
    buckets: int,
    total: str,
    whole: str,
) -> DataFrame:
    """Adds `total`, the running sum of `value` in `order` within `group`, and
    `whole`, the group's sum, without ever bringing a group into one task.

    `fraction` in [0, 1) must not decrease along `order`. It cuts each group
    into buckets; sums of buckets are added up first, and only a bucket is
    sorted by one task. With about sqrt(rows) buckets, both the list of a
    group's buckets and a bucket's rows stay near sqrt(rows).
    Group columns must not be null.
    """
    keys = [*group, "__bucket"]
    cut = df.withColumn("__bucket", F.floor(fraction * F.lit(buckets)).cast("long")).withColumn("__value", value)
    sums = cut.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    along = Window.partitionBy(*group).orderBy("__bucket")
    before = sums.select(
        *keys,
        F.coalesce(F.sum("__sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__sum").over(Window.partitionBy(*group)).alias(whole),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(before, keys)
        .withColumn(total, F.col("__before") + F.sum("__value").over(inside))
        .drop("__bucket", "__value", "__before")
    )


def root_buckets(rows: int) -> int:
    return max(1, round(rows**0.5))
