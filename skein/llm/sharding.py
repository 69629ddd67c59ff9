"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import draw, root_buckets, running_total, unit


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """Deals every row of `docs` (doc_id, text, source) to shards so that each
    shard holds the corpus's mixture of sources.

    Rows of a source are shuffled by a seeded hash and ranked; a row's
    fractional rank (rank - 1 + u) / n, with u a hash of the source, spreads
    each source evenly over [0, 1). All rows sorted by it are cut into shards
    whose row counts differ by at most one (the law `rows`).

    Adds size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from
    0 in each shard) and grown_shard (null: the law is not `key`); the input's
    other columns stay, except that columns of these names are replaced.
    Null text counts as empty; null sources form one source of their own;
    repeated rows each get a slot; no rows give no rows. Reruns agree, except
    that fully equal rows are interchangeable.
    """
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    rows = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(
        *[c for c in docs.columns if c not in new],
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    placed = named.withColumns(
        {
            "__stratum": F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))),
            "__shuffle": draw(F.lit(seed), F.col("doc_id"), F.col("text_crc32")),
        }
    )
    buckets = root_buckets(rows)
    ties = [F.col("__shuffle"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = running_total(
        placed, group=["__stratum"], fraction=unit(F.col("__shuffle")), order=ties, value=F.lit(1),
        buckets=buckets, total="__rank", whole="__n",
    )
    share = (F.col("__rank") - 1 + unit(draw(F.lit(seed + 1), F.col("__stratum")))) / F.col("__n")
    ranked = ranked.withColumn("__share", F.least(share, F.lit(1.0 - 2.0**-52))).drop("__rank", "__n")
    dealt = running_total(
        ranked, group=[], fraction=F.col("__share"), order=[F.col("__share"), F.col("__stratum"), *ties],
        value=F.lit(1), buckets=buckets, total="__place", whole="__all",
    )
    at = F.col("__place") - 1
    shard = F.floor(at * shards / F.col("__all")) if shards == 1 else F.expr(f"(__place - 1) * {shards} div __all")
    return (
        dealt.withColumn("__shard", shard.cast("long"))
        .withColumns(
            {
                "law": F.lit("rows"),
                "shard": F.col("__shard").cast("int"),
                "slot": F.expr(f"__place - 1 - (__shard * __all + {shards - 1}) div {shards}").cast("long"),
                "grown_shard": F.lit(None).cast("int"),
            }
        )
        .drop("__shard", "__place", "__all", "__share", "__stratum", "__shuffle")
    )
