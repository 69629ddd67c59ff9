"""A training-data pipeline over `documents`: five stages, each one operator.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import decontamination, jaccard, mixing, quality, sharding
from skein.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject (score of at least 0.5).

    Null and empty texts score the sample's share of good rows, and so stay
    where most are good; equal texts fare alike; repeated rows each stay; no
    rows, or no labels, reject nothing."""
    space = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _documents(quality.with_quality(docs.select(*COLUMNS), space).filter("score >= 0.5"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one of smallest id.

    Documents are told apart by id and text, so that a text is no copy only
    because its id stands on another text too; the smallest (id, text key) of a
    component names it, so the decision needs no second look at the group. Rows
    that repeat both id and text are one document; of those the first by source,
    lang and n_chars stays. Documents without words are no copies of each other
    and stay. No rows give no rows.
    """
    key = F.xxhash64("text")
    named = docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text")
    found = jaccard.near_duplicates(named).filter("n_shingles > 0 AND NOT doc_id <=> component_id")
    copies = found.select(F.col("doc_id.doc_id").alias("copy_id"), F.col("doc_id.key").alias("copy_key")).distinct()
    once = Window.partitionBy("doc_id", key).orderBy("source", "lang", "n_chars")
    kept = docs.select(*COLUMNS).join(copies, docs["doc_id"].eqNullSafe(F.col("copy_id")) & (key == F.col("copy_key")), "left_anti")
    return _documents(kept.withColumn("nth", F.row_number().over(once)).filter("nth = 1"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage stands. Null and empty texts
    hold none; repeated rows go or stay together; an empty benchmark drops
    nothing; ids that differ only in being null are told apart by the text."""
    found = decontamination.find_passages(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.filter("contaminated").select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return _documents(docs.select(*COLUMNS).join(leaks, docs["doc_id"].eqNullSafe(F.col("leak_id")) & (key == F.col("leak_key")), "left_anti"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, three times at most.
    A null source is a source; documents without words stay once for each whole
    pass over their source; repeated rows are rows of their own; no rows give no
    rows."""
    size = mixing.blank_word_count(F.col("text"))
    mixed = mixing.mix(docs.select(*COLUMNS), member=F.array("source"), size=size, identity=[F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))])
    return _documents(mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; null texts and sources, repeated
    rows and empty tables as sharding.interleaved_shards says."""
    return sharding.interleaved_shards(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_stage),
]

#: Votes of neighbours have no SQL form. Tests hold the join and decontamination
#: stages against brute force, the others to their laws on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
