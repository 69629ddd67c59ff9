"""Labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SAMPLE_PARTS = 12


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(0)).cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, per_label: int) -> DataFrame:
    """doc_id, text, y of at most `per_label` documents of each label (0, 1),
    outside the held-out fold, drawn by a hash of the id. Ids with both labels
    are left out. The bound is what makes the broadcast of ids safe. An id that
    stands in several documents brings all of them, up to the bound of
    `per_label` texts a label again, in the same order. The drawn rows are gathered in SAMPLE_PARTS partitions, so that what a fit sums up by
    partition does not grow with the corpus."""
    known = labels.filter(F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
    agreed = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most").select("doc_id", "y")
    drawn = [agreed.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("__key", F.xxhash64("doc_id", "text"))
    # Ranks of hashes first: the texts are shuffled once they are few.
    nth = [rows.filter(F.col("y") == y).select("y", "doc_id", "__key").orderBy(F.xxhash64("doc_id"), "doc_id", "__key").limit(per_label) for y in (0, 1)]
    few = nth[0].unionByName(nth[1]).distinct()
    return rows.join(F.broadcast(few), ["y", "doc_id", "__key"], "left_semi").drop("__key").repartition(SAMPLE_PARTS)
