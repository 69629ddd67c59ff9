"""Where finds stand in their texts: offsets and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_lines(documents: DataFrame, pattern: str) -> DataFrame:
    """doc_id, ordinal, place, line, value: every find of a pattern in documents
    (doc_id, content), each with its own offset and 1-based line, also where
    equal ones repeat. Null texts have none; repeated rows each give theirs.

    A text is cut once into finds and what stands between them; running sums of
    their lengths and line ends, over one document's finds, give the rest. Only
    finds and numbers are shuffled, never texts, and no text is read again for a
    find. The pattern must need at least one character."""
    text = F.coalesce("content", F.lit(""))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    told = lambda c: F.struct(F.length(c).alias("n"), breaks(c).alias("lines"))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), told)
    # Numbered before finds are told apart: a number stands for a text.
    numbered = documents.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "content")
    each = numbered.select("__row", "doc_id", F.posexplode(F.arrays_zip(gaps.alias("gap"), values.alias("value"))).alias("pos", "f"))
    rows = each.select("__row", "doc_id", F.col("pos").cast("long").alias("ordinal"), "f.gap", "f.value").withColumn("own", told(F.col("value")))
    upto = Window.partitionBy("__row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)

    def reached(part: str) -> Column:
        return F.sum(f"gap.{part}").over(upto) + F.coalesce(F.sum(f"own.{part}").over(before), F.lit(0))

    return rows.select("doc_id", "ordinal", reached("n").alias("place"), (reached("lines") + 1).alias("line"), "value")
