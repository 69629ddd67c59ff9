"""Benchmark decontamination with a distributed positional index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import lower_ascii, words

#: Up to so many anchor words are tested as a literal set, and up to so many
#: windows are broadcast; beyond, both are joined by shuffles.
LITERAL_WORDS, BROADCAST_WINDOWS = 50_000, 100_000


def _sets(value: Column, words_: list[str]) -> Column:
    return F.filter(value, lambda w: w.isin(words_))


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """item_id, w (all words), at, terms: each run of `width` words; an item of
    fewer words, but not none, is one window."""
    w = items.select("item_id", words(lower_ascii(F.col("text"))).alias("w")).filter(F.size("w") > 0).distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return w.select("item_id", "w", F.explode(starts).alias("at")).withColumn("terms", F.slice("w", F.col("at") + 1, width))


def find_passages(docs: DataFrame, items: DataFrame, *, width: int = 10, near: float = 0.8) -> DataFrame:
    """Where windows of `width` benchmark words occur in documents.

    Term frequencies over all documents tell each window's rarest terms, its
    anchors: one more than a proximity match may lack. One pass posts the
    anchors' places in every document, each with the words around it; postings
    meet the item places that their word anchors and are shifted by them, and
    the places of the other terms are intersected once for all windows around:
    a window with all of them is an exact phrase match, one with at least
    `near` of them a proximity match, also where it begins before a document's
    first word or ends behind its last. Terms that no document has anchor nothing.

    Returns one row per document row: doc_id, n_words, n_hit (words inside an
    exact match), n_items, items_sha256, contaminated, item_ids, n_near
    (items with proximity matches only), text_key (hash of the text). Null
    texts have no words; repeated rows each get a row; an empty benchmark
    leaves all documents clean; other columns are not read.
    """
    windows = windows_of(items, width)
    vocabulary = [r[0] for r in windows.select(F.explode("terms")).distinct().limit(LITERAL_WORDS + 1).collect()]
    tokens = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(lower_ascii(F.col("text"))).alias("w"))
    small = len(vocabulary) <= LITERAL_WORDS
    terms = windows.select(F.explode(F.array_distinct("terms")).alias("word")).distinct()
    spread = tokens.select(F.explode(_sets(F.col("w"), vocabulary) if small else F.col("w")).alias("word"))
    df = (spread if small else spread.join(terms, "word", "left_semi")).groupBy("word").agg(F.count("*").alias("df"))
    df = df.persist()
    placed = windows.select("item_id", "w", "at", F.posexplode("terms").alias("offset", "word"))
    ranked = (
        placed.join(df, "word", "left")
        .groupBy("item_id", "w", "at")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "word"))).alias("ranked"))
    )
    # A match lacks at most n - ceil(n * near) terms, so it has one of one more.
    n_anchors = (F.size("ranked") - F.ceil(F.size("ranked") * near) + 1).cast("int")
    reach = width - 1
    around = lambda w, pos: F.slice(w, F.greatest(pos - reach + 1, F.lit(1)), F.least(pos, F.lit(reach)) + reach + 1)
    left = lambda pos: F.least(pos, F.lit(reach))  # noqa: E731  words of a context before the anchor
    place = F.col("at") + F.col("a.offset")
    anchors = (
        ranked.select("item_id", "w", "at", F.explode(F.slice("ranked", F.lit(1), n_anchors)).alias("a"))
        .filter("a.df > 0")
        .select("item_id", F.size("w").alias("n"), F.col("a.word").alias("word"), place.alias("place"), around(F.col("w"), place).alias("context"), left(place).alias("left"))
        .distinct()
        .persist()
    )
    n_windows = anchors.count()
    chosen = [r[0] for r in anchors.select("word").distinct().limit(LITERAL_WORDS + 1).collect()]
    if len(chosen) <= LITERAL_WORDS:
        noted = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda h: h["word"].isin(chosen))
        posts = F.transform(noted, lambda h: F.struct(h["pos"].alias("pos"), h["word"].alias("word"), around(F.col("w"), h["pos"]).alias("context"), left(h["pos"]).alias("left")))
        rows = tokens.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), posts.alias("posts"))
        rows = rows.select("doc_id", "text_key", "n_words", F.posexplode_outer("posts").alias("nth", "post"))
    else:
        every = tokens.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "word"))
        keep = anchors.select("word").distinct().withColumn("known", F.lit(True))
        rows = every.join(keep, "word", "left").filter(F.col("known") | (F.coalesce("pos", F.lit(0)) == 0))
        rows = rows.select(
            "doc_id", "text_key", "n_words", F.coalesce("pos", F.lit(0)).alias("nth"),
            F.when(F.col("known"), F.struct("pos", "word", around(F.col("w"), F.col("pos")).alias("context"), left(F.col("pos")).alias("left"))).alias("post"),
        )
    rows = rows.select("doc_id", "text_key", "n_words", F.coalesce("nth", F.lit(0)).alias("nth"), F.col("post.pos").alias("pos"), F.col("post.word").alias("word"), F.col("post.context").alias("context"), F.col("post.left").alias("left"))
    # `nth` counts a document row once, however many postings and windows meet.
    right = anchors.groupBy("word").agg(F.collect_list(F.struct("item_id", "n", "place", "context", F.col("left").alias("before"))).alias("anchored"))
    right = F.broadcast(right) if n_windows <= BROADCAST_WINDOWS else right
    met = rows.join(right, "word", "left")

    def shared(a: Column) -> Column:
        """Item places around the anchor whose word stands in the document too."""
        both = F.least(F.col("left"), a["before"])
        mine = F.slice("context", F.col("left") - both + 1, F.greatest(F.size("context"), F.lit(0)))
        its = F.slice(a["context"], a["before"] - both + 1, F.size(a["context"]))
        alike = F.filter(F.transform(F.zip_with(mine, its, lambda x, y: x == y), lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
        return F.transform(alike, lambda i: a["place"] - both + i)

    least = lambda n: F.ceil(F.least(n, F.lit(width)) * near)
    close = F.transform("anchored", lambda a: F.struct(a["item_id"].alias("item_id"), a["n"].alias("n"), a["place"].alias("place"), shared(a).alias("at")))
    met = met.select("doc_id", "text_key", "n_words", "nth", "pos", F.filter(close, lambda a: F.size(a["at"]) >= least(a["n"])).alias("close"))

    def judged(a: Column) -> Column:
        """The windows around an anchor with enough of their places shared."""
        n = F.least(a["n"], F.lit(width))
        starts = F.sequence(F.greatest(a["place"] - reach, F.lit(0)), F.least(a["place"], a["n"] - n))
        counted = lambda s: F.struct(
            a["item_id"].alias("item_id"), (F.col("pos") - a["place"] + s).alias("start"), n.alias("n"),
            F.size(F.filter(a["at"], lambda p: (p >= s) & (p < s + n))).alias("same"),
        )
        return F.filter(F.transform(starts, counted), lambda m: m["same"] >= least(m["n"]))

    found = F.when(F.size("close") > 0, F.flatten(F.transform("close", judged)))
    kind = dict(anchors.dtypes)["item_id"]
    met = met.select("doc_id", "text_key", "n_words", "nth", F.coalesce(found, F.array().cast(f"array<struct<item_id:{kind},start:int,n:int,same:int>>")).alias("found"))
    # A document's first posting keeps its row, others count only if they found something.
    met = met.filter((F.col("nth") == 0) | (F.size("found") > 0))
    exact = F.filter("found", lambda m: m["same"] == m["n"])
    met = met.select(
        "doc_id", "text_key", "n_words", "nth",
        F.transform(exact, lambda m: F.struct(m["start"].alias("start"), m["n"].alias("n"))).alias("spans"),
        F.array_distinct(F.transform(exact, lambda m: m["item_id"].cast("string"))).alias("exact"),
        F.array_distinct(F.transform("found", lambda m: m["item_id"].cast("string"))).alias("near"),
    )
    held = met.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.when(F.col("nth") == 0, 1).otherwise(0)).alias("copies"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("exact")))).alias("item_ids"),
        F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    out = held.select(
        "doc_id",
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "item_ids",
        F.size(F.array_except("near", "item_ids")).cast("long").alias("n_near"),
        "text_key",
        "copies",
    )
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copies", "copy")
