"""License scans by a positional index of rare licence words."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import lower_ascii, materialize, words

#: Label, notice, and the phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "licensed under the gnu general public license version 3", ("general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd", "clause license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("isc", "licensed under the isc license", ("isc license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by", "licensed under cc by 4 0", ("licensed under cc by 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("compliance with the license", "apache org licenses"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ("redistributions of source code", "redistributions in binary form"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "hereby granted provided that"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
        ("express or implied warranty", "held liable for any damages"),
    ),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license")),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("related or neighboring rights",)),
)
#: Phrases whose places are always counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words too common to post: templates and phrases hold them as free places.
COMMON = frozenset("the a an is are of to and or in into any this with without for under by all as no use 0".split())


def _mandatory(notice: str, phrases: tuple[str, ...]) -> list[tuple[int, list[str]]]:
    """Where the mandatory phrases stand in a notice, and their words."""
    terms = notice.split()
    each = [p.split() for p in phrases]
    return [(next(i for i in range(len(terms)) if terms[i : i + len(p)] == p), p) for p in each]


def template_words() -> list[tuple[int, str, int, str, bool]]:
    """(template, label, place, word, mandatory) of what is looked for: common
    words only where a mandatory phrase has them."""
    rows = []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):
        must = {i for at, p in _mandatory(notice, phrases) for i in range(at, at + len(p))}
        rows += [(t, label, i, w, i in must) for i, w in enumerate(notice.split()) if i in must or w not in COMMON]
    return rows


def _parts() -> tuple[list[tuple], list[str], list[tuple[str, int, str]]]:
    """Template postings, all posted words, and the common words of mandatory
    phrases: (word, distance, posted word of the phrase that must stand there)."""
    beside: set[tuple[str, int, str]] = set()
    for _, notice, phrases in TEMPLATES:
        for _, p in _mandatory(notice, phrases):
            rare = [k for k, w in enumerate(p) if w not in COMMON]
            for i, w in enumerate(p):
                if w in COMMON:
                    k = min(rare, key=lambda k: (abs(k - i), k))
                    beside.add((w, k - i, p[k]))
    rows = template_words()
    posted = {w for phrase, _ in BASE for w in phrase.split()} | {r[3] for r in rows if r[3] not in COMMON}
    return rows, sorted(posted), sorted(beside)


def _places(hits: Column, phrase: str) -> Column:
    """Start places of a phrase, from postings in word order."""
    terms = phrase.split()
    follow = [hits] + [F.slice(hits, k + 1, F.greatest(F.size(hits) - k, F.lit(0))) for k in range(1, len(terms))]
    found = F.transform(hits, lambda h: F.struct(h["pos"].alias("at"), (h["word"] == terms[0]).alias("ok")))
    for k in range(1, len(terms)):
        found = F.zip_with(found, follow[k], _followed_by(k, terms[k]))
    return F.transform(F.filter(found, lambda f: f["ok"]), lambda f: f["at"])


def _followed_by(k: int, word: str) -> Callable[[Column, Column], Column]:
    return lambda f, h: F.struct(
        f["at"].alias("at"), F.coalesce(f["ok"] & (h["word"] == word) & (h["pos"] == f["at"] + k), F.lit(False)).alias("ok")
    )


def scan_licenses(docs: DataFrame, *, least: float = 0.6) -> DataFrame:
    """Licence notices of every document (doc_id, text).

    One pass posts each document's licence words with their places, and common
    words only beside the word of a mandatory phrase they belong to. Document
    frequencies over all documents give each word its IDF; the rarest mandatory
    word of each template, wherever it stands, tells where the template would
    start, and the template's postings are intersected there. A start whose
    mandatory phrases all stand and whose matched IDF reaches `least` of the
    template's is a match. Base phrases count wherever they stand.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels (base and matched), score (highest matched share of IDF, 1 where a
    base phrase stands) and matches (template label, start, share). Null and
    empty texts have no words; repeated rows each get a row; other columns of
    the input are not read. The postings of a document are as many as its
    licence words, and the templates are a fixed list.
    """
    spark = docs.sparkSession
    parts, posted, beside = _parts()
    tokens = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), words(lower_ascii(F.col("text"))).alias("w"))

    def is_noted(h: Column) -> Column:
        stands = [(h["word"] == c) & F.coalesce(F.get("w", (h["pos"] + d).cast("int")) == near, F.lit(False)) for c, d, near in beside]
        return h["word"].isin(posted) | (h["word"].isin(sorted({c for c, _, _ in beside})) & reduce(or_, stands))

    noted = F.filter(F.transform("w", lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word"))), is_noted)
    base = tokens.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), noted.alias("hits"))
    base = materialize(base.select("*", F.monotonically_increasing_id().alias("row")), "licenses")

    postings = base.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word")
    spread = base.filter(F.size("hits") > 0).select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    n_docs = base.count()
    df = {r["word"]: r["df"] for r in spread.groupBy("word").agg(F.count("*").alias("df")).collect()}
    idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 0.01 for w in posted}
    # Common words must stand where a mandatory phrase has them, but weigh nothing.
    weight = [(t, label, place, w, must, idf.get(w, 0.0)) for t, label, place, w, must in parts]
    template = F.broadcast(spark.createDataFrame(weight, "template int, label string, place long, word string, must boolean, idf double"))
    # A match holds all mandatory words, so the rarest of them finds every start.
    rarest: dict[int, tuple[float, int, str]] = {}
    for t, _, place, w, must, _ in weight:
        if must and w in idf:
            rarest[t] = min(rarest.get(t, (math.inf, 0, "")), (-idf[w], place, w))
    lookup = F.broadcast(spark.createDataFrame([(t, place, w) for t, (_, place, w) in rarest.items()], "template int, place long, word string"))
    starts = postings.join(lookup, "word").select("row", "template", (F.col("pos") - F.col("place")).alias("start"))
    expected = starts.join(template, "template").withColumn("pos", F.col("start") + F.col("place"))
    met = expected.join(postings.withColumn("met", F.lit(True)), ["row", "pos", "word"], "left")
    matches = (
        met.groupBy("row", "template", "label", "start")
        .agg(
            (F.sum(F.when(F.col("met"), F.col("idf")).otherwise(0.0)) / F.sum("idf")).alias("share"),
            F.min(F.col("met").isNotNull() | ~F.col("must")).alias("all_must"),
        )
        .filter(F.col("all_must") & (F.col("share") >= least))
        .groupBy("row")
        .agg(F.collect_list(F.struct("label", "start", F.round("share", 6).alias("share"))).alias("matches"))
    )
    labelled = [F.when(F.size(F.col(f"p{i}")) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]
    counted = base.select("row", "doc_id", "n_words", *[_places(F.col("hits"), p).alias(f"p{i}") for i, (p, _) in enumerate(BASE)])
    counted = counted.select(
        "row",
        "doc_id",
        "n_words",
        F.concat(*[f"p{i}" for i in range(len(BASE))]).alias("places"),
        F.array_sort(F.array_compact(F.array(*labelled))).alias("named"),
    )
    joined = counted.join(matches, "row", "left").withColumn("matches", F.coalesce("matches", F.expr("cast(array() as array<struct<label:string,start:long,share:double>>)")))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("named", F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        F.array_sort("matches").alias("matches"),
    )
