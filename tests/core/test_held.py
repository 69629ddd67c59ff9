"""One pass tells which words texts hold; detectors find the same as without it."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from skein.functions import patterns as P
from skein.functions import text as X
from skein.operators import detectors, held, offsets


def test_held_words_are_those_that_stand_there(spark):
    words = frozenset({"let ", "token", "tokens", "access_token", "$(", "[", "aes", "x-a"})
    texts = ["", "é accessToken ACCESS_TOKENS", "x=$(a)[0]", "to", "ken", "Caesar AES", "ſ X-A漢", "le", "t LET tOkEn", "Key [[["]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", held.held(F.col("t"), words).alias("h")).collect()
    for _, t, (found, _) in rows:
        lines = found.split("\n")
        for w in words:
            assert any(w in x.lower() for x in lines) == (w in t.lower()), (t, w)
            assert all(x in t for x in lines)
            assert any(w.upper() in x for x in lines) == (w.upper() in t), (t, w)


def test_runs_are_seen_across_slices_and_ends():
    run = held._held(pa.array(["x", "ab/+" * 4, "", " b", "é" + "f" * 15, "-" + "f" * 16 + "-"]).slice(1), held._finder(frozenset({"x"}))).field("runs").to_pylist()
    assert run[0] and run[4] and not run[2]
    assert not held._held(pa.array(["f" * 15 + " "]), held._finder(frozenset({"x"}))).field("runs").to_pylist()[0]


def test_words_behind_common_beginnings_are_needed():
    assert X.needles(P.SECRETS[13]) == ("passwd", "password", "pwd")
    assert X.needles(r"\bAES(?:-[0-9]+)?\b") == ("AES",) and X.needles(r"(?i)\bSHA-?256\b") == ("sha-256", "sha256")
    assert len([p for p in detectors._fixed_patterns(P.SEARCHED) if not X.needles(p)]) == 1


def test_texts_are_not_searched_word_by_word(spark):
    """Only the pass over the bytes, and expressions behind it, read a text."""
    documents = spark.createDataFrame([(1, "a")], "doc_id long, content string")
    plan = detectors.long(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(__held" in plan and "Contains(__low" not in plan and "Contains(content" not in plan


def test_detectors_find_the_same_as_plain_patterns(spark):
    draw = random.Random(5)
    parts = [
        "token = 'abcdefgh12345'", "PASSWORD:\t\"hunter22hunter\"", "pwd='x1'", "AES-256", "aes", "ſecret", "Key", "SK" + "0aF" * 11, "ghp_" + "Ab1" * 8, "eyJab.cd-e.f_g",
        "\\x41", "\\u00e9", "['a', 'b']", "fetch('/api/v1')", "$('#a')", "'#/route'", "QUJD" * 12 + "==", "0123456789abcdef" * 2, "x-key: 'v'", "innerHTML += 1", "let a = {url: 1}", "/v2/x", "X", "+", "é", "\n", ";",
    ]
    texts = ["".join(draw.choice(parts) + draw.choice(["", " ", "\n", "=", "漢"]) for _ in range(draw.randint(1, 9))) for _ in range(150)]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, content string")
    base, text = detectors.with_text(documents)
    patterns = sorted(detectors._fixed_patterns((P.SEARCHED, P.ENCODED, P.HIDDEN, P.LONG_RUNS)))
    checks = [F.when((text.has(p) != F.col("content").rlike(p)) | (text.all(p) != X.find_all(F.col("content"), p)), F.lit(p)) for p in patterns]
    assert base.select(F.explode(F.array_compact(F.array(*checks)))).collect() == []


def test_sums_without_plus_signs_are_still_folded(spark):
    documents = spark.createDataFrame([(1, 'k = Buffer.concat([Buffer.from("abcdefgh")])'), (2, 'k = "abcd" + "efgh"'), (3, "abcdefgh")], "doc_id long, content string")
    assert sorted(r["doc_id"] for r in offsets.folded_literals(documents).collect()) == [1, 2]


def test_signals_ask_the_same_pass(spark):
    documents = spark.createDataFrame([(1, "a")], "doc_id long, content string")
    plan = detectors.signals(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(__held_low" in plan and "Contains(__low" not in plan and "Contains(content" in plan
