"""The stages of the pipeline against plain versions, on awkward rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from skein.llm import mixing
from tests.llm import brute
from tests.llm.conftest import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, awkward, tmp_path_factory):
    """A folder of tables: awkward rows, junk, near copies, leaks, labels."""
    rng = random.Random(21)
    passage = prose(rng, 14)
    texts = [(d, t, s) for d, t, s in awkward if d is not None and len(t or "") < 10_000]
    texts += [(200 + i, " ".join(f"{w}$$$" for w in prose(rng, 30).split()), "junk") for i in range(30)]
    base = prose(rng, 60).split()
    texts += [(300 + i, " ".join(base[: 60 - i % 4]), "b") for i in range(12)]
    texts += [(400, f"{prose(rng, 20)} {passage} end", "a"), (401, passage.upper(), None), (402, " ".join(passage.split()[:9]), "a")]
    texts += [(500 + i, prose(rng, 40), "a") for i in range(60)]
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in texts]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    marks = [(d, int(not 200 <= d < 300), 0) for d, _, _, _, _ in rows if d >= 200]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def rows_of(df):
    assert df.columns[:5] == list(corpus_pipeline.COLUMNS)
    return [tuple(r)[:5] for r in df.collect()]


def staged(spark, rows):
    """Rows with a clashing column besides those of documents."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, COLUMNS).withColumns({"score": F.lit(0.1), "sig": F.lit("x"), "copies": F.lit(7)})


def test_quality_stage_rejects_junk_only(spark, corpus):
    at, rows = corpus
    kept = {r[0] for r in rows_of(corpus_pipeline.quality_classifier(spark, staged(spark, rows), at))}
    assert not any(200 <= d < 300 for d in kept) and {d for d, *_ in rows if d >= 300} <= kept | {402}


def test_join_stage_keeps_one_of_each_group(spark, corpus):
    at, rows = corpus
    want = brute.near_components([(d, t) for d, t, *_ in rows])
    distinct = Counter((d, t) for d, t, *_ in rows)
    keep = {(d, t) for d, t in distinct if want[d][0] == 0 or want[d][1] == d}
    got = Counter((d, t) for d, t, *_ in rows_of(corpus_pipeline.ngram_jaccard_join(spark, staged(spark, rows), at)))
    assert got == Counter(dict.fromkeys(keep, 1))


def test_join_stage_tells_documents_of_one_id_apart(spark, corpus):
    at, _ = corpus
    rng = random.Random(8)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(5, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (None, b, "en", "s", 1), (9, None, "en", "s", 0), (9, "", "en", "s", 0)]
    got = Counter(r[:2] for r in rows_of(corpus_pipeline.ngram_jaccard_join(spark, staged(spark, rows), at)))
    # A null id is the smallest.
    assert got == Counter({(5, a): 1, (None, b): 1, (9, None): 1, (9, ""): 1})


def test_decontamination_stage_drops_leaks_only(spark, corpus):
    at, rows = corpus
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    windows = brute.item_windows(items)
    want = Counter(r for r in rows if not brute.leaks(r[1], windows)["contaminated"])
    got = Counter(rows_of(corpus_pipeline.benchmark_decontamination(spark, staged(spark, rows), at)))
    assert got == want and 400 not in {r[0] for r in got} and 402 in {r[0] for r in got}


def test_mixing_stage_comes_near_its_targets(spark, corpus):
    at, rows = corpus
    got = Counter(rows_of(corpus_pipeline.source_mixing(spark, staged(spark, rows), at)))
    whole = Counter(rows)
    assert set(got) <= set(whole) and all(n <= 3 * whole[r] for r, n in got.items())
    words = lambda t: len(brute.BLANK.findall(t or ""))
    own, taken = Counter(), Counter()
    for r, n in whole.items():
        own[r[3]] += n * words(r[1])
    for r, n in got.items():
        taken[r[3]] += n * words(r[1])
    names = sorted(own, key=lambda x: (x is None, x or ""))
    targets = mixing.water_fill([own[n] for n in names], mixing.cyclic_weights(names), sum(own.values()), 3)
    assert all(abs(taken[n] - t) <= 60 for n, t in zip(names, targets, strict=True))


def test_sharding_stage_deals_all_rows(spark, corpus):
    at, rows = corpus
    out = corpus_pipeline.sharding_stage(spark, staged(spark, rows), at).collect()
    sizes = Counter(r["shard"] for r in out)
    assert Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in out) == Counter(rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_of_empty_tables(spark, corpus):
    at, _ = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, staged(spark, []), at).count() == 0


def test_run_applies_all_stages(spark, corpus):
    at, rows = corpus
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, at).collect()}
    assert ids <= {r[0] for r in rows} and not any(200 <= d < 300 for d in ids) and not ids & {400, 401}
    # One of the copies at most: the mix may leave it out.
    assert ids & set(range(300, 312)) <= {300}
