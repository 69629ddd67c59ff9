"""Shards, mixes, joins, searches and classifiers."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import catalog, jaccard, mixing, quality, sharding, topk, toxicity
from tests.llm import brute
from tests.llm.conftest import prose


def test_shards_are_even_gapless_and_proportional(spark, docs, no_docs, awkward):
    got = sharding.interleaved_shards(docs, shards=5).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(awkward) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.interleaved_shards(no_docs).count() == 0
    big = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    per = Counter((r["source"], r["shard"]) for r in sharding.interleaved_shards(big, shards=8).collect())
    for source in {s for s, _ in per}:
        counts = [per[source, k] for k in range(8)]
        assert max(counts) - min(counts) <= 2


def test_water_filling_shares_everything():
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 210, 3) == pytest.approx([30, 120, 60])
    assert mixing.water_fill([], [], 0, 3) == [] and mixing.water_fill([0, 0], [5, 2], 0, 3) == [0, 0]


def test_flow_spreads_repeats_and_serves_overlaps():
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [1], [0, 1]], [15, 15], 3)
    assert [sum(f.values()) for f in flow] == [10, 10, 10]
    assert sum(f.get(0, 0) for f in flow) == 15 and sum(f.get(1, 0) for f in flow) == 15
    assert sum(sum(f.values()) for f in mixing.min_cost_flow([4], [[0]], [12], 3)) == 12


def plain_flow(sizes, member, quotas, repeats):
    """Most words, then least cost, over all whole routings."""
    options = []
    for size, sources in zip(sizes, member, strict=True):
        all_ = itertools.product(range(size * repeats + 1), repeat=len(sources))
        options.append([dict(zip(sources, v, strict=True)) for v in all_ if sum(v) <= size * repeats])
    best = (-1, 0)
    for routed in itertools.product(*options):
        got = Counter()
        for r in routed:
            got.update(r)
        if all(got[k] <= q for k, q in enumerate(quotas)):
            best = max(best, (sum(got.values()), -flow_cost(routed, sizes)))
    return best


def flow_cost(routed, sizes):
    total = 0
    for r, size in zip(routed, sizes, strict=True):
        words, nth = sum(r.values()), 1
        while words > 0:
            total, words, nth = total + nth * min(words, size), words - size, nth + 1
    return total


def test_flow_is_the_cheapest_of_the_largest():
    rng = random.Random(3)
    for _ in range(120):
        sources, patterns = rng.randint(1, 3), rng.randint(1, 3)
        sizes = [rng.randint(0, 2) for _ in range(patterns)]
        member = [sorted(rng.sample(range(sources), rng.randint(1, min(2, sources)))) for _ in range(patterns)]
        quotas = [rng.randint(0, 5) for _ in range(sources)]
        routed = mixing.min_cost_flow(sizes, member, quotas, 2)
        assert (sum(sum(r.values()) for r in routed), -flow_cost(routed, sizes)) == plain_flow(sizes, member, quotas, 2)


def test_mix_of_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], [], None]), rng.randint(0, 40), "x", 0.5) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n long, size string, target double")
    got = mixing.mix(docs, member=F.col("sources"), size=F.col("n"), identity=[F.col("doc_id")]).collect()
    assert len(got) == 600 and all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    want = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - want) < 0.02 * want


def test_mix_comes_near_targets(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 4}" if i % 5 else None, rng.randint(0, 60)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    from pyspark.sql import functions as F

    got = mixing.mix(docs, member=F.array("source"), size=F.col("n"), identity=[F.col("doc_id")]).collect()
    assert len(got) == 900 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
    again = mixing.mix(docs.repartition(5), member=F.array("source"), size=F.col("n"), identity=[F.col("doc_id")]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(docs.limit(0), member=F.array("source"), size=F.col("n"), identity=[F.col("doc_id")]).count() == 0


def variants(rng, base, n):
    """Copies with a few words changed, around the threshold of a link."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        cut = rng.randint(0, 6)
        out.append(" ".join(w[cut:] if rng.random() < 0.5 else w[: len(w) - cut]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, awkward, seed):
    rng = random.Random(seed)
    texts = [t for _, t, _ in awkward]
    for _ in range(6):
        texts += variants(rng, prose(rng, rng.randint(6, 70)).split(), rng.randint(2, 25))
    shared = prose(rng, 50)
    texts += [f"{prose(rng, rng.randint(0, 14))} {shared}" for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.near_components(rows)


def test_near_duplicates_of_short_texts_equal_all_pairs(spark):
    rng = random.Random(12)
    texts = []
    for i in range(300):
        w = [f"w{i}x{k}" for k in range(rng.randint(6, 15))]
        texts += [" ".join(w), " ".join([*w[:-1], "other"] if i % 2 else [*w, "more"])]
    rows = list(enumerate(texts))
    want = brute.near_components(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 100
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want
    one = spark.createDataFrame([(i, f"a{i} b c d e f") for i in range(40)], "doc_id long, text string").repartition(40)
    assert jaccard.near_duplicates(one).filter("doc_id = component_id").count() == 40


def test_near_duplicates_of_no_documents(no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(4)
    nodes = rng.sample(range(-500, 500), 60)
    links = list(zip(nodes, nodes[1:20], strict=False)) + [(nodes[30], n) for n in nodes[31:]]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for part in (nodes[:20], nodes[30:]):
        low = min(part)
        assert all(got.get(n, n) == low for n in part)


def plain_top(rows, k, every):
    v = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in rows}
    out = []
    for q in sorted(v):
        if q % every == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 16)).astype(np.float32) * rng.gamma(2, 1, (300, 1)).astype(np.float32)
    x[40:80] = x[40]
    x[100:110] = 0
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)]
    bad = [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (None, [0.1] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_inner_products(df, every=10, block=64, head=32).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain_top(rows, 5, 10)
    rounds = topk.top_inner_products(df, every=10, block=16, head=8, first=1).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in rounds] == plain_top(rows, 5, 10)
    few = topk.top_inner_products(df.filter("vec_id < 3"), every=1).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in few] == plain_top(rows[:3], 5, 1)
    assert topk.top_inner_products(df.limit(0)).count() == 0


def test_top_k_ignores_clashing_columns_and_takes_long_vectors(spark):
    rows = [(i, [float((i * k) % 7) / 8 for k in range(400)], i, [1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, v array<double>")
    got = topk.top_inner_products(df, every=10, block=8, head=4).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain_top([r[:2] for r in rows], 5, 10)


def test_shards_by_the_plain_rule(spark, docs, awkward):
    """Ranks, shares and cuts as the docstring says, row by row."""
    import hashlib

    draw = lambda *parts: int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:15], 16)
    unit = lambda d: min(d / 2.0**60, 1.0 - 2.0**-52)
    rows = [(("1" if s is None else f"0{s}"), draw(20, d, zlib.crc32((t or "").encode())), d, zlib.crc32((t or "").encode())) for d, t, s in awkward]
    order = sorted(rows)
    by = Counter(r[0] for r in rows)
    nth, placed = Counter(), []
    for r in order:
        nth[r[0]] += 1
        placed.append((min((nth[r[0]] - 1 + unit(draw(21, r[0]))) / by[r[0]], 1.0 - 2.0**-52), *r))
    placed.sort()
    want = sorted((r[3], r[4], i * 5 // len(rows)) for i, r in enumerate(placed))
    got = sorted((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.interleaved_shards(docs, shards=5).collect())
    assert got == want


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        toxic, junk = i % 4 == 0, i % 5 == 0
        w = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumbleton", "zarkface", "nobwit" + prose(rng, 1)])
        text = " ".join(x + "$$$" for x in w) if junk else " ".join(w)
        rows.append((i, text))
        marks.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, threshold=0.5):
    rows = scored.join(labels, "doc_id").select("score", column).collect()
    return sum((r["score"] >= threshold) == bool(r[column]) for r in rows) / len(rows)


def test_toxicity_learns_words_and_stems(labelled):
    docs, labels = labelled
    lexicon = toxicity.fit_lexicon(toxicity.labelled_sample(docs, labels, "toxic", folds=5, held_out=0, per_label=1000))
    assert any(t.startswith(" nobwit") for t in lexicon.weights)
    assert accuracy(toxicity.score_toxicity(docs, lexicon), labels, "toxic") > 0.98
    assert lexicon.score(toxicity.folded("you Grоmblеton")) < 0.5 < lexicon.score(toxicity.folded("you zаrkf4ce"))


def test_toxicity_learns_a_wide_vocabulary_but_no_copies(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 20)} zonk{'abcdefgh'[i % 8]}{'klmno'[i // 8 % 5]}q {prose(rng, 20)}", 1) for i in range(1000)]
    rows += [(i, prose(rng, 40), 0) for i in range(1000, 2000)]
    copied = f"{prose(rng, 30)} harmlessword {prose(rng, 30)}"
    rows += [(i, f"{copied} {prose(rng, 1)}", 1) for i in range(2000, 2060)]
    lexicon = toxicity.fit_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    insults = {t.split()[20] for _, t, y in rows[:1000]}
    assert len(insults) == 40 and all(lexicon.score(f" you {w} ") > 0.5 for w in insults)
    assert lexicon.weight(" harmlessword ") == 0


def test_folding():
    assert toxicity.folded("  1d10t, IDІOT! m0rоn $cum") == " idiot idiot moron scum "
    assert toxicity.folded(None) == toxicity.folded("") == " " and toxicity.folded("in 2024, 7 of 9") == " in of "
    lexicon = toxicity.Lexicon({" trash ": 3.0})
    assert lexicon.weight(" the trash can is full ") == 0 < lexicon.weight(" you trash ")


def test_scores_of_awkward_rows(docs, no_docs, labelled, awkward):
    _, labels = labelled
    scored = toxicity.toxicity(docs, labels.limit(0))
    assert scored.count() == len(awkward) and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    space = quality.fit_quality(docs, labels)
    rated = quality.with_quality(docs, space)
    assert rated.count() == len(awkward) and rated.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    empty = quality.fit_quality(no_docs, labels.limit(0))
    assert quality.with_quality(docs, empty).filter("score = 0.5").count() == len(awkward)
    assert quality.with_quality(no_docs, empty).count() == 0


def test_quality_votes(labelled):
    docs, labels = labelled
    assert accuracy(quality.with_quality(docs, quality.fit_quality(docs, labels)), labels, "quality") > 0.98


def test_quality_votes_equal_plain_votes(labelled):
    docs, labels = labelled
    space = quality.fit_quality(docs, labels)
    texts = [r["text"] for r in docs.limit(40).collect()]
    x = space.embed(quality.term_counts(texts))
    for row, score in zip(x, space.score(x), strict=True):
        near = sorted(range(len(space.labels)), key=lambda i: -float(row @ space.vectors[i]))[: space.neighbours]
        weight = [max(0.0, float(row @ space.vectors[i])) ** space.power for i in near]
        assert score == pytest.approx(sum(w * space.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), rel=1e-3)


def test_byte_classes_are_apart():
    code, cyrillic, accents = (quality.term_counts([t])[0][: quality.PAIRS] for t in ("{}[]|~^", "привет", "éàü"))
    assert not (code * cyrillic).any() and not (code * accents).any() and not (cyrillic * accents)[quality._CLASS[0xD0] :: quality.CLASSES].any()


def test_hits_equal_a_plain_search():
    lexicon = toxicity.Lexicon({" zonk ": 2.0, " blor": 1.5, " blorfest ": 3.0, " the": -1.0}, exceptions=("zonk valve",))
    line = toxicity.folded("The zonk valve, a Zonk! blorfest blorish theatre zоnk")
    want = {}
    covered = [(m, m + len(" zonk valve ")) for m in range(len(line)) if line.startswith(" zonk valve ", m)]
    for entry, weight in lexicon.weights.items():
        for a in range(len(line)):
            b = a + len(entry)
            if line.startswith(entry, a) and not any(x <= a and b <= y for x, y in covered) and weight > want.get(a, (0, float("-inf")))[1]:
                want[a] = (b, weight)
    assert sorted(lexicon.hits(line)) == sorted((a, b, w) for a, (b, w) in want.items())


def test_toxicity_without_documents_or_labels(no_docs, docs, labelled, awkward):
    _, labels = labelled
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.toxicity(docs, labels).count() == len(awkward)


def test_a_sample_is_bounded_in_rows_too(spark):
    from skein.llm.labels import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", folds=7, held_out=6, per_label=10).count() == 11


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.queries())
    assert numbers == list(range(1, 11))
