"""Merkle manifests against a plain tree."""

import hashlib
import zlib
from collections import Counter

import pytest

from skein.llm import manifest
from tests.llm.brute import UP

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """The root, and each leaf's way up as (left, right) pairs."""
    paths, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, held = [], []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            above.append(sha("".join(run)))
            held.append([i for own in owners[at : at + 16] for i in own])
            for k, own in enumerate(owners[at : at + 16]):
                for i in own:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, owners = above, held
    return (level[0] if level else None), paths


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held, subroots = {}, []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        sub, paths = plain_tree([leaf(*r) for r in mine])
        held[s] = (mine, paths)
        subroots.append(sub)
    root, above = plain_tree(subroots)
    out = []
    for s, sub, up in zip(sources, subroots, above, strict=True):
        for r, path in zip(*held[s], strict=True):
            node = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(*r[:4], r[4] if r[4] is None else r[4].translate(UP))
            way = path + up
            for left, right in way:
                node = sha(left + node + right)
            out.append((r[0], leaf(*r), sub, root, sha("".join(a + b for a, b in way)), node, node == root))
    return out


def got(df):
    return Counter(tuple(r) for r in df.collect())


def make(spark, rows):
    from pyspark.sql import functions as F

    clash = {"place": F.lit(1), "digest": F.lit("x"), "run": F.lit(2), "grp": F.lit("y"), "size": F.lit(0)}
    return spark.createDataFrame(rows, COLUMNS).repartition(3).withColumns(clash)


def awkward_rows():
    rows = [(i, "hot", "en", i * 3, f"Text {i} of É") for i in range(300)]
    rows += [(1000 + i, None, None, None, None if i % 2 else "") for i in range(17)]
    rows += [(2000, "lone", "de", 1, "ONE"), (None, "hot", "en", 2, "no id"), (None, None, None, None, None)]
    rows += [(5, "twice", "en", 4, "Same Id"), (5, "twice", "en", 4, "Other Text"), (7, "twice", "en", 4, "same"), (7, "twice", "en", 4, "same")]
    rows += [(3000, "ä", "x", -1, "Long " * 20_000), (3001, "", "x", 0, ":-"), (3002, "Z", "x", 0, "A\U0001f600Z")]
    return rows


def test_manifest_equals_a_plain_tree(spark):
    rows = awkward_rows()
    assert got(manifest.merkle_manifest(make(spark, rows))) == Counter(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert got(manifest.merkle_manifest(make(spark, rows))) == Counter(plain_manifest(rows))


def test_many_sources_make_a_tree_of_their_own(spark):
    rows = [(i, f"s{i % 270}", "en", i, "T") for i in range(280)]
    found = manifest.merkle_manifest(make(spark, rows))
    assert got(found) == Counter(plain_manifest(rows))


def test_fields_are_told_apart():
    assert leaf(1, "a", None, 1, "b") != leaf(1, "a", "-", 1, "b") and leaf(1, "ab", "c", 1, "") != leaf(1, "a", "bc", 1, "")
