"""Token counts against the library itself."""

import json
import random
from collections import Counter

import pytest

from skein.llm import tokens
from tests.llm.conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'r", "'ll", "the", "ing", "1", "23", "!", "é", "漢", "字", "\x1c", "<|endoftext|>", "<|", "text|>"]
PARTS += ["\U0001f600", "aa", "I'm", "\t", "--", "....", "́", "​", " ", "　", "Ⅷ", "ǅ", "。", "՘"]


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return json.load(f)


def texts():
    rng = random.Random(7)
    for _ in range(8000):
        yield "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
    for _ in range(400):
        yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x4E00, 0x4FFF), rng.randint(0, 0x2FFF)])) for _ in range(60))
    yield from (c * n for c in "a 1=\n漢'" for n in range(1, 120, 7))


def test_transducer_counts_as_the_library(spec, library):
    machine = tokens.Transducer(spec)
    for text in texts():
        assert machine.count(text) == library(text), repr(text)


def test_clearing_the_table_changes_nothing(spec, library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    machine = tokens.Transducer(spec)
    for text in list(texts())[::40]:
        assert machine.count(text) == library(text)


@pytest.mark.parametrize("size", [1, 2, 5, 17])
def test_chunk_maps_compose_to_the_whole(spec, library, size):
    machine = tokens.Transducer(spec)
    for text in list(texts())[:: 20 * size]:
        maps = [machine.chunk_map(text[at : at + size]) for at in range(0, len(text), size)]
        prefixes = machine.scanned(maps)
        assert len(prefixes) == len(maps)
        for i, upto in enumerate(prefixes):
            assert machine.total(upto) == library(text[: (i + 1) * size]), repr(text)


def test_composition_is_associative(spec):
    machine, rng = tokens.Transducer(spec), random.Random(2)
    for _ in range(200):
        a, b, c = (machine.chunk_map("".join(rng.choice(PARTS) for _ in range(4))) for _ in range(3))
        join = machine.compose
        assert machine.total(join(join(a, b), c)) == machine.total(join(a, join(b, c)))


def test_counts_of_a_table(spark, docs, no_docs, awkward, library):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    more = [(900, "a" * 70_000), (901, "漢字" * 3000 + "<|endoftext|>" + prose(rng, 9000)), (902, " \n" * 4000), (903, "x" * 999), (903, "x" * 1001)]
    rows = [(d, t) for d, t, _ in awkward] + more + [(None, "no id"), (904, "<|endoftext|>")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"n_tokens": F.lit("x"), "row": F.lit(1), "nth": F.lit(2)})
    want = Counter((d, len((t or "").encode()), n := library(t), n > 1024) for d, t in rows)
    for chunk in (tokens.CHUNK, 1000):
        found = tokens.count_tokens(table, PATH, chunk=chunk)
        assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(tuple(r) for r in found.collect()) == want
    assert tokens.count_tokens(no_docs, PATH).count() == 0


def test_other_tokenizers_are_refused(spark, docs, spec):
    with pytest.raises(ValueError, match="json"):
        tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(ValueError, match="byte-level"):
        tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="earlier"):
        tokens.Transducer(spec | {"model": spec["model"] | {"merges": [["qq", "q"]]}})
