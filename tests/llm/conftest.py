import random

import pytest

SYLLABLES = "re th an on er ti en st ha ou ing ed wh sh".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows of (doc_id, text, source): nulls, empties, repeats, a long text."""
    rng = random.Random(11)
    base = prose(rng, 80)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "   \n", None), (103, base, "a"), (104, base, "b"), (104, base, "b"), (105, base.upper(), "c")]
    rows += [(106, prose(rng, 30_000), "long"), (107, "x", "a"), (108, "é\U0001f600 É one two", "a")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The awkward rows with columns whose names the operators use themselves."""
    rows = [(d, t, "en", s, len(t or ""), 0.5, "x", 1, "y") for d, t, s in awkward]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, size string, shard int, sig string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
