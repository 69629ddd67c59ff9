"""Places and lines of finds against Python's own."""

import random
import re
from collections import Counter

from skein.operators import places


def test_places_and_lines_are_python_s(spark):
    rng = random.Random(4)
    texts = ["", None, "ab", "\n", "\n\nab\n", "xabab\nab", "é\U0001f600ab\n ab", "a\nb a\nb"]
    texts += ["".join(rng.choice(["ab", "a", "b", "\n", " ", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts.append("".join(rng.choice(["ab", "x", "\n"]) for _ in range(60_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    for pattern in ("ab+", "a\\s*b"):
        want = Counter()
        for i, text in rows:
            for k, m in enumerate(re.finditer(pattern, text or "")):
                want[i, k, m.start(), (text or "").count("\n", 0, m.start()) + 1, m[0]] += 1
        found = places.find_lines(spark.createDataFrame(rows, "doc_id long, content string").repartition(3), pattern)
        assert Counter(tuple(r) for r in found.collect()) == want
