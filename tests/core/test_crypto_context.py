"""Contexts around crypto signals against plain versions."""

import random

import pytest

from skein.operators import crypto_context as cc
from skein.operators import offsets

SCRIPT = """import { Enc as e, Other } from "./lib/chunk-C1.js";
import { Plain } from './plain.js'; import {U} from "./chunk-U2.js"; import {V} from "chunk-V3.js"; import {W} from "chunk-W4.js";
function seal(v) { const key = "k"; return CryptoJS.AES.encrypt(v, key); }
function open_(v) { return decrypt(v) }
function plain(v) { return v }
this.svc = e; other = U;
this.svc.decryptData(x);
"""


def texts():
    rng = random.Random(3)
    words = ["CryptoJS", "AES", "encrypt(", "SHA256", "x" * 90, "\n", "function f(a) {", "decrypt me", "cbc ", "y" * 300, "var k = 1;", "aes line"]
    return [SCRIPT, "", None, "no signal at all", "import { A } from 'b'"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]


@pytest.fixture(scope="module")
def made(spark):
    rows = list(enumerate(texts()))
    return cc.facts(spark.createDataFrame(rows, "doc_id long, content string").repartition(3)).persist()


def plain_windows(text):
    return sorted((max(0, at - 220), min(len(text), at + 220), at, value) for kind, _, value, at, _ in cc.facts_of(text or "") if kind == "signal")


def test_contexts_are_unions_of_windows(made):
    want = {}
    for doc, text in enumerate(texts()):
        spans = []
        for b, e, _, _ in plain_windows(text):
            if spans and b <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([b, e])
        want |= {(doc, b): (e, text[b:e], sorted(v for s, _, at, v in plain_windows(text) if b <= s and at < e)) for b, e in spans}
    got = {(r["doc_id"], r["start"]): (r["end"], r["text"], sorted(r["signals"])) for r in cc.contexts(made).collect()}
    assert got == want and len(got) > 40


def test_flows_know_the_function_that_holds_them(made):
    want = set()
    for doc, text in enumerate(texts()):
        facts = cc.facts_of(text or "")
        begins = [(at, name) for kind, name, _, at, _ in facts if kind == "function"]
        for kind, name, value, at, _ in facts:
            if kind == "signal":
                near = max((b for b in begins if b[0] <= at), default=None)
                want.add((doc, value, name, at, near[1] if near and at < near[0] + 400 else None))
    assert {(r["doc_id"], r["signal"], r["category"], r["at"], r["function"]) for r in cc.flows(made).collect()} == want


def test_snippets_functions_and_targets(made):
    of = lambda df: [tuple(r)[1:] for r in df.filter("doc_id = 0").orderBy("nth").collect()]
    assert [name for _, name, _, _ in of(cc.functions(made))] == ["seal", "open_", "plain"]
    assert any("encrypt(v, key)" in line for _, line in of(cc.snippets(made)))
    assert any("key" in line for _, line in of(cc.deep_lines(made)))
    assert of(cc.targets(made)) == [(1, "chunk-C1.js", "service"), (2, "chunk-U2.js", "import"), (3, "chunk-V3.js", "import")]
    assert cc.contexts(made.limit(0)).count() == cc.flows(made.limit(0)).count() == cc.targets(made.limit(0)).count() == 0


def test_keys_near_signals_by_binary_search():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.randint(0, 3000) for _ in range(rng.randint(0, 8)))
        at = rng.randint(0, 3000)
        assert offsets.within(places, at, 399) == any(abs(p - at) <= 399 for p in places)
