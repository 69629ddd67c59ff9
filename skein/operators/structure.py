"""What a script is made of, counted over its tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.operators.batches import pieces
from skein.operators.script_text import tokens

_KINDS = ("imports", "exports", "declarations", "functions", "classes", "calls", "literals", "properties", "names_called", "tokens", "lines")
_NOT_CALLED = frozenset("if for while switch catch function return typeof await with".split())


def structure_of(text: str) -> tuple[dict[str, int], str]:
    """Counts by kind, and the module system."""
    toks = tokens(text)
    n = dict.fromkeys(_KINDS, 0)
    called = set()
    n["tokens"], n["lines"] = len(toks), text.count("\n") + 1 if text else 0
    for i, t in enumerate(toks):
        after = toks[i + 1].text if i + 1 < len(toks) else ""
        before = toks[i - 1].text if i else ""
        if t.kind in ("text", "number"):
            n["literals"] += 1
        if t.kind in ("name", "text") and after == ":" and before in ("{", ","):
            n["properties"] += 1
        if t.kind == "sign":
            n["functions"] += t.text == "=>"
        elif t.kind == "name" and before not in (".", "?."):
            n["imports"] += t.text == "import" and after != "("
            n["exports"] += t.text == "export"
            n["declarations"] += t.text in ("const", "let", "var")
            n["functions"] += t.text == "function"
            n["classes"] += t.text == "class"
        if t.kind == "name" and after == "(" and t.text not in _NOT_CALLED and before != "function":
            n["calls"] += 1
            k = i
            while k > 1 and toks[k - 1].text in (".", "?.") and toks[k - 2].kind == "name":
                k -= 2
            called.add(toks[k].text)
    n["names_called"] = len(called)
    system = "ES modules" if n["imports"] or n["exports"] else "CommonJS" if re.search(r"\brequire\s*\(", text) else "unknown" if text else "none detected"
    return n, system


def complexity(n: dict[str, int]) -> int:
    """A bounded score: declarations and classes count twice, functions three times."""
    return min(100, 2 * (2 * n["declarations"] + 3 * n["functions"] + 2 * n["classes"] + n["properties"] + n["names_called"]))


def script_structure(documents: DataFrame) -> DataFrame:
    """doc_id, the counts of structure_of, complexity and module_system for
    every document (doc_id, content); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [structure_of(t.as_py() or "") for t in batch.column(1)]
            counts = [pa.array([n[k] for n, _ in found], pa.int64()) for k in _KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([complexity(n) for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())],
                ["doc_id", *_KINDS, "complexity", "module_system"],
            )

    ddl = ", ".join(f"{k} long" for k in _KINDS)
    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(run, f"doc_id long, {ddl}, complexity long, module_system string")
