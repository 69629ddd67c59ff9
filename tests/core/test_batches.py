"""Python workers hold the finds of a few texts at a time."""

import tracemalloc

import pyarrow as pa
import pytest

from skein.operators import analyzers, batches, crypto_context, offsets, requests, structure, taint

SCRIPT = 'import { A } from "./chunk-A1.js";\nfunction seal(v) { return CryptoJS.AES.encrypt(v, "k"); }\nfetch("/api/x");\n' + "el.innerHTML = location.hash;\n" * 8


class Documents:
    """Takes the Python step of an operator from the plan it is put in."""

    dtypes = (("doc_id", "bigint"),)

    def select(self, *_):
        return self

    filter = selectExpr = select

    def __getattr__(self, name):
        if name == "mapInArrow":
            return self._take
        raise AttributeError(name)

    def _take(self, run, _):
        self.run = run
        return self


def test_pieces_are_all_rows_in_order():
    made = [pa.RecordBatch.from_pydict({"doc_id": list(range(n))}) for n in (0, 1, 5, 12)]
    cut = list(batches.pieces(made, 5))
    assert [b.num_rows for b in cut] == [1, 5, 5, 5, 2]
    assert [x for b in cut for x in b.column(0).to_pylist()] == [x for b in made for x in b.column(0).to_pylist()]


@pytest.mark.parametrize("operator", [crypto_context.facts, taint.flows, requests.attack_surface, structure.script_structure, analyzers.analyzed, offsets.crypto_material])
def test_a_large_batch_leaves_in_pieces(spark, operator):
    documents = Documents()
    operator(documents)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "content": [SCRIPT] * 600})
    out = list(documents.run(iter([batch])))
    assert [len(set(b.column(0).to_pylist())) for b in out] == [256, 256, 88]
    assert sorted({x for b in out for x in b.column(0).to_pylist()}) == list(range(600))


def test_memory_of_facts_does_not_grow_with_the_batch(spark):
    documents = Documents()
    crypto_context.facts(documents)

    def peak(n):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "content": [SCRIPT] * n})
        tracemalloc.start()
        for _ in documents.run(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(4096) < 2 * peak(512)
