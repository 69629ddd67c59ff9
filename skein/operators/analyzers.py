"""Analyzers by name, with their faults as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.operators import offsets
from skein.operators.batches import pieces

#: An analyzer gives what it finds in a text, as anything JSON can hold.
Analyzer = Callable[[str], Iterable[object]]
ANALYZERS: dict[str, Analyzer] = {"folded_literals": offsets.folded_of, "crypto_places": offsets.crypto_places}
# Fixed value: characters kept of a fault's message.
MESSAGE = 240
ROWS = "analyzer string, ordinal long, value string, error string"


def analyzed(documents: DataFrame, analyzers: Mapping[str, Analyzer] = ANALYZERS) -> DataFrame:
    """doc_id, analyzer, ordinal, value, error: what each analyzer finds in each
    document (doc_id, content), as JSON in order, or one row with its fault.

    All analyzers share one pass over the texts. A fault is caught where it
    happens: it costs one analyzer's finds of one document, those found before
    it included, and neither other analyzers, other documents nor the job. Null
    texts are read as empty; repeated rows each give theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, analyze in analyzers.items():
                    try:
                        found = [json.dumps(x, ensure_ascii=False) for x in analyze(text.as_py() or "")]
                    except Exception as error:  # noqa: BLE001 - any fault becomes a row
                        out.append((doc_id, name, 0, None, f"{type(error).__name__}: {error}"[:MESSAGE]))
                    else:
                        out += [(doc_id, name, i, value, None) for i, value in enumerate(found)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "analyzer", "ordinal", "value", "error"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {ROWS}")


def finds(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NULL").drop("error")


def errors(rows: DataFrame) -> DataFrame:
    """doc_id, analyzer, error."""
    return rows.filter("error IS NOT NULL").select("doc_id", "analyzer", "error")
