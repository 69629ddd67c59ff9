"""Arrow batches in small pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Texts whose finds a Python worker holds at once.
PIECE_ROWS = 256


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in views of at most `rows`; nothing is copied. Finds are
    many times larger as Python objects than in Arrow, so that those of a whole
    batch would fill a worker; a piece's leave before the next one's are made."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
