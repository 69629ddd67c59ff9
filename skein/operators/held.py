"""Which words of a vocabulary texts hold, and whether they hold long runs: one
pass over their bytes for all words."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators.batches import PIECE_ROWS

#: Bits of a character's class; three of them begin a word.
BITS = 7
#: Runs of letters, digits, + and / of this length count as long.
LONG_RUN = 16


def _tree(words: Iterable[str]) -> str:
    """An expression for the longest of some lower-case words, in any case, as a
    tree by characters."""
    by_first: dict[str, set[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], set()).add(w[1:])
    whole = by_first.pop("", None) is not None
    each = [(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c)) + _tree(by_first[c]) for c in sorted(by_first)]
    return (f"(?:{'|'.join(each)})" + "?" * whole) if each else ""


Finder = tuple[np.ndarray, np.ndarray, "re.Pattern[bytes]"]


def _finder(vocabulary: frozenset[str]) -> Finder:
    """Classes of bytes (0: in no word), which three classes begin a word, and
    the expression that takes the longest word at a place."""
    chars = sorted(set("".join(vocabulary)))
    if len(chars) >= 1 << BITS or not all(c.isascii() and c == c.lower() for c in chars) or "" in vocabulary:
        raise ValueError("a vocabulary has words of lower-case ASCII")
    classes, number = np.zeros(256, np.uint32), {c: i for i, c in enumerate(chars, 1)}
    for c, i in number.items():
        classes[[ord(c), ord(c.upper())]] = i
    starts = np.zeros((1 << BITS,) * 3, bool)
    for w in vocabulary:
        starts[tuple(number[c] for c in w[:3])] = True
    return classes, starts.reshape(-1), re.compile(_tree(vocabulary).encode())


_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = True


def _held(texts: pa.Array, finder: Finder) -> pa.Array:
    classes, starts, words = finder
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if ends[-1] > ends[0] else b""
    ends = ends[1:] - ends[0]
    data = np.frombuffer(raw, np.uint8)
    c = np.zeros(len(raw) + 2, np.uint32)
    c[: len(raw)] = classes[data]
    at = np.flatnonzero(starts[(c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]])
    found: list[dict[bytes, None]] = [{} for _ in range(len(texts))]
    rows = np.searchsorted(ends, at, side="right")
    for place, row, end in zip(at.tolist(), rows.tolist(), ends[rows].tolist(), strict=True):
        if m := words.match(raw, place, end):
            found[row][m[0]] = None
    # A run may seem to go on in the next text; what is asked then is the text.
    breaks = np.concatenate([[-1], np.flatnonzero(~_IN_RUN[data]), [len(raw)]])
    long = np.flatnonzero(np.diff(breaks) > LONG_RUN)
    runs = np.zeros(len(texts), bool)
    for first, last in zip(np.searchsorted(ends, breaks[long] + 1, side="right").tolist(), np.searchsorted(ends, breaks[long + 1] - 1, side="right").tolist(), strict=True):
        runs[first : last + 1] = True
    return pa.StructArray.from_arrays([pa.array([b"\n".join(f).decode() for f in found], pa.string()), pa.array(runs)], ["words", "runs"])


def held(content: Column, vocabulary: frozenset[str]) -> Column:
    """struct<words, runs> of texts without nulls. `words` are those of the
    vocabulary (lower case, ASCII) that a text holds, as written there, one a
    line: a word without line ends stands in the text, in any case or a certain
    one, if and only if it stands in `words`, as at each place the longest is
    taken, which begins with all others. `runs` is true where there may be a run
    of LONG_RUN letters, digits, + and /, and false where there is none."""

    @F.arrow_udf("struct<words: string, runs: boolean>")
    def find(texts: pa.Array) -> pa.Array:
        finder = _finder(vocabulary)
        each = [_held(texts.slice(at, PIECE_ROWS), finder) for at in range(0, len(texts), PIECE_ROWS)]
        return pa.concat_arrays(each) if each else _held(texts, finder)

    return find(content)
