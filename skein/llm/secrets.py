"""Secret scans: fixed patterns, and guess costs of credential values."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import bound_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "guess")

#: Fixed patterns of the base scan.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Names that put the value after them into credential context.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client)[_-]?key)"
    r"[\"']?\x20*[:=]\x20*[\"']?([^\s\"',;<>(){}]{6,})",
    re.I | re.A,
)
#: A cheap test that some name of CONTEXT or ASSIGN may occur.
NAMED = re.compile(r"[:=]")

#: Words that guessers try first, most frequent first.
COMMON_WORDS = (
    "password", "secret", "token", "admin", "welcome", "letmein", "dragon", "monkey", "master", "login",
    "qwerty", "hello", "summer", "winter", "spring", "autumn", "test", "user", "root", "default",
    "changeme", "example", "sample", "dummy", "love", "shadow", "sunshine", "princess", "football", "baseball",
    "iloveyou", "superman", "batman", "computer", "internet", "server", "database", "access", "public", "private",
    "none", "null", "undefined", "placeholder", "your", "here", "value", "key", "pass", "word",
)
#: The keyboard's rows, each shifted half a key against the one above.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl;", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oieastasi")
#: Blocks of up to so many characters count as repeated; longer ones are
#: priced by what they hold.
LONGEST_BLOCK = 32
#: log10 costs: of one more span, of a key to begin at, of each turn of a walk,
#: and of copying a block.
SPAN, KEY, TURN, COPY = 0.3, math.log10(47), math.log10(8), 1.3
#: From this cost on a value is beyond any guessing; its exact cost is not sought.
ENOUGH = 30.0

_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE_REACH = 10


def _steps() -> dict[tuple[str, str], frozenset[tuple[int, int]]]:
    """The directions from one key to the next: along a row, to the rows above
    and below, and from a letter to its neighbours in the alphabet, which for
    some pairs are both."""
    at = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    beside = {(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)}
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = {(a, b): {(d, 9)} for d in (1, -1) for a, b in zip(letters[::d], letters[::d][1:], strict=False)}
    for a, (x, y) in at.items():
        for b, (x2, y2) in at.items():
            if (x2 - x, y2 - y) in beside:
                out.setdefault((a, b), set()).add((x2 - x, y2 - y))
    return {pair: frozenset(ways) for pair, ways in out.items()}


_STEP = _steps()
_NO_STEP: frozenset[tuple[int, int]] = frozenset()


class Dictionary:
    """Words by rank: those that guessers try first, then `words` in order."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*COMMON_WORDS, *words):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


def vocabulary_words(path: str) -> list[str]:
    """Whole words of three letters or more in a public BPE vocabulary with
    word ends (JSON, `model.vocab`), in the order in which they were merged."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, t[:-4]) for t, i in vocab.items() if t.endswith("</w>"))
    return [w for _, w in words if len(w) >= 3 and w.isascii() and w.isalpha()]


PLAIN = Dictionary()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


def _jumps(value: str, dictionary: Dictionary) -> Iterator[list[tuple[int, float]]]:
    """For each place of `value`: (end, cost) of the words and dates that begin there."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    rank, longest = dictionary.rank, dictionary.longest
    for i in range(n):
        out = []
        if value[i].isdigit():
            out += [(m.end(), math.log10(365 * 120)) for m in [_DATE.match(value, i)] if m]
            out += [(m.end(), math.log10(120)) for m in [_YEAR.match(value, i)] if m]
        for end in range(i + 3, min(n, i + longest) + 1):
            if r := rank.get(plain[i:end]):
                twists = 1 + (value[i:end] != low[i:end]) + 2 * (low[i:end] != plain[i:end])
                out.append((end, math.log10(r * twists + 1)))
        yield out


def guess_cost(value: str, dictionary: Dictionary = PLAIN) -> float:
    """log10 of the guesses that the cheapest segmentation of `value` needs.

    Spans are words (any case, digits for letters), dates, keyboard and
    alphabet walks, copies of the block before (of up to LONGEST_BLOCK
    characters), and single brute-force characters. A span of more than one
    character costs SPAN besides, unless it begins the value, as each doubles
    the orders in which a guesser tries. A walk costs its first key, a
    direction, and each further turn; a copy costs COPY, however long.

    Dynamic programming over the places of `value`: the least cost of a cover
    that ends there, and of one that is inside a walk, or a copy of each
    period. From ENOUGH on, the least of them is returned as a lower bound.
    "" costs 0.
    """
    n, low = len(value), value.lower() if len(value.lower()) == len(value) else value
    best = [0.0] + [math.inf] * n
    walks: dict[tuple[int, int], float] = {}  # costs of walks that end here, by last direction
    copies: dict[int, float] = {}
    reach = max(dictionary.longest, _DATE_REACH)
    for i, jumps in enumerate(_jumps(value, dictionary)):
        here, more = best[i], SPAN if i else 0.0
        best[i + 1] = min(best[i + 1], here + _brute(value[i]))
        for end, cost in jumps:
            best[end] = min(best[end], here + more + cost)
        going: dict[int, float] = {}
        for p in range(1, min(i, LONGEST_BLOCK) + 1):
            if value[i] == value[i - p]:
                going[p] = min(copies.get(p, math.inf), here + SPAN + COPY)
        copies = going
        if i:
            begun = min([best[i - 1] + (SPAN if i > 1 else 0.0) + KEY, *walks.values()]) + TURN
            walks = {step: min(begun, walks.get(step, math.inf)) for step in _STEP.get((low[i - 1], low[i]), _NO_STEP)}
        best[i + 1] = min([best[i + 1], *walks.values(), *copies.values()])
        if best[i + 1] >= ENOUGH and (least := min(best[max(0, i + 2 - reach) : i + 2])) >= ENOUGH:
            return least
    return best[n]


def secret_spans(text: str | None, least: float = 9.0, dictionary: Dictionary = PLAIN) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses) by start, then kind. Positions count
    code points; null and empty texts have none."""
    if not text:
        return []
    found: list[tuple[str, int, int, float | None]] = []
    if NAMED.search(text):
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        for m in CONTEXT.finditer(text):
            if (cost := guess_cost(m[1], dictionary)) >= least:
                found.append(("guess", *m.span(1), cost))
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
SPANS_DDL = "array<struct<kind:string,start:long,end:long,log10_guesses:double>>"


def scan_secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: float = 9.0, words: Sequence[str] = ()) -> DataFrame:
    """One row per document with all its secret spans.

    Base spans come from three fixed patterns; the method adds `guess` spans:
    values in credential context whose guess cost (guess_cost) reaches 10 to
    the power `least`. `words` (bounded by the caller) are guessed after the
    built-in ones. Rows keep their number, repeated ones too; null or empty
    texts have an empty list; no rows give no rows; texts are scanned whole,
    however long; other columns of the input are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(Dictionary(words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(1):
                spans.append([dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in secret_spans(value.as_py(), least, held.value)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["id", "spans"])

    bound_batches(docs.sparkSession)
    kind = dict(docs.select(id).dtypes)[id]
    return docs.select(id, text).mapInArrow(scan, f"id {kind}, spans {SPANS_DDL}").withColumnRenamed("id", id)
