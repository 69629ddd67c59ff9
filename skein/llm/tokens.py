"""Token counts by a tokenizer compiled to a deterministic transducer."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import batches_of, materialize

#: Characters of one chunk; longer texts are dealt to tasks by chunks.
CHUNK = 32_768
#: Transitions that a worker keeps before it starts anew; about 200 MB.
KEPT = 600_000
#: Bytes of a tokenizer file; it is broadcast.
FILE_BYTES = 64_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 for itself, the other bytes for U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What bars a token that may begin at a place: pairs of a token that it would
#: first be merged to there, and the rank from which on it is safe.
Bars = tuple[tuple[int, int], ...]


class Merges:
    """A byte-level BPE model: its tokens as a trie over bytes, and the order of
    its merges, which tells whether two tokens can stand side by side.

    Two tokens join if some merge across their border comes before both its
    sides have merged with others; of equal merges the leftmost is first. So the
    left token bars some of what may lie at the right one's left end, up to a
    rank; what it bars is all that the right one has to know of it.
    """

    def __init__(self, model: dict) -> None:
        letters = byte_letters()
        self.children: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.path: list[bytes] = [b""]
        self.inner: set[int] = set()
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.spelled: list[bytes] = []
        #: For a token and a byte: the merges with a token that begins with it.
        self.onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
        ids: dict[str, int] = {}
        for letter, byte in letters.items():
            ids[letter] = len(ids)
            self._add(bytes([byte]))
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a not in ids or b not in ids:
                raise ValueError(f"merge {rank} joins what no earlier merge gives")
            if a + b in ids:
                raise ValueError(f"two merges give {a + b!r}")
            x, y = ids[a], ids[b]
            ids[a + b] = token = len(ids)
            self.parts[token] = (x, y, rank)
            self.onward.setdefault((x, self.spelled[y][0]), []).append((y, rank))
            self._add(self.spelled[x] + self.spelled[y])
        #: A state lists the places where a longer token may have begun: the
        #: trie node reached from there, what bars it, and the count of tokens
        #: there, less the count now. At the place itself stands the last token.
        self.start = ((0, -1, 0),)

    def _add(self, spelled: bytes) -> None:
        token, node = len(self.spelled), 0
        self.spelled.append(spelled)
        for byte in spelled:
            self.inner.add(node)
            child = self.children.get(node << 8 | byte)
            if child is None:
                child = self.children[node << 8 | byte] = len(self.token)
                self.token.append(-1)
                self.path.append(self.path[node] + bytes([byte]))
            node = child
        self.token[node] = token

    def _left(self, node: int, bars: Bars) -> Bars:
        """The bars that still matter below a node: of tokens on the way to it,
        or beyond it."""
        path = self.path[node]
        return tuple(b for b in bars if (spelled := self.spelled[b[0]]).startswith(path) or path.startswith(spelled)) if bars else bars

    def _bars(self, last: int, byte: int) -> Bars:
        """What a token bars in those that begin with a byte."""
        out: dict[int, int] = {}
        until = len(self.parts)
        while True:
            for y, rank in self.onward.get((last, byte), ()):
                if rank < until and rank < out.get(y, until):
                    out[y] = rank
            if last not in self.parts:
                return tuple(sorted(out.items()))
            _, last, until = self.parts[last]

    def _barred(self, token: int, bars: Bars) -> bool:
        if not bars:
            return False
        from_rank, until = dict(bars), len(self.parts)
        while True:
            if from_rank.get(token, until + 1) <= until:
                return True
            if token not in self.parts:
                return False
            token, _, until = self.parts[token]

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and by how much the count of tokens
        changes. What is merged up to a place is settled by the last token: it
        is the one that stands apart from the one before it."""
        kept, last, change = [], -1, 0
        for node, bars, count in state:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            if node == 0:
                bars = self._bars(bars, byte) if bars >= 0 else ()
            token = self.token[child]
            if token >= 0 and not self._barred(token, bars):
                last, change = token, count + 1
            if child in self.inner:
                kept.append((child, bars, count))
        return (*((n, self._left(n, b), c - change) for n, b, c in kept), (0, last, 0)), change

class _Open(dict):
    """A state within one piece of text; bytes to (state, change), when met."""

    __slots__ = ("entries", "of")

    def __init__(self, of: Transducer, entries: tuple) -> None:
        self.of, self.entries = of, entries

    def __missing__(self, byte: int) -> tuple[_Open, int]:
        entries, change = self.of.merges.step(self.entries, byte)
        hit = self[byte] = (self.of.open_state(entries), change)
        self.of.size += 1
        return hit


class _State(dict):
    """A state of the transducer: characters to (state, tokens emitted), when met.

    `mode` says what is open: nothing (""), a run of letters, numbers or others
    (L, N, O), blanks (S; all but the last are in `open`), or an apostrophe that
    may begin an ending (A). `pending` is read but not yet in `open`; `final`
    are the tokens it adds where the text ends.
    """

    __slots__ = ("final", "mode", "of", "open", "pending")

    def __init__(self, of: Transducer, mode: str, open_: _Open, pending: str) -> None:
        self.of, self.mode, self.open, self.pending = of, mode, open_, pending
        self.final = of.ended(self) if pending else 0

    def __missing__(self, char: str) -> tuple[_State, int]:
        hit = self[char] = self.of.read(self, char)
        self.of.size += 1
        return hit


#: Endings that are tokens' own pieces after an apostrophe: fixed values.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Transducer:
    """The splitter and the merges as one machine over characters. States and
    transitions are worked out when first met; past KEPT transitions, between
    texts, the table is cleared.

    Pieces are: endings; runs of letters, of numbers, and of others, each with
    one space before it; and blanks, of which the last is left to the next piece.
    The classes of characters are asked of the installed library's splitter, so
    that its version of Unicode decides.
    """

    def __init__(self, spec: dict) -> None:
        splitter = spec.get("pre_tokenizer") or {}
        model = spec.get("model") or {}
        plain = not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or model.get("type") != "BPE" or not plain:
            raise ValueError("only byte-level BPE tokenizers without normalizer or prefix space are compiled")
        added = spec.get("added_tokens") or []
        if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their neighbourhood are not compiled")
        from tokenizers import pre_tokenizers

        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.merges = Merges(model)
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        inside = {c for n in names for c in n[1:]}
        stops = "".join(re.escape(c) for c in ",.;:!?。、，！？" if c not in inside)
        blanks = "".join(re.escape(c) for c in " \t\n\r" if c not in inside)
        #: Places where a piece begins, whatever stands around: between a letter
        #: or number and a stop, and before the first of some blanks.
        self.sure = re.compile(rf"(?<=[^\W_])(?=[{stops}])|(?<=\S)(?=[{blanks}])")
        self._classes: dict[str, str] = {}
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self._opens: dict[tuple, _Open] = {}
        self._states: dict[tuple, _State] = {}
        self._empty = self.open_state(self.merges.start)
        self.start = self._state("", self._empty, "")

    def open_state(self, entries: tuple) -> _Open:
        found = self._opens.get(entries)
        if found is None:
            found = self._opens[entries] = _Open(self, entries)
        return found

    def _state(self, mode: str, open_: _Open, pending: str) -> _State:
        key = (mode, id(open_), pending)
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = _State(self, mode, open_, pending)
        return found

    def kind(self, char: str) -> str:
        """L, N, O or S: the run that the library joins a character to."""
        found = self._classes.get(char)
        if found is None:
            alone = lambda lead: len(self._split(lead + char)) == 1
            found = self._classes[char] = next((k for lead, k in (("a", "L"), ("1", "N"), ("!", "O")) if alone(lead)), "S")
        return found

    @staticmethod
    def _along(open_: _Open, text: str) -> tuple[_Open, int]:
        total = 0
        for byte in text.encode():
            open_, change = open_[byte]
            total += change
        return open_, total

    def ended(self, state: _State) -> int:
        """Tokens of what is pending where the text ends."""
        if state.mode == "A":
            return sum(self._along(self._empty, piece)[1] for piece in (state.pending[:1], state.pending[1:]) if piece)
        return self._along(state.open, state.pending)[1]

    def read(self, state: _State, char: str) -> tuple[_State, int]:
        """One transition."""
        kind, mode, pending = self.kind(char), state.mode, state.pending
        if mode == "A":
            grown = pending + char
            if grown in ENDINGS:
                return self.start, self._along(self._empty, grown)[1]
            if any(e.startswith(grown) for e in ENDINGS):
                return self._state("A", self._empty, grown), 0
            # No ending: the apostrophe opens a run of others, the rest follows.
            open_, total = self._along(self._empty, "'")
            now = self._state("O", open_, "")
            for c in grown[1:]:
                now, more = self.read(now, c)
                total += more
            return now, total
        if mode == "S":
            if kind == "S":
                open_, total = self._along(state.open, pending)
                return self._state("S", open_, char), total
            if pending == " ":
                open_, total = self._along(self._empty, pending + char)
                return self._state(kind, open_, ""), total
            now, total = self.read(self.start, char)
            return now, total + self._along(self._empty, pending)[1]
        if mode and kind == mode:
            open_, total = self._along(state.open, char)
            return self._state(mode, open_, ""), total
        if kind == "S":
            return self._state("S", self._empty, char), 0
        if char == "'":
            return self._state("A", self._empty, char), 0
        open_, total = self._along(self._empty, char)
        return self._state(kind, open_, ""), total

    def _plain(self, text: str) -> int:
        state, total = self.start, 0
        for char in text:
            state, emitted = state[char]
            total += emitted
        return total + state.final

    def count(self, text: str) -> int:
        """Tokens of a whole text; each added token inside it is one."""
        if self.size > KEPT:
            self.clear()
        if self.added is None:
            return self._plain(text)
        pieces = self.added.split(text)
        return sum(map(self._plain, pieces)) + len(pieces) - 1

    def chunk_map(self, chunk: str) -> Map:
        """What a chunk does to any state. The state before it is told by the
        text that is open there; the map adds `head` to it, emits `inner` more
        tokens, and leaves `tail` open. A chunk in which no piece begins for
        sure only adds to what is open (`inner` None)."""
        sure = [m.start() for m in self.sure.finditer(chunk)]
        if not sure:
            return chunk, None, ""
        return chunk[: sure[0]], self.count(chunk[sure[0] : sure[-1]]), chunk[sure[-1] :]

    def compose(self, first: Map, then: Map) -> Map:
        """The map of two neighbours; associative."""
        (head, inner, tail), (head2, inner2, tail2) = first, then
        if inner is None:
            return head + head2, inner2, tail2
        if inner2 is None:
            return head, inner, tail + head2
        return head, inner + self.count(tail + head2) + inner2, tail2

    def scanned(self, maps: list[Map]) -> list[Map]:
        """The maps of all prefixes: a prefix scan in rounds, each of which joins
        what lies twice as far apart, pairs first, then what lies between."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        out = [maps[0]]
        for i, upto in enumerate(self.scanned(pairs)):
            out.append(upto)
            if 2 * i + 2 < len(maps):
                out.append(self.compose(upto, maps[2 * i + 2]))
        return out

    def total(self, whole: Map) -> int:
        """The tokens that a map gives from the start to the end of a text."""
        head, inner, tail = whole
        return self.count(head) if inner is None else self.count(head) + inner + self.count(tail)


#: A chunk's effect: text that it adds to what is open before it, tokens
#: emitted within it (None: no piece begins for sure), text open behind it.
Map = tuple[str, int | None, str]

#: Compiled in a worker, by the file's digest: tables outlive a task.
_compiled: dict[str, Transducer] = {}


def _machine(spec: tuple) -> Transducer:
    """The transducer of a spec: the file's digest and its broadcast content."""
    digest, content = spec
    if digest not in _compiled:
        _compiled.clear()
        _compiled[digest] = Transducer(json.loads(content.value))
    return _compiled[digest]


_COUNTED = "doc_id {0}, n_bytes long, n_tokens long"
_CHUNKS = "row long, doc_id {0}, n_bytes long, nth int, chunk string"
_MAPS = "row long, doc_id {0}, n_bytes long, nth int, head string, inner long, tail string"

Batches = Iterator[pa.RecordBatch]


def _counting(spec: tuple) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        machine = _machine(spec)
        for b in batches:
            counts = [machine.count(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cutting(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                for nth, at in enumerate(range(0, len(text), size)):
                    row = [b.column(c).slice(i, 1) for c in ("row", "doc_id", "n_bytes")]
                    chunk = [pa.array([nth], pa.int32()), pa.array([text[at : at + size]])]
                    yield pa.RecordBatch.from_arrays([*row, *chunk], ["row", "doc_id", "n_bytes", "nth", "chunk"])

    return run


def _mapping(spec: tuple) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        machine = _machine(spec)
        for b in batches:
            heads, inners, tails = zip(*map(machine.chunk_map, b.column("chunk").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            made = [pa.array(heads, pa.string()), pa.array(inners, pa.int64()), pa.array(tails, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "n_bytes", "nth")), *made], ["row", "doc_id", "n_bytes", "nth", "head", "inner", "tail"])

    return run


def _scanning(spec: tuple) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        machine = _machine(spec)
        for b in batches:
            totals = []
            for maps in b.column("maps").to_pylist():
                prefixes = machine.scanned([(m["head"], m["inner"], m["tail"]) for m in maps])
                totals.append(machine.total(prefixes[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of
    every whole text, as the library counts them without begin, end or added
    special tokens; a special token's string inside a text is that one token.

    `tokenizer` is the path of a byte-level BPE file on the driver, which is
    broadcast (at most FILE_BYTES). Null texts count as empty, with no tokens;
    repeated rows each stay; other columns take no part; no rows give no rows.
    Texts of more than `chunk` characters are cut at fixed places and dealt to
    all tasks; the chunks' maps are gathered by row and composed.
    """
    spark = docs.sparkSession
    if not tokenizer.endswith(".json"):
        raise ValueError("only tokenizer .json files are compiled")
    content = Path(tokenizer).read_text(encoding="utf-8")
    if len(content) > FILE_BYTES:
        raise ValueError(f"{tokenizer} is too large to broadcast")
    Transducer(json.loads(content))  # refuses here what cannot be compiled
    spec = hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)
    key = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    with batches_of(spark, 256):
        short = docs.filter(~long).select("doc_id", "text", n_bytes).mapInArrow(_counting(spec), _COUNTED.format(key))
        rows = docs.filter(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", n_bytes)
        dealt = rows.mapInArrow(_cutting(chunk), _CHUNKS.format(key)).repartition("row", "nth")
        maps = dealt.mapInArrow(_mapping(spec), _MAPS.format(key))
        gathered = maps.groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("nth", "head", "inner", "tail"))).alias("maps"))
        scanned = gathered.select("doc_id", "n_bytes", "maps").mapInArrow(_scanning(spec), _COUNTED.format(key))
        counted = materialize(short.unionByName(scanned), "tokens")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
