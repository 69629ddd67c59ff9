"""Script text as tokens, statements and constants.

A tokenizer that knows strings, comments and brackets, but no grammar: enough
to tell code from text, to cut statements, and to evaluate constant text.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<text>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|[=!]==?|[+\-*/%&|^]=|\+\+|--|&&|\|\||\?\?|\?\.|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: After these words a slash begins a regular expression, as after any sign
#: that does not end a value.
_REGEX_AHEAD = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
#: After these a brace opens a value; after anything else, a block.
_VALUE_AHEAD = frozenset("= ( , : [ return ? && || ?? + += ! const let var".split())
#: A line that ends or begins with these goes on.
_OPEN_END = frozenset("= ( , : [ ? . && || ?? + - * / % < > += -= => ! & |".split())
_OPEN_START = frozenset(". , ? : + * / % = && || ?? => ) ] ?.".split())
_CLOSER = {")": "(", "]": "[", "}": "{"}
_WRITES = frozenset("= += -= *= /= %= &= |= ^= ++ --".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    new_line: bool

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def _opens_regex(before: Token | None) -> bool:
    if before is None:
        return True
    if before.kind == "name":
        return before.text in _REGEX_AHEAD
    return before.kind == "sign" and before.text not in (")", "]", "}", "++", "--")


def tokens(source: str) -> list[Token]:
    """Tokens in order; kinds are text, name, number, sign and regex. What
    quotes inside of a regular expression hold is no text."""
    out: list[Token] = []
    broken, at = False, 0
    while m := _TOKEN.match(source, at):
        if m.lastgroup == "skip":
            broken = broken or "\n" in m[0]
        else:
            kind = m.lastgroup
            if kind == "sign" and m[0][0] == "/" and _opens_regex(out[-1] if out else None) and (literal := _REGEX.match(source, at)):
                m, kind = literal, "regex"
            out.append(Token(kind, m[0], m.start(), broken))
            broken = False
        at = m.end()
    return out


class Lines:
    """1-based line numbers of offsets."""

    def __init__(self, source: str):
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    def __call__(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1


class Cut(NamedTuple):
    """A run of tokens, and what ended it: a statement's end (""), the head of
    a block ("{"), or a block's end ("}")."""

    tokens: Sequence[Token]
    ended_by: str


def statements(toks: Sequence[Token]) -> Iterator[Cut]:
    """Statements end at semicolons and line ends outside of brackets; blocks,
    also those inside of calls, are cut into statements of their own."""
    stack: list[str] = []
    held: list[Token] = []
    for t in toks:
        loose = not stack or stack[-1] == "block"
        if loose and t.new_line and held and held[-1].text not in _OPEN_END and t.text not in _OPEN_START:
            yield Cut(held, "")
            held = []
        if t.kind != "sign":
            held.append(t)
        elif t.text == ";" and loose:
            yield Cut(held, "")
            held = []
        elif t.text == "{" and not (held and held[-1].text in _VALUE_AHEAD):
            stack.append("block")
            yield Cut(held, "{")
            held = []
        elif t.text in "([{":
            stack.append(t.text)
            held.append(t)
        elif t.text in _CLOSER:
            while stack and stack[-1] not in (_CLOSER[t.text], "block"):
                stack.pop()
            if stack and stack[-1] == "block":
                if t.text == "}":
                    stack.pop()
                    yield Cut(held, "}")
                    held = []
                continue
            if stack:
                stack.pop()
            held.append(t)
        else:
            held.append(t)
    if held:
        yield Cut(held, "")


def split(toks: Sequence[Token], at: str) -> list[Sequence[Token]]:
    """Parts between signs `at` that stand outside of brackets."""
    out, depth, start = [], 0, 0
    for i, t in enumerate(toks):
        if t.kind == "sign":
            if t.text in "([{":
                depth += 1
            elif t.text in _CLOSER:
                depth -= 1
            elif t.text == at and depth <= 0:
                out.append(toks[start:i])
                start = i + 1
    return [*out, toks[start:]]


def closing(toks: Sequence[Token], at: int) -> int:
    """Index of the bracket that closes the one at `at`; the end where none does."""
    depth = 0
    for i in range(at, len(toks)):
        if toks[i].kind == "sign":
            depth += (toks[i].text in "([{") - (toks[i].text in _CLOSER)
            if not depth:
                return i
    return len(toks)


def unquoted(text: str) -> str | None:
    """The text of a literal; null for a template with parts to fill in."""
    body = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
    if text[0] == "`" and "${" in body:
        return None
    if "\\" not in body:
        return body
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN_ESCAPES.get(m[3], m[3]), body)


class Constants:
    """Names that are written exactly once, to constant text, and constant
    expressions: literals, their sums, String.fromCharCode, atob, Buffer.from
    and Buffer.concat of constants, and such names."""

    def __init__(self, toks: Sequence[Token]):
        self.toks = toks
        self.values: dict[str, str] = {}
        writes: dict[str, int] = {}
        places: dict[str, int] = {}
        for i, t in enumerate(toks[:-1]):
            if t.kind == "name" and toks[i + 1].text in _WRITES and not (i and toks[i - 1].text in (".", "?.")):
                writes[t.text] = writes.get(t.text, 0) + 1
                if toks[i + 1].text == "=":
                    places[t.text] = i + 2
        for name, at in places.items():
            if writes[name] == 1:
                value, end, _ = self.sum(at)
                if value is not None and self._ends(end):
                    self.values[name] = value

    def _ends(self, at: int) -> bool:
        """Whether an expression ends before token `at`."""
        return at >= len(self.toks) or self.toks[at].text in ";,)}]" or self.toks[at].new_line and self.toks[at].text not in _OPEN_START

    def sum(self, at: int) -> tuple[str | None, int, int]:
        """Value, end and number of terms of the constant sum that begins at a
        token; a null value where the first term is not constant."""
        value, end = self.term(at)
        terms = 0 if value is None else 1
        while value is not None and end < len(self.toks) and self.toks[end].text == "+":
            more, after = self.term(end + 1)
            if more is None:
                break
            value, end, terms = value + more, after, terms + 1
        return value, end, terms

    def _is(self, at: int, *texts: str) -> bool:
        return all(at + k < len(self.toks) and self.toks[at + k].text == x for k, x in enumerate(texts))

    def term(self, at: int) -> tuple[str | None, int]:
        """Value and end of the constant term that begins at a token."""
        if at >= len(self.toks):
            return None, at
        t = self.toks[at]
        if t.kind == "text":
            return unquoted(t.text), at + 1
        if t.kind != "name":
            return None, at
        if self._is(at, "String", ".", "fromCharCode", "("):
            end = closing(self.toks, at + 3)
            codes = [x.text for x in self.toks[at + 4 : end] if x.text != ","]
            if codes and all(c.isdigit() and int(c) < 0x110000 for c in codes):
                return "".join(chr(int(c)) for c in codes), end + 1
        elif self._is(at, "atob", "("):
            inner, end = self.term(at + 2)
            if inner is not None and self._is(end, ")"):
                try:
                    return base64.b64decode(inner, validate=True).decode(), end + 1
                except ValueError:
                    return None, at
        elif self._is(at, "Buffer", ".", "from", "("):
            inner, end = self.term(at + 4)
            if inner is not None and self._is(end, ")"):
                return inner, end + 1
        elif self._is(at, "Buffer", ".", "concat", "(", "["):
            out, end = "", at + 5
            while (inner := self.term(end))[0] is not None:
                out, end = out + inner[0], inner[1]
                if self._is(end, "]", ")"):
                    return out, end + 2
                end += self._is(end, ",")
        elif t.text in self.values and not (at + 1 < len(self.toks) and self.toks[at + 1].text in (".", "(", "[", "?.")):
            return self.values[t.text], at + 1
        return None, at

    def sums(self) -> Iterator[tuple[str, str, int]]:
        """(target, value, offset) of every text put together from several
        constants. A sum that goes on with something unknown counts as far as
        it consists of literals."""
        i = 0
        while i < len(self.toks):
            t = self.toks[i]
            after = i and self.toks[i - 1].text
            if t.kind not in ("text", "name") or after in (".", "?."):
                i += 1
                continue
            joined = self._is(i, "Buffer", ".", "concat")
            value, end, terms = self.sum(i)
            if value is not None and (terms > 1 or joined):
                whole = after != "+" and not (end < len(self.toks) and self.toks[end].text in ("+", ".", "(", "["))
                if whole or all(x.kind == "text" or x.text == "+" for x in self.toks[i:end]):
                    target = self.toks[i - 2].text.strip("\"'") if i > 1 and after in ("=", ":") and self.toks[i - 2].kind in ("name", "text") else "folded"
                    yield target, value, t.start
            i = max(end, i + 1)
