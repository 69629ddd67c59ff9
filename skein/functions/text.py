"""Scalar functions over text, URLs and versions, as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce
from operator import or_
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Shorter pieces say too little to test for them first, unless they are signs
#: only, or hold one that prose lacks.
SHORTEST_NEEDLE = 3
RARE_SIGNS = frozenset("\\$#@[]{}`~^|")
#: Pieces of this length are told apart enough; so many are tested for at most.
TELLING, MOST_NEEDLES = 4, 64
_SPACE = frozenset(" \t\n\x0b\f\r")
_CLASSES = {"CATEGORY_SPACE": _SPACE, "CATEGORY_DIGIT": frozenset("0123456789"), "CATEGORY_WORD": frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")}


def any_case(pattern: str) -> bool:
    return "(?i" in pattern


@lru_cache(maxsize=1024)
def needles(pattern: str) -> tuple[str, ...]:
    """Texts of which every match of a pattern holds one: in lower case where
    the pattern asks for any case; none where it needs no fixed text."""
    parts = parser.parse(pattern.replace("(?i)", ""))
    return tuple(sorted(_needles(parts, any_case(pattern)) or ()))


def _class(items: Iterable) -> frozenset[str] | None:
    """The characters of a class; null where it cannot be listed in ASCII."""
    out: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(value))
        elif name == "RANGE" and value[1] < 128:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif name == "CATEGORY" and str(value) in _CLASSES:
            out |= _CLASSES[str(value)]
        else:
            return None
    return frozenset(out) if all(c.isascii() for c in out) else None


def _product(left: frozenset[str], right: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a in left for b in right)


def _texts(op: object, value: object, fold: bool) -> frozenset[str] | None:
    """All texts that a part matches, if they are few."""
    name, out = str(op), None
    if name == "LITERAL":
        out = frozenset({chr(value)}) if chr(value).isascii() else None
    elif name in ("AT", "ASSERT", "ASSERT_NOT"):
        out = frozenset({""})
    elif name == "IN":
        out = _class(value)
    elif name == "SUBPATTERN":
        out = _all_texts(value[3], fold)
    elif name == "BRANCH":
        each = [_all_texts(b, fold) for b in value[1]]
        out = frozenset().union(*each) if None not in each else None
    elif name in ("MAX_REPEAT", "MIN_REPEAT") and (value[0], value[1]) == (0, 1):
        inner = _all_texts(value[2], fold)
        out = inner | {""} if inner else None
    if out and fold:
        out = frozenset(t.lower() for t in out)
    return out if out and len(out) <= MOST_NEEDLES else None


def _all_texts(parts: Iterable, fold: bool) -> frozenset[str] | None:
    out = frozenset({""})
    for op, value in parts:
        texts = _texts(op, value, fold)
        if texts is None or len(out) * len(texts) > MOST_NEEDLES:
            return None
        out = _product(out, texts)
    return out


def _needles(parts: Iterable, fold: bool) -> frozenset[str] | None:
    """The most telling set of a sequence: longest shortest text, then fewest.
    Neighbouring parts of few texts are put together until they tell enough."""
    found: list[frozenset[str]] = []
    run = frozenset({""})

    def close() -> None:
        nonlocal run
        if all(len(t) >= SHORTEST_NEEDLE or not RARE_SIGNS.isdisjoint(t) or len(t) == 2 and not any(c.isalnum() or c.isspace() for c in t) for t in run):
            found.append(run)
        run = frozenset({""})

    def goes_on(texts: frozenset[str], literal: bool) -> bool:
        return len(run) * len(texts) <= MOST_NEEDLES and (literal or min(map(len, run)) < TELLING)

    for op, value in parts:
        name, inner = str(op), None
        texts = _texts(op, value, fold)
        if texts == frozenset({""}):
            continue
        if texts is not None:
            if not goes_on(texts, name == "LITERAL"):
                close()
            run = _product(run, texts)
            continue
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _needles(value[2], fold)
            each = _all_texts(value[2], fold)
            for _ in range(value[0] if each else 0):
                if not goes_on(each, False):
                    break
                run = _product(run, each)
        close()
        if name == "SUBPATTERN":
            inner = _needles(value[3], fold)
        elif name == "BRANCH":
            branches = [_needles(b, fold) for b in value[1]]
            inner = frozenset().union(*branches) if all(branches) else None
        if inner and len(inner) <= 2 * MOST_NEEDLES:
            found.append(inner)
    close()
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def holds_any(text: Column, needed: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(n) for n in sorted(set(needed))])


def may_match(low: Column, patterns: Sequence[str]) -> Column | None:
    """Whether a lower-cased text holds what some of the patterns need; null
    where one of them needs nothing."""
    each = [needles(p) for p in patterns]
    return holds_any(low, {n.lower() for e in each for n in e}) if all(each) else None


def no_finds() -> Column:
    return F.expr("cast(array() as array<string>)")


def find_some(content: Column, low: Column, pattern: str, group: int = 0) -> Column:
    """find_all() where the lower-cased text holds what the pattern needs:
    most texts are spared the regular expression."""
    test = may_match(low, [pattern])
    found = find_all(content, pattern, group)
    return found if test is None else F.when(test, found).otherwise(no_finds())


def matches(content: Column, low: Column, pattern: str) -> Column:
    """rlike(), tested for what the pattern needs first."""
    test = may_match(low, [pattern])
    return content.rlike(pattern) if test is None else test & content.rlike(pattern)


def find_all(content: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern (or of one group), in order; none for null."""
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), F.lit(group))


def ordered_distinct(*arrays: Column) -> Column:
    """All items of some arrays, each at its first place."""
    return F.array_distinct(F.concat(*arrays))


def first(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty or null."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    each = F.transform(
        F.array_distinct(chars),
        lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n,
    )
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def character_classes(text: Column) -> Column:
    """How many of lower case, upper case, digits and other a text has."""
    return sum((text.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))


def assigned_value(text: Column) -> Column:
    """The quoted value of four or more characters, else the trimmed text."""
    quoted = F.regexp_extract(text, r"['\"]([^'\"]{4,})['\"]", 1)
    return F.when(quoted != "", quoted).otherwise(F.trim(text))


def line_of(content: Column, needle: Column) -> Column:
    """1-based line of the first occurrence; 0 where there is none."""
    at = F.instr(content, needle)
    before = F.substring(content, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(0)


def around(content: Column, needle: Column, before: int, after: int) -> Column:
    """What stands around the first occurrence; "" where there is none."""
    at = F.instr(content, needle)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(content, start, at - start + after))).otherwise("")


def url_host(url: Column) -> Column:
    """Host in lower case without port or user; "" for relative URLs."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def canonical_url(url: Column) -> Column:
    """Without fragment, query and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"/+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(canonical_url(F.replace(path, F.lit("\\"), F.lit("/"))), r"([^/]*)$", 1)


def version_parts(text: Column) -> Column:
    """[major, minor, patch] of a version, null where it doesn't begin with a number."""
    pattern = r"^\s*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("0")).cast("int")
    return F.when(text.rlike(pattern), F.array(part(1), part(2), part(3)))


def version_within(version: Column, constraint: Column) -> Column:
    """Whether a version meets one `<x`, `<=x`, `>x`, `>=x`, `=x` or `x`; false
    where either can't be read."""
    shape = r"^\s*(<=|>=|<|>|=)?\s*([0-9]+(?:\.[0-9]+){0,2})\s*$"
    op, bound = F.regexp_extract(constraint, shape, 1), version_parts(F.regexp_extract(constraint, shape, 2))
    v = version_parts(version)
    met = (
        F.when(op == "<", v < bound).when(op == "<=", v <= bound).when(op == ">", v > bound).when(op == ">=", v >= bound).otherwise(v == bound)
    )
    return F.when(constraint.rlike(shape), F.coalesce(met, F.lit(False))).otherwise(F.lit(False))


def version_in(version: Column, ranges: Column) -> Column:
    """Whether a version meets every comma-separated constraint."""
    return F.forall(F.split(F.coalesce(ranges, F.lit("")), ","), lambda c: version_within(version, c))


def safe_name(url: Column, content: Column) -> Column:
    """stem[:80]-hash[:12].ext of a downloaded script."""
    name = basename(url)
    stem = F.substring(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    suffix = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.when(stem == "", "script").otherwise(stem), F.lit("-"), F.substring(F.sha2(content, 256), 1, 12), F.when(suffix == "", ".js").otherwise(suffix))


def iso_utc(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_char_codes(codes: Column) -> Column:
    """The text of an array of code points; null where one is no character."""
    each = F.transform(codes, lambda c: F.when(c.between(0, 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")))
    return F.when(~F.exists(each, lambda c: c.isNull()), F.array_join(each, ""))
