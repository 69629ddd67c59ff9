"""Hashes of words and word shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: An odd base, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD += 1
_COEFF = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blank-separated words of all texts, A-Z lower-cased, and
    each text's first word in them (one more offset than texts)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
    start, stop = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_FOLD[data] * up[: len(data)], out=total[1:])
    h = mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h, np.r_[0, np.searchsorted(start, ends)]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words; one for all of fewer words."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return mixed((words * _COEFF[:n]).sum(keepdims=True) + np.uint64(n))
    out = words[: n - width + 1] * _COEFF[0]
    for k in range(1, width):
        out = out + words[k : n - width + 1 + k] * _COEFF[k]
    return mixed(out)


def shingle_sets(texts: Sequence[str | None], width: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for null or blank.

    Texts are hashed together up to `chunk` bytes; a longer one goes alone."""
    held: list[bytes] = []
    size = 0

    def done() -> Iterator[np.ndarray]:
        words, at = word_hashes(held)
        for a, b in zip(at, at[1:], strict=False):
            yield np.unique(shingle_hashes(words[a:b], width))

    for text in texts:
        raw = (text or "").encode()
        if held and size + len(raw) > chunk:
            yield from done()
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from done()


def set_signature(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes."""
    if not len(hashes):
        return 0
    with np.errstate(over="ignore"):
        h = mixed(np.array([hashes.sum() + np.bitwise_xor.reduce(mixed(hashes + np.uint64(1))) * np.uint64(BASE) + np.uint64(len(hashes))], np.uint64))
    return int(h.view(np.int64)[0])
