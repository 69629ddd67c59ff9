"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, materialize
from skein.llm.jaccard import near_duplicates
from skein.llm.labels import labelled_sample

#: Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Insults known before any label is seen.
KNOWN = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "scum", "scumbag", "loser", "losers", "dumbass", "bastard", "asshole", "bitch", "bullshit", "fuck", "fucking", "retard", "whore", "slut")
KNOWN_WEIGHT = 3.0
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "sore loser clause", "bitch unit", "moron number", "stupid simple", "pathetic fallacy")
PREFIXES = range(4, 9)
#: False discoveries among learned entries.
LEVEL = 0.01

_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()}
_TABLE |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()}
_TABLE |= dict.fromkeys([*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _TABLE) + "]")
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!89]+(?=[^\W\d_])|(?<![^\W_])[013457@$89]+(?=[^\W\d_])|(?<=[^\W\d_])[01345789]+(?![^\W_])")
_SPOKEN = {ord(k): v for k, v in SUBSTITUTES.items()}
_GAP = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Lower-cased words between single blanks, with homoglyphs, marks and
    letter substitutes folded; " " for no words."""
    if not text:
        return " "
    low = text.lower()
    if not low.isascii() and _ODD.search(low):
        low = low.translate(_TABLE)
    low = _INSIDE.sub(lambda m: m[0].translate(_SPOKEN), low)
    return f" {_GAP.sub(' ', low).strip()} "


def terms(line: str) -> set[str]:
    """Whole words (" word ") and prefixes (" pref") of a folded text."""
    out: set[str] = set()
    for w in set(line.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the score's scale."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    offset: float = -2.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight, False))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, line: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries in a folded text, outside
        exceptions; of a word's entries the one of most weight."""
        found, covered = [], []
        if len(self.weights) + len(self.exceptions):
            for end, (size, weight, skip) in self.automaton().iter(line):
                (covered if skip else found).append((end + 1 - size, end + 1, weight))
        if covered:
            found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b, _ in covered)]
        best: dict[int, tuple[int, int, float]] = {}
        for h in found:
            if h[0] not in best or h[2] > best[h[0]][2]:
                best[h[0]] = h
        return list(best.values())

    def weight(self, line: str) -> float:
        """Summed weight, normalised by the logarithm of the length in words."""
        if not (hits := self.hits(line)):
            return 0.0
        return sum(h[2] for h in hits) / (1.0 + math.log1p(line.count(" ") / 50))

    def score(self, line: str) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * self.weight(line) + self.offset))))


def _may_pass(share: float, level: float = LEVEL) -> Column:
    """Terms (pos, neg) whose own bound is below `level`, as all are that _significant keeps."""
    n = F.col("pos") + F.col("neg")
    clean = F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / n / (1 - share))).otherwise(0.0)
    return (F.col("pos") > share * n) & (F.col("pos") * F.log(F.col("pos") / n / share) + clean >= -math.log(level) - 1e-6)


def _significant(rows: list[tuple[str, int, int]], share: float, tested: int, level: float = LEVEL) -> list[tuple[str, int, int]]:
    """Benjamini-Hochberg over Chernoff bounds of the binomial tail: how likely
    so many toxic documents among a term's documents are by chance."""
    if not rows:
        return []
    pos, neg = np.array([[r[1], r[2]] for r in rows], float).T
    n = pos + neg
    p = pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)
    log_p = np.where(p > share, -n * kl, 0.0)
    order = np.argsort(log_p, kind="stable")
    passes = log_p[order] <= np.log(level * np.arange(1, len(rows) + 1) / max(tested, len(rows)))
    last = int(np.flatnonzero(passes).max(initial=-1))
    return [rows[i] for i in order[: last + 1]]


def _without_nesting(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of entries (documents, weight). Of entries that begin alike, the
    longest stands for nearly all documents of the shorter; then none stays
    that begins with another of at least its weight."""
    replaced = set()
    for t, (pos, _) in found.items():
        stem = t.rstrip()
        for k in range(5, len(stem) + (t != stem)):
            if (short := stem[:k]) in found and short != t and pos >= 0.95 * found[short][0]:
                replaced.add(short)
    kept: dict[str, float] = {}
    for t in sorted(found.keys() - replaced, key=lambda t: (len(t), t)):
        if not any(kept.get(t[:k], -math.inf) >= found[t][1] for k in range(5, len(t))):
            kept[t] = found[t][1]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a little ridge; classes weigh alike."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    a = np.c_[x, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (p - y)) + 0.1 * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_lexicon(sample: DataFrame) -> Lexicon:
    """Learns entries, exceptions and scale from a bounded sample (doc_id, text, y).

    A term's weight is its log odds between toxic and other documents. Terms
    enter if their share of toxic documents is significant at a false-discovery
    rate of 1 %. Of near copies with one label only one counts, so that a copied
    text does not make its words significant. An exception is a neighbouring
    word pair that occurs in clean documents of the sample only. Without both
    labels, or rows, the known insults alone make the lexicon. Null and empty
    texts have no terms; repeated rows count once. What comes to the driver is
    bounded by the sample: its significant terms and pairs.
    """
    groups = near_duplicates(sample).join(sample.select("doc_id", "y").distinct(), "doc_id")
    first = groups.groupBy("component_id", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    sample = materialize(sample.join(F.broadcast(first), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "toxic_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(terms(folded(text)))
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen[y])), pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y].values()), pa.int64())], ["term", "y", "n"]
                )

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_neg, n_pos = sizes.get(0, 0), sizes.get(1, 0)
    known = {f" {w} ": KNOWN_WEIGHT for w in KNOWN}
    if not n_neg or not n_pos:
        return Lexicon(known)
    counted = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(count, "term string, y int, n long")
    df = counted.groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")
    )
    share = n_pos / (n_pos + n_neg)
    df = df.filter("pos + neg >= 3").persist()
    tested = df.count()
    rich = df.filter((F.col("pos") >= 3) & _may_pass(share))
    rows = [tuple(r) for r in rich.orderBy(F.desc("pos"), "neg", "term").collect()]
    clean = {r["term"] for r in df.filter(F.col("term").isin(list(known)) & (F.col("neg") > F.col("pos"))).collect()}
    df.unpersist()
    odds = lambda pos, neg: min(8.0, math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1)))
    weights = _without_nesting({t: (pos, odds(pos, neg)) for t, pos, neg in _significant(rows, share, tested)})
    lexicon = Lexicon({**{t: w for t, w in known.items() if t not in clean}, **weights})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float, int]] = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line = folded(text)
                out.append(("", lexicon.weight(line), y))
                pairs = set()
                for start, end, _ in lexicon.hits(line):
                    end = line.index(" ", end - 1)
                    left, right = line.rfind(" ", 0, start), line.find(" ", end + 1)
                    pairs |= {line[max(left, 0) : end].strip()} if left >= 0 else set()
                    pairs |= {line[start:right].strip()} if right > 0 else set()
                out += [(p, 0.0, y) for p in pairs if " " in p]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.float64(), pa.int32()), strict=True)], ["pair", "x", "y"])

    def points(chosen: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([chosen.weight(folded(t)) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "y"])

        got = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "x double, y int").toArrow()
        return np.array(got["x"], float), np.array(got["y"], int)

    pairs = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(look, "pair string, x double, y int")
    only_clean = pairs.filter("pair <> ''").groupBy("pair").agg(F.count("*").alias("n"), F.max("y").alias("toxic")).filter("toxic = 0 AND n >= 2")
    lexicon.exceptions = (*EXCEPTIONS, *sorted(r["pair"] for r in only_clean.collect()))
    lexicon._automaton = None
    x, y = points(lexicon)
    lexicon.slope, lexicon.offset = _logistic(x, y)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1), n_hits for every row of `docs`. Null and empty
    texts have no hits and score as texts without any; equal texts score alike;
    no rows give no rows; texts are matched whole; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [folded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lexicon.score(x) for x in lines], pa.float64()), pa.array([len(lexicon.hits(x)) for x in lines], pa.int64())],
                ["doc_id", "score", "n_hits"],
            )

    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, *, per_label: int = 4000, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Scores every document with a lexicon learned from at most `per_label`
    rows of each label outside the held-out fold (fit_lexicon, score_toxicity).
    Labels that are null, or differ for one id, are left out."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", folds=folds, held_out=held_out, per_label=per_label).persist()
    try:
        lexicon = fit_lexicon(sample)
    finally:
        sample.unpersist()
    return score_toxicity(docs, lexicon)
