"""Quality by nearest-neighbour votes in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import bound_batches
from skein.llm.labels import labelled_sample
from skein.llm.shingles import word_hashes

#: Byte classes: other controls, each lower-case letter, upper-case letters as
#: one, digits as one, blanks, line ends, each ASCII sign, and kinds of
#: non-ASCII bytes: two of continuation bytes, and the lead bytes of marked
#: Latin letters, Greek, Cyrillic, other two-byte letters, and three and four bytes.
CLASSES = 72
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = 27
_CLASS[48:58] = 28
_CLASS[[32, 9, 13]] = 29
_CLASS[10] = 30
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = np.arange(31, 31 + len(_SIGNS))
_MORE = 31 + len(_SIGNS)
for _k, (_from, _to) in enumerate([(0x80, 0xA0), (0xA0, 0xC0), (0xC0, 0xE0), (0xC2, 0xC6), (0xCE, 0xD0), (0xD0, 0xD4), (0xE0, 0xF0), (0xF0, 0x100)]):
    _CLASS[_from:_to] = _MORE + _k
_CAPITALS = 27 * CLASSES + 27
#: Terms: pairs of byte classes, words by hash, and four that count repetition.
PAIRS, WORD_TERMS = CLASSES * CLASSES, 1 << 12
TERMS = PAIRS + WORD_TERMS + 4
#: Rows in which a matrix of terms is summed up.
SUM_ROWS = 16


def term_counts(texts: Sequence[str | None]) -> np.ndarray:
    """Term counts of each text: byte-class pairs over the whole text, words
    by hash, words equal to the one before, word pairs and word triples seen
    before in the text, and words in capitals; one row a text."""
    raw = [(t or "").encode() for t in texts]
    out = np.zeros((len(raw), TERMS), np.float32)
    for i, r in enumerate(raw):
        if len(r) > 1:
            c = _CLASS[np.frombuffer(r, np.uint8)]
            out[i, :PAIRS] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=PAIRS)
            # Runs inside capitals count once more: shouting is a term of its own.
            out[i, -1] = out[i, _CAPITALS] / 4
    words, at = word_hashes(raw)
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        w = words[a:b]
        out[i, PAIRS:-4] = np.bincount((w % np.uint64(WORD_TERMS)).astype(np.int64), minlength=WORD_TERMS)
        if len(w) > 2:
            two = w[:-1] * np.uint64(3) + w[1:]
            three = two[:-1] * np.uint64(5) + w[2:]
            out[i, -4:-1] = (w[1:] == w[:-1]).sum(), len(two) - len(np.unique(two)), len(three) - len(np.unique(three))
    return out


@dataclass
class LatentSpace:
    """IDF, an SVD basis, and the labelled vectors of a bounded sample."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.basis)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; the
        sample's share where nothing is similar."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(vectors), prior)
        k = min(self.neighbours, len(self.labels))
        near = vectors @ self.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(np.float64) ** self.power
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[top]).sum(1) / np.where(total > 0, total, 1.0), prior)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies by IDF, of pairs and of words each
    by their own number; repetition weighs as much as a fixed share of the text."""
    pairs = np.maximum(counts[:, :PAIRS].sum(1, keepdims=True), 1.0)
    words = np.maximum(counts[:, PAIRS:-4].sum(1, keepdims=True), 1.0)
    length = np.concatenate([np.repeat(pairs, PAIRS, 1), np.repeat(words, WORD_TERMS, 1), np.repeat(pairs, 4, 1)], 1)
    out = np.sqrt(counts / length) * idf
    out[:, -4:] *= 4.0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1.0)).astype(np.float32)


def fit_space(sample: DataFrame, *, dims: int = 48, neighbours: int = 15, power: float = 8.0) -> LatentSpace:
    """Fits IDF and SVD on a bounded sample (doc_id, text, y) and keeps its
    vectors as the voters. The sample's term counts are summed up on the
    executors; only its vectors come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(TERMS)
        for counts, _ in _counted(batches):
            n += len(counts)
            df += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tolist()], pa.list_(pa.float64()))], ["n", "df"])

    base = sample.select("text", "y")
    found = base.mapInArrow(sums, "n long, df array<double>").toArrow()
    n = sum(found["n"].to_pylist())
    df = np.sum([np.array(x) for x in found["df"].to_pylist()], axis=0) if found.num_rows else np.zeros(TERMS)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + np.float32(0.1)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A fixed random projection finds the range of the leading vectors.
        probe = np.random.default_rng(4).standard_normal((TERMS, dims + 16)).astype(np.float32)
        total = np.zeros(probe.shape, np.float32)
        for counts, _ in _counted(batches):
            x = _weighted(counts, idf)
            total += x.T @ (x @ probe)
        parts = np.array_split(total, SUM_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SUM_ROWS), pa.int32()), pa.array([p.tobytes() for p in parts])], ["k", "y"])

    def add(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(r.as_py(), np.float32).astype(np.float64) for r in table["y"]]
        return pa.table({"k": table["k"][:1], "y": pa.array([sum(rows[1:], rows[0]).astype(np.float32).tobytes()])})

    # Summed up on the executors, one matrix comes back.
    parts = base.mapInArrow(second, "k int, y binary").groupBy("k").applyInArrow(add, "k int, y binary").toArrow().sort_by("k")["y"]
    y = np.frombuffer(b"".join(p.as_py() for p in parts), np.float32).reshape(-1, dims + 16) if len(parts) else np.zeros((TERMS, dims + 16), np.float32)
    q = np.linalg.qr(y)[0]
    basis = q.astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts, labels in _counted(batches):
            x = (_weighted(counts, idf) @ basis).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(labels, pa.int32())], ["x", "y"])

    rows = base.mapInArrow(project, "x binary, y int").toArrow()
    x = np.array([np.frombuffer(r, np.float32) for r in rows["x"].to_pylist()], np.float32).reshape(-1, dims + 16)
    if len(x):
        # Right singular vectors from the small product: no matrix of rows by rows.
        turn = np.linalg.eigh(x.T.astype(np.float64) @ x)[1][:, ::-1][:, :dims]
        basis = (basis @ turn).astype(np.float32)
        x = x @ turn.astype(np.float32)
    return LatentSpace(idf, basis, _unit(x), np.array(rows["y"].to_pylist(), np.float64), neighbours, power)


def _counted(batches: Iterator[pa.RecordBatch], block: int = 128) -> Iterator[tuple[np.ndarray, list[int]]]:
    for batch in batches:
        for s in range(0, batch.num_rows, block):
            part = batch.slice(s, block)
            yield term_counts(part.column(0).to_pylist()), part.column(1).to_pylist()


def with_quality(docs: DataFrame, space: LatentSpace, block: int = 128) -> DataFrame:
    """`docs` (text and any other columns) with a score (0 to 1) for each row;
    a column of that name is replaced. Texts of fewer than two bytes are
    similar to nothing and score the sample's share of label 1, as do all where
    the space has no voters (0.5 then). Equal texts score alike; no rows give
    no rows. Of equally near neighbours any may vote."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vars(space))
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = LatentSpace(**held.value)
        for batch in batches:
            scores = [np.empty(0)]
            for s in range(0, batch.num_rows, block):
                scores.append(space.score(space.embed(term_counts(batch.column(at).slice(s, block).to_pylist()))))
            score = pa.array(np.clip(np.concatenate(scores), 0.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_label: int = 2000, folds: int = 3, held_out: int = 1) -> LatentSpace:
    """The space of at most `per_label` labelled rows of each label outside
    the held-out fold. Null and empty texts are rows without terms; an id that
    repeats may count up to the sample's bound; without labels, or documents,
    the space has no voters."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", folds=folds, held_out=held_out, per_label=per_label).persist()
    try:
        return fit_space(sample)
    finally:
        sample.unpersist()
