"""Exact top-k inner products over vectors sorted by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import batches_of, discard, materialize


#: Lengths that tell the driver where blocks of falling length end.
LANDMARKS = 1024


def quantize(vectors: DataFrame, *, id: str, vector: str, scale: float) -> DataFrame:
    """id, v: floor(scale * x) for each component, x as double. Rows whose id
    or vector is null, or whose vector holds null or non-finite components,
    are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col(id).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return kept.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows as int64; short vectors are padded with zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dims), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; floats where they hold every sum."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k best: higher score first, then smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


def block_top(q_ids, q, floor, c_ids, c, basis, k):
    """The k best of one candidate block for each query of one block.

    `floor` holds scores that k other vectors are known to reach. Queries whose
    length times the block's greatest length stays below are skipped; the
    others sum the first quarter of the rotated components and bound the rest
    by Cauchy-Schwarz; only what may still reach the floor is computed exactly.
    Returns (query index, candidate index, score).
    """
    empty = (np.empty(0, np.int64),) * 3
    if not len(q_ids) or not len(c_ids):
        return empty
    qf, cf = q @ basis, c @ basis
    q_len, c_len = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    slack = 1e-6 * (1.0 + q_len * c_len.max())
    live = np.flatnonzero(q_len * c_len.max() + slack >= floor)
    if not len(live):
        return empty
    m = max(1, q.shape[1] // 4)
    partial = qf[live, :m] @ cf[:, :m].T
    rest = np.linalg.norm(qf[live, m:], axis=1)[:, None] * np.linalg.norm(cf[:, m:], axis=1)[None, :]
    may = partial + rest + slack[live, None] >= floor[live, None]
    may &= q_ids[live, None] != c_ids[None, :]
    qi, ci = np.nonzero(may)
    if not len(qi):
        return empty
    if len(qi) > may.size // 20:
        scores = _products(q[live], c)[qi, ci]
    else:
        scores = np.concatenate([np.einsum("ij,ij->i", q[live[qi[s : s + 65536]]], c[ci[s : s + 65536]]) for s in range(0, len(qi), 65536)])
    keep = scores >= floor[live[qi]]
    qi, ci, scores = qi[keep], ci[keep], scores[keep]
    top = _best(qi, c_ids[ci], scores, k)
    return live[qi[top]], ci[top], scores[top]


def _packed(rows: np.ndarray) -> bytes:
    """A matrix of integers with its shape and the narrowest width that holds it."""
    top = int(np.abs(rows).max(initial=0))
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return np.array([np.dtype(kind).itemsize, *rows.shape], np.int64).tobytes() + rows.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    size, *shape = np.frombuffer(raw[:24], np.int64)
    return np.frombuffer(raw[24:], f"i{size}").reshape(shape).astype(np.int64)


def top_inner_products(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    block: int = 4096,
    head: int = 2048,
    first: int = 4,
) -> DataFrame:
    """The k highest integer inner products of every query with all other rows.

    Queries are the rows whose id is divisible by `every`. Components become
    floor(scale * x). The `head` longest vectors (a fixed number) fit the SVD
    rotation and give each query a first floor: a score that k others reach.

    All vectors are packed into blocks of `block` in order of falling length.
    Rounds go through the blocks, `first` of them, then twice as many each
    time. A query block, gathered from queries that need alike lengths, meets
    only blocks with a vector long enough to reach the least of its floors
    (Cauchy-Schwarz); inside, partial sums of the rotated components bound the
    rest. After each round the floors rise to the k-th best score so far, and
    the search ends when no block left is long enough. Where blocks end is
    known by at most LANDMARKS lengths, so the driver holds a fixed table.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. A query has fewer rows if fewer others exist. A query never meets
    rows of its own id; of several rows with one query id the smallest vector
    asks. Other repeated rows are candidates each. Shorter vectors count as
    padded with zeros. Rows that quantize() leaves out take no part; no rows
    give no rows.
    """
    spark = vectors.sparkSession
    whole = materialize(quantize(vectors, id=id, vector=vector, scale=scale), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, dims = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, dims)
    longest = whole.withColumn("length", length).orderBy(F.desc("length"), "id").limit(head).select("id", "v").collect()
    head_ids = np.array([r["id"] for r in longest], np.int64)
    head_rows = np.zeros((len(longest), dims), np.int64)
    for i, r in enumerate(longest):
        head_rows[i, : len(r["v"])] = r["v"]
    basis = np.linalg.eigh(head_rows.T.astype(np.float64) @ head_rows)[1][:, ::-1]

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = np.array(batch.column(0), np.int64), _matrix(batch.column(1), dims)
            scores = _products(q, head_rows).astype(np.float64)
            scores[ids[:, None] == head_ids[None, :]] = -np.inf
            floor = np.partition(scores, -k, axis=1)[:, -k] if len(head_ids) >= k else np.full(len(ids), -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(np.linalg.norm(q, axis=1))], ["id", "v", "floor", "length"])

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else None
        for s in range(0, table.num_rows if table else 0, block):
            part = table.slice(s, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array([min(part["need"].to_pylist())]), pa.array([np.array(part["id"], np.int64).tobytes()]), pa.array([_packed(_matrix(part["v"], dims))]), pa.array([np.array(part["floor"], np.float64).tobytes()])],
                ["need", "q_ids", "q", "floor"],
            )

    def pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                part = batch.slice(s, block)
                ids, c = np.array(part.column(0), np.int64), _matrix(part.column(1), dims)
                top = float(np.linalg.norm(c.astype(np.float64), axis=1).max(initial=0.0))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([top]), pa.array([ids.tobytes()]), pa.array([_packed(c)])], ["part", "top", "c_ids", "c"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                q, c, floor = _unpacked(row["q"]), _unpacked(row["c"]), np.frombuffer(row["floor"], np.float64)
                for s in range(0, len(q_ids), 512):
                    qi, ci, scores = block_top(q_ids[s : s + 512], q[s : s + 512], floor[s : s + 512], c_ids, c, basis, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[s + qi]), pa.array(c_ids[ci]), pa.array(scores)], ["query_id", "vec_id", "score"])

    parts = max(1, -(-n // block))
    ordered = whole.withColumn("length", length).repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    with batches_of(spark, block):
        blocks = materialize(ordered.select("id", "v").mapInArrow(pack_candidates, "part long, top double, c_ids binary, c binary"), "blocks")
        queries = whole.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
        queries = materialize(queries.mapInArrow(first_floors, "id long, v array<long>, floor double, length double"), "queries")
    n_queries = queries.count()
    stride = -(-parts // LANDMARKS)
    marks = sorted(map(tuple, blocks.groupBy((F.floor(F.col("part") / stride) * stride).alias("from")).agg(F.max("top").alias("top")).collect()))
    best = materialize(spark.createDataFrame([], "query_id long, vec_id long, score long"), "best", 0)
    floors = queries.select("id", "v", "floor", "length")
    low, width = 0, first
    while low < parts:
        # The length that a vector must have to reach the floor; any will do below 0.
        need = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.col("floor") / F.col("length") * (1 - 1e-6)).otherwise(F.lit(float("-inf")))
        asked = floors.withColumn("need", need)
        least = asked.agg(F.min("need")).first()[0]
        if least is None or not any(top >= least for at, top in marks if at + stride > low):
            break
        high = min(parts, low + width)
        cut = asked.repartitionByRange(max(1, -(-n_queries // block)), "need").sortWithinPartitions("need")
        with batches_of(spark, block):
            packed = materialize(cut.select("id", "v", "floor", "need").mapInArrow(pack_queries, "need double, q_ids binary, q binary, floor binary"), "asked")
        # Landmarks tell up to which part a query block must go.
        until = F.lit(low)
        for at, top in marks:
            if at < high and at + stride > low:
                until = F.when(F.col("need") <= top, F.lit(min(high, at + stride))).otherwise(until)
        pairs = packed.withColumn("until", until).filter(F.col("until") > low)
        pairs = pairs.withColumn("part", F.explode(F.expr(f"sequence({low}L, CAST(until AS BIGINT) - 1)")))
        met = pairs.join(blocks.filter(F.col("part").between(low, high - 1)), "part").filter("need <= top")
        # A row holds two blocks: few may share an Arrow batch.
        with batches_of(spark, 4):
            found = materialize(met.select("q_ids", "q", "floor", "c_ids", "c").mapInArrow(meet, "query_id long, vec_id long, score long"), "found")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top_k = best.unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        before, best = best, materialize(top_k.drop("rank"), "best", k * n_queries)
        discard(before, found, packed)
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
        floors = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "v", F.greatest("floor", F.coalesce("kth", F.lit(float("-inf")))).alias("floor"), "length")
        low, width = high, 2 * width
    discard(blocks, queries, whole)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
