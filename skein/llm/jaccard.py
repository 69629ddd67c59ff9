"""The n-gram Jaccard join as a blocked sparse matrix product.

The incidence of documents by shingles is cut into blocks of columns. A
product over the blocks counts, for each set, the shingles it shares with any
other set; sets that share too few to reach the threshold leave. Of the others
a second product takes the columns that the size-derived bound requires: the
rarest of each set, in one order for all, so that a common passage is left out
of nearly every set. Two sets that meet in a column are a pair only if the
places of the column in both leave room for the overlap they need. Pairs come
in rounds: each set with a few sets of its column, of other components, and at
last, in the columns whose sets aren't connected yet, all pairs that would
connect. Each pair's overlap is counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import batches_of, bound_batches, discard, materialize
from skein.llm.shingles import set_signature, shingle_sets

#: So many sets, or hashes, are gathered before a map task writes.
GATHER, GATHER_HASHES = 8_192, 1_500_000
#: Bits of the table that keeps most sets without partners out of a shuffle.
#: It has a fixed size; where it fills up, the join after it does all the work.
FILTER_BITS = 1 << 25
#: So many counted entries make a block of columns, whatever the input's size.
BLOCK_ENTRIES = 1 << 19
#: Counters of the fixed-size sketch of column frequencies, and rows it takes.
COUNTERS, COUNTER_ROWS = 1 << 20, 64
#: Sets of a column that each of its sets meets, by round, before all meet.
HUBS = (1, 16)


def _signatures(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), n_half (hashes in the half that is counted first), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, half, sig = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                half.append(int(np.searchsorted(s, np.uint64(1 << 63))))
                sig.append(set_signature(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(half, pa.int64()), pa.array(sig, pa.int64())], ["doc_id", "n", "n_half", "sig"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n long, n_half long, sig long")


Sets = Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]]


def _lower_half(width: int) -> Sets:
    """Signatures and lower half of the hashes of a batch of texts."""

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for s in shingle_sets(batch.column(0).to_pylist(), width):
            if len(s):
                yield set_signature(s), s[: np.searchsorted(s, np.uint64(1 << 63))]

    return sets


def _column_blocks(source: DataFrame, sets_of: Sets, blocks: int) -> DataFrame:
    """The incidence of sets by hashes in blocks of columns: packed entries of
    48 hash bits and 16 bits for the set's place in `sigs`.

    A column that many sets of one task share goes on as one entry (place
    65535), and the sets' shares are counted here: `credits`.
    """

    def flush(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sigs = np.fromiter(sets, np.int64, len(sets))
        tokens = np.concatenate(list(sets.values()))
        if not len(tokens):
            return
        place = np.repeat(np.arange(len(sigs), dtype=np.uint64), [len(s) for s in sets.values()])
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], place[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]]
        run = np.cumsum(new) - 1
        shared = np.bincount(run)[run] > 1
        credits = np.bincount(place[shared].astype(np.int64), minlength=len(sigs))
        one = ~shared
        tokens = np.r_[tokens[one], tokens[shared & new]]
        place = np.r_[place[one], np.full(int((shared & new).sum()), 0xFFFF, np.uint64)]
        block = (tokens % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        packed = (((tokens >> np.uint64(15)) & np.uint64((1 << 48) - 1)) << np.uint64(16) | place)[order]
        cut = np.searchsorted(block[order], np.arange(blocks + 1))
        for b in range(blocks):
            part = packed[cut[b] : cut[b + 1]]
            if len(part):
                at = (part & np.uint64(0xFFFF)).astype(np.int64)
                used = np.unique(at[at != 0xFFFF])
                there = np.zeros(65536, np.uint64)
                there[used] = np.arange(len(used), dtype=np.uint64)
                there[0xFFFF] = 0xFFFF
                part = part & ~np.uint64(0xFFFF) | there[at]
                yield row(b, part.tobytes(), sigs[used].tobytes(), b"")
        own = np.flatnonzero(credits)
        if len(own):
            yield row(int(sigs[0]) % blocks, b"", sigs[own].tobytes(), credits[own].astype(np.int64).tobytes())

    def row(block: int, packed: bytes, sigs: bytes, credits: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed]), pa.array([sigs]), pa.array([credits])], ["block", "packed", "sigs", "credits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for sig, s in sets_of(batch):
                if sig not in sets:
                    sets[sig] = s
                    size += len(s)
                    if len(sets) >= GATHER or size >= GATHER_HASHES:
                        yield from flush(sets)
                        sets, size = {}, 0
        if sets:
            yield from flush(sets)

    return source.mapInArrow(run, "block int, packed binary, sigs binary, credits binary")


def _shared_counts(columns: DataFrame, blocks: int) -> DataFrame:
    """sig, shared: of how many counted columns another set has an entry.

    A block's counts go on packed by ranges of signatures, and each range is
    summed up by one task: a row a set leaves, not one a set and block."""

    def product(table: pa.Table) -> pa.Table:
        hashes, owners, credit_sigs, credit_n = [], [], [], []
        for packed, sigs, credits in zip(table["packed"], table["sigs"], table["credits"], strict=True):
            own = np.frombuffer(sigs.as_py(), np.int64)
            if raw := credits.as_py():
                credit_sigs.append(own)
                credit_n.append(np.frombuffer(raw, np.int64))
                continue
            part = np.frombuffer(packed.as_py(), np.uint64)
            at = (part & np.uint64(0xFFFF)).astype(np.int64)
            hashes.append(part >> np.uint64(16))
            owners.append(np.where(at == 0xFFFF, 0, np.r_[own, 0][np.minimum(at, len(own))]))
        if hashes:
            h, o = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            new_h = np.r_[True, h[1:] != h[:-1]]
            new_o = new_h | np.r_[True, o[1:] != o[:-1]]
            column = np.cumsum(new_h) - 1
            # Entry 0 stands for several sets of one task.
            several = np.bincount(column[new_o]) + np.bincount(column, weights=o == 0) > 1
            met = new_o & several[column] & (o != 0)
            sig, n = np.unique(o[met], return_counts=True)
            credit_sigs.append(sig)
            credit_n.append(n)
        sigs, counts = np.concatenate(credit_sigs), np.concatenate(credit_n).astype(np.int64)
        span = sigs % blocks
        order = np.argsort(span, kind="stable")
        sigs, counts = sigs[order], counts[order]
        cut = np.searchsorted(span[order], np.arange(blocks + 1))
        there = [r for r in range(blocks) if cut[r] < cut[r + 1]]
        parts = lambda x: pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in there], pa.binary())
        return pa.table({"span": pa.array(there, pa.int32()), "sigs": parts(sigs), "counts": parts(counts)})

    def total(table: pa.Table) -> pa.Table:
        sigs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["sigs"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]])
        each, at = np.unique(sigs, return_inverse=True)
        return pa.table({"sig": pa.array(each, pa.int64()), "shared": pa.array(np.bincount(at, weights=counts).astype(np.int64), pa.int64())})

    found = columns.groupBy("block").applyInArrow(product, "span int, sigs binary, counts binary")
    return found.groupBy("span").applyInArrow(total, "sig long, shared long")


def _bit_table(sigs: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, one set for each signature's hash."""
    at = sigs.select(F.pmod("sig", F.lit(FILTER_BITS)).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[np.array(found["word"], np.int64)] = np.array(found["bits"], np.int64)
    return table


def _kept_sets(texts: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    """sig, n, hashes (packed) of the sets in `kept`, one row each."""
    bits = texts.sparkSession.sparkContext.broadcast(_bit_table(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            sigs, sets = [], []
            seen: set[int] = set()
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if len(s) and (sig := set_signature(s)) not in seen:
                    at = sig % FILTER_BITS
                    if table[at >> 6] >> (at & 63) & 1:
                        seen.add(sig)
                        sigs.append(sig)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["sig", "n", "hashes"])

    sets = texts.select("text").mapInArrow(run, "sig long, n long, hashes binary")
    return sets.join(kept.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many hashes of all sets fall on each of COUNTERS counters."""
    width = COUNTERS // COUNTER_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(total, np.frombuffer(raw.as_py(), np.uint64) % np.uint64(COUNTERS), 1)
        parts = [(k, total[k * width : (k + 1) * width]) for k in range(COUNTER_ROWS)]
        parts = [(k, p) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], ["k", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for raw in table["counts"]:
            total += np.frombuffer(raw.as_py(), np.int64)
        return pa.table({"k": table["k"][:1], "counts": pa.array([total.tobytes()])})

    found = sets.select("hashes").mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").toArrow()
    out = np.zeros(COUNTERS, np.int64)
    for k, raw in zip(found["k"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[k * width : (k + 1) * width] = np.frombuffer(raw, np.int64)
    return out


def _required_columns(sets: DataFrame, percent: int) -> DataFrame:
    """sig, n, column, place: the rarest hashes of each set, so many that two
    linked sets have one in common, and their places in the set's order.

    Rarity is the count of the hash's counter, then the hash: any order that is
    the same for all sets gives the same links, a better one fewer pairs."""
    held = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            lists = []
            for n, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                need = n - -(-percent * n // 100) + 1
                lists.append(s[np.lexsort((s, counts[s % np.uint64(COUNTERS)]))[:need]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["sig", "n", "columns"])

    lists = sets.select("sig", "n", "hashes").mapInArrow(run, "sig long, n long, columns array<long>")
    return lists.select("sig", "n", F.posexplode("columns").alias("place", "column"))


def _meeting(columns: DataFrame, hubs: int | None, percent: int) -> DataFrame:
    """a < b: sets of different roots that meet in a column and may link.

    With `hubs`, each set meets one set of each of so many groups of its
    column's roots: the one with the fewest columns rarer than this, as it has
    least of its own and links best. Without, all sets of the column that are not of its
    most frequent root meet all. At their first common column, what is left of
    both sets bounds the overlap."""
    if hubs:
        group = F.pmod(F.xxhash64("root"), F.lit(hubs)).alias("group")
        few = columns.groupBy("column", group).agg(F.min(F.struct("place", "n", "sig", "root")).alias("x")).select("column", "x.*")
    else:
        of_root = columns.groupBy("column", "root").agg(F.count("*").alias("rows"))
        most = of_root.groupBy("column").agg(F.max(F.struct("rows", "root"))["root"].alias("most"))
        few = columns.join(most, "column").filter("root <> most")
    few = few.select("column", F.col("n").alias("xn"), F.col("sig").alias("x"), F.col("place").alias("xplace"), F.col("root").alias("xroot"))
    room = F.least(F.col("n") - F.col("place"), F.col("xn") - F.col("xplace"))
    met = columns.join(few, "column").filter((F.col("root") != F.col("xroot")) & (room * (100 + percent) >= (F.col("n") + F.col("xn")) * percent))
    return met.select(F.least("x", "sig").alias("a"), F.greatest("x", "sig").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose overlap reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row_a, row_b, raw_a, raw_b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(raw_a, np.uint64), np.frombuffer(raw_b, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                if 100 * overlap >= percent * (len(both) - overlap):
                    a.append(row_a)
                    b.append(row_b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    x = sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, label: str = "components", rows: int | None = None) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b), for every
    node that has one.

    Alternates large-star and small-star steps: every node points at the
    smallest neighbour known, until nothing moves. A step shuffles the links
    twice; a node with very many links is summed up before it is shuffled.
    `rows` is a bound of the links, if one is known.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label, rows)
    # A step never makes more edges than nodes and edges before it.
    rows = 2 * edges.count()
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, materialize(small.select("e.u", "e.v").filter("u > v").distinct(), label, rows)
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._skein_path = edges._skein_path
            return out
        state = now


def _roots(sets: DataFrame, percent: int) -> DataFrame:
    """node, root: components of the sets (sig, n, hashes), for those with links."""
    spark = sets.sparkSession
    with batches_of(spark, 256):
        columns = materialize(_required_columns(sets, percent), "columns")
    entries = columns.count()
    roots = materialize(spark.createDataFrame([], "node long, root long"), "roots", 0)
    met = materialize(spark.createDataFrame([], "a long, b long"), "met", 0)
    held = columns.withColumn("root", F.col("sig"))
    for hubs in (*HUBS, None):
        # A column whose sets are all connected is done.
        open_ = held.groupBy("column").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("column")
        open_columns = materialize(held.join(open_, "column", "left_semi"), "open", entries)
        discard(columns)
        columns, entries = open_columns, open_columns.count()
        pairs = materialize(_meeting(columns, hubs, percent).join(met, ["a", "b"], "left_anti"), "pairs", entries)
        n_pairs = pairs.count()
        # A batch of pairs holds two sets a row.
        with batches_of(spark, 128):
            links = materialize(_linked(pairs, sets, percent), "links", n_pairs)
        if not links.isEmpty():
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            before, roots = roots, components(known.union(links), rows=known.count() + n_pairs)
            discard(before)
        if hubs is None:
            discard(columns, met, pairs, links)
            return roots
        before, met = met, materialize(met.union(pairs), "met", n_pairs + met.count())
        discard(before, pairs, links)
        held = columns.drop("root").join(roots, columns["sig"] == roots["node"], "left").select("sig", "n", "place", "column", F.coalesce("root", "sig").alias("root"))
    raise AssertionError("the last round returns")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    Words are separated by blanks, A-Z lower-cased; a document's set holds its
    distinct runs of `width` words, or all its words if they are fewer. Two
    documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable over links. Documents with
    equal sets are one class, so copies are never paired. Null and blank texts
    have the empty set and link with nothing; repeated rows each get a row; no
    rows give no rows; other columns are not read.

    Shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", "text")
    base = materialize(_signatures(texts, width), "sets")
    rows, entries = base.agg(F.count("*"), F.coalesce(F.sum("n_half"), F.lit(0))).first()
    blocks = int(entries // BLOCK_ENTRIES) + 1
    # A linked set has at most n * (100 - percent) / 100 columns of its own.
    alone = F.floor(F.col("n") * (100 - percent) / 100)
    shared = _shared_counts(_column_blocks(texts.select("text"), _lower_half(width), blocks), blocks)
    classes = base.filter("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("n_half").alias("n_half"))
    # A set without a row shares nothing in that half, and may link by the other.
    kept = classes.join(shared, "sig", "left").filter(F.col("n_half") - F.coalesce("shared", F.lit(0)) <= alone)
    kept = materialize(kept.select("sig"), "kept", rows)
    sets = materialize(_kept_sets(texts, kept, width), "kept_sets")
    roots = _roots(sets, percent)
    discard(kept, sets)

    rooted = base.join(roots, base["sig"] == roots["node"], "left").select("doc_id", "n", F.coalesce("root", "sig").alias("root"))
    rooted = materialize(rooted, "rooted", rows)
    discard(base, roots)
    least = rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(least, "root", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
