"""Merkle manifests of a dataset: one tree a source, one over the sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import discard, lower_ascii, materialize

#: Nodes of a run: as many digests make one parent.
FANOUT = 16
#: Columns of documents that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value told apart from all others that stand beside it: '-' if null,
    else its UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, digest, tampered): each row's leaf, and the leaf after
    tampering, which lower-cases A-Z of the text where 5 divides the CRC-32 of
    the decimal doc_id. `grp` names the source and sorts as sources do: null
    first, then by bytes."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    covered = [F.col(c) for c in COVERED]
    low = [lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in COVERED]
    return docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("grp"),
        digest(covered).alias("digest"),
        F.when(hit, digest(low)).alias("tampered"),
    )


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `place`, each row's place in its `grp` from 0 in `order`, and
    `size`, the rows of the group; written and read again.

    Rows are dealt to tasks by ranges of (grp, order), so that no task holds a
    large group; only counts of (group, range) are put in order by group. Fully
    equal rows are split by where they were read: they are interchangeable.
    """
    keys = ["grp", *order, "__row"]
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    cut = materialize(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("grp", "__range").agg(F.count("*").alias("__n"))
    along, whole = Window.partitionBy("grp").orderBy("__range"), Window.partitionBy("grp")
    before = counts.select(
        "grp",
        "__range",
        F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("size"),
    )
    inside = Window.partitionBy("grp", "__range").orderBy(*order, "__row")
    return (
        cut.join(before, ["grp", "__range"])
        .withColumn("place", F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__row", "__range", "__before")
    )


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("size")).first()[0] or 0


def levels(nodes: DataFrame, members: Sequence[str]) -> list[DataFrame]:
    """The runs of each level from the nodes (grp, place, size, digest,
    `members`) up, until every group has one node.

    A run is a window over (grp, place div FANOUT): its ordered full frame
    gives the parent's input and, as `run`, all siblings; the first row of each
    run stands for the parent. `alone` marks a group of one node, which is its
    own parent and has no siblings. `members` go into the lowest level's runs.
    Each level is a sixteenth of the one below and is written once.
    """
    out: list[DataFrame] = []
    below, kept = nodes, ["digest", *members]
    while True:
        parent = F.expr(f"place div {FANOUT}")
        frame = Window.partitionBy("grp", parent).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = below.withColumn("run", F.collect_list(F.struct(*kept)).over(frame)).filter(f"place % {FANOUT} = 0")
        joined = F.sha2(F.array_join(F.col("run.digest"), ""), 256)
        level = materialize(
            runs.select(
                "grp",
                parent.alias("place"),
                F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"),
                (F.col("size") == 1).alias("alone"),
                "run",
                F.when(F.col("size") == 1, F.col("digest")).otherwise(joined).alias("digest"),
            ),
            "runs",
        )
        out.append(level)
        if _largest(level) <= 1:
            return out
        # A group that has come to one node has its root in `level` already.
        below, kept = level.filter("size > 1").select("grp", "place", "size", "digest"), ["digest"]


def roots(tree: Sequence[DataFrame]) -> DataFrame:
    """(grp, digest): each group's last node."""
    tops = [level.filter("size = 1").select("grp", "digest") for level in tree]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def _step(run: Column, at: Column) -> Column:
    """What stands left and right of a run's member `at` (from 0)."""
    side = lambda x: F.array_join(x, "")
    return F.struct(
        side(F.slice(run, F.lit(1), at)).alias("left"),
        side(F.slice(run, at + 2, F.lit(FANOUT))).alias("right"),
    )


def members_with_paths(tree: Sequence[DataFrame], top: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The lowest level's members, one row each, with `path`: what stands left
    and right of the node and of each of its ancestors, lowest first.

    `top` gives each group's root its own path and the columns `carried`. The
    way leads down: a level's runs meet their own paths by (grp, place), and
    pass them on to their members.
    """
    passed: DataFrame | None = None
    below = None
    for level in reversed(tree):
        ends = level.filter("size = 1").join(top, "grp")
        if passed is not None:
            ends = ends.unionByName(level.filter("size > 1").join(passed, ["grp", "place"]))
        below = ends.select("grp", "place", "alone", "path", *carried, F.col("run.digest").alias("__digests"), F.posexplode("run").alias("__at", "__member"))
        below = below.withColumn(
            "path",
            F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(_step(F.col("__digests"), F.col("__at"))), F.col("path"))),
        )
        passed = below.select("grp", (F.col("place") * FANOUT + F.col("__at")).alias("place"), "path", *carried)
    return below.select("grp", "path", *carried, "__member.*")


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Each row's leaf, its source's subroot, the dataset's root, the digest of
    its proof, and whether the row, after tampering, still leads to the root.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    Leaves ascend by doc_id within a source, nulls first, and equal ids by
    leaf; a null in any column is a value of its own, as is an empty text;
    repeated rows are leaves of their own and interchangeable; other columns
    take no part; no rows give no rows. A third of all rows in one source, or
    in one id, is dealt to many tasks.
    """
    rows = materialize(leaves(docs), "leaves")
    ranked = placed(rows, ["doc_id", "digest"])
    tree = levels(ranked, ["doc_id", "tampered"])
    sources = roots(tree).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    over = levels(placed(sources, ["name"]), ["name"])
    discard(rows)
    no_path = F.expr("CAST(array() AS array<struct<left: string, right: string>>)")
    top = members_with_paths(over, roots(over).select("grp", F.col("digest").alias("root"), no_path.alias("path")), ["root"])
    subroots = top.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    found = members_with_paths(tree, subroots, ["subroot", "root"])
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("tampered", "digest")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
