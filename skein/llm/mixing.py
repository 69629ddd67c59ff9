"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BLANK_WORD, draw, materialize, root_buckets, running_total, unit

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def cyclic_weights(names: Sequence[str | None]) -> list[int]:
    return [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: int) -> list[float]:
    """Shares of `total` by weight, none above `repeats` times its size; what
    is cut off goes to the others by weight, again until none is above."""
    targets = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > repeats * sizes[i]}
        for i in full or open_:
            targets[i] = float(repeats * sizes[i]) if full else left * weights[i] / weight
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def min_cost_flow(sizes: Sequence[int], member: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words routed from each pattern to each source it belongs to.

    The k-th pass over a pattern costs k a word, so the cost is convex and
    repetition is spread before any pattern is read once more. Primal-dual:
    each phase finds the distances from the start, then a whole maximum flow
    over the edges on shortest paths (levels and blocking flows). Path costs
    are small integers, so phases are few, whatever the number of patterns.
    """
    n_p, n_s = len(sizes), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    edges: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]

    def link(a: int, b: int, capacity: int, price: int) -> int:
        for u, v, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            edges[u].append(len(to))
            to.append(v)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    for p, size in enumerate(sizes):
        for k in range(repeats):
            link(start, p, size, k + 1)
    routes = [{s: link(p, n_p + s, sizes[p] * repeats, 0) for s in member[p]} for p in range(n_p)]
    for s, quota in enumerate(quotas):
        link(n_p + s, end, quota, 0)
    potential = [0] * len(edges)

    def distances() -> bool:
        far: list[float] = [float("inf")] * len(edges)
        far[start], queue = 0, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in edges[u]:
                if room[e] and (nd := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = nd
                    heapq.heappush(queue, (nd, to[e]))
        # Nodes out of reach move as far as the end, so that costs stay right.
        for u, d in enumerate(far):
            potential[u] += int(min(d, far[end])) if far[end] < float("inf") else 0
        return far[end] < float("inf")

    def levels() -> list[int]:
        level = [-1] * len(edges)
        level[start], queue = 0, [start]
        for u in queue:
            for e in edges[u]:
                if room[e] and level[to[e]] < 0 and cost[e] + potential[u] == potential[to[e]]:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        return level

    def block(level: list[int]) -> None:
        """A blocking flow of the level graph, by one path after another."""
        turn = [0] * len(edges)
        path: list[int] = []
        u = start
        while True:
            if u == end:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[u] < len(edges[u]):
                e = edges[u][turn[u]]
                if room[e] and level[to[e]] == level[u] + 1 and cost[e] + potential[u] == potential[to[e]]:
                    break
                turn[u] += 1
            if turn[u] < len(edges[u]):
                path.append(edges[u][turn[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                return

    while distances():
        while (level := levels())[end] >= 0:
            block(level)
    return [{s: room[e ^ 1] for s, e in route.items() if room[e ^ 1]} for route in routes]


def mix(
    docs: DataFrame,
    *,
    member: Column,
    size: Column,
    identity: Sequence[Column],
    weights: Callable[[Sequence[str | None]], Sequence[float]] = cyclic_weights,
    repeats: int = 3,
    seed: int = 9,
    max_patterns: int = 100_000,
) -> DataFrame:
    """How often the mix takes each row of `docs`.

    `member`: array of the sources a row belongs to (overlaps allowed; null is
    a source, sorted last). Rows are summed by membership pattern; a min-cost
    flow routes each pattern's words, up to `repeats` passes of them, to the
    sources' quotas; within a pattern all rows are taken as often as whole
    passes need, and rows in seeded order make up the rest, the last of them
    chosen to close the gap best. Quotas are shares of all words by weight,
    cut at `repeats` times a source's own words (water_fill).

    Returns the columns of `docs` (its own size, source_size, target, copies and
    taken are replaced) plus size, source_size and target (of the row's first
    source), copies and taken = copies * size. `identity`: what tells rows
    apart in the seeded order; fully equal rows are interchangeable. Rows
    without words are in every whole pass and take nothing. A null or empty
    `member` counts as the null source. No rows give no
    rows. The table of patterns is all the driver sees; more than
    `max_patterns` of them raise ValueError.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "copies", "taken"]
    null_source = F.array(F.lit(None).cast(docs.select(F.element_at(member, 1)).dtypes[0][1]))
    member = F.when(F.size(F.coalesce(member, F.array())) > 0, member).otherwise(null_source)
    base = docs.withColumns(
        {
            "__size": F.coalesce(size, F.lit(0)).cast("long"),
            "__pattern": F.to_json(F.struct(F.array_sort(F.array_distinct(member)).alias("m")), {"ignoreNullFields": "false"}),
            "__first": F.array_sort(F.array_distinct(member))[0],
            "__draw": draw(F.lit(seed), *identity),
        }
    ).drop(*new)
    base = materialize(base, "mix")
    found = (
        base.groupBy("__pattern")
        .agg(F.sum("__size").alias("size"), F.count("*").alias("rows"), F.first(F.array_sort(F.array_distinct(member))).alias("m"))
        .limit(max_patterns + 1)
        .collect()
    )
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found.sort(key=lambda r: r["__pattern"])
    names = sorted({x for r in found for x in r["m"]}, key=lambda x: (x is None, x or ""))
    at = {x: i for i, x in enumerate(names)}
    own = [0] * len(names)
    for r in found:
        for x in r["m"]:
            own[at[x]] += r["size"]
    total = sum(r["size"] for r in found)
    targets = water_fill(own, list(weights(names)), total, repeats)
    flow = min_cost_flow([r["size"] for r in found], [[at[x] for x in r["m"]] for r in found], [int(t + 0.5) for t in targets], repeats)
    plan = []
    for r, routed in zip(found, flow, strict=True):
        words = sum(routed.values())
        passes, rest = divmod(words, r["size"]) if r["size"] else (1, 0)
        first = at[r["m"][0]]
        plan.append((r["__pattern"], int(own[first]), float(targets[first]), int(passes), int(rest)))
    planned = spark.createDataFrame(plan, "__pattern string, source_size long, target double, __passes long, __rest long")
    rows = sum(r["rows"] for r in found)
    ties = [F.col("__draw"), *identity]
    run = running_total(
        base, group=["__pattern"], fraction=unit(F.col("__draw")), order=ties, value=F.col("__size"),
        buckets=root_buckets(rows), total="__end", whole="__whole",
    )
    run = run.join(F.broadcast(planned), "__pattern").withColumn("__in", F.col("__end") <= F.col("__rest"))
    # The gap that whole rows leave, and the row outside that closes it best.
    gap = run.groupBy("__pattern").agg(
        (F.max("__rest") - F.coalesce(F.max(F.when(F.col("__in"), F.col("__end"))), F.lit(0))).alias("__gap")
    )
    near = F.struct(F.abs(F.col("__gap") - F.col("__size")).alias("off"), F.col("__draw").alias("draw"), F.col("__end").alias("end"))
    fill = (
        run.filter(~F.col("__in") & (F.col("__size") > 0))
        .join(F.broadcast(gap), "__pattern")
        .filter(F.abs(F.col("__gap") - F.col("__size")) < F.col("__gap"))
        .groupBy("__pattern")
        .agg(F.min(near).alias("__fill"))
    )
    out = run.join(F.broadcast(fill), "__pattern", "left")
    extra = F.col("__in") | F.coalesce(
        (F.col("__fill.draw") == F.col("__draw")) & (F.col("__fill.end") == F.col("__end")) & (F.col("__size") > 0), F.lit(False)
    )
    copies = F.col("__passes") + F.when(extra & (F.col("__rest") > 0) & (F.col("__size") > 0), 1).otherwise(0)
    return out.select(
        *[c for c in docs.columns if c not in new],
        F.col("__size").alias("size"),
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("__size")).alias("taken"),
    )


def blank_word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK_WORD)).cast("long")
