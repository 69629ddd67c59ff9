"""Repair of conversation structure by a lazily determinised weighted automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.llm.common import BATCH_ROWS, batches_of, materialize

BLANKS = " \t\n\x0b\x0c\r"
#: What a row is to the repair: its role's initial and its fate.
BLANK, DUPLICATE, CLEAN, CUT = "0123"
KEEP, REROLE, DELETE, INSERT, CUT_STAYS = 0, 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant. What comes
#: next unless a system row opens; 0 and 3 accept.
NEXT, ACCEPTING, FAR = (2, 2, 3, 2), (0, 3), 10**9
_ROLE = {2: "user", 3: "assistant"}
#: Edits with the role they give: u, a insert; U, A rerole; K keeps; D deletes.
_AUDIT = str.maketrans("uaUAKD", "IIRRKD")


def audit_of(codes: str) -> str:
    return codes.translate(_AUDIT)


class Repairer:
    """The determinised automaton: its states are vectors of the cost of each
    state, less their least; steps are worked out when first met and kept in
    tables. Vectors, signs and marks are few, whatever the rows."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.closed: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._steps: dict[tuple[int, str], tuple[int, int]] = {}
        self._marks: dict[tuple[int, str, int], int] = {}
        self._moves: dict[tuple[int, str, int, int], tuple[str, int]] = {}
        self.start = self._id((0, FAR, FAR, FAR))

    def _id(self, vector: tuple[int, ...]) -> int:
        if vector not in self._ids:
            self._ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            closed = list(vector)
            for q in (0, 1, 3, 2):  # an insertion leads to 2, or from 2 to 3
                closed[NEXT[q]] = min(closed[NEXT[q]], closed[q] + INSERT)
            self.closed.append(tuple(closed))
        return self._ids[vector]

    @staticmethod
    def arcs(q: int, sign: str) -> list[tuple[str, int, int]]:
        """(code, state, cost) of a row's edits, in the order of their letters."""
        initial, fate = sign
        out = [("D", q, DELETE)]
        if fate in (CLEAN, CUT):
            left, then = (CUT_STAYS if fate == CUT else 0), NEXT[q]
            if initial == "s" and q == 0:
                out.append(("K", 1, KEEP + left))
            if initial == _ROLE[then][0]:
                out.append(("K", then, KEEP + left))
            out.append((_ROLE[then][0].upper(), then, REROLE + left))
        return out

    def step(self, at: int, sign: str) -> tuple[int, int]:
        found = self._steps.get((at, sign))
        if found is None:
            costs = [FAR] * 4
            for q, have in enumerate(self.closed[at]):
                if have < FAR:
                    for _, then, cost in self.arcs(q, sign):
                        costs[then] = min(costs[then], have + cost)
            # States that state 3 beats whatever follows go, so that differences
            # stay small: it takes all that state 1 takes, and a system row,
            # which only state 0 keeps, it can delete.
            rival = min(costs[3], min(costs[2], costs[0] + INSERT, costs[1] + INSERT) + INSERT)
            costs[0] = FAR if costs[0] > rival + DELETE else costs[0]
            costs[1] = FAR if costs[1] > rival else costs[1]
            least = min(costs)
            found = self._steps[at, sign] = (self._id(tuple(c - least if c < FAR else FAR for c in costs)), least)
        return found

    def _inserted(self, at: int, marks: int) -> int:
        """Marks also what leads to a marked state by cheapest insertions."""
        costs = self.closed[at]
        for q in (2, 0, 1, 3):
            if marks >> NEXT[q] & 1 and costs[q] + INSERT == costs[NEXT[q]]:
                marks |= 1 << q
        return marks

    def _mark(self, at: int, sign: str, marks: int) -> int:
        """The states of a vector on a cheapest way to the marked ones behind a row."""
        key = (at, sign, marks)
        if key not in self._marks:
            then, less = self.step(at, sign)
            tight = 0
            for q, have in enumerate(self.closed[at]):
                for _, to, cost in self.arcs(q, sign) if have < FAR else ():
                    if marks >> to & 1 and have + cost - less == self.closed[then][to]:
                        tight |= 1 << q
            self._marks[key] = self._inserted(at, tight)
        return self._marks[key]

    def _move(self, at: int, sign: str, marks: int, q: int) -> tuple[str, int]:
        """From a marked state over one row, by the least letters: the codes,
        insertions before the row included, and the state behind it."""
        key = (at, sign, marks, q)
        if key not in self._moves:
            then, less = self.step(at, sign)
            costs, here, codes = self.closed[at], self._mark(at, sign, marks), ""
            while True:
                ways = [
                    (audit_of(code), code, to)
                    for code, to, cost in self.arcs(q, sign)
                    if marks >> to & 1 and costs[q] + cost - less == self.closed[then][to]
                ]
                onward = NEXT[q]
                if here >> onward & 1 and costs[q] + INSERT == costs[onward]:
                    ways.append(("I", _ROLE[onward][0], onward))
                letter, code, q = min(ways)
                codes += code
                if letter != "I":
                    break
            self._moves[key] = (codes, q)
        return self._moves[key]

    def repair(self, signs: list[str]) -> tuple[int, list[str]]:
        """The least cost, and the codes of each row's edits; insertions at the
        end stand with the last row. Of equally cheap edits, the one whose
        letters come first in ASCII. One scan of the table forward, one of the
        marks backward, one of the moves forward."""
        if not signs:
            return 0, []
        way, cost = [self.start], 0
        for sign in signs:
            at, more = self.step(way[-1], sign)
            way.append(at)
            cost += more
        last = self.closed[way[-1]]
        least = min(last[q] for q in ACCEPTING)
        ends = sum(1 << q for q in ACCEPTING if last[q] == least)
        marks = [self._inserted(way[-1], ends)]
        for at, sign in zip(reversed(way[:-1]), reversed(signs), strict=True):
            marks.append(self._mark(at, sign, marks[-1]))
        marks.reverse()
        q, out = 0, []
        for i, sign in enumerate(signs):
            codes, q = self._move(way[i], sign, marks[i + 1], q)
            out.append(codes)
        while not (ends >> q & 1):
            q = NEXT[q]
            out[-1] += _ROLE[q][0]
        return cost + least, out


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repaired_lines(codes: str, role: str, text: str) -> list[str]:
    line = {"u": "user:", "a": "assistant:", "U": f"user:{text}", "A": f"assistant:{text}", "K": f"{role}:{text}"}
    return [line[c] for c in codes if c != "D"]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage, one for each copy's original: conv_id, turn, role,
    text, `copies` (0: dropped), `initial`, `fate` (BLANK, CLEAN or CUT) and
    `tie`, by which rows of one turn are ordered."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    hurt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), draw.alias("draw"), spaced("role").alias("role"), spaced("text").alias("text"))
    hurt = hurt.withColumn("tie", F.md5(F.concat_ws(":", "role", "text")))
    d = F.col("draw")
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = hurt.select(
        "conv_id",
        "turn",
        F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d != 0, text).otherwise("").alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"),
        "tie",
    )
    first, last = F.substring("role", 1, 1), F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    return hurt.withColumns(
        {
            "initial": F.when(first.isin("s", "u", "a"), first).otherwise("o"),
            "fate": F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(CUT),
        }
    )


#: Characters of one conversation's texts that a task holds at once, and the
#: most rows; longer conversations take the way of those cut between tasks.
HELD_CHARS, HELD_ROWS = 4_000_000, 20_000
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _schema(conv: T.DataType, more: str) -> T.StructType:
    out = T.StructType([T.StructField("conv_id", conv)])
    for f in T.StructType.fromDDL(more).fields:
        out = out.add(f)
    return out


def _counts(signs: list[str]) -> dict[str, int]:
    fates = [s[1] for s in signs]
    return {
        "blank": fates.count(BLANK),
        "duplicate": fates.count(DUPLICATE),
        "truncated": fates.count(CUT),
        "illegal": illegal_pairs("".join(s[0] for s in signs)),
    }


def _whole(repairer: Repairer, rows: list[tuple]) -> dict:
    """The result of a conversation from its rows (turn, role, text, copies,
    initial, fate) in order."""
    seen: set[tuple[str, str]] = set()
    signs, kept, turns = [], [], set()
    for turn, role, text, copies, initial, fate in rows:
        for _ in range(copies):
            known = (role, text) in seen
            signs.append(initial + (DUPLICATE if known and fate != BLANK else fate))
            seen.add((role, text))
            kept.append((role, text))
            turns.add(turn)
    cost, codes = repairer.repair(signs)
    lines = [line for c, (role, text) in zip(codes, kept, strict=True) for line in repaired_lines(c, role, text)]
    turns.discard(None)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **_counts(signs),
        "cost": cost,
        "audit": audit_of("".join(codes)),
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _sweep(schema: T.StructType, held_chars: int, held_rows: int):
    """Arrow batches of ordered rows to results, and rows of conversations that
    may go on in another task, or are too long to hold, as they are."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, repairer = TaskContext.get().partitionId(), Repairer()
        out: list[dict] = []
        now: object = run  # no conversation's id
        held: list[tuple] = []
        chars = seq = 0
        passing = first = True

        def pass_on() -> None:
            nonlocal seq
            for turn, role, text, copies, initial, fate in held:
                row = {"conv_id": now, "part": part, "turn": turn, "role": role, "text": text, "initial": initial, "fate": fate}
                for _ in range(copies):
                    out.append(row | {"seq": seq})
                    seq += 1
                if not copies:
                    out.append({"conv_id": now, "part": part})
            held.clear()

        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "initial", "fate")), strict=True):
                if conv != now:
                    if now is not run:
                        if passing or first:
                            pass_on()
                        else:
                            out.append({"conv_id": now} | _whole(repairer, held))
                            held.clear()
                        first = False
                    now, chars, passing = conv, 0, False
                held.append(tuple(row))
                chars += len(row[2])
                if chars > held_chars or len(held) > held_rows:
                    passing, chars = True, 0
                    pass_on()
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        pass_on()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def _plans(schema: T.StructType):
    """Conversations' signs by segment to one row of results each, and one row
    a segment with the codes of its rows."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer()
        for batch in batches:
            for conv, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                joined = "".join(s["signs"] for s in segments)
                signs = [joined[i : i + 2] for i in range(0, len(joined), 2)]
                cost, codes = repairer.repair(signs)
                result = {"conv_id": conv, **_counts(signs), "cost": cost, "audit": audit_of("".join(codes))}
                yield pa.RecordBatch.from_pylist([result], arrow)
                at = 0
                for s in segments:
                    upto = at + len(s["signs"]) // 2
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": s["part"], "base": s["base"], "codes": codes[at:upto]}], arrow)
                    at = upto

    return run


def _hashes(schema: T.StructType):
    """Pieces of repaired conversations in order to one SHA-256 each."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        running = hashlib.sha256()
        for batch in batches:
            done = []
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if conv != now:
                    if now is not run:
                        done.append({"conv_id": now, "repaired_sha256": running.hexdigest()})
                    now, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if now is not run:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": running.hexdigest()}], arrow)

    return run


#: Rows of one piece of a repaired conversation.
PIECE_ROWS = 64


def _lines() -> Column:
    """The repaired lines of a row by its codes; null where none is left."""
    said = lambda role: F.concat(role, F.lit(":"), F.col("text"))

    def line(c: Column) -> Column:
        return (
            F.when(c == "u", "user:")
            .when(c == "a", "assistant:")
            .when(c == "U", said(F.lit("user")))
            .when(c == "A", said(F.lit("assistant")))
            .when(c == "K", said(F.col("role")))
        )

    lines = F.transform(F.filter(F.split("code", ""), lambda c: c.isin(*"uaUAK")), line)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _cut_conversations(rows: DataFrame, conv: T.DataType) -> DataFrame:
    """Results of conversations that lie in several tasks or are long: rows
    (conv_id, part, seq, turn, role, text, initial, fate), ordered by (part, seq).

    Texts stay spread: first places of equal rows are summed up by hash, signs
    (two characters a row) are gathered, as the audit that comes of them is one
    value too, and what each row becomes goes back to it by place.
    """
    live = rows.filter("seq IS NOT NULL")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    firsts = live.groupBy("conv_id", same.alias("same")).agg(F.min(F.struct("part", "seq")).alias("at")).select("at.*", F.lit(True).alias("fresh"))
    fate = F.when(F.col("fresh").isNull() & (F.col("fate") != BLANK), DUPLICATE).otherwise(F.col("fate"))
    signed = live.select("conv_id", "part", "seq", "initial", "fate").join(firsts, ["part", "seq"], "left")
    signed = signed.withColumn("sign", F.concat("initial", fate))
    in_order = F.array_sort(F.collect_list(F.struct("seq", "sign")))
    segments = signed.groupBy("conv_id", "part").agg(F.min("seq").alias("base"), F.array_join(F.transform(in_order, lambda s: s["sign"]), "").alias("signs"))
    gathered = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "base", "signs"))).alias("segments"))
    planned = _schema(conv, "blank long, duplicate long, truncated long, illegal long, cost long, audit string, part int, base long, codes array<string>")
    plans = materialize(gathered.mapInArrow(_plans(planned), planned), "plans")

    edits = plans.filter("part IS NOT NULL").select("part", "base", F.posexplode("codes").alias("nth", "code"))
    edits = edits.select("part", (F.col("base") + F.col("nth")).alias("seq"), "code")
    lines = live.select("conv_id", "part", "seq", "role", "text").join(edits, ["part", "seq"]).withColumn("line", _lines()).filter("line IS NOT NULL")
    block = F.floor(F.col("seq") / PIECE_ROWS).alias("block")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    pieces = lines.groupBy("conv_id", "part", block).agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("piece"))
    hashed = _schema(conv, "repaired_sha256 string")
    hashes = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "piece").mapInArrow(_hashes(hashed), hashed)

    turns = live.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    known = rows.select("conv_id").distinct()
    found = known
    for more in (turns, plans.filter("part IS NULL").drop("part", "base", "codes"), hashes):
        found = found.unionByName(more, allowMissingColumns=True)
    names = [f.name for f in T.StructType.fromDDL(_RESULT).fields]
    out = found.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in names])
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return out.select("conv_id", *[F.coalesce(n, empty.get(n, F.lit(0))).alias(n) for n in names])


def repair_conversations(rows: DataFrame, *, held_chars: int = HELD_CHARS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Damages `rows` (conv_id, turn, role, text) by rule, and finds the cheapest
    repair of every conversation.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 for every conv_id of the input. Null ids form one
    conversation; null turns come first; null roles and texts are one blank;
    rows of one turn are ordered by the MD5 of role:text before damage, equal
    rows being interchangeable; a role that begins with neither s, u nor a
    cannot be kept; other columns take no part; no rows give no rows.

    Rows are dealt to tasks by ranges of (conv_id, turn), in order, so a
    conversation of any share of the rows is spread. What lies whole inside a
    task is repaired in one sweep; conversations that a task's ends may cut, or
    of more than `held_chars` characters or `held_rows` rows, take
    _cut_conversations. Both ways give the same.
    """
    conv = rows.schema["conv_id"].dataType
    keys = ["conv_id", "turn", "tie", "__row"]
    spark = rows.sparkSession
    with batches_of(spark, BATCH_ROWS):
        dealt = damaged(rows).withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        schema = _schema(conv, f"{_RESULT}, part int, seq long, turn long, role string, text string, initial string, fate string")
        light = dealt.select("conv_id", "turn", "role", "text", "copies", "initial", "fate")
        swept = materialize(light.mapInArrow(_sweep(schema, held_chars, held_rows), schema), "swept")
        names = ["conv_id", *[f.name for f in T.StructType.fromDDL(_RESULT).fields]]
        whole = swept.filter("part IS NULL").select(*names)
        cut = swept.filter("part IS NOT NULL").drop(*names[1:])
        return whole.unionByName(materialize(_cut_conversations(cut, conv), "repaired"))
