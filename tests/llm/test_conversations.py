"""Conversation repair against a plain search over edits."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from skein.llm import conversations

BLANK = re.compile(r"[\x20\x09-\x0D]+$")


def cheapest(rows):
    """(cost, letters, lines) of the best edits of rows (role, text, fate),
    tried one by one: what is next is told by the roles given so far."""

    @functools.cache
    def best(i, given, inserted):
        options = []
        if i == len(rows) and (given == "" or given[-1] == "a"):
            options.append((0, "", ()))
        wanted = "assistant" if given[-1:] == "u" else "user"
        if inserted < 2:
            cost, letters, lines = best(i, wanted[0], inserted + 1)
            options.append((cost + 2, "I" + letters, (wanted + ":", *lines)))
        if i < len(rows):
            role, text, fate = rows[i]
            cost, letters, lines = best(i + 1, given, 0)
            options.append((cost + 3, "D" + letters, lines))
            if fate not in ("blank", "duplicate"):
                more = fate == "truncated"
                if role[:1] == wanted[0] or (role[:1] == "s" and given == ""):
                    cost, letters, lines = best(i + 1, role[0], 0)
                    options.append((cost + more, "K" + letters, (f"{role}:{text}", *lines)))
                cost, letters, lines = best(i + 1, wanted[0], 0)
                options.append((cost + 2 + more, "R" + letters, (f"{wanted}:{text}", *lines)))
        return min(options, default=(10**6, "", ()))

    for i in reversed(range(len(rows) + 1)):
        for given in ("", "s", "u", "a"):
            best(i, given, 0)
    return best(0, "", 0)


def plain(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        mine = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in table if c == conv]
        for turn, role, text in sorted(mine, key=lambda m: (m[0] is not None, m[0] or 0, hashlib.md5(f"{m[1]}:{m[2]}".encode()).hexdigest())):
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if draw:
                text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
                rows += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
        fates, seen = [], set()
        for _, role, text in rows:
            stem = BLANK.sub("", text)
            fates.append("blank" if not stem else "duplicate" if (role, text) in seen else "" if stem[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, letters, lines = cheapest(tuple((role, text, fate) for (_, role, text), fate in zip(rows, fates, strict=True)))
        n = Counter(fates)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_automaton_equals_the_search_over_edits():
    rng, repairer = random.Random(3), conversations.Repairer()
    names = {"0": "blank", "1": "duplicate", "2": "", "3": "truncated"}
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(1500):
        signs = [rng.choice("suuaao") + rng.choice("01222223") for _ in range(rng.randint(0, 9))]
        cost, codes = repairer.repair(signs)
        want = cheapest(tuple((roles[s[0]], "t", names[s[1]]) for s in signs))
        lines = [x for c, s in zip(codes, signs, strict=True) for x in conversations.repaired_lines(c, roles[s[0]], "t")]
        assert (cost, conversations.audit_of("".join(codes)), tuple(lines)) == want
    # States are few whatever was read.
    assert len(repairer.vectors) < 60


def awkward_rows():
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        roles = (["system"] if conv % 7 == 0 else []) + ["user", "assistant"] * rng.randint(0, 5) + ["user"] * (conv % 3)
        rows += [(conv, t, r, rng.choice(["One. ", "Two!", "cut", "Same?", "x. y.\n"]) * rng.randint(1, 3)) for t, r in enumerate(roles)]
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None), (None, 3, "assistant", None)]
    rows += [(500, 1, "user", "same."), (500, 1, "user", "same."), (500, 1, "assistant", "other."), (500, 1, "", "no role."), (500, 9, "Unknown", "z.")]
    rows += [(501, None, "system", "only."), (502, 0, "user", "word " * 50_000 + "."), (502, 1, "assistant", "\x0b \t"), (503, -5, "user", "é\U0001f600?")]
    rows += [(600, t, "user" if t % 2 else "assistant", f"Turn {t % 211}{'.' if t % 5 else ''}") for t in range(900)]
    # Every row of this one is dropped.
    rows += [(700, t, "user", "gone.") for t in range(400) if zlib.crc32(f"700:{t}".encode()) % 20 == 0]
    return rows


def got(df):
    out = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    assert df.columns[0] == "conv_id" and len(out) == df.count()
    return out


@pytest.mark.parametrize("held", [{}, {"held_rows": 0}, {"held_chars": 200}])
def test_repair_equals_plain_rows(spark, held):
    from pyspark.sql import functions as F

    rows = awkward_rows()
    random.Random(1).shuffle(rows)
    clash = {"copies": F.lit(9), "cost": F.lit("x"), "part": F.lit(1), "fate": F.lit("y"), "tie": F.lit(0)}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns(clash)
    found, want = got(conversations.repair_conversations(table, **held)), plain(rows)
    assert found == want
    assert found[700] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_conversations(none).count() == 0
