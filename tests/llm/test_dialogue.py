import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from quayside.llm import dialogue as dl
from quayside.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, part string, salt string, audit int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], SCHEMA)


def symbol(role, fault):
    return 8 if fault in (1, 2) else "sua".find(role[:1] or "?") % 4 + 4 * (fault == 3)


def all_edits(symbols):
    """Cheapest cost and least edits by dynamic programming over whole texts:
    the least of all edits that lead to a state."""
    def inserted(best):
        for _ in range(4):
            for s, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if s in best:
                    new = (best[s][0] + 2, best[s][1] + "I")
                    best[to] = min(best.get(to, new), new)
        return best
    best = inserted({0: (0, "")})
    for x in symbols:
        nxt = {}
        for s, (c, e) in best.items():
            ways = [(s, c + 3, "D")]
            if x != 8:
                more = x // 4
                given = 3 if s == 2 else 2
                ways.append((given, c + 2 + more, "R"))
                initial = "sua?"[x % 4]
                if initial == "s" and s == 0:
                    ways.append((1, c + more, "K"))
                if initial == "u" and s != 2:
                    ways.append((2, c + more, "K"))
                if initial == "a" and s == 2:
                    ways.append((3, c + more, "K"))
            for to, cost, edit in ways:
                nxt[to] = min(nxt.get(to, (1 << 30, "")), (cost, e + edit))
        best = inserted(nxt)
    return min(best[s] for s in (0, 3) if s in best)


def exhaustive(symbols):
    """Every sequence of edits with few insertions, checked by the pattern."""
    best = None
    spots = len(symbols) + 1
    for inserts in itertools.product(range(3), repeat=spots):
        for edits in itertools.product("DKR", repeat=len(symbols)):
            text, cost, out = "", 0, []
            for i in range(spots):
                text += "I" * inserts[i]
                cost += 2 * inserts[i]
                out += ["ua"] * inserts[i]
                if i < len(symbols):
                    e, x = edits[i], symbols[i]
                    if x == 8 and e != "D":
                        break
                    text += e
                    cost += {"D": 3, "K": 0, "R": 2}[e] + (x // 4 if e != "D" and x != 8 else 0)
                    if e != "D":
                        out.append("sua?"[x % 4] if e == "K" else "ua")
            else:
                if (best is None or (cost, text) < best) and any(
                        re.fullmatch(r"(s?(ua)+)?", "".join(o)) for o in itertools.product(*out)):
                    best = (cost, text)
    return best


def test_tables_equal_all_edits():
    for n in range(3):
        for symbols in itertools.product(range(9), repeat=n):
            want = exhaustive(symbols)
            assert all_edits(symbols) == want
            assert (dl.cost_of(bytes(symbols)), dl.edits_of(bytes(symbols))) == want


def test_blocks_equal_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(600):
        symbols = bytes(rnd.choice((0, 1, 2, 3, 5, 6, 8)) for _ in range(rnd.randint(0, 40)))
        assert (dl.cost_of(symbols), dl.edits_of(symbols)) == all_edits(symbols)


def test_chunks_combine():
    rnd = random.Random(4)
    for _ in range(60):
        parts = [bytes(rnd.randrange(9) for _ in range(rnd.randint(0, 9))) for _ in range(4)]
        v, after = 0, []
        effects = [dl.Effect.from_bytes(dl.Effect.of(p).to_bytes()) for p in parts]
        for e in reversed(effects):
            after.append(v)
            v = int(e.before[v])
        state, text = 0, ""
        for k, (p, e, a) in enumerate(zip(parts, effects, reversed(after))):
            text += dl.edits_of(p, a, state, k == 3)
            state = int(e.state[a, state])
        assert text == dl.edits_of(b"".join(parts)) == all_edits(b"".join(parts))[1]


def test_block_tables_are_all_there():
    t = dl.tables()
    assert t.block[0].shape == (len(t.vectors), 9 ** dl.BLOCK)
    assert all(min(v) == 0 for v in t.vectors) and len(set(t.vectors)) == len(t.vectors)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def brute(rows, ids):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
        by[conv].append((turn is not None, turn or 0, digest, role, text))
    out = []
    for conv in ids:
        got, seen, faults = sorted(by[conv]), set(), []
        for _, _, _, role, text in got:
            solid = WORD.findall(text)
            faults.append(1 if not solid else 2 if (role, text) in seen
                          else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, edits = all_edits([symbol(r[3], f) for r, f in zip(got, faults)])
        lines, i, state = [], 0, 0
        for e in edits:
            role = "assistant" if state == 2 else "user"
            if e != "I":
                mine, text = got[i][3], got[i][4]
                i += 1
                if e == "D":
                    continue
                if e == "K":
                    role = mine
                    state = 1 if role[0] == "s" else 2 if role[0] == "u" else 3
                else:
                    state = 3 if state == 2 else 2
            else:
                text, state = "", 3 if state == 2 else 2
            lines.append(f"{role}:{text}")
        turns = {t for known, t, *_ in got if known}
        pairs = [a[3][:1] + b[3][:1] for a, b in zip(got, got[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    faults.count(1), faults.count(2), faults.count(3),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def answer(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                          "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(0, 9)):
            rows.append((c, t + rnd.choice((0, 0, 0, 1)),
                         rnd.choice(["user", "assistant", "system", "user", "assistant", "tool"]),
                         rnd.choice(["Hello there.", "fine", " \t\n", "So it is!", "Why? ",
                                     f"Text {rnd.randint(0, 99)}."])))
    return rows


@pytest.mark.parametrize("chunk_rows,parts", [(4096, 3), (3, 5), (1, 2)])
def test_equals_brute_force(spark, chunk_rows, parts):
    rows = conversations(60, chunk_rows)
    rows += [(1000, i // 2, ["user", "assistant"][i % 2], f"turn {i % 11}.") for i in range(300)]
    got = dl.repair(table(spark, rows).repartition(parts), chunk_rows=chunk_rows)
    assert answer(dl.digests(got)) == brute(rows, {r[0] for r in rows})


def test_damaged_rows(spark):
    rows = conversations(150, 7)
    df = table(spark, rows)
    assert sorted(map(tuple, dl.damaged(df).collect())) == sorted(damage(rows))
    got = dl.digests(dl.repair(dl.damaged(df), ids=df, chunk_rows=4))
    assert answer(got) == brute(damage(rows), {r[0] for r in rows})


def test_awkward_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(None, None, None, None), (None, None, None, None), (None, 3, "user", "Hi."),
            (1, None, "user", "Yes."), (1, None, "user", "Yes."), (1, 5, "assistant", None),
            (2, None, None, "Go."), (3, 1, "user", ""), (4, -7, "", "Empty role."),
            (4, 9, "Ünïcode", "x"), (5, 1, "user", long), (5, 2, "assistant", long),
            (6, 1, "user", "a\nb."), (7, 1, "assistant", "漢字。"), (8, None, "system", "S."),
            (9, 1, "user:", "x."), (9, 1, "user", ":x.")]
    rows += [(12, 4, "user", "the same.")] * 700
    for chunk_rows in (2, 4096):
        got = dl.repair(table(spark, rows).repartition(3), chunk_rows=chunk_rows,
                        chunk_bytes=1_000_000)
        assert answer(dl.digests(got)) == brute(rows, {r[0] for r in rows})


def test_a_hot_conversation_lies_in_several_tasks(spark):
    rows = [(1, None, None, None)] * 3000 + [(i, 1, "user", "One.") for i in range(2, 300)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        pieces = dl.repair(table(spark, rows).repartition(4), chunk_rows=100)
    finally:
        spark.conf.set(coalesce, "true")
    parts = {r["part"] for r in pieces.where("conv_id = 1").select("part").collect()}
    assert len(parts) > 1
    assert answer(dl.digests(pieces)) == brute(rows, {r[0] for r in rows})


def test_empty_tables(spark):
    none = table(spark, [])
    assert answer(dl.digests(dl.repair(none))) == []
    one = table(spark, [(5, 1, "user", "Hello.")])
    assert answer(dl.digests(dl.repair(none, ids=one))) == [
        (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert answer(queries.op11_dialogue(spark, SF_SMALL)) == brute(
        damage(rows), {r[0] for r in rows})
