"""Repair of a conversation's structure at least cost, by Four-Russians tables.

A repaired conversation's roles spell ``(s?(ua)+)?`` by their initials.  Rows
are kept (cost 0), given the role user or assistant (2) or deleted (3, which
blank and duplicate rows must be); an empty user or assistant row can be
inserted anywhere (2); a truncated row that stays costs 1 more.  Of the
cheapest edits those whose initials (D, I, K, R) are least as text are taken.

What is left to pay from each of the grammar's four states is a cost vector.
Read from a conversation's end, a row changes the vector by one of nine
symbols, and once its minimum is taken out only a few vectors occur.  For all
of them and all blocks of ``BLOCK`` symbols the vector before the block, the
cost taken out and the state after it are computed once.  A conversation is
then read block by block by lookup.  For the edits, a block is expanded
backward from the vector known at its end and walked forward, always by the
least edit that still reaches the known cost, so ties need no comparing of
whole texts; an expansion is kept and used again.

Rows are sorted over all tasks by conversation and turn, so a long
conversation lies in several of them, in chunks of at most ``chunk_rows`` rows
and ``chunk_bytes``.  A chunk's effect is a table over all vectors and states;
the chunks of a cut conversation are combined by these tables alone, and then
repaired each by itself.  A conversation that lies within one task, the usual
case, is repaired where it is read.  Only the digest of a whole conversation,
which ``digests`` makes, must go through its texts in one task, piece by piece.

Defined cases: a null role or text counts as one space; null ids are one
conversation, null turns come first; rows of one turn are ordered by the md5
of their role and text; repeated rows are duplicates of the first; a role that
begins with none of s, u, a (an empty one too) cannot stay as it is; a
conversation without rows is repaired at no cost; an empty table gives no
rows.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, removed, scratch, written
from .tokens import slices

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
BLOCK = 4
#: Symbols: initial s, u, a, other (0-3), truncated (4-7), must go (8).
INITIALS = {"s": 0, "u": 1, "a": 2}
GONE, SYMBOLS = 8, 9
#: States: nothing yet, after s, after u, after a; what an inserted or given
#: role leads to (assistant after u, else user), and where a kept initial does.
GIVEN = (2, 2, 3, 2)
KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _inserted(costs: list[int]) -> list[int]:
    """Costs by state where rows may first be inserted."""
    out = list(costs)
    for _ in out:
        out = [min(c, INSERT + out[GIVEN[s]]) for s, c in enumerate(out)]
    return out


def _taken(after, symbol: int) -> list[list[tuple[int, str, int]]]:
    """Per state, what the row can do: (cost to the end, edit, next state)."""
    out = []
    for s in range(4):
        ways = [(DELETE + after[s], "D", s)]
        if symbol != GONE:
            more = CUT_OFF if symbol >= 4 else 0
            if symbol % 4 in KEPT[s]:
                to = KEPT[s][symbol % 4]
                ways.append((KEEP + more + after[to], "K", to))
            ways.append((REROLE + more + after[GIVEN[s]], "R", GIVEN[s]))
        out.append(ways)
    return out


def _before(after, symbol: int) -> list[int]:
    return _inserted([min(w[0] for w in ways) for ways in _taken(after, symbol)])


def _walk(after, symbol: int, state: int) -> tuple[str, int]:
    """The least edits of one row (insertions before it included) that reach
    the least cost, and the state after them."""
    costs, ways, edits = _before(after, symbol), _taken(after, symbol), ""
    while True:
        best = min((e, to) for c, e, to in [*ways[state],
                                            (INSERT + costs[GIVEN[state]], "I", GIVEN[state])]
                   if c == costs[state])
        edits, state = edits + best[0], best[1]
        if best[0] != "I":
            return edits, state


class Tables:
    """Transitions of all normalised vectors by one symbol and by a block.

    ``before[v, x]`` is the vector before x if v is the one after it,
    ``cost[v, x]`` the minimum taken out, ``state[v, x, s]`` the state after x
    on the best way from s."""

    def __init__(self):
        end = tuple(_inserted([0 if s in ACCEPTED else 1 << 20 for s in range(4)]))
        self.vectors, at = [end], {end: 0}
        before, cost, self.steps = [], [], []
        for v in self.vectors:     # grows while it is read
            row = []
            for x in range(SYMBOLS):
                costs = _before(v, x)
                small = tuple(c - min(costs) for c in costs)
                if small not in at:
                    at[small] = len(self.vectors)
                    self.vectors.append(small)
                row.append((at[small], min(costs)))
            before.append([r[0] for r in row])
            cost.append([r[1] for r in row])
            self.steps.append([[_walk(v, x, s) for s in range(4)] for x in range(SYMBOLS)])
        one = (np.array(before, np.int16), np.array(cost, np.int32),
               np.array([[[s[1] for s in x] for x in v] for v in self.steps], np.int8))
        self.one = self.block = one
        for _ in range(BLOCK - 1):     # one more symbol in front of the block
            b, c, s = self.block
            n = b.shape[1]
            self.block = (one[0][b].transpose(0, 2, 1).reshape(len(b), -1),
                          (one[1][b] + c[:, :, None]).transpose(0, 2, 1).reshape(len(b), -1),
                          np.take_along_axis(np.repeat(s[:, :, None, :], SYMBOLS, axis=2),
                                             one[2][b].astype(np.int64), axis=3)
                          .transpose(0, 2, 1, 3).reshape(len(b), SYMBOLS * n, 4))
        self.expansions: dict[tuple, tuple[str, int]] = {}

    def expand(self, after: int, code: int, length: int, state: int) -> tuple[str, int]:
        """Edits of a block and the state after it; expanded once per case."""
        key = (after, code, length, state)
        got = self.expansions.get(key)
        if got is None:
            symbols = [code // SYMBOLS ** (length - 1 - i) % SYMBOLS for i in range(length)]
            ends = [after]
            for x in reversed(symbols[1:]):
                ends.append(int(self.one[0][ends[-1], x]))
            edits = ""
            for v, x in zip(reversed(ends), symbols):
                more, state = self.steps[v][x][state]
                edits += more
            got = self.expansions[key] = (edits, state)
        return got

    def closing(self, state: int) -> str:
        """Insertions after the last row."""
        edits = ""
        while state not in ACCEPTED:
            edits, state = edits + "I", GIVEN[state]
        return edits


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks(symbols: bytes) -> list[tuple[int, int]]:
    """(code, length) of the blocks: what is over comes first, by one symbol."""
    over = len(symbols) % BLOCK
    weights = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
    codes = np.frombuffer(symbols[over:], np.uint8).reshape(-1, BLOCK) @ weights
    return [(x, 1) for x in symbols[:over]] + [(c, BLOCK) for c in codes.tolist()]


def _read(parts: list[tuple[int, int]], after):
    """Vector after each block and before the first, and cost taken out, from
    the vector (or the array of vectors) after the last block."""
    t, ends, cost = tables(), [after], 0
    for code, length in reversed(parts):
        b, c, _ = t.block if length == BLOCK else t.one
        cost = cost + c[ends[-1], code]
        ends.append(b[ends[-1], code])
    return ends[::-1], cost


def edits_of(symbols: bytes, after: int = 0, state: int = 0, last: bool = True) -> str:
    """The edits of some rows, given the vector after them and the state before."""
    t, parts = tables(), blocks(symbols)
    ends, _ = _read(parts, after)
    out = []
    for v, (code, length) in zip(ends[1:], parts):
        more, state = t.expand(int(v), code, length, state)
        out.append(more)
    return "".join(out) + (t.closing(state) if last else "")


def cost_of(symbols: bytes) -> int:
    ends, cost = _read(blocks(symbols), 0)
    return int(cost) + tables().vectors[int(ends[0])][0]


class Effect:
    """What a chunk does to every vector after it and state before it."""

    def __init__(self, before: np.ndarray, cost: np.ndarray, state: np.ndarray):
        self.before, self.cost, self.state = before, cost, state

    @classmethod
    def of(cls, symbols: bytes) -> "Effect":
        t, parts = tables(), blocks(symbols)
        n = len(t.vectors)
        ends, cost = _read(parts, np.arange(n))
        state = np.tile(np.arange(4), (n, 1))
        for v, (code, length) in zip(ends[1:], parts):
            s = (t.block if length == BLOCK else t.one)[2]
            state = s[v[:, None], code, state]
        return cls(ends[0], np.zeros(n, np.int64) + cost, state)

    def to_bytes(self) -> bytes:
        return (self.before.astype("<i2").tobytes() + self.cost.astype("<i8").tobytes()
                + self.state.astype("i1").tobytes())

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Effect":
        n = len(tables().vectors)
        return cls(np.frombuffer(raw, "<i2", n), np.frombuffer(raw, "<i8", n, 2 * n),
                   np.frombuffer(raw, "i1", 4 * n, 10 * n).reshape(n, 4))


def repaired(edits: str, roles: list[str], texts: list[str], state: int = 0):
    """Roles and texts after the edits."""
    out_roles, out_texts, i = [], [], 0
    for e in edits:
        if e == "I":
            out_roles.append("assistant" if state == 2 else "user")
            out_texts.append("")
            state = GIVEN[state]
            continue
        if e == "K":
            out_roles.append(roles[i])
            out_texts.append(texts[i])
            state = KEPT[state][INITIALS[roles[i][:1]]]
        elif e == "R":
            out_roles.append("assistant" if state == 2 else "user")
            out_texts.append(texts[i])
            state = GIVEN[state]
        i += 1
    return out_roles, out_texts


class Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.turns, self.size = [], [], [], [], 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)      # they come in order
        self.size += len(role) + len(text)

    def symbols(self) -> bytes:
        return bytes(GONE if f in (BLANK, DUPLICATE)
                     else INITIALS.get(r[:1], 3) + 4 * (f == TRUNCATED)
                     for r, f in zip(self.roles, self.faults))

    def summary(self) -> dict:
        firsts = [r[:1] for r in self.roles]
        return {"blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE),
                "truncated": self.faults.count(TRUNCATED),
                "illegal": sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:])),
                "ends": [firsts[0], firsts[-1]] if firsts else [],
                "turns": [self.turns[0], self.turns[-1], len(self.turns)] if self.turns else []}


def joined(parts: list[dict]) -> dict:
    """Summaries of following chunks as one."""
    out = {n: sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated", "illegal")}
    ends = [p["ends"] for p in parts if p["ends"]]
    out["illegal"] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:]))
    turns = [p["turns"] for p in parts if p["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    out["gaps"] = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
    return out


MADE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("whole", pa.bool_()),
    *[(n, pa.int64()) for n in STATS], ("audit", pa.string()), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("symbols", pa.binary()), ("ends", pa.list_(pa.string())),
    ("turns", pa.list_(pa.int64())), ("effect", pa.binary())])
MADE_DDL = ("conv_id long, part int, number int, whole boolean, "
            + ", ".join(f"{n} long" for n in STATS)
            + ", audit string, roles array<string>, texts array<string>, symbols binary, "
              "ends array<string>, turns array<long>, effect binary")
PIECE = ["conv_id", "part", "number", *STATS, "audit", "roles", "texts"]


def _chunks(chunk_rows: int, chunk_bytes: int):
    """Sorted rows to repaired conversations, or chunks of those that are cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, at, number, begun, first = TaskContext.get().partitionId(), ..., 0, 0, True
        chunk, marked, out, size = Chunk(), False, [], 0

        def close(ended: bool) -> None:
            """The chunk is full, or its conversation has ended for this task."""
            nonlocal chunk, number, size
            summary, symbols = chunk.summary(), chunk.symbols()
            row = {"conv_id": at, "part": part, "number": number, **summary}
            # a conversation at either end of the task may go on in another
            if ended and number == begun and not first:
                audit = edits_of(symbols)
                roles, texts = repaired(audit, chunk.roles, chunk.texts)
                row |= {"whole": True, **joined([summary]), "cost": cost_of(symbols),
                        "audit": audit, "roles": roles, "texts": texts}
            else:
                row |= {"whole": False, "symbols": symbols, "roles": chunk.roles,
                        "texts": chunk.texts, "effect": Effect.of(symbols).to_bytes()}
            out.append(row)
            size += chunk.size + 200
            chunk, number = Chunk(), number + 1

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            rows, out, size = out, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([r.get(f.name) for r in rows], f.type) for f in MADE], schema=MADE)

        for batch in batches:
            for a, b in slices(batch.column(3)):
                for conv, turn, role, text, fault, kind in zip(
                        *(batch.column(i).slice(a, b - a).to_pylist() for i in range(6))):
                    if at is ... or conv != at:
                        if at is not ...:
                            close(True)
                            first = False
                        at, begun = conv, number
                    if kind == 1:
                        if fault != BLANK and not marked:
                            fault = DUPLICATE
                        chunk.add(turn, role, text, fault)
                        if len(chunk.faults) >= chunk_rows or chunk.size >= chunk_bytes:
                            close(False)
                    marked = kind == 0
                    if size >= 4_000_000:
                        yield flush()
        if at is not ...:
            close(False)
            yield flush()
    return run


PLAN = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("after", pa.int32()),
                  ("entry", pa.int32()), ("last", pa.bool_()),
                  *[(f"all_{n}", pa.int64()) for n in STATS]])
PLAN_DDL = ("part int, number int, after int, entry int, last boolean, "
            + ", ".join(f"all_{n} long" for n in STATS))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunk summaries to each chunk's vector after it, state before it
    and the figures of the whole conversation."""
    def plan(parts: list[dict]) -> pa.RecordBatch:
        effects = [Effect.from_bytes(p["effect"]) for p in parts]
        v, after, cost = 0, [], 0
        for e in reversed(effects):
            after.append(v)
            cost, v = cost + int(e.cost[v]), int(e.before[v])
        after.reverse()
        entry = [0]
        for e, a in zip(effects, after):
            entry.append(int(e.state[a, entry[-1]]))
        stats = joined(parts) | {"cost": cost + tables().vectors[v][0]}
        n = len(parts)
        cols = {"part": [p["part"] for p in parts], "number": [p["number"] for p in parts],
                "after": after, "entry": entry[:n], "last": [False] * (n - 1) + [True],
                **{f"all_{k}": [stats[k]] * n for k in STATS}}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in PLAN],
                                          schema=PLAN)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                yield plan(held)
                held = []
            held.append(row)
    if held:
        yield plan(held)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their plan to repaired pieces."""
    for batch in batches:
        for i in range(batch.num_rows):      # a chunk has a few megabytes
            r = batch.slice(i, 1).to_pylist()[0]
            r["audit"] = edits_of(r["symbols"], r["after"], r["entry"], r["last"])
            r["roles"], r["texts"] = repaired(r["audit"], r["roles"], r["texts"], r["entry"])
            r |= {n: r[f"all_{n}"] for n in STATS}
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n]], MADE.field(n).type) for n in PIECE], names=PIECE)


def tie(role: Column, text: Column) -> Column:
    """Digest of role and text; the length keeps the two apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text))


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id",
           turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk_rows: int = 4096, chunk_bytes: int = 4_000_000) -> DataFrame:
    """The repaired conversations, in pieces: conv_id, part, number, gaps,
    blank, duplicate, truncated, illegal, cost (of the whole conversation),
    audit (edits of this piece), roles, texts.

    A conversation is one row, unless it was cut; its pieces in order of part
    and number are then the conversation.  ``ids`` names conversations (column
    ``conv_col``) to return even if they have no rows."""
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    source = scratch(spark, "turns")
    rows.select(F.col(conv_col).cast("long").alias("conv_id"),
                F.col(turn_col).cast("long").alias("turn"),
                role.alias("role"), text.alias("text")).write.parquet(source)
    stored = spark.read.schema("conv_id long, turn long, role string, text string").parquet(source)
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
             .when(~F.col("text").rlike(rf"[.!?]({SPACE})?\z"), TRUNCATED).otherwise(OK))
    key = ["conv_id", "turn", "tie", "salt"]
    turns = stored.select("*", fault.alias("fault"), tie(F.col("role"), F.col("text")).alias("tie"),
                          F.monotonically_increasing_id().alias("salt"), F.lit(1).alias("kind"))
    # a marker goes before the first row of each role and text, and one before
    # each conversation; equal rows are told apart by their place in the table
    firsts = (turns.where(F.col("fault") != BLANK).groupBy("conv_id", "tie")
              .agg(F.min(F.struct("turn", "salt")).alias("first"))
              .select("conv_id", F.col("first.turn").alias("turn"), "tie",
                      F.col("first.salt").alias("salt"), F.lit(0).alias("kind")))
    known = stored.select("conv_id") if ids is None else ids.select(
        F.col(conv_col).cast("long").alias("conv_id"))
    marks = firsts.unionByName(known.distinct().withColumn("kind", F.lit(-1)),
                               allowMissingColumns=True)
    ordered = (turns.unionByName(marks, allowMissingColumns=True).repartitionByRange(*key)
               .sortWithinPartitions(*key, "kind"))
    made = written(ordered.select("conv_id", "turn", "role", "text", "fault", "kind")
                   .mapInArrow(_chunks(chunk_rows, chunk_bytes), MADE_DDL), "chunks")
    removed(spark, source)
    cut = made.where("NOT whole")
    plan = (cut.select("conv_id", "part", "number", "effect", "ends", "turns", "blank",
                       "duplicate", "truncated", "illegal").repartition("conv_id")
            .sortWithinPartitions("conv_id", "part", "number").mapInArrow(_combined, PLAN_DDL))
    types = {f.name: f.dataType.simpleString() for f in made.schema}
    pieces = cut.select("conv_id", "part", "number", "roles", "texts", "symbols").join(
        plan, ["part", "number"]).mapInArrow(
        _expanded, ", ".join(f"{n} {types[n]}" for n in PIECE))
    return made.where("whole").select(*PIECE, F.lit(True).alias("whole")).unionByName(
        written(pieces, "pieces").withColumn("whole", F.lit(False)))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0
    drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats
    it, 4 makes it the user's.  Nulls are one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")),
                 F.lit(20))
    copies = F.when(F.col("hit") == 0, F.array().cast("array<int>")).when(
        F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("hit") == 1, "").when(
        F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", filled("role").alias("role"),
                        filled("text").alias("text"), hit.alias("hit"))
            .select("conv_id", "turn",
                    F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(copies).alias("copy")).drop("copy"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row per conversation; texts go through the digest
    piece by piece."""
    names = ["conv_id", *STATS, "audit", "repaired_sha256"]

    def done(row: dict, audits: list[str], digest) -> pa.RecordBatch:
        values = [*(row[n] for n in names[:-2]), "".join(audits), digest.hexdigest()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64() if i < len(names) - 2 else pa.string())
             for i, v in enumerate(values)], names=names)

    held = None
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if held is not None and held["conv_id"] != r["conv_id"]:
                yield done(held, audits, digest)
                held = None
            if held is None:
                held, audits, digest, begun = r, [], hashlib.sha256(), False
            audits.append(r["audit"])
            for role, text in zip(r["roles"], r["texts"]):
                digest.update(("\n" if begun else "").encode() + f"{role}:{text}".encode())
                begun = True
    if held is not None:
        yield done(held, audits, digest)


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the figures of ``repair``, audit and
    repaired_sha256 (of ``role:text`` lines)."""
    lines = F.concat_ws("\n", F.zip_with("roles", "texts",
                                         lambda r, t: F.concat(r, F.lit(":"), t)))
    whole = pieces.where("whole").select("conv_id", *STATS, "audit",
                                         F.sha2(lines, 256).alias("repaired_sha256"))
    cut = (pieces.where("NOT whole").repartition("conv_id")
           .sortWithinPartitions("conv_id", "part", "number").drop("whole"))
    return whole.unionByName(cut.mapInArrow(
        _digested, "conv_id long, " + ", ".join(f"{n} long" for n in STATS)
        + ", audit string, repaired_sha256 string"))
