"""Repair of conversations by depth-first branch and bound.

A conversation is to become an optional system turn and pairs of user and assistant. Edits keep, re-role, delete or insert
turns; the cheapest sequence counts, of equal ones the one whose initials come first in ASCII. The search holds an explicit
stack of prefixes. A suffix bound (the same edits, with any end allowed) and the incumbent (cost, initials) cut prefixes that
can't win, and a table of the best prefix a node (turns done, state of the grammar) cuts those that another one dominates.
Children go cheapest first, so the incumbent is good early, and the search ends when the stack is empty: then it is proved best.

Turns are range-partitioned and sorted by conversation and turn, and searched in pieces of bounded size as they stream by. A
conversation that lies in one piece is done there. Of a longer one, or one that may go on in the next partition, each piece is
solved from every state to every state, and a fold over those small tables, in order, picks each piece's edits. So no task
holds a whole group, whatever its length; only the digest of a repaired conversation, which is sequential, streams in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import table, to_python

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns and characters of a piece at most (a longer text is a piece of its own).
PIECE_TURNS, PIECE_CHARS = 256, 1 << 20
#: States: nothing yet, after the system turn, after a user, after an assistant. What each may take, and where an added or re-roled turn leads.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEXT, ROLE, DONE = [2, 2, 3, 2], ["user", "user", "assistant", "user"], (0, 3)
PIECE = "conv {conv}, part int, no long, whole boolean, turns array<long>, faults string, roles array<string>, texts array<string>, costs array<long>, audits array<string>"


def moves(row: tuple[str, str], state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits that take a turn, given as (initial of its role, fault)."""
    initial, fault = row
    yield "D", DELETE, state
    if fault not in ("b", "d"):
        late = TRUNCATED if fault == "t" else 0
        if initial in STEP[state]:
            yield "K", KEEP + late, STEP[state][initial]
        yield "R", REROLE + late, NEXT[state]


def suffix_bounds(rows: list[tuple[str, str]]) -> list[list[int]]:
    """[turns done][state]: what the rest costs at least."""
    out = [[0] * 4]
    for row in reversed(rows):
        line = [min(cost + out[-1][after] for _, cost, after in moves(row, s)) for s in range(4)]
        for _ in range(2):
            line = [min(line[s], INSERT + line[NEXT[s]]) for s in range(4)]
        out.append(line)
    return out[::-1]


def search(rows: list[tuple[str, str]], start: int = 0, goals: tuple[int, ...] = DONE, bounds: list[list[int]] | None = None) -> tuple[int, str] | None:
    """The best (cost, initials of the edits) from `start` to one of `goals`; None if there is no way."""
    bounds, n = bounds or suffix_bounds(rows), len(rows)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best and (cost + bounds[i][state], audit) > (best[0], best[1][: len(audit)]):
            continue
        node = (i, state)
        if node in seen and seen[node] <= (cost, audit):
            continue
        seen[node] = (cost, audit)
        if i == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = [(cost + INSERT + bounds[i][NEXT[state]], "I", i, NEXT[state], cost + INSERT)]
        if i < n:
            children += [(cost + c + bounds[i + 1][after], e, i + 1, after, cost + c) for e, c, after in moves(rows[i], state)]
        children.sort(key=lambda x: x[:2], reverse=True)
        # a state left by inserts is reached again by inserts alone, dearer, so the table ends such rounds
        stack += [(j, after, c, audit + e) for _, e, j, after, c in children]
    return best


def repaired(edits: str, roles: list[str], texts: list[str], state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that `edits` leave, from a state on."""
    i = 0
    for e in edits:
        if e == "I":
            yield e, ROLE[state], ""
            state = NEXT[state]
            continue
        if e == "K":
            yield e, roles[i], texts[i]
            state = STEP[state][roles[i][:1]]
        elif e == "R":
            yield e, ROLE[state], texts[i]
            state = NEXT[state]
        i += 1


def with_faults(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text: none null but conv and turn) with fault: b blank, d duplicate of an earlier turn, t truncated, else ''.

    Rows of one turn, role and text stand side by side in order; all but the first of them are told apart while they stream by.
    """
    key = [F.col("conv"), F.col("role"), F.md5(F.col("text").cast("binary")).alias("md5")]
    order = F.struct(F.col("turn").isNotNull(), "turn")
    many = turns.select(*key, "turn").groupBy("conv", "role", "md5").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    many = many.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("md5").alias("m"), "first")
    both = turns.join(many, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.md5(F.col("text").cast("binary")) == F.col("m")), "left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(order > F.col("first"), "d").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("")
    return both.select("conv", "turn", "role", "text", fault.alias("fault"))


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns as pieces with what their edits cost. The first and the last conversation of a partition may go on in another."""
    part, no = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    conv, size, closed, first, last = None, 0, False, True, None
    out: list[dict] = []

    def piece(whole: bool) -> dict:
        nonlocal no
        rows = [(role[:1], fault) for _, role, _, fault in held]
        bounds = suffix_bounds(rows)
        found = [search(rows, bounds=bounds)] if whole else [search(rows, p, (q,), bounds) for p in range(4) for q in range(4)]
        no += 1
        return {
            "conv": conv, "part": part, "no": no, "whole": whole, "turns": [h[0] for h in held], "roles": [h[1] for h in held], "texts": [h[2] for h in held],
            "faults": "".join(h[3] or "-" for h in held), "costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found],
        }

    for batch in batches:
        for now, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and now != conv:
                out.append(piece(not closed and not first))
                held, size, closed, first, last = [], 0, False, False, None
            elif held and (len(held) >= most or size + len(text) > PIECE_CHARS):
                out.append(piece(False))
                held, size, closed = [], 0, True
            if last == (turn, role, text) and conv == now and fault != "b":
                fault = "d"
            conv, last = now, (turn, role, text)
            held.append((turn, role, text, fault))
            size += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        yield pa.RecordBatch.from_pylist([piece(False)], schema)


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of pieces in order, the edits of each on its conversation's best way. What all open ways share is given out at once."""
    ways: dict[int, tuple[int, str, list[tuple]]] = {}
    rows = ((batch, i) for batch in batches for i in range(len(batch)))
    for _, group in groupby(rows, key=lambda r: r[0].column(0)[r[1]].as_py()):
        ways, out = {0: (0, "", [])}, []
        for batch, i in group:
            _, part, no, costs, audits = (c[i].as_py() for c in batch.columns)
            found: dict[int, tuple] = {}
            for p, (cost, audit, _) in ways.items():
                for q in range(4):
                    if costs[4 * p + q] is not None:
                        new = (cost + costs[4 * p + q], audit + audits[4 * p + q], p)
                        if q not in found or new[:2] < found[q][:2]:
                            found[q] = new
            step = lambda p, q: (part, no, p, audits[4 * p + q])
            if len(before := {p for _, _, p in found.values()}) == 1:
                out += ways[p := before.pop()][2]
                ways = {q: (cost, audits[4 * p + q], [step(p, q)]) for q, (cost, _, _) in found.items()}
            else:
                ways = {q: (cost, audit, [*ways[p][2], step(p, q)]) for q, (cost, audit, p) in found.items()}
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                out = []
        out += min((w for q, w in ways.items() if q in DONE), key=lambda w: w[:2])[2]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)


def repair_pieces(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_turns: int = PIECE_TURNS) -> DataFrame:
    """Pieces of conversations with the edits that repair them: conv, part, no (their order), whole, turns, faults (a letter a turn), roles, texts, state (of the grammar before it), edits.

    A null role or text is one space; a null turn comes first; rows of a null conversation are one conversation. Rows of one turn
    are ordered by role and text. A role counts by its first character; one without any can't be kept. Repeated rows are
    duplicates. An empty table gives no pieces. Other columns are ignored, whatever their names.
    """
    known = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    schema = PIECE.format(conv=known.schema["conv"].dataType.simpleString())
    arrow = known.select("conv").limit(0).toArrow().schema.field("conv").type
    texts = pa.list_(pa.string())
    shape = pa.schema([("conv", arrow), ("part", pa.int32()), ("no", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("faults", pa.string()), ("roles", texts), ("texts", texts), ("costs", pa.list_(pa.int64())), ("audits", texts)])
    ordered = table(with_faults(known)).repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    pieces = table(to_python(ordered).mapInArrow(lambda batches: _pieces(batches, shape, most_turns), schema))
    done = pieces.where("whole").withColumns({"state": F.lit(0), "edits": F.col("audits")[0]})
    rest = pieces.where("NOT whole")
    steps = rest.select("conv", "part", "no", "costs", "audits").repartition("conv").sortWithinPartitions("conv", "part", "no")
    way = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])
    chosen = steps.mapInArrow(lambda batches: _fold(batches, way), "part int, no long, state int, edits string")
    return done.unionByName(rest.join(chosen, ["part", "no"])).drop("costs", "audits")


def repair_conversations(turns: DataFrame, **columns) -> DataFrame:
    """Repaired conversations: conv, part, no, place (their order), edit, role, text. Arguments and odd input as in repair_pieces.

    Deleted turns are left out, and inserted ones have an empty text.
    """
    pieces = repair_pieces(turns, **columns).select("conv", "part", "no", "roles", "texts", "state", "edits")
    kind = pieces.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "no", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, part, no, i, *t) for conv, part, no, roles, texts, state, edits in zip(*[c.to_pylist() for c in batch.columns], strict=True) for i, t in enumerate(repaired(edits, roles, texts, state))]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return to_python(pieces).mapInArrow(run, f"conv {kind}, part int, no long, place int, edit string, role string, text string")


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation of repair_pieces: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Pieces stream by in order, and a conversation is a few numbers and a hash while they do.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    fields = pieces.select("conv", "turns", "faults", "roles", "texts", "state", "edits", "whole", "part", "no")
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns[:7]], strict=True))
        out = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            low = high = before = None
            distinct = illegal = cost = 0
            hashed, apart, faults, audit, initial = hashlib.sha256(), b"", dict.fromkeys("bdt-", 0), [], None
            for _, turns, marks, roles, texts, state, edits in group:
                for turn, role in zip(turns, roles, strict=True):
                    if initial is not None and initial + role[:1] not in ("su", "ua", "au"):
                        illegal += 1
                    initial = role[:1]
                    if turn is not None:
                        low, high, distinct, before = turn if low is None else low, turn, distinct + (turn != before), turn
                for mark in marks:
                    faults[mark] += 1
                left = iter(marks)
                for e in edits:
                    mark = "-" if e == "I" else next(left)
                    cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e] + TRUNCATED * (mark == "t" and e != "D")
                for _, role, text in repaired(edits, roles, texts, state):
                    hashed.update(apart + f"{role}:{text}".encode())
                    apart = b"\n"
                audit.append(edits)
            out.append((conv, 0 if low is None else high - low + 1 - distinct, faults["b"], faults["d"], faults["t"], illegal, cost, "".join(audit), hashed.hexdigest()))
            if len(out) >= 2000:
                yield shaped(out)
                out = []
        if out:
            yield shaped(out)

    arrow = pieces.select("conv").limit(0).toArrow().schema.field("conv").type
    types = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
    shaped = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    parts = fields.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "part", "no")
    return to_python(fields.where("whole")).mapInArrow(run, schema).unionByName(to_python(parts).mapInArrow(run, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it the user's.

    A null in any column is one space there; the turn itself stays null.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    each = turns.select("conv_id", "turn", F.when(code == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), code.alias("__code"))
    return each.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("__code") == 0, 0).when(F.col("__code") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def repair_digests(turns: DataFrame, **how) -> DataFrame:
    """A row for each conv_id of `turns` before damage; what damage leaves without a turn has zeros, no edit and the hash of nothing."""
    found = digests(repair_pieces(damaged(turns), **how))
    ids = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    both = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_branch_and_bound_repair(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every conversation, damaged and repaired."""
    return repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
