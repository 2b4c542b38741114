"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation should go ``(s?(ua)+)?``: a system row perhaps, then pairs of user and assistant. The
cheapest edits that bring it there are a path through four states (nothing yet, system, user,
assistant); a step over a row keeps it, gives it another role or deletes it, after inserting rows
or none. Among the cheapest the one with the least audit string (the edits' initials) counts.

A span of rows is halved: costs forward from the state at its start and backward from the state
at its end meet between the halves, and the state to cross at is the cheapest one; of equal ones that
whose way there has the least audit. That is enough, as two ways to the same place are never one the
start of the other (both end with the step over the last row). Then each half is solved alike. Only
the vectors of the present spans are held, and the path.

Spark cuts the rows, in order, into blocks of ``BLOCK``. Every block turns its part of a conversation into
the costs and order of the 16 ways through it (state in, state out). A conversation's blocks are
then rows of these numbers alone; the same method finds the states between them. After that
each block rebuilds its own part, so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.llm.common import written
from tallyrack.operators.numbering import number_rows

#: Rows of one block.
BLOCK = 512
#: Initials of the roles, and the state after a row of each; nothing yet is 0.
ROLES = ("system", "user", "assistant")
AFTER = {"s": 1, "u": 2, "a": 3}
#: Initial that may follow each state, but for ``s`` at the start.
NEXT = ("u", "u", "a", "u")
RE_ROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
FINE, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3

#: A way: its cost and something that orders it among others (a rank, or its audit).
Way = tuple[int, object] | None
#: ``step[p][q]`` is the way from state p to state q.
Step = tuple[tuple[Way, ...], ...]


def _follow(state: int, initial: str) -> int | None:
    """State after a row with that initial, if it may stand there."""
    return AFTER[initial] if initial in ("s", "u", "a") and (initial == NEXT[state] or (initial == "s" and state == 0)) else None


@lru_cache(maxsize=64)
def step_of(initial: str, fault: int) -> Step:
    """The ways over a row: insert up to two rows, then keep it, give it a role or delete it."""
    table: list[list[Way]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserted in range(3):
            moves = [(DELETE, "D", state)]
            if fault < DUPLICATE:
                rest = LEFT_TRUNCATED if fault == TRUNCATED else 0
                moves.append((rest + RE_ROLE, "R", _follow(state, NEXT[state])))
                moves.append((rest, "K", _follow(state, initial)))
            for cost, edit, end in moves:
                way = (cost + INSERT * inserted, "I" * inserted + edit)
                if end is not None and (table[start][end] is None or way < table[start][end]):
                    table[start][end] = way
            state = _follow(state, NEXT[state])
    return tuple(map(tuple, table))


#: Cost and audit from each state to an end where the conversation may stop.
END: tuple[tuple[int, str], ...] = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def advance(vector: tuple[Way, ...], step: Step) -> tuple[Way, ...]:
    """(cost, rank) of the best way to each state, one step further; ranks order the ways' audits."""
    found: list = []
    for q in range(4):
        found.append(min((((v[0] + step[p][q][0]), v[1], step[p][q][1]) for p, v in enumerate(vector) if v is not None and step[p][q] is not None), default=None))
    order = {key: rank for rank, key in enumerate(sorted(f[1:] for f in found if f is not None))}
    return tuple(None if f is None else (f[0], order[f[1:]]) for f in found)


def retreat(costs: tuple[int | None, ...], step: Step) -> tuple[int | None, ...]:
    """Cost from each state to the end, one step earlier."""
    return tuple(min((step[p][q][0] + c for q, c in enumerate(costs) if c is not None and step[p][q] is not None), default=None) for p in range(4))


def start_at(state: int) -> tuple[Way, ...]:
    return tuple((0, 0) if p == state else None for p in range(4))


def states_between(step: Callable[[int], Step], low: int, high: int, entry: int, leave: int) -> list[int]:
    """State after each step of [low, high) on the best way from ``entry`` to ``leave``."""
    out = [leave] * (high - low)
    spans = [(low, high, entry, leave)]
    while spans:
        a, b, first, last = spans.pop()
        if b - a < 2:
            continue
        middle = (a + b) // 2
        ahead = start_at(first)
        for i in range(a, middle):
            ahead = advance(ahead, step(i))
        back: tuple[int | None, ...] = tuple(0 if q == last else None for q in range(4))
        for i in range(b - 1, middle - 1, -1):
            back = retreat(back, step(i))
        cross = min((v[0] + back[p], v[1], p) for p, v in enumerate(ahead) if v is not None and back[p] is not None)[2]
        out[middle - 1 - low] = cross
        spans += [(a, middle, first, cross), (middle, b, cross, last)]
    return out


def best_end(vector: tuple[Way, ...]) -> int:
    """The last state of the best whole way: cheapest with what must still be inserted, then least audit."""
    return min((v[0] + END[q][0], v[1], q) for q, v in enumerate(vector) if v is not None)[2]


def edits(initials: list[str], faults: list[int], entry: int = 0, leave: int | None = None) -> list[str]:
    """Edits over each row, such as ``K`` or ``IR``, from state ``entry`` to ``leave`` (none: to the best end)."""
    steps = [step_of(i, f) for i, f in zip(initials, faults)]
    if leave is None:
        vector = start_at(entry)
        for s in steps:
            vector = advance(vector, s)
        leave = best_end(vector)
    states = [entry, *states_between(steps.__getitem__, 0, len(steps), entry, leave)]
    return [s[p][q][1] for s, p, q in zip(steps, states, states[1:])]


def turns_of(rows: list[tuple[str, str]], over: list[str], entry: int) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) rows that the edits over ``rows`` give, and the state after them."""
    out, state = [], entry
    for (role, text), steps in zip(rows, over):
        for edit in steps:
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else NEXT[state]
            state = AFTER[initial]
            out.append((role if edit == "K" else ROLES[state - 1], "" if edit == "I" else text))
    return out, state


def close(state: int) -> list[tuple[str, str]]:
    """The rows to insert at the end."""
    return [(ROLES[AFTER[i] - 1], "") for i in ("u", "a")[2 - len(END[state][1]) :]]


# -- faults

#: White space as the contract has it, and the last other character.
_SPACES = r"[\x20\x09-\x0D]*"


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, as (conv_id, turn, role, text, position, block, fault).

    The order is conv_id, turn (nulls first), role, text; equal rows are alike, so theirs doesn't matter. A
    row that repeats an earlier (role, text) of its conversation is a duplicate. Null roles and texts
    count as one space. Duplicates are told by the first position of each text's digest, so no
    conversation and no text is gathered anywhere.
    """
    plain = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed = number_rows(plain, ["conv_id", "turn", "role", "text", "tie"]).drop("tie")
    placed = placed.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("first"))
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){_SPACES}\z", 1)
    fault = (
        F.when(last == "", BLANK)
        .when(F.col("first").isNull(), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    return placed.join(firsts, "position", "left").select(
        "conv_id", "turn", "role", "text", "position", F.floor(F.col("position") / BLOCK).alias("block"), fault.alias("fault")
    )


# -- Spark jobs

_WAYS = "array<bigint>"
_SUMMARY = (
    "conv_id bigint, block bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
    f"turns bigint, low bigint, high bigint, costs {_WAYS}, ranks {_WAYS}"
)
_LINK = "conv_id bigint, block bigint, entry int, leave int, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_PART = "conv_id bigint, block bigint, last boolean, audit string, turns array<struct<role:string,text:string>>"


def _grouped(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys, across batches; the rows must be sorted by them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, lambda row: tuple(row[k] for k in key))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _map(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(make(batches), arrow), schema)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (_, conv, block), rows in _grouped(batches, "block", "conv_id", "block"):
        vectors = [start_at(p) for p in range(4)]
        count = [0, 0, 0, 0]
        n = illegal = distinct = 0
        head = before = turn = low = None
        for row in rows:
            step = step_of(row["initial"], row["fault"])
            vectors = [advance(v, step) for v in vectors]
            count[row["fault"]] += 1
            n += 1
            head = row["initial"] if before is None else head
            illegal += before is not None and not _legal(before, row["initial"])
            before = row["initial"]
            if row["turn"] is not None and row["turn"] != turn:
                distinct, turn = distinct + 1, row["turn"]
                low = turn if low is None else low
        ways = [w if w is not None else (-1, -1) for v in vectors for w in v]
        yield {
            "conv_id": conv, "block": block, "n": n, "blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[TRUNCATED],
            "illegal": illegal, "head": head, "tail": before, "turns": distinct, "low": low, "high": turn,
            "costs": [c for c, _ in ways], "ranks": [r for _, r in ways],
        }


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (conv,), rows in _grouped(batches, "conv_id"):
        blocks, steps = [], []
        total = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        low = high = before = None
        vector = start_at(0)
        for row in rows:
            blocks.append(row["block"])
            ways = [None if c < 0 else (c, r) for c, r in zip(row["costs"], row["ranks"])]
            steps.append(tuple(tuple(ways[4 * p : 4 * p + 4]) for p in range(4)))
            vector = advance(vector, steps[-1])
            for name in ("blank", "duplicate", "truncated", "illegal"):
                total[name] += row[name]
            total["illegal"] += before is not None and not _legal(before, row["head"])
            before = row["tail"]
            total["gaps"] -= row["turns"] - (high is not None and row["low"] == high)
            low, high = row["low"] if low is None else low, row["high"] if row["high"] is not None else high
        if low is not None:
            total["gaps"] += high - low + 1
        leave = best_end(vector)
        cost = vector[leave][0] + END[leave][0]
        states = [0, *states_between(steps.__getitem__, 0, len(steps), 0, leave)]
        for i, block in enumerate(blocks):
            yield {"conv_id": conv, "block": block, "entry": states[i], "leave": states[i + 1], "last": i == len(blocks) - 1, "cost": cost, **total}


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (_, conv, block), group in _grouped(batches, "block", "conv_id", "block"):
        rows = list(group)
        entry, last = rows[0]["entry"], rows[0]["last"]
        over = edits([r["role"][:1] for r in rows], [r["fault"] for r in rows], entry, rows[0]["leave"])
        turns, state = turns_of([(r["role"], r["text"]) for r in rows], over, entry)
        audit = "".join(over)
        if last:
            audit, turns = audit + END[state][1], turns + close(state)
        yield {"conv_id": conv, "block": block, "last": last, "audit": audit, "turns": [{"role": r, "text": t} for r, t in turns]}


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("block").sortWithinPartitions("block", "position")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations in parts, and one row of accounts for each.

    ``rows`` has (conv_id, turn, role, text); other columns are left out. The parts are (conv_id, block, last,
    audit, turns): the edits' initials over up to ``BLOCK`` rows and the (role, text) rows they leave; a
    conversation's parts go by ``block``, and most have one. The accounts are conv_id, gaps, blank,
    duplicate, truncated, illegal and cost. A null conv_id is a conversation too; null turns go first; null
    roles and texts count as one space; rows of one turn go by role and text. No rows, no result.
    """
    faulty = written(with_faults(rows))
    light = faulty.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "position", "block", "fault")
    summaries = written(_map(_in_blocks(light), _summaries, _SUMMARY))
    links = written(_map(summaries.repartition("conv_id").sortWithinPartitions("conv_id", "block"), _link, _LINK))
    at = links.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "leave", "last")
    # (block, conversation) has at most BLOCK rows, so the join has no hot key
    met = faulty.join(at, (F.col("block") == F.col("b")) & F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "b")
    parts = _map(_in_blocks(met), _rebuild, _PART)
    return parts, links.filter("last").drop("block", "entry", "leave", "last")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (conv,), rows in _grouped(batches, "conv_id"):
        digest, audit, any_turn = hashlib.sha256(), [], False
        for row in rows:
            audit.append(row["audit"])
            for turn in row["turns"]:
                digest.update((("\n" if any_turn else "") + turn["role"] + ":" + turn["text"]).encode())
                any_turn = True
        yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the parts of each conversation read in order, one at a time."""
    rows = parts.select("conv_id", "block", "audit", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return _map(rows, _digests, "conv_id bigint, audit string, repaired_sha256 string")


# -- damage, to measure the repair on

def damaged(rows: DataFrame) -> DataFrame:
    """Every row by crc32 of ``conv_id:turn`` modulo 20: 0 goes, 1 loses its text, 2 its full stops, 3 comes twice, 4 is a user's.

    Nulls read as one space (in the key too); a null turn stays null in the order.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), times.alias("times"), kind.alias("kind"))
    return kept.filter("kind <> 0").select("conv_id", "turn", "role", "text", F.explode("times")).drop("col")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """Accounts and digests of the damaged and repaired rows, for every conversation that ``rows`` has."""
    parts, accounts = repair(damaged(rows))
    made = accounts.join(digests(parts).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = rows.select("conv_id").distinct().withColumnRenamed("conv_id", "c")
    whole = every.join(made, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return whole.select(
        F.col("c").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
