"""Repair of conversations against an exhaustive search, SQL over odd rows, and blocks of other sizes."""

import hashlib
import random
import re
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyrack.llm import queries, repair
from tools.compare import rows_of

COLUMNS = "conv_id bigint, turn bigint, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def exhaustive(initials, faults):
    """(cost, audit) of the cheapest edits, the least audit among equals, by trying them all, from the last row on."""

    @lru_cache(None)
    def go(i, state, inserted):
        ways = [(0, "")] if i == len(initials) and state in (0, 3) else []
        if inserted < 3:
            cost, audit = go(i, NEXT[state], inserted + 1)
            ways.append((cost + 2, "I" + audit))
        if i < len(initials):
            cost, audit = go(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit))
            if faults[i] < 2:
                cost, audit = go(i + 1, NEXT[state], 0)
                ways.append((cost + 2 + faults[i], "R" + audit))
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initials[i]))
                if keep:
                    cost, audit = go(i + 1, keep, 0)
                    ways.append((cost + faults[i], "K" + audit))
        return min(ways, default=(10**9, ""))

    for i in range(len(initials), 0, -1):  # so that no call goes deep
        for state in range(4):
            go(i, state, 0)
    return go(0, 0, 0)


def test_edits_against_exhaustive_search():
    rng = random.Random(3)
    for k in range(3000):
        n = rng.randint(0, 9 if k % 10 else 60)
        initials = tuple(rng.choice(["s", "u", "a", "u", "a", " ", ""]) for _ in range(n))
        faults = tuple(rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))
        over = repair.edits(list(initials), list(faults))
        turns, state = repair.turns_of([(c, "t") for c in initials], over, 0)
        turns += repair.close(state)
        audit = "".join(over) + repair.END[state][1]
        cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in audit) + sum(f == 1 and o[-1] != "D" for o, f in zip(over, faults))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns))
        assert (cost, audit) == exhaustive(initials, faults)


def brute(rows):
    """What the query should say of each conversation, row by row."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode())
    for conv in {r[0] for r in rows}:
        mine = [(t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in sorted((r for r in rows if r[0] == conv), key=order)]
        seen, faults = set(), []
        for _, role, text in mine:
            left = text.strip(" \t\n\x0b\x0c\r")
            faults.append(3 if not left else 2 if (role, text) in seen else 1 if left[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = tuple(role[:1] for _, role, _ in mine)
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit = exhaustive(initials, tuple(faults))
        fixed, at, state = [], 0, 0
        for edit in audit:
            if edit in "RI":
                state = NEXT[state]
                role = {2: "user", 3: "assistant"}[state]
            elif edit == "K":
                role = mine[at][1]
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            if edit != "D":
                fixed.append(f"{role}:{'' if edit == 'I' else mine[at][2]}")
            at += edit != "I"
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(3), faults.count(2), faults.count(1),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest(),
        )
    return out


def odd_rows():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([1, 2, 3, 8, 30])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "Ångström"])
            text = rng.choice(["Yes.", "no", None, "", " \n", "Ok! \t", "…", "a?b", "long " * 50 + ".", "é.", "x\n.", "tail\n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, -turn, turn + 3]), role, text))
    rows += rows[:25]  # repeated rows
    rows += [(99, None, "user", f"n{i}.") for i in range(5)] + [(100, 5, None, None)] * 4
    rows += [(101, t, "user" if t % 2 else "assistant", "same." if t % 7 else f"{t}") for t in range(400)]
    rows += [(102, 1, "user", "x" * 2_000_000), (102, 2, "assistant", "y" * 2_000_000 + ".")]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_odd_rows_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame(rows, COLUMNS).withColumn("fault", F.lit("clash")).withColumn("block", F.lit("clash")).withColumn("a.b", F.lit(1))
    parts, accounts = repair.repair(df)
    digest = {r["conv_id"]: r for r in repair.digests(parts).collect()}
    got = {r["conv_id"]: r for r in accounts.collect()}
    want = brute(rows)
    assert set(got) == set(want) == set(digest)
    for conv, fact in want.items():
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        assert (*[got[conv][n] for n in names], digest[conv]["audit"], digest[conv]["repaired_sha256"]) == fact, conv
    most = parts.selectExpr("max(length(translate(audit, 'I', '')))").first()[0]
    assert most <= block  # a long conversation is spread over parts


def test_damage_and_sql_over_odd_rows(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_repair"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.SQL["op12_repair"])
    names = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
    damaged = brute([tuple(r) for r in repair.damaged(spark.createDataFrame(rows, COLUMNS)).collect()])
    assert all(damaged[r["conv_id"]][6] == r["audit"] for r in got.collect() if r["conv_id"] in damaged)


def test_no_rows(spark):
    empty = spark.createDataFrame([], COLUMNS)
    parts, accounts = repair.repair(empty)
    assert parts.count() == accounts.count() == repair.repaired_digests(empty).count() == 0
    # every row of this conversation is dropped by the damage
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repaired_digests(spark.createDataFrame([(gone, 0, "user", "Hi.")], COLUMNS)).first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
