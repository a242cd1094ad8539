"""Conversation repair against a search over all edits, and its defined cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftline.llm import conversations as C

WHOLE, OPEN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"(s?(ua)*u?)?\Z")


def every_way(rows):
    """(cost, audit, turns) of the best of all edits with at most two inserts in a place; rows are (role, text, fault)."""
    best = None

    def go(i, cost, audit, initials, turns, inserted):
        nonlocal best
        if (best and cost > best[0]) or not OPEN.match(initials):
            return
        if i == len(rows) and WHOLE.match(initials):
            best = min([x for x in (best, (cost, audit, turns)) if x], key=lambda x: x[:2])
        for role in ("user", "assistant") if inserted < 2 else ():
            go(i, cost + 3, audit + "I", initials + role[0], [*turns, f"{role}:"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", initials, turns, 0)
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                if role:
                    go(i + 1, cost + more, audit + "K", initials + role[0], [*turns, f"{role}:{text}"], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", initials + new[0], [*turns, f"{new}:{text}"], 0)
    go(0, 0, "", "", [], 0)
    return best


def searched(rows):
    r, audit = C.Repair(True), b""
    for row in rows:
        r.step(*row)
        audit += r.take()
    cost, rest, sha = r.finish()
    return cost, (audit + rest).translate(C.TO_AUDIT).decode(), sha


def digest(turns):
    return hashlib.sha256("\n".join(turns).encode()).hexdigest()


def test_every_way():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), str(i), rng.choice([0, 0, 0, 1, 2, 3]))
                for i in range(rng.randrange(7))]
        cost, audit, turns = every_way(rows)
        assert searched(rows) == (cost, audit, digest(turns)), rows


@pytest.mark.parametrize("roles, most", [(["user", "assistant"], 8), (["user", "user", "assistant", "assistant"], 16)])
def test_unresolved_part_stays_small(roles, most):
    r = C.Repair(True)
    for i in range(20_000):
        r.step(roles[i % len(roles)], "x" * 1000, 1 if i % 17 == 3 else 0)
        r.take()
    assert r.most <= most


def test_late_decisions_stay_whole():
    """Of users alone, the number of rows decides at the second row: nothing coalesces, and the audit is still exact."""
    for n in (6, 7):
        rows = [("user", str(i), 0) for i in range(n)]
        assert searched(rows)[:2] == every_way(rows)[:2]
    odd = searched([("user", str(i), 0) for i in range(7)])[1]
    assert searched([("user", str(i), 0) for i in range(41)])[1] == odd[:2] + "KR" * 17 + odd[2:]


ODD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", None), (1, None, None, "What?"), (2, 5, "tool", "é" * 300_000 + "!"),
       (2, 5, "tool", "é" * 300_000 + "!"), (3, None, "", "Text."), (None, 1, "user", "Who."), (None, 2, "assistant", "I."), (4, 9, "user", " \x0b\x0c"),
       (5, 1, "assistant", "No"), (5, 2, "system", "Rule."), (5, 3, "user", "So?"), (5, 7, "user", "So?"), (5, 7, "user", "So?")]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("live", "nth", "fault", "row", "key", "kind", "edit", "at", "of", "copy"):
        df = df.withColumn(c, F.lit("x"))
    return df


def plain(rows):
    """Audits of rows without damage, by definition."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([(t is not None, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv],
                      key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(C.SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit, turns = every_way([(m[2], m[3], f) for m, f in zip(mine, faults)])
        at = sorted({m[1] for m in mine if m[0]})
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (at[-1] - at[0] + 1 - len(at) if at else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest(turns))
    return out


def undamaged(spark):
    rows = odd(spark)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", text("role"), text("text"), F.lit(True).alias("live"))


def test_defined_cases(spark):
    got = {r[0]: tuple(r)[1:-1] for r in C.audits(undamaged(spark)).collect()}
    assert got == plain(ODD)


def test_turns_give_the_hash(spark):
    rows = C.damaged(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).unionByName(undamaged(spark).withColumn("conv_id", -1 - F.col("conv_id")))
    turns = {}
    for r in C.repaired(rows).orderBy("conv_id", "edit_no").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in C.audits(rows).collect():
        assert digest(turns.get(r.conv_id, [])) == r.repaired_sha256
    edits = {}
    for r in C.edits(rows).orderBy("conv_id", "edit_no").collect():
        edits[r.conv_id] = edits.get(r.conv_id, "") + r.edit[0]
    assert all(edits.get(r.conv_id, "") == r.audit for r in C.audits(rows).collect())


def test_damage_and_empty(spark):
    got = C.audits(C.damaged(odd(spark)))
    assert got.count() == 6
    gone = [(c, 1, "user", "Hi.") for c in range(200)]
    left = {r.conv_id: r for r in C.audits(C.damaged(odd(spark, gone))).collect()}
    assert len(left) == 200
    empty = [r for r in left.values() if r.audit == ""]
    assert empty and all((r.cost, r.gaps, r.repaired_sha256) == (0, 0, digest([])) for r in empty)
    assert C.audits(C.damaged(odd(spark, []))).count() == 0 and C.repaired(C.damaged(odd(spark, []))).count() == 0
