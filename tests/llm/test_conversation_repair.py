"""Conversation repair against a plain recursion over edit strings."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from kiln.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv_id, turn, role, text) -> the rows after damage by conversation, and all conversations."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        out[c] += []
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        out[c] += [(t, r, x)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """One conversation's report, by the wording of the contract."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        end = x.rstrip(BLANKS)[-1:]
        faults.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end not in ".!?" else "")
        seen.add((r, x))
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # last letter -> next

    @cache
    def best(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        to = "a" if last == "u" else "u"
        if inserted < 3:
            found.append(add(2, "I", best(i, to, inserted + 1)))
        if i < len(rows):
            found.append(add(3, "D", best(i + 1, last, 0)))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                found.append(add(2 + extra, "R", best(i + 1, to, 0)))
                if rows[i][1][:1] in moves[last]:
                    found.append(add(extra, "K", best(i + 1, rows[i][1][:1], 0)))
        return min(found, default=(10 ** 9, ""))

    def add(cost, letter, rest):
        return rest[0] + cost, letter + rest[1]

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for k in (3, 2, 1, 0):
            for last in moves:
                best(i, last, k)
    cost, audit = best(0, "", 0)
    lines, i, last = [], 0, ""
    for e in audit:
        if e == "D":
            i += 1
            continue
        letter = rows[i][1][:1] if e == "K" else "a" if last == "u" else "u"
        role = rows[i][1] if e == "K" else {"a": "assistant", "u": "user"}[letter]
        lines.append(role + ":" + ("" if e == "I" else rows[i][2]))
        i, last = i + (e != "I"), letter
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}, lines


def same(report, rows):
    want = damaged(rows)
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in report.collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == plain(want[c])[0], c


def random_rows(seed, conversations=150):
    rng = np.random.default_rng(seed)
    texts = ["a.", "b!", "b!", "no end", "", "  \n", "c? ", "long text " * 20 + ".", "ünï。", "x", None]
    roles = ["user", "assistant", "system", "tool", "", "ugly", "user", "assistant", None]
    out = []
    for c in range(conversations):
        n = int(rng.integers(1, 9))
        turns = [None if rng.random() < 0.05 else int(t) for t in rng.integers(-3, 12, n)]
        out += [(None if c == 7 else c, t, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for t in turns]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("spill", [1, 3, 1 << 15])
def test_reports_equal_the_plain_recursion(spark, seed, spill):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    same(cr.repair_report(cr.damage(df), spill_rows=spill), rows)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    same(cr.repair_report(cr.damage(df)), [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows(spark):
    rows = random_rows(5, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in cr.repaired(cr.damage(df)).orderBy("conv_id", "position").collect():
        got[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, part in damaged(rows).items():
        assert got.get(c, []) == plain(part)[1]


def test_long_conversation_over_batches_and_spills(spark):
    # a third of all rows in one conversation, over many Arrow batches
    rng = np.random.default_rng(9)
    roles = ["user", "assistant", "user", "assistant", "tool", "system"]
    rows = [(1, t, roles[rng.integers(6)], f"text {rng.integers(3000)}" + ".?! x"[rng.integers(5)]) for t in range(3000)]
    rows += [(c, t, roles[t % 2], f"{c} {t}.") for c in range(2, 1502) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["conv_id"]: r for r in cr.repair_report(cr.damage(df), spill_rows=100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = damaged(rows)
    for c in (1, 2, 700, 1501):
        w = plain(want[c])[0]
        assert {k: got[c][k] for k in w} == w
    assert len(got) == 1501


def test_nothing_and_all_dropped(spark):
    schema = "conv_id string, turn long, role string, text string, _c string, cost string, audit string"
    assert cr.repair_report(cr.damage(spark.createDataFrame([], schema))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"x:{t}".encode()) % 20 == 0)
    out = cr.repair_report(cr.damage(spark.createDataFrame([("x", gone, "user", "a.", "k", "c", "d")], schema))).collect()
    assert [tuple(r) for r in out] == [("x", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_shuffle_of_the_rows(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = cr.repair_report(cr.damage(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, and the few pieces of each conversation


def test_program_has_few_situations():
    program, situations = cr.Program(), {((0, 0),)}
    codes = [i + f for i in "suax" for f in "-td"]
    todo = list(situations)
    while todo:
        now = todo.pop()
        for code in codes:
            then = program.steps[program.step(now, code)][0]
            if then not in situations:
                situations.add(then)
                todo.append(then)
    assert len(situations) < 1000
