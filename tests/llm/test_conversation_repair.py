"""Conversation repair against a plain search over all edits, without blocks or checkpoints."""

import hashlib
import random
from functools import lru_cache

import pytest

from factloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, part string, block string, at string, conv string, n string, fault string"


def conversations():
    r = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    said = ["Yes.", "No!", "Why?", "cut off", "", "  \n", None, "a.b", "End. \t"]
    out = []
    for c in range(40):
        usual = r.random() < 0.5
        for t in range(r.randrange(1, 14)):
            role = ("user", "assistant")[t % 2] if usual and r.random() < 0.8 else r.choice(roles)
            out.append((c, t + (r.random() < 0.1) if r.random() < 0.95 else None, role, r.choice(said) if r.random() < 0.5 else f"Sentence {c} {t}."))
    out += [(100, t, r.choice(["user", "assistant", "user", "system"]), f"{t % 170}{r.choice(['.', '', '!'])}") for t in range(700)]
    out += [(101, 5, "user", "Again.")] * 300 + [(101, 6, "assistant", " ")] * 50 + [(101, 7, "assistant", "Fine.")]
    out += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (102, None, "user", "x"), (102, None, None, None), (103, 1, "assistant", "long " * 100_000 + ".")]
    return out


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for x in "ua":
            if inserted < 2 and x in follow[state] and (sub := best(i, x, inserted + 1)):
                options.append((5 + sub[0], "I" + sub[1], (("user:" if x == "u" else "assistant:"), sub[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if sub := best(i + 1, state):
                options.append((2 + sub[0], "D" + sub[1], sub[2]))
            more = 5 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                for name, e, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    x = name[:1]
                    if x and x in follow[state] and (sub := best(i + 1, x)):
                        options.append((cost + more + sub[0], e + sub[1], (f"{name}:{text}", sub[2])))
        return min(options, key=lambda o: o[:2]) if options else None

    for i in range(len(rows), 0, -1):  # fills the memory from the end, so that calls don't nest
        for state in ("a", "u", "s", ""):
            best(i, state)
    cost, audit, chain = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines = []
    while chain:
        lines.append(chain[0])
        chain = chain[1]
    return (gaps, *(faults.count(x) for x in cr.FAULTS[1:]), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected():
    by = {}
    for c, *row in conversations():
        by.setdefault(c, []).append(tuple(row))
    return {c: plain(rows) for c, rows in by.items()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_plain_search(spark, partitions):
    rows = spark.createDataFrame([(*r, *"pbacnf") for r in conversations()], SCHEMA)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r[0]: tuple(r)[1:] for r in cr.digest(cr.repair(rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = expected()
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_blocks_grow_as_the_root_and_cover_all_rows(spark):
    rows = spark.createDataFrame([(*r, *"pbacnf") for r in conversations()], SCHEMA).selectExpr("conv_id AS conv", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text").where("conv = 100")
    cut = cr.blocks(cr.faults(rows).coalesce(1)).collect()
    marks = [r for r in cut if r["at"] == -1]
    assert sum(len(r["numbers"]) for r in marks) == sum(r["at"] >= 0 for r in cut)
    assert max(len(r["numbers"]) for r in marks) <= 2 * len(cut) ** 0.5 and len(marks) <= 5 * len(cut) ** 0.5


def test_edits_are_rows(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Yes."), (2, 1, "system", "Be kind.")], "conv_id long, turn long, role string, text string")
    got = [(r.conv, r.edit, r.was, r.role, r.text) for r in cr.repair(rows).collect() if r.edit]
    assert sorted(got, key=lambda r: (r[0], r[4])) == [(1, "K", "user", "user", "Hello."), (1, "D", "user", None, "Hi."), (1, "K", "assistant", "assistant", "Yes."), (2, "D", "system", None, "Be kind.")]


def test_damage(spark):
    from zlib import crc32

    rows = spark.createDataFrame([(c, t, "assistant", "A. b!") for c in range(20) for t in range(10)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in cr.damage(rows).collect()), key=repr)
    want = []
    for c, t, role, text in [(c, t, "assistant", "A. b!") for c in range(20) for t in range(10)] + [(None, None, " ", " ")]:
        code = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if code == 4 else role, "" if code == 1 else "A b" if code == 2 and c is not None else text)
        want += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    assert got == sorted(want, key=repr)


def test_conversations_without_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    names = spark.createDataFrame([(1,), (7,), (None,)], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in cr.digest(cr.repair(rows, names)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: (0, 0, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest()), 7: nothing, None: nothing}
    assert cr.digest(cr.repair(rows.limit(0))).count() == 0
