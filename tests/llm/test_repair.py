"""Conversation repair against a search over all edits, and its edge cases."""

import hashlib
import random
import sys
import zlib
from functools import cache

import pytest

from lintlake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        r = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if r == 0:
            continue
        text = "" if r == 1 else "".join(c for c in text if c not in ".!?") if r == 2 else text
        out += [(conv, turn, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    return out


def order(r):
    return (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, edits, repaired roles) over all edits with up to two insertions in each gap; no program over states but the grammar's own."""

    def grows(roles, initial):
        if initial == "s":
            return roles == ""
        return initial == ("a" if roles.endswith("u") else "u")

    def take(a, b):
        return b is None or a[:2] < b[:2]

    @cache
    def full(i, last, inserted):
        best = None
        if i == len(rows) and last in ("", "a"):
            best = (0, "", ())
        if i < len(rows):
            role, fault = rows[i][2], found[i]
            options = [("D", 2, None)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                options += [("K", more, role), ("R", more + 1, "user"), ("R", more + 1, "assistant")]
            for edit, cost, new in options:
                if new is not None and not grows(last, new[:1]):
                    continue
                one = full(i + 1, last if new is None else new[0], 0)
                option = one and (cost + one[0], edit + one[1], ((i, new), *one[2]))
                if option and take(option, best):
                    best = option
        if inserted < 2:
            for new in ("user", "assistant"):
                if grows(last, new[0]):
                    one = full(i, new[0], inserted + 1)
                    option = one and (5 + one[0], "I" + one[1], ((None, new), *one[2]))
                    if option and take(option, best):
                        best = option
        return best

    return full(0, "", 0)


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=order)
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, edits = cheapest(own, found)
        texts = [f"{new}:{'' if i is None else own[i][3]}" for i, new in edits if new is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in repair.FAULTS],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
        )
    return out


def corpus():
    rng = random.Random(4)
    rows = []
    for conv in range(250):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "What", "So it is. ", " \n", "", None, f"Turn {turn}."])
            rows.append((conv if conv else None, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 3]), role, text))
    rows += [(900, k, "user", "Same.") for k in range(30)] + [(901, 5, "user", "One."), (901, 5, "user", "One."), (901, 5, "assistant", "One.")]
    rows += [(902, 1, "assistant", "word " * 60_000 + "end."), (902, 0, "user", "?" + " " * 100_000)]
    return rows


def check(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = repair.digests(d).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in ("gaps", *repair.FAULTS, "illegal", "cost", "audit", "repaired_sha256")) == want[r.conv_id], r.conv_id


def test_against_a_search_over_all_edits(spark):
    check(spark, corpus())


def test_small_blocks_and_batches_give_the_same(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark, [r for r in corpus() if r[0] is None or r[0] < 25 or r[0] > 899])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_giant_conversation_spills(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    monkeypatch.setattr(repair, "IN_MEMORY", 64)
    rng = random.Random(1)
    rows = [(0, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no"]) + str(k) + rng.choice([".", ""])) for k in range(700)]
    p = repair.Program()
    found = faults(rows)
    for r, fault in zip(rows, found, strict=True):
        p.add((r[1],), True, r[1], r[2], fault, 1)
    cost, tail = p.close()
    assert p.spool._rolled and len(p.block) < 16
    blocks = sorted(p.blocks())
    assert [k for k, _ in blocks] == [(k,) for k in range(0, 700, 16)]
    audit = "".join(repair.EDITS[e] for _, b in blocks for e in b) + "I" * tail
    sys.setrecursionlimit(10_000)
    assert (cost, audit) == cheapest(rows, found)[:2]


def test_repaired_turns_and_clashing_columns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hello."), (2, 0, "assistant", "cut")]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("h", "conv", "edits", "n", "last"):
        d = d.withColumn(c, d.text)
    got = {(r.conv_id, r.place): (r.turn, r.role, r.text, r.edit) for r in repair.turns_of(repair.repaired(d)).collect()}
    assert got == {("1", 0): (0, "system", "Be kind.", "K"), ("1", 1): (1, "user", "Hi.", "K"), ("1", 3): (3, "assistant", "Hello.", "K")}


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", "Hi.")]])
def test_empty_and_tiny(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    assert repair.repaired(d).where("edit = 'end'").count() == len(rows)
    assert {r.conv_id for r in repair.digests(d).collect()} == {r[0] for r in rows}
