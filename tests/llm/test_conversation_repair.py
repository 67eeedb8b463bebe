"""Operator 12 against every way to edit short conversations, and against its SQL on random ones."""

import hashlib
import random
from itertools import product
from zlib import crc32

import duckdb
import pytest

from codeloom.llm import conversation_repair as cr
from codeloom.llm import earley
from codeloom.llm.conversation_repair import Repair, damaged, repair_summaries, repaired_turns
from codeloom.llm.earley import Kind

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def every_edit(kinds):
    """(cost, audit) of the best of all edits with up to two inserts between turns."""
    legal = lambda s: not s or (s[1:] if s[0] == "s" else s) == "ua" * (len(s[1:] if s[0] == "s" else s) // 2) and s != "s"
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    for chosen in product(*[[(e, r) for e in ("K", "Ru", "Ra", "D")  for r in [k]] for k in kinds]):
        if any(k.must_go and e != "D" for e, k in chosen) or any(e == "K" and not k.role for e, k in chosen):
            continue
        base = sum({"K": 0, "R": 3, "D": 4}[e[0]] + (3 if k.truncated and e != "D" else 0) for e, k in chosen)
        for added in product(inserts, repeat=len(kinds) + 1):
            out, audit, cost = "", "", base
            for i in range(len(kinds) + 1):
                out, audit, cost = out + added[i], audit + "I" * len(added[i]), cost + 3 * len(added[i])
                if i < len(kinds):
                    e, k = chosen[i]
                    out += {"K": k.role, "D": ""}.get(e, e[1:])
                    audit += e[0]
            if legal(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_parser_equals_every_edit():
    kinds = [Kind(r, False, t) for r in "sua" for t in (False, True)] + [Kind("", False, False), Kind("u", True, False)]
    rng = random.Random(2)
    cases = [[k] for k in kinds] + [list(c) for c in product(kinds, repeat=2)] + [[rng.choice(kinds) for _ in range(3)] for _ in range(25)]
    for case in [[], *cases]:
        r = Repair(1)
        for k in case:
            role = {"s": "system", "u": "user", "a": "assistant", "": "tool"}[k.role]
            r.add(None, role, str(len(r.window)), False, k.must_go, not k.truncated)
        list(r.end())
        assert (r.cost, r.audit.decode()) == every_edit(case), case


def rows_of(seed, n_conv=60, longest=30):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "Why? ", "", " \n", None, "é 漢.", "a\nb!\t", "same.", "same."]
    rows = []
    for c in [None, *range(n_conv)]:
        good = rng.random() < 0.5
        for t in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[t % 2] if good and rng.random() < 0.8 else rng.choice(roles)
            number = None if rng.random() < 0.03 else t + (rng.randrange(3) if rng.random() < 0.1 else 0)
            rows.append((c, number, role, f"{t} said." if rng.random() < 0.6 else rng.choice(texts)))
    return rows + rows[:12]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return {r[0]: r for r in con.execute(f"SELECT {', '.join(NAMES)} FROM ({cr.ORACLE})").fetchall()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", False) for r in rows], "conv_id long, turn long, role string, text string, n long, same string, repeated boolean")


@pytest.mark.parametrize("seed, look", [(1, 64), (2, 1), (3, 4)])
def test_equals_sql_on_odd_conversations(spark, monkeypatch, seed, look):
    monkeypatch.setattr(cr, "LOOK", look)
    rows = rows_of(seed)
    got = [tuple(r) for r in repair_summaries(damaged(frame(spark, rows))).select(*NAMES).collect()]
    want = by_sql(rows)
    have = {r[0]: r for r in got}
    assert len(got) == len(have) and set(have) == {r[0] for r in rows}
    for conv, row in have.items():
        assert row == want[conv], conv


def test_repaired_turns_have_the_digest(spark):
    rows = rows_of(9)
    turns = damaged(frame(spark, rows))
    digests = {r.conv_id: r for r in repair_summaries(turns).collect()}
    said = {}
    for r in sorted(repaired_turns(turns).collect(), key=lambda r: r.n):
        said.setdefault(r.conv_id, []).append(r)
    for conv, row in digests.items():
        own = said.get(conv, [])
        assert [r.n for r in own] == list(range(len(own)))
        assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest()
        assert "".join(r.edit for r in own) == row.audit.replace("D", "")
        initials = "".join(r.role[0] for r in own)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2) and initials != "s"


def test_damage():
    for conv, turn in ((1, 2), (None, 3), (4, None)):
        assert 0 <= crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 < 20


def test_a_long_conversation_is_settled_as_it_streams():
    """The window stays at what parses differ on; runs of turns that must go take one entry."""
    rng, most = random.Random(4), 0
    r = Repair(1)
    for t in range(60_000):
        role = ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(["user", "system", "tool"])
        must_go = 20_000 < t < 50_000
        r.add(t, role, f"{t} x", False, must_go, rng.random() < 0.9)
        for _ in r.settle():
            pass
        most = max(most, len(r.window))
    list(r.end())
    assert most < 1000 and len(r.audit.replace(b"I", b"")) == 60_000
    assert earley.step.cache_info().currsize < 2000


def test_empty_and_all_gone(spark):
    assert repair_summaries(damaged(frame(spark, []))).count() == 0
    gone = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair_summaries(damaged(frame(spark, [(gone, 0, "user", "Hi.")]))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
