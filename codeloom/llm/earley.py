"""Error-correcting Earley parsing of the turns of a conversation under a weighted role grammar.

A conversation has the form `(s?(ua)+)?` in the initials of its roles. Productions for errors let a turn be deleted, be
read as a user's or an assistant's, or be missing. Chart items hold the least (cost, audit), where the audit has the
initial of each edit: Keep, Rerole, Delete, Insert.

Every nonterminal stands first in its production, so all items begin at column 0, whose items alone wait for completions:
a column is computed from the column before it and no others are held.

Audits are compared without being spelled out. All audits of a column that end with the edit of its last turn hold
as many turns, and of two such none begins with the other, so their order stays as it is whatever both go on with. They
are numbered in that order (`rank`), and an item's value is (cost, rank, inserts since). A column less its least cost is one
of few, so columns are met again and steps between them are remembered.
"""

from __future__ import annotations

import heapq
from functools import cache
from typing import NamedTuple

#: Productions; one-letter names are turns of that role.
GRAMMAR = {"S": ((), ("Turns",)), "Turns": (("u", "a"), ("s", "u", "a"), ("Turns", "u", "a"))}
#: Costs of the edits, and of a truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Whatever an item goes on with, finished turns can follow it for so much more: an insert takes up the other place in a
#: pair, a delete stands for a kept system turn. An item that costs more than that above them is on no least parse.
BRIDGE = INSERT + DELETE
#: Roles that a turn can be given; the others are only kept.
GIVEN = {"u": "user", "a": "assistant"}


class Item(NamedTuple):
    """A production with the dot before symbol `dot` of it."""

    name: str
    symbols: tuple[str, ...]
    dot: int

    @property
    def next(self) -> str | None:
        return self.symbols[self.dot] if self.dot < len(self.symbols) else None

    def moved(self) -> Item:
        return self._replace(dot=self.dot + 1)


class Kind(NamedTuple):
    """What the parser sees of a turn."""

    role: str
    must_go: bool
    truncated: bool


Value = tuple[int, int, str]
#: Items with their values, by item.
Column = tuple[tuple[Item, Value], ...]
#: For each rank of a column, the rank in the column before and the edits since.
Roots = tuple[tuple[int, str], ...]


def _closed(seeds: dict[Item, Value]) -> Column:
    """Predicts, completes and inserts until nothing gets less; the least value first, so each item is final once taken."""
    done: dict[Item, Value] = {}
    agenda = [(v, item) for item, v in seeds.items()]
    heapq.heapify(agenda)
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = value
        wanted = item.next
        if wanted is None:  # completer
            found = [Item(n, p, 1) for n, each in GRAMMAR.items() for p in each if p[:1] == (item.name,)]
        elif wanted in GRAMMAR:  # predictor
            found = [Item(wanted, p, 0) for p in GRAMMAR[wanted]]
        else:
            found = []
            if wanted in GIVEN:
                heapq.heappush(agenda, ((value[0] + INSERT, value[1], value[2] + "I"), item.moved()))
        for f in found:
            heapq.heappush(agenda, (value, f))
    return tuple(sorted(done.items()))


@cache
def first() -> Column:
    return _closed({Item("S", p, 0): (0, 0, "") for p in GRAMMAR["S"]})


@cache
def accepted(column: Column, name: str = "S") -> Value:
    """The least value of a finished parse of this nonterminal."""
    return min(v for item, v in column if item.name == name and item.next is None)


@cache
def ranks(column: Column) -> frozenset[int]:
    return frozenset(v[1] for _, v in column)


@cache
def step(column: Column, kind: Kind) -> tuple[Column, int, Roots]:
    """The column after a turn less its least cost, that cost, and where its ranks come from."""
    seeds: dict[Item, Value] = {}

    def offer(item: Item, value: Value, cost: int, edit: str) -> None:
        new = (value[0] + cost, value[1], value[2] + edit)
        seeds[item] = min(seeds.get(item, new), new)

    extra = TRUNCATED if kind.truncated else 0
    for item, value in column:
        wanted = item.next
        if wanted in GRAMMAR or wanted is None and item.name != "S":
            continue
        offer(item, value, DELETE, "D")
        if wanted is None or kind.must_go:
            continue
        if wanted == kind.role:
            offer(item.moved(), value, extra, "K")
        if wanted in GIVEN:
            offer(item.moved(), value, REROLE + extra, "R")
    least = min(v[0] for v in seeds.values())
    roots = tuple(sorted({v[1:] for v in seeds.values()}))
    column = _closed({item: (v[0] - least, roots.index(v[1:]), "") for item, v in seeds.items()})
    column = tuple((item, v) for item, v in column if v[0] <= accepted(column, "Turns")[0] + BRIDGE)
    used = sorted(ranks(column))
    return tuple((item, (v[0], used.index(v[1]), v[2])) for item, v in column), least, tuple(roots[r] for r in used)


