"""Operator 12: repair of conversations whose turns break the order of roles, by error-correcting Earley parsing.

A shuffle brings the turns of a conversation to one task in order, where they stream past the parser (earley.py). Once all
surviving parses agree on a turn, its edit is final: it goes to the output and its text is let go, so a task holds the
turns on which parses still differ, not the conversation. The digest of a conversation is read in order by its nature, so a
conversation is one task's work however long it is. Repeated turns are found beforehand, by a partial aggregation of the
first place of each (conversation, role, text), so no set of texts seen is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import earley
from codeloom.llm.common import join_on_hot_key, read_table
from codeloom.llm.earley import GIVEN, Kind

#: The ASCII white space of `[\x20\x09-\x0D]`, and the characters that end a sentence; fixed values.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Pairs of role initials that may stand side by side.
LEGAL = {"su", "ua", "au"}
#: Turns that are held before the parser first looks whether its parses agree.
LOOK = 64


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of turns after the damage that the CRC-32 of `conv_id:turn` chooses; a null role,
    text, id or number is read as one space, a null turn keeps its place before all others."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")), "gone": F.col("code") == 0})
    again = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))))
    return again.select("conv_id", "turn", "role", "text", "gone")


class Repair:
    """One conversation: turns go in by add(), repaired turns come out of settle() and end()."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.column, self.cost, self.look = earley.first(), 0, LOOK
        self.window: list[list] = []  # [roots, turns that they hold for, (role, text) or None]
        self.audit, self.digest, self.n_out, self.has_system = bytearray(), hashlib.sha256(), 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.before: tuple | None = None
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool, ended: bool) -> None:
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
            repeated = repeated or self.before == (turn, role, text)
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.before = (turn, role, text)
        cut = not (blank or repeated or ended)
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut
        initial = role[:1]
        kind = Kind(initial if initial in {"s", "u", "a"} else "", blank or repeated, cut)
        self.column, more, roots = earley.step(self.column, kind)
        self.cost += more
        if kind.must_go and self.window and self.window[-1][0] is roots and self.window[-1][2] is None:
            self.window[-1][1] += 1
        else:
            self.window.append([roots, 1, None if kind.must_go else (role, text)])

    def settle(self) -> Iterator[tuple[str, str, str]]:
        """Repaired turns on which all surviving parses agree, if it is time to look for them."""
        if len(self.window) < self.look:
            return
        alive = earley.ranks(self.column)
        for at in range(len(self.window) - 1, -1, -1):
            roots, n, _ = self.window[at]
            for _ in range(n):
                older = frozenset(roots[r][0] for r in alive)
                if older == alive:
                    break
                alive = older
            if len(alive) == 1:
                yield from self._out(at, min(alive))
                break
        self.look = max(LOOK, 2 * len(self.window))

    def _out(self, upto: int, rank: int) -> Iterator[tuple[str, str, str]]:
        """Settles the first `upto` entries of the window, on the path that ends in this rank."""
        edits = []
        for roots, n, turn in reversed(self.window[:upto]):
            run = []
            for _ in range(n):
                rank, edit = roots[rank]
                run.append(edit)
            edits.append((run[::-1], turn))
        del self.window[:upto]
        for run, turn in reversed(edits):
            for edit in chain.from_iterable(run):
                yield from self._edit(edit, turn)

    def _edit(self, edit: str, turn: tuple[str, str] | None) -> Iterator[tuple[str, str, str]]:
        self.audit += edit.encode()
        if edit == "D":
            return
        if edit == "K":
            role, text = turn
            self.has_system |= not self.n_out and role[:1] == "s"
        else:
            role, text = list(GIVEN.values())[(self.n_out - self.has_system) % 2], turn[1] if edit == "R" else ""
        self.digest.update(f"{chr(10) if self.n_out else ''}{role}:{text}".encode())
        self.n_out += 1
        yield role, text, edit

    def end(self) -> Iterator[tuple[str, str, str]]:
        cost, rank, tail = earley.accepted(self.column)
        self.cost += cost
        yield from self._out(len(self.window), rank)
        for edit in tail:
            yield from self._edit(edit, None)

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, n long, role string, text string, edit string"
IN = ["conv_id", "turn", "role", "text", "gone", "blank", "repeated", "ended"]


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns with what is wrong with each, those of a conversation side by side in order."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    seen = turns.withColumns({"blank": bare == "", "ended": F.right(bare, F.lit(1)).isin(*ENDS), "place": F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))})
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    seen = seen.withColumn("same", F.when(~F.col("gone") & ~F.col("blank"), F.sha2(whole.cast("binary"), 256)))
    often = seen.filter("same is not null").groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    seen = join_on_hot_key(seen, often, "same", "times", max(1, turns.count()), "left")
    seen = seen.withColumn("repeated", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    return seen.select(*IN).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _streamed(turns: DataFrame, schema: str, summaries: bool) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        out: list[tuple] = []

        def take(found: Iterator[tuple[str, str, str]]) -> None:
            for role, text, edit in found:
                if not summaries:
                    out.append((now.conv_id, now.n_out - 1, role, text, edit))

        def close() -> None:
            if now is not None:
                take(now.end())
                if summaries:
                    out.append(now.summary())

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema([(n, pa.string() if f.endswith("string") else pa.int64()) for n, f in zip(names, schema.split(", "))]))
            out.clear()
            return batch

        for batch in batches:
            for conv, turn, role, text, gone, blank, repeated, ended in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv_id:
                    close()
                    now = Repair(conv)
                if not gone:
                    now.add(turn, role, text, blank, repeated, ended)
                    take(now.settle())
            if out:
                yield packed()
        close()
        if out:
            yield packed()

    return _ordered(turns).mapInArrow(run, schema)


def repair_summaries(turns: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: (conv_id, turn, role, text, gone); turns that are gone only make their conversation known. Turns stand in the order
    of their numbers, nulls first, and with equal numbers in that of role and text; turns with a null conversation
    are one conversation. A role is known by its first letter; other letters, and roles without one, are never kept. A
    conversation without turns, or of which nothing stays, has an empty audit or one of deletes, and the digest of an empty
    string. An empty table gives no rows; further columns are not read.
    """
    return _streamed(turns, SUMMARY, True)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, n (from 0), role, text, edit (K, R or I)."""
    return _streamed(turns, TURNS, False)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summaries(damaged(read_table(spark, sf_dir, "conversations")))


def _add(value: str, cost: str, edit: str) -> str:
    """A value (nine digits of cost, then the audit) with one more edit, in SQL."""
    return f"(lpad(CAST(CAST(substr({value}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{edit}')"


def oracle() -> str:
    # CRC-32 (reflected polynomial 0xEDB88320): a table entry is eight shift-and-xor steps on its index.
    entry = "list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    # Least values in four states: nothing yet, after the system turn, after a user's, after an assistant's.
    u = f"least(r.u, {_add('r.e', '3', 'I')}, {_add('r.h', '3', 'I')}, {_add('r.a', '3', 'I')})"
    a = f"least(r.a, {_add(u, '3', 'I')})"
    keep = lambda v, role: f"CASE WHEN NOT t.bad AND t.i = '{role}' THEN {_add(v, 't.cut', 'K')} END"
    rerole = lambda v: f"CASE WHEN NOT t.bad THEN {_add(v, '3 + t.cut', 'R')} END"
    into_u = ", ".join(f(v) for v in ("r.e", "r.h", a) for f in (lambda v: keep(v, "u"), rerole))
    return rf"""
WITH RECURSIVE tbl AS (SELECT list({entry} ORDER BY i) AS t FROM range(256) r(i)),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT c.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(k[j + 1]) AS BIGINT) FOR j IN range(length(k))]), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) % 20 AS code FROM c, tbl),
x AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d, range(CASE WHEN code = 3 THEN 2 ELSE 1 END) WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM x),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
      coalesce(substr(role, 1, 1) IN ('s', 'u', 'a'), false) AS known, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) AS side FROM o),
t AS MATERIALIZED (SELECT *, blank OR again AS bad, NOT blank AND again AS twice, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
      CASE WHEN NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS cut, CASE WHEN known THEN substr(role, 1, 1) ELSE '' END AS i FROM f),
r AS (SELECT conv_id, 0 AS n, '000000000' AS e, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM t)
      UNION ALL SELECT r.conv_id, t.n, {_add('r.e', '4', 'D')}, least({_add('r.h', '4', 'D')}, {keep('r.e', 's')}),
      least({_add(u, '4', 'D')}, {into_u}), least({_add(a, '4', 'D')}, {keep(u, 'a')}, {rerole(u)}) FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.n = r.n + 1),
z AS (SELECT r.conv_id, least(r.e, {a}) AS v FROM r JOIN (SELECT conv_id, max(n) AS n FROM t GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.n = r.n),
p AS (SELECT conv_id, k, v[k] AS edit, k - 9 - length(replace(substr(v, 10, k - 9), 'I', '')) AS ins, length(replace(substr(v, 10, k - 9), 'D', '')) AS place FROM z, range(10, length(z.v) + 1) g(k)),
q AS (SELECT p.conv_id, p.place, p.edit, t.role, CASE WHEN edit = 'I' THEN '' ELSE t.text END AS text, first_value(p.edit = 'K' AND t.i = 's') OVER (PARTITION BY p.conv_id ORDER BY p.place) AS sys
      FROM p LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.k - 9 - p.ins AND p.edit <> 'I' WHERE p.edit <> 'D'),
s AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - CAST(sys AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS said FROM q GROUP BY conv_id),
w AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(twice) AS duplicate, count_if(open) AS truncated, count_if(side NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(substr(v, 1, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(v, 10), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM k.conv_id
"""


ORACLE = oracle()
