"""Operator 6: chat formatting by schema fingerprints.

A record's nested field paths (`messages[].role`) are hashed; the hash selects a declarative mapping from that layout to
canonical turns (conversation, number, role, text); with fields of other layouts beside them, the first mapping whose
required paths are all present. The template then writes each turn as
`<|turn|>role<|text|>text<|end|>` and a line feed. In roles and texts a backslash is doubled, and one is put after the
first character of every control string, so no control string of this or other common templates is left and the original
comes back by dropping each backslash and keeping the character after it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import read_table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings of this template and of other common ones; fixed values.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
SEGMENT = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Mapping:
    """turns: (role, text) pairs for flat layouts, where a role that starts with '=' is a literal and the others are
    fields; each: the list field whose elements are turns. Records with an absent optional field also match."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    conversation: str = ""
    number: str = ""

    def paths(self) -> set[str]:
        own = {f"{self.each}[].{f}" for f in (self.role, self.text)} if self.each else {f for f in (self.role, self.text) if f}
        own |= {p for r, t in self.turns for p in (r, t) if p and p[0] != "="}
        return own | {p for p in (self.conversation, self.number) if p}

    def fingerprints(self) -> Iterator[str]:
        for k in range(len(self.optional) + 1):
            for gone in combinations(self.optional, k):
                yield fingerprint(self.paths() - set(gone))


def fingerprint(paths: set[str]) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("turn rows", role="role", text="text", conversation="conv_id", number="turn"),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("conversations", each="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt and completion", turns=(("=system", "system"), ("=user", "prompt"), ("=assistant", "completion")), optional=("system",)),
    Mapping("prompt and response", turns=(("=system", "system"), ("=user", "prompt"), ("=assistant", "response")), optional=("system",)),
    Mapping("instruction", turns=(("=system", "system"), ("=user", "instruction"), ("=user", "input"), ("=assistant", "output")), optional=("system", "input")),
)
REGISTRY = {f: m for m in MAPPINGS for f in m.fingerprints()}
KNOWN = set().union(*(m.paths() for m in MAPPINGS))


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields), set())
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def value_paths(value: object, prefix: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{prefix}[]") for v in value), set())
    return {prefix}


def mapping_of(paths: set[str], rows: bool) -> Mapping | None:
    """The mapping for these paths: of tables with one turn in each row, or of whole records.

    A fingerprint that matches all known fields comes first. Else it is the first of MAPPINGS whose required paths are all
    there: lists of turns before flat layouts, in the order above. Fields that it does not name are further columns.
    """
    exact = REGISTRY.get(fingerprint(paths & KNOWN))
    if exact and bool(exact.conversation) == rows:
        return exact
    return next((m for m in MAPPINGS if bool(m.conversation) == rows and m.paths() - set(m.optional) <= paths), None)


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table with one turn in each row; null roles and texts are empty.

    Further columns are not read, whatever their names. Raises ValueError if a column of the layout is missing.
    """
    m = mapping_of(schema_paths(rows.schema), rows=True)
    if m is None:
        raise ValueError(f"no mapping for rows with the fields {sorted(schema_paths(rows.schema))}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.col(m.conversation).cast("long").alias("conv_id"), F.col(m.number).cast("long").alias("turn"), text(m.role).alias("role"), text(m.text).alias("text"))


def record_turns(record: object) -> tuple[str | None, list[tuple[str, str]]]:
    """Name of the mapping (None: unknown layout) and the turns of one parsed record. A list of turns with an element that
    is no object is an unknown layout too: no turn of it is guessed."""
    m = mapping_of(value_paths(record), rows=False) if isinstance(record, dict) else None
    if m is None or m.each and not all(isinstance(e, dict) for e in record[m.each]):
        return None, []
    said = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if m.each:
        return m.name, [(dict(m.roles).get(said(e.get(m.role)), said(e.get(m.role))), said(e.get(m.text))) for e in record[m.each]]
    out: list[tuple[str, str]] = []
    for role, field in m.turns:
        if record.get(field) is not None:
            if out and out[-1][0] == role[1:]:
                out[-1] = (role[1:], f"{out[-1][1]}\n{said(record[field])}")
            else:
                out.append((role[1:], said(record[field])))
    return m.name, out


def turns_of_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turn, role, text) of heterogeneous JSON records. A record that is null, not JSON or of an unknown
    layout gives one row with a null layout, turn, role and text, so none is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    name, turns = record_turns(json.loads(text or "null"))
                except ValueError:
                    name, turns = None, []
                out += [(i, name, k, r, t) for k, (r, t) in enumerate(turns)] or [(i, name, None, None, None)]
            cols = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "layout", "turn", "role", "text"])

    return records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, "conv_id long, layout string, turn long, role string, text string")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns with two more columns: segment (the turn in the template) and loss (whether its text is under the loss
    mask). A conversation's output is its segments in order of turn, role and text; no row is moved for it."""
    segment = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT), escaped(F.col("text")), F.lit(END))
    return turns.withColumns({"segment": segment, "loss": F.col("role") == LOSS_ROLE})


def conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_texts): whole outputs, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment", "loss")))
    return segments.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join("p.segment", "").alias("formatted"), F.transform(F.filter("p", lambda x: x["loss"]), lambda x: x["text"]).alias("loss_texts"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted output: number and SHA-256 of turns, code points and
    SHA-256 of all text under the loss mask, code points of the output.

    Conversations are dealt out by id and sorted on disk; a task reads its segments one after another and holds one at a
    time, so a conversation of any length fits. Null ids are one conversation; null turns come first; repeated rows count
    each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = object(), None, []

        def end() -> None:
            if state is not None:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            cols = zip(*done) if done else ([],) * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or conv != key:
                    end()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(segment)
                for role, text in SEGMENT.findall(segment):
                    role, text = unescaped(role), unescaped(text)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        state[2] += len(text)
                        state[3].update(text.encode())
            if len(done) > 1000:
                yield batch()
                done.clear()
        end()
        yield batch()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment").mapInArrow(run, READ)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = turns_of_rows(read_table(spark, sf_dir, "conversations")).unionByName(extra)
    return read_back(format_turns(turns))


def _oracle() -> str:
    def esc(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for s in CONTROL:
            out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
        return out

    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length('{TURN}{TEXT}{END.strip()}') + 1 + length({esc('role')}) + length({esc('text')}) AS n FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


ORACLE = _oracle()
