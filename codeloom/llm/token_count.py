"""Operator 3: token counts by rank-synchronous array merging.

The pre-tokens of an Arrow batch that were not met before are held as one ragged numpy array of symbols. In each round
every sequence finds its lowest-rank adjacent pair and merges all its occurrences at once; sequences without a mergeable
pair leave. What survives is counted. Counts of met pre-tokens stay in a bounded memo, so a word is merged about once
for each Python worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import read_table

#: Pre-token pattern of byte-level BPE files of this kind; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000
#: Longer pre-tokens are counted but not kept in the memo.
MEMO_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merge ranks of a byte-level BPE file as an open-addressing table keyed by (left id, right id)."""

    def __init__(self, spec: dict):
        """Only files that ask for what counter() does are taken; others raise ValueError."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bare = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        if not (plain and bare and not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)):
            raise ValueError("not a plain byte-level BPE file with the usual pre-token pattern")
        vocab = model["vocab"]
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = 1 << (4 * len(pairs)).bit_length()
        self.keys = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, len(pairs), np.int64)
        self.made = np.zeros(len(pairs) + 1, np.int64)
        self.none = len(pairs)
        for r, (a, b) in enumerate(pairs):
            self.made[r] = vocab[a + b]
            key = vocab[a] << 32 | vocab[b]
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & (self.size - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.rank[slot] = key, r
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), self.none, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        sym = self.bytes[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        seq = np.repeat(np.arange(len(live)), lengths[live])
        while len(sym):
            pair = np.full(len(sym), self.none, np.int64)
            inside = np.flatnonzero(seq[:-1] == seq[1:])
            pair[inside] = self.ranks(sym[inside], sym[inside + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(pair, starts)
            size = np.diff(np.r_[starts, len(sym)])
            done = low == self.none
            if done.any():
                out[live[seq[starts[done]]]] = size[done]
            low = np.repeat(np.where(done, -1, low), size)
            at = pair == low
            # Of a run of overlapping pairs (a a a a) every second one merges, from the left.
            first = at & ~np.r_[False, at[:-1]]
            index = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(first, index, -1))
            at &= (index - run) % 2 == 0
            where = np.flatnonzero(at)
            sym = sym.copy()
            sym[where] = self.made[pair[where]]
            keep = low >= 0
            keep[where + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


def counter(spec: dict):
    """A function from texts to their token counts."""
    table = MergeTable(spec)
    find = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
    memo: dict[str, int] = {}

    def count(texts: list[str | None]) -> list[int]:
        nonlocal memo
        pieces, owners, extra = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if special and special.search(text):
                parts = special.split(text)
                extra[i] = len(parts) - 1
            for part in parts:
                if part:
                    pieces.append(find(part))
                    owners.append(i)
        if len(memo) > MEMO:
            memo = {}
        new = {w for piece in pieces for w in piece if w not in memo}
        own = memo
        if new:
            words = list(new)
            counts = dict(zip(words, table.count([w.encode() for w in words]).tolist()))
            own = memo | counts if any(len(w) > MEMO_CHARS for w in words) else memo
            memo.update((w, c) for w, c in counts.items() if len(w) <= MEMO_CHARS)
        for i, piece in zip(owners, pieces):
            extra[i] += sum(map(own.__getitem__, piece))
        return extra

    return count


def token_counts(docs: DataFrame, spec: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    spec is the text of a byte-level BPE tokenizer file. Null and empty texts have 0 tokens. Special strings inside a text
    are one token each, as the library does by default. Texts are whole, however long; ids may be null or repeated; an
    empty table gives no rows; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(json.loads(shared.value))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2).to_pylist()
                n = pa.array(count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(read_table(spark, sf_dir, "documents"), Path(vocabulary).read_text())
