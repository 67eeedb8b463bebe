"""Operator 10: benchmark decontamination with an FM-index for each training shard.

A shard is a bounded group of documents. Its words are mapped to benchmark word numbers by a dictionary of the words
themselves; runs of words that all occur in the benchmark and are long enough to hold its shortest phrase go into the
shard's FM-index (no phrase can lie elsewhere, so nothing is lost). The phrases whose words all occur in the shard are
searched backward at once through wavelet-tree ranks, their occurrences located by sampled suffix positions, and the
located spans merged for each document. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import read_table, stored, with_outputs
from codeloom.llm.fm_index import FMIndex
from codeloom.llm.wordhash import ALNUM, word_bounds

WINDOW = 13
#: UTF-8 bytes of text in one shard, unless a single document is longer.
SHARD_BYTES = 1 << 20
#: Phrases of this much text are broadcast at once (4 bytes a word, 9 a window, and the distinct words); a larger benchmark
#: is searched in parts.
MAX_BENCHMARK_BYTES = 16 << 20
#: Phrases that a shard searches at a time.
SLICE = 200_000

Found = tuple[int, int, list, list[tuple[int, int]]]


class Phrases:
    """The windows of a benchmark as places in one array of word numbers (from 1), and the item of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, self.names = window, [None if i is None else str(i) for i, _ in items]
        self.words: dict[bytes, int] = {}
        parts, starts, lengths, owner, at = [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            own = [self.words.setdefault(w, len(self.words) + 1) for w in (text or "").encode().translate(ALNUM).split()]
            if own:
                n = max(1, len(own) - window + 1)
                parts.append(np.array(own, np.int32))
                starts.append(np.arange(at, at + n, dtype=np.int32))
                lengths.append(np.full(n, min(len(own), window), np.uint8))
                owner.append(np.full(n, k, np.int32))
                at += len(own)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.sequence, self.starts, self.lengths, self.owner = join(parts, np.int32), join(starts, np.int32), join(lengths, np.uint8), join(owner, np.int32)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers; 0 for words that the benchmark lacks."""
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))

    def among(self, present: np.ndarray) -> np.ndarray:
        """Windows whose words are all marked in present (by number)."""
        lost = np.r_[0, np.cumsum(~present[self.sequence], dtype=np.int32)]
        return np.flatnonzero(lost[self.starts + self.lengths] == lost[self.starts])

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Windows as right-aligned rows of word numbers."""
        at = np.arange(self.window) + (self.starts[which] + self.lengths[which].astype(np.int32))[:, None] - self.window
        blank = np.arange(self.window) < self.window - self.lengths[which][:, None].astype(np.int32)
        return np.where(blank, 0, self.sequence[np.maximum(at, 0)])


def scan(phrases: Phrases, texts: list[bytes], prior: list[tuple[list, list[tuple[int, int]]]] | None = None) -> list[Found]:
    """Of each text: words, hit words, items met (sorted, a null one last), and merged byte spans of hit words. prior: items
    and spans of each text that other phrases gave, which count as well."""
    folded = b"\n".join(texts).translate(ALNUM)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends = word_bounds(folded)
    first = np.searchsorted(starts, begins)  # each text's first word
    n_words = np.diff(first)
    hit = np.zeros(len(starts), bool)
    items: dict[int, set] = {}
    for t, (names, spans) in enumerate(prior or []):
        if names:
            items[t] = set(names)
            for s, e in spans:
                hit[np.searchsorted(starts, begins[t] + s) : np.searchsorted(starts, begins[t] + e)] = True
    for at, which in _occurrences(phrases, folded, first, n_words):
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + phrases.lengths[which], -1)
        hit |= np.cumsum(edge[:-1]) > 0
        text_of = np.searchsorted(first, at, "right") - 1
        for t, k in np.unique(np.stack([text_of, phrases.owner[which]], 1), axis=0).tolist():
            items.setdefault(t, set()).add(phrases.names[k])
    out: list[Found] = [(int(n), 0, [], []) for n in n_words]
    for t, names in items.items():
        a, b = first[t], first[t + 1]
        h = np.flatnonzero(hit[a:b]) + a
        gap = np.flatnonzero(np.diff(h) > 1)
        s, e = starts[h[np.r_[0, gap + 1]]] - begins[t], ends[h[np.r_[gap, len(h) - 1]]] - begins[t]
        out[t] = (int(b - a), len(h), sorted(names, key=lambda x: (x is None, x)), list(zip(s.tolist(), e.tolist())))
    return out


def _occurrences(phrases: Phrases, folded: bytes, first: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First words and phrase numbers of all occurrences in a shard, as pairs of arrays."""
    words = folded.split()
    if not phrases.shortest or not words:
        return
    number = phrases.numbers(words)
    # Runs of benchmark words within one text.
    head = np.zeros(len(words), bool)
    head[first[:-1][n_words > 0]] = True
    known = number > 0
    new_run = known & (head | ~np.r_[False, known[:-1]])
    run_of = np.cumsum(new_run) - 1
    run_len = np.bincount(run_of[known], minlength=1)
    use = np.flatnonzero(known & (run_len[np.maximum(run_of, 0)] >= phrases.shortest))
    if not len(use):
        return
    # The shard's symbols: runs with a 0 between them; where[i] is the word at symbol i.
    cut = np.flatnonzero(np.r_[False, (np.diff(use) > 1) | (run_of[use][1:] != run_of[use][:-1])])
    where = np.insert(use, cut, -1)
    symbols = np.where(where >= 0, number[where], 0)
    present = np.zeros(len(phrases.words) + 1, bool)
    present[symbols] = True
    may = phrases.among(present)
    if not len(may):
        return
    index = FMIndex(symbols)
    for part in np.split(may, range(SLICE, len(may), SLICE)):
        lo, hi = index.search(phrases.rows(part), phrases.lengths[part].astype(np.int64))
        met = np.flatnonzero(hi > lo)
        if len(met):
            count = (hi - lo)[met]
            which = np.repeat(met, count)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            yield where[index.locate(lo[which] + offset)], part[which]


OUTPUTS = ("n_words", "n_hit", "items", "spans")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs with four more columns: n_words, n_hit, items and spans (byte ranges of hit words, merged), after a prefix.

    Words are maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters, compared as they are. A
    phrase is `window` consecutive words of an item, or the whole of a shorter one; a document word inside any occurrence
    is hit. Null texts have no words; empty tables on either side give no hits. All rows stay, and all columns but those
    with the name of an output, which give way to it. Repeated items count once; a null item is one, listed last as null.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    names = [prefix + n for n in OUTPUTS]
    # A benchmark above the bound is searched in parts, one pass over the documents after the other without a shuffle.
    parts = -(-size // MAX_BENCHMARK_BYTES) or 1
    for k in range(parts):
        own = benchmark.filter(F.pmod(F.xxhash64(F.col(item_col).cast("string"), item_text), F.lit(parts)) == k) if parts > 1 else benchmark
        rows = own.select(F.col(item_col).cast("string"), F.col(item_text).cast("string")).collect()  # about MAX_BENCHMARK_BYTES of text
        docs = _search(docs, Phrases([(r[0], r[1]) for r in rows], window), text_col, names, k > 0)
        if k + 1 < parts:  # so that only one part is held at a time
            docs = stored(docs, "searched")
    return docs


def _search(docs: DataFrame, phrases: Phrases, text_col: str, names: list[str], again: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    at = docs.columns.index(text_col)
    kinds = ("long", "long", "array<string>", "array<struct<start:long,end:long>>")
    kept, schema = with_outputs(docs, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    before = [docs.columns.index(c) for c in names[2:]] if again else []
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([len(t or "") for t in batch.column(at).to_pylist()])
            begin = 0
            while begin < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SHARD_BYTES, "right")) - begin)
                part = batch.slice(begin, n)
                prior = [(i, [(s["start"], s["end"]) for s in p]) for i, p in zip(*(part.column(c).to_pylist() for c in before))] if before else None
                found = scan(shared.value, [(t or "").encode() for t in part.column(at).to_pylist()], prior)
                cols = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.list_(pa.string())))]
                spans = pa.array([[{"start": s, "end": e} for s, e in f[3]] for f in found], span)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *cols, spans], schema.names)
                begin += n

    return docs.mapInArrow(run, schema)


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = find_benchmark(docs, read_table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS p
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, unnest(range(n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
