"""Operator 2: language identification by prediction by partial matching.

For each language a context tree of orders 0 to ORDER over UTF-8 bytes is counted once and then frozen. A byte's exact
code length under escape method C is -log2 of n(byte) / (n + d) in the longest context that has met the byte, plus the
escapes log2((n + d) / d) of the longer contexts passed on the way (d: distinct bytes met); below order 0 all 256 bytes
are equally likely. Since the statistics are frozen, the code length of each (context, byte) met by any language is
tabulated for all languages at once; a text's code length in each language is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import crc_of_id, read_table, with_outputs

ORDER = 3
#: Bytes of training text for one language, and for all together, on average of the hash sample. They bound the strings
#: counted, and so the model, which has a row for each distinct string and a column for each language.
TRAIN_BYTES, TOTAL_BYTES = 3_000_000, 24_000_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Every k consecutive bytes as one big-endian integer."""
    out = np.zeros(max(len(raw) - k + 1, 0), np.uint64)
    for i in range(k):
        out = out << np.uint64(8) | raw[i : len(raw) - k + 1 + i].astype(np.uint64)
    return out


class Model:
    """Frozen context trees of several languages, tabulated. keys[k] holds the sorted (context, byte) strings of k + 1
    bytes and costs[k] their code lengths by language; escape[k] the cost of leaving a context of k bytes."""

    def __init__(self, languages: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]]):
        """counts[language][k]: sorted distinct strings of k + 1 bytes and how often they occur."""
        self.languages = languages
        n_lang = len(languages)
        self.tables, self.leave = [], []
        below = None
        for k in range(len(counts[0]) if counts else 0):
            keys = np.unique(np.concatenate([counts[g][k][0] for g in range(n_lang)]))
            ctx = np.unique(keys >> np.uint64(8))
            leave, cost = np.zeros((len(ctx), n_lang), np.float32), np.zeros((len(keys), n_lang), np.float32)
            at = np.searchsorted(ctx, keys >> np.uint64(8))
            shorter = np.float32(8.0) if below is None else below.rows[np.searchsorted(below.own, keys & np.uint64((1 << (8 * k)) - 1))]  # was counted too
            for g in range(n_lang):
                own, n = counts[g][k]
                full = np.zeros(len(keys))
                full[np.searchsorted(keys, own)] = n
                total = np.bincount(at, full, len(ctx))
                distinct = np.bincount(at, full > 0, len(ctx))
                met = total > 0
                leave[met, g] = np.log2((total[met] + distinct[met]) / distinct[met])
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = np.log2((total + distinct)[at]) - np.log2(full)
                cost[:, g] = np.where(full > 0, seen, leave[at, g] + (shorter if below is None else shorter[:, g]))
            below = Lookup(keys, cost)
            self.tables.append(below)
            self.leave.append(Lookup(ctx, leave))

    def cost(self, strings: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last byte of strings of k + 1 bytes, given the bytes before it: one column per language."""
        row = self.tables[k].find(strings)
        out = self.tables[k].of(row)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            s = strings[lost]
            up = self.leave[k].of(self.leave[k].find(s >> np.uint64(8)))
            out[lost] = up + (8.0 if k == 0 else self.cost(s & np.uint64((1 << (8 * k)) - 1), k - 1))
        return out

    def score(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; raw is the texts' bytes one after another, none of them empty."""
        order = len(self.tables) - 1
        total = np.zeros((len(starts), len(self.languages)))
        # The first bytes of a text have shorter contexts.
        size = np.diff(np.r_[starts, len(raw)])
        for k in range(order):
            at = starts[size > k]
            s = np.zeros(len(at), np.uint64)
            for i in range(k + 1):
                s = s << np.uint64(8) | raw[at + i].astype(np.uint64)
            total[size > k] += self.cost(s, k)
        long = np.flatnonzero(size > order)
        if len(long):
            bits = np.zeros((len(raw), len(self.languages)), np.float32)
            bits[order:] = self.cost(grams(raw, order + 1), order)
            for i in range(order):
                bits[np.minimum(starts + i, len(raw) - 1)] = 0
            # Positions that were blanked hold contexts across two texts.
            total[long] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)[long]
        return total


class Lookup:
    """Sorted uint64 keys to rows by open addressing; absent keys get row -1, which is all zeros. The slots are made where
    they are first used, so that the model travels without them."""

    def __init__(self, own: np.ndarray, rows: np.ndarray):
        self.own, self.rows, self.slot = own, rows, None

    def __getstate__(self) -> dict:
        return {"own": self.own, "rows": self.rows, "slot": None}

    def of(self, row: np.ndarray) -> np.ndarray:
        if not len(self.rows):
            return np.zeros((len(row), self.rows.shape[1]), self.rows.dtype)
        out = self.rows[row]
        out[row < 0] = 0
        return out

    def _build(self) -> None:
        keys = self.own
        self.mask = (1 << max(4, int(4 * max(1, len(keys))).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.slot = np.full(self.mask + 1, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._hash(keys)
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot[at[put]] = put
            self.keys[at[put]] = keys[put]
            todo = todo[self.slot[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.slot is None:
            self._build()
        at = self._hash(keys)
        row = self.slot[at].astype(np.int64)
        wrong = np.flatnonzero((row >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            row[wrong] = self.slot[at[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return row


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", max_bytes: int = TRAIN_BYTES, order: int = ORDER, total_bytes: int = TOTAL_BYTES) -> Model:
    """Counts byte strings of 1 to order + 1 bytes per language over a sample of rows with text and language.

    A language with more than max_bytes of text (less where many share total_bytes) is sampled by a hash of key and text
    with probability max_bytes / bytes; the counts are summed by Spark, and what reaches the driver is bounded by that sample. Languages of texts without
    letters, and null languages, teach nothing.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key")).filter("lang is not null and text is not null and lang <> 'und'")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}
    if not sizes:
        return Model([], [])
    names, max_bytes = sorted(sizes), min(max_bytes, total_bytes // len(sizes))
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, max_bytes / max(1, n))))])
    number = F.create_map(*[x for i, g in enumerate(names) for x in (F.lit(g), F.lit(i))])
    pick = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003
    sample = rows.filter(pick).select(number[F.col("lang")].alias("lang"), F.col("text").cast("binary").alias("raw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(1, order + 2):
                    held.setdefault((lang, k), []).append(np.unique(grams(np.frombuffer(raw, np.uint8), k), return_counts=True))
            for key, parts in held.items():
                if len(parts) > 64:
                    held[key] = [_summed(parts)]
        for (lang, k), parts in held.items():
            keys, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, np.int32)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "k", "gram", "n"])

    found = sample.mapInArrow(count, "lang int, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, ks, gram, n = (found.column(c).to_numpy() for c in ("lang", "k", "gram", "n"))
    order_of = np.lexsort((gram, ks, lang))
    lang, ks, gram, n = lang[order_of], ks[order_of], gram[order_of].astype(np.uint64), n[order_of]
    learned = np.unique(lang).tolist()
    counts = []
    for g in learned:
        counts.append([])
        for k in range(1, order + 2):
            a, b = np.searchsorted(lang, [g, g + 1])
            a, b = a + np.searchsorted(ks[a:b], [k, k + 1])
            counts[-1].append((gram[a:b], n[a:b]))
    return Model([names[g] for g in learned], counts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with two more columns: the language with the shortest code and its posterior under equal priors.

    Null texts, texts without any letter, and all texts under a model without languages are 'und' with score 0. Ties go
    to the alphabetically first language. All rows stay, and all columns but those with the name of an output, which give
    way; the whole text is scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    at = docs.columns.index(text_col)
    kept, out = with_outputs(docs, f"`{pred_col}` string, `{score_col}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for begin in range(0, big.num_rows, 64):
                batch = big.slice(begin, 64)
                pred, score = predict(shared.value, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], out.names)

    return docs.mapInArrow(run, out)


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter: those that identify() gives a language under any model that has one."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(t and LETTER.search(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model.languages:
        group, size = [], 0
        for i, t in enumerate(texts):
            if t and LETTER.search(t):
                group.append((i, t.encode()))
                size += len(group[-1][1])
            if group and (size > 1 << 18 or i == len(texts) - 1):
                _predict(model, group, pred, score)
                group, size = [], 0
        if group:
            _predict(model, group, pred, score)
    return pred, score


def _predict(model: Model, group: list[tuple[int, bytes]], pred: list[str], score: list[float]) -> None:
    raw = np.frombuffer(b"".join(b for _, b in group), np.uint8)
    starts = np.cumsum([0, *(len(b) for _, b in group[:-1])])
    bits = model.score(raw, starts)
    best = bits.argmin(1)
    odds = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
    for (i, _), g, p in zip(group, best, odds):
        pred[i], score[i] = model.languages[g], float(p)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 5 is not 0 and predicts all of them."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    model = train(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


