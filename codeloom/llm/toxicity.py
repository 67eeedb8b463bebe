"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows are dealt to folds by a hash of their id. A lexicon of words and word beginnings is learned by their odds
between the labels, once without each fold and once from all; a row's dense features come from the lexicon without its
fold. Trees fitted without a fold give that fold's margins, on which the calibration is fitted; the trees in use are
fitted on all rows. The model then scores every whole text from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.boosting import Boosted, Isotonic
from codeloom.llm.common import crc_of_id, read_table, with_outputs

#: Labelled rows that training uses at most, on average of the hash sample.
MAX_ROWS = 16_000
#: Entries of the learned lexicon at most, those with the best odds; and documents that an entry must occur in at least.
MAX_LEXICON, MIN_DOCS = 20_000, 3
MIN_ODDS = 1.6
FOLDS = 5
BEGINNINGS = (4, 5, 6)
NEAR = 5
MEMO = 400_000
#: Words that address the reader; fixed value.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tú tus usted ustedes vosotros os".split())
WORDS = regex.compile(r"[^\W\d_]+")
FEATURES = ("log_words", "hits", "hit_density", "best_odds", "sum_odds", "distinct_hits", "near_second_person", "second_person", "capitals", "shouted", "exclaims", "punctuation", "obfuscated", "stretched")

_LETTER, _ODD = 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
CLASSES[[*b"0123456789@$*"]] = _ODD
PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def entries(word: str) -> list[str]:
    """What a word can be in the lexicon as: itself, and its beginnings marked with an asterisk."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Extractor:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo = {}
            found = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
            self.memo[word] = found
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORDS.findall(text.lower())
        memo = self.memo
        odds = [memo[w] if w in memo else self.weight(w) for w in words]
        at = [i for i, o in enumerate(odds) if o]
        n = max(1, len(words))
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        second = sum(w in SECOND_PERSON for w in words)
        raw = np.frombuffer(text.encode(), np.uint8)
        count = np.bincount(raw, minlength=256)
        kinds = CLASSES[raw]
        letters = max(1, int(count[CLASSES == _LETTER].sum()))
        upper = (raw >= 65) & (raw < 91)
        mixed = int(((kinds[:-2] == _LETTER) & (kinds[1:-1] == _ODD) & (kinds[2:] == _LETTER)).sum()) if len(raw) > 2 else 0
        long = int(((raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & (kinds[2:] == _LETTER)).sum()) if len(raw) > 2 else 0
        shout = int((upper[:-2] & upper[1:-1] & upper[2:]).sum()) if len(raw) > 2 else 0
        return [
            float(np.log1p(len(words))), float(np.log1p(len(at))), len(at) / n, max((odds[i] for i in at), default=0.0), float(np.log1p(sum(odds[i] for i in at))),
            float(len({words[i] for i in at})), near / max(1, len(at)), second / n, int(upper.sum()) / letters, shout / letters,
            int(count[33]) / n, int(count[PUNCTUATION].sum()) / max(1, len(raw)), mixed / n, long / letters,
        ]


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Boosted, curve: Isotonic):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.curve(self.trees.margin(features)), 0.0, 1.0)


def _lexicon(counts: list[tuple[str, int, int, int]], totals: dict[tuple[int, int], int], without: int) -> dict[str, float]:
    """Entries by their odds between the labels, from all folds but one."""
    size = [sum(n for (label, fold), n in totals.items() if label == y and fold != without) for y in (0, 1)]
    sums: dict[str, list[int]] = {}
    for entry, fold, yes, n in counts:
        if fold != without:
            own = sums.setdefault(entry, [0, 0])
            own[0] += yes
            own[1] += n - yes
    odds = {e: float(np.log((yes + 0.5) / (size[1] + 1)) - np.log((no + 0.5) / (size[0] + 1))) for e, (yes, no) in sums.items() if yes >= MIN_DOCS}
    best = sorted((e for e, o in odds.items() if o > MIN_ODDS), key=lambda e: (-odds[e], e))
    return {e: odds[e] for e in best[:MAX_LEXICON]}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fits the model on documents with a label of 0 or 1. Null labels and ids teach nothing; of contradicting labels of
    one id the larger counts. Only a hash sample of at most about max_rows labels is used, which bounds all that reaches
    the driver. Without both labels every text scores 0.5."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n = own.count()
    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003))
    sample = own.filter(h < min(1.0, max_rows / max(1, n)) * 1_000_003)
    fold = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select("label", fold.alias("fold"), "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                seen = list({e for w in set(WORDS.findall((text or "").lower())) for e in entries(w)})
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(seen), pa.int32()), pa.array([fold] * len(seen), pa.int32()), pa.array(seen, pa.string())], ["label", "fold", "entry"])

    totals = {(r[0], r[1]): r[2] for r in rows.groupBy("label", "fold").agg(F.count(F.lit(1))).collect()}
    if {label for label, _ in totals} != {0, 1}:
        return Model({}, Boosted().fit(np.zeros((0, len(FEATURES))), np.zeros(0)), Isotonic().fit(np.zeros(0), np.zeros(0)))
    by_fold = rows.mapInArrow(words, "label int, fold int, entry string").groupBy("entry", "fold").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    # Entries that reach MIN_DOCS and MIN_ODDS with some fold left out, or none; at most max_rows texts' words. The bound is
    # that of _lexicon, lowered by a hair for rounding.
    def reaches(without: int) -> Column:
        toxic, clean = (sum(n for (label, fold), n in totals.items() if label == y and fold != without) for y in (1, 0))
        left = F.col("fold") != without
        y, z = F.sum(F.when(left, F.col("yes")).otherwise(0)), F.sum(F.when(left, F.col("n") - F.col("yes")).otherwise(0))
        return (y >= MIN_DOCS) & ((y + 0.5) / (toxic + 1) > (z + 0.5) / (clean + 1) * float(np.exp(MIN_ODDS - 1e-6)))

    some = reduce(or_, [reaches(k) for k in (*range(FOLDS), -1)])
    may = by_fold.groupBy("entry").agg(some.alias("some"), F.collect_list(F.struct("fold", "yes", "n")).alias("f"))
    counts = [(r[0], f[0], f[1], f[2]) for r in may.filter("some").select("entry", "f").toLocalIterator() for f in r[1]]
    lexicons = [_lexicon(counts, totals, k) for k in (*range(FOLDS), -1)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)  # at most FOLDS + 1 times MAX_LEXICON entries

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = [Extractor(x) for x in shared.value]
        for b in batches:
            x = pa.array([extract[k](t) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["label", "fold", "x"])

    # Each row's features come from a lexicon that has not met it.
    data = rows.mapInArrow(features, "label int, fold int, x array<double>").toArrow()  # bounded by max_rows
    x = np.array(data["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y, fold = data["label"].to_numpy(), data["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same order of rows in every run
    x, y, fold = x[order], y[order], fold[order]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicons[-1], Boosted().fit(x, y), Isotonic().fit(margin, y))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, the calibrated probability of the label. Null and empty texts get the score of an empty
    text; all rows stay, and all columns but one with the name of the score, which gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LEXICON and the number of trees
    at = docs.columns.index(text_col)
    kept, out = with_outputs(docs, f"`{score_col}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        extract = Extractor(model.lexicon)
        for big in batches:
            for begin in range(0, big.num_rows, 512):
                b = big.slice(begin, 512)
                x = np.array([extract(t) for t in b.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(model.scores(x), pa.float64())], out.names)

    return docs.mapInArrow(run, out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of documents whose crc32(doc_id) mod 3 is not 1 and scores all documents."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.pmod(crc_of_id(F.col(c)), F.lit(3)) == 1, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = train(docs, labels)
    scored = score(docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
