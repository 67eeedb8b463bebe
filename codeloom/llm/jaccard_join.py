"""Operator 9: n-gram Jaccard join by T-occurrence search.

The join itself, over all machines, is in similar_sets.py. Here is the search: the rarest (1 - t) * size + 1 shingles of
a set, less its unrepeated ones, must meet a partner's (prefix filter), so these are its tokens; in a task an inverted
index answers a T-occurrence search for each set: with DivideSkip, the short lists are merged and the few long lists
probed by binary search, for candidates that can still reach T.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import read_table
from codeloom.llm.similar_sets import N_WORDS, least_overlap, similar_components

#: The threshold as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 80


class Inverted:
    """Inverted lists over sets: for each key the ascending numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        ranked = every[order]
        head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        self.keys, self.begin = ranked[head], np.r_[head, len(ranked)]

    def search(self, payload: bytes, size: int) -> np.ndarray:
        """Numbers of all sets with percent or more Jaccard similarity to a set of `size` elements that has these keys."""
        keys, percent = np.frombuffer(payload, np.uint64), self.percent
        t = least_overlap(size, percent)
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = at[self.keys[at] == keys]
        lo, hi = self.begin[at], self.begin[at + 1]
        length = hi - lo
        if len(at) < max(t, 1):
            return np.zeros(0, np.int64)
        # DivideSkip: L long lists are only probed; 0.0085 is the published tuning constant.
        longest = int(length.max())
        n_long = min(t - 1, int(t / (0.0085 * math.log2(longest + 1) + 1))) if longest > 8 else 0
        rank = np.argsort(length, kind="stable")
        short, long = rank[: len(rank) - n_long], rank[len(rank) - n_long :]
        take = np.repeat(lo[short], length[short]) + (np.arange(length[short].sum()) - np.repeat(np.cumsum(length[short]) - length[short], length[short]))
        merged = np.sort(self.owner[take])
        head = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(merged)])
        cand = merged[head]
        need = -(-percent * (size + self.sizes) // (100 + percent))
        alive = count >= np.maximum(need[cand] - n_long, 1)
        cand, count = cand[alive], count[alive]
        for done, k in enumerate(long):
            if not len(cand):
                break
            part = self.owner[lo[k] : hi[k]]
            where = np.minimum(np.searchsorted(part, cand), len(part) - 1)
            count = count + (part[where] == cand)
            alive = count >= need[cand] - (n_long - done - 1)
            cand, count = cand[alive], count[alive]
        return cand[100 * count >= percent * (size + self.sizes[cand] - count)]


class TOccurrence:
    """Sets carry their repeated keys; tokens are the rarest of them."""

    def __init__(self, percent: int):
        self.percent = percent

    def carried(self, keys: np.ndarray, repeated: np.ndarray, least: int) -> tuple[bytes, np.ndarray]:
        return repeated.tobytes(), repeated[:least].astype(np.int64)

    def index(self, payloads: list[bytes], sizes: np.ndarray) -> Inverted:
        return Inverted([np.frombuffer(p, np.uint64) for p in payloads], sizes, self.percent)

    def shared(self, one: bytes, n: int, other: bytes, m: int, percent: int) -> int:
        return len(np.intersect1d(np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64), assume_unique=True))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach, itself included); nulls, ties,
    empty texts and repeated ids as similar_components says."""
    return similar_components(docs, TOccurrence(percent), id_col, text_col, n_words)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def oracle(percent: int, more: str = "") -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(len(w), 5)], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, y FROM r JOIN both_ways ON r.b = x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id{more}
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
""".replace("{percent}", str(percent)).replace("{more}", more)


ORACLE = oracle(PERCENT)
