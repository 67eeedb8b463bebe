"""Operator 13: MinHash near-deduplication with sequential Bayesian verification.

The join itself, over all machines, is in similar_sets.py; here is the search. A set's signature holds the least value of
BANDS * ROWS hash functions over its shingles. Two sets are candidates if a band of ROWS values is equal; the bands' hashes
are the tokens that bring sets together. A candidate's signature is compared with the query's in batches. After each, with m
of n values equal and every similarity equally likely beforehand, the similarity is Beta(m + 1, n - m + 1) distributed;
a candidate goes once the probability that it reaches the threshold falls below MISS. Survivors are compared on their
whole sets, so a link is never a guess, and similar_sets.py holds the links against the words once more.

Two sets at the threshold of 0.85 share no band with probability (1 - 0.85^6)^48 = 1.3e-10, and are pruned by a batch with
probability below 1e-9; both fall quickly above the threshold.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import mix, read_table
from codeloom.llm.jaccard_join import oracle
from codeloom.llm.similar_sets import N_WORDS, similar_components

#: The threshold as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 48, 6
#: Values of a signature that a batch compares.
BATCH = 32
#: The chosen probability that a pruned candidate reaches the threshold.
MISS = 1e-9
#: Products of one step of hashing.
CELLS = 1_000_000


@cache
def multipliers(size: int) -> np.ndarray:
    """Odd numbers of the hash functions."""
    return mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)


def signature(keys: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """uint32 MinHash values of a set of random 64-bit keys."""
    by = multipliers(size)[:, None]
    step = max(1, CELLS // size)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), step):
        np.minimum(least, (by * keys[None, at : at + step]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature (a row), different bands apart."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return out


@cache
def enough(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the fewest equal values so far with which the probability that the similarity reaches percent, a tail
    of a Beta distribution and so of a binomial one, is at least miss."""
    t, out = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


class Signatures:
    """Sets with their signatures, found by bands."""

    def __init__(self, payloads: list[bytes], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        self.signatures = np.array([split(p)[0] for p in payloads], np.uint32).reshape(len(payloads), BANDS * ROWS)
        self.keys = [split(p)[1] for p in payloads]
        flat = band_hashes(self.signatures).ravel()
        order = np.argsort(flat, kind="stable")
        self.bands, self.owner = flat[order], order // BANDS

    def search(self, payload: bytes, size: int) -> np.ndarray:
        """Numbers of the sets that link with this one, ascending."""
        own, keys = split(payload)
        bands = band_hashes(own[None, :])[0]
        lo, hi = np.searchsorted(self.bands, bands, "left"), np.searchsorted(self.bands, bands, "right")
        cand = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo.tolist(), hi.tolist())]))
        small, large = np.minimum(size, self.sizes[cand]), np.maximum(size, self.sizes[cand])
        cand = cand[100 * small >= self.percent * large]
        equal = np.zeros(len(cand), np.int64)
        for k, least in enumerate(enough(self.percent)):
            at = slice(k * BATCH, (k + 1) * BATCH)
            equal += (self.signatures[cand, at] == own[at]).sum(axis=1)
            alive = equal >= least
            cand, equal = cand[alive], equal[alive]
        shared = np.array([len(np.intersect1d(keys, self.keys[c], assume_unique=True)) for c in cand.tolist()], np.int64)
        return cand[100 * shared >= self.percent * (size + self.sizes[cand] - shared)]


def split(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signature and keys of a set."""
    return np.frombuffer(payload, np.uint32, BANDS * ROWS), np.frombuffer(payload, np.uint64, offset=4 * BANDS * ROWS)


class SequentialBayes:
    """Sets carry their signature and their repeated keys, as no others can be shared; tokens are hashes of the bands."""

    def __init__(self, percent: int):
        self.percent = percent

    def carried(self, keys: np.ndarray, repeated: np.ndarray, least: int) -> tuple[bytes, np.ndarray]:
        own = signature(keys)
        return own.tobytes() + repeated.tobytes(), band_hashes(own[None, :])[0].astype(np.int64)

    def index(self, payloads: list[bytes], sizes: np.ndarray) -> Signatures:
        return Signatures(payloads, sizes, self.percent)

    def shared(self, one: bytes, n: int, other: bytes, m: int, percent: int) -> int:
        (a, x), (b, y) = split(one), split(other)
        equal = np.add.reduceat((a == b).astype(np.int64), np.arange(0, BANDS * ROWS, BATCH)).cumsum()
        if (equal < np.array(enough(percent))).any():
            return 0
        return len(np.intersect1d(x, y, assume_unique=True))


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach, itself included), kept (id and
    component_id are equal; null ids are kept if they are alone in their component). Nulls, ties, empty texts and repeated
    ids as similar_components says: rows that share an id share what is kept."""
    found = similar_components(docs, SequentialBayes(percent), id_col, text_col, n_words)
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read_table(spark, sf_dir, "documents"))


ORACLE = oracle(PERCENT, ", d.doc_id = m.c AS kept")
