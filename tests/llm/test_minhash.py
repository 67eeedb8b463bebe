"""Operator 13 against brute force, its parts, and joins whose digests collide."""

import math
import random
import uuid

import numpy as np
import pytest
from helpers import empty, table
from test_dedup import brute_near, near_rows

from codeloom.llm import similar_sets, wordhash
from codeloom.llm.jaccard_join import TOccurrence
from codeloom.llm.minhash import BANDS, BATCH, MISS, ROWS, SequentialBayes, Signatures, band_hashes, enough, minhash_components, signature
from codeloom.llm.similar_sets import false_pairs


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, cluster", [(1, 3000), (2, 6)])
def test_minhash_equals_brute_force(spark, monkeypatch, seed, cluster):
    monkeypatch.setattr(similar_sets, "CLUSTER", cluster)
    rows = near_rows(seed)
    got = minhash_components(table(spark, rows))
    assert rows_of(got) == brute_near(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_minhash_of_nothing(spark):
    assert minhash_components(empty(spark)).count() == 0
    got = minhash_components(table(spark, [(1, None), (2, ""), (3, " \n"), (None, None)], False)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [("1", 0, "1", True), ("2", 0, "2", True), ("3", 0, "3", True), ("None", 0, "None", True)]


def near_sets(rng, n, k):
    base = rng.integers(0, 2**63, n).astype(np.uint64)
    other = rng.integers(0, 2**63, n).astype(np.uint64)
    return base, np.r_[base[k:], other[:k]]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, k in ((400, 20), (400, 100), (50, 10), (3000, 900)):
        a, b = near_sets(rng, n, k)
        true, seen = (n - k) / (n + k), (signature(a) == signature(b)).mean()
        assert abs(true - seen) < 5 * math.sqrt(true * (1 - true) / (BANDS * ROWS))
    assert (signature(a) == signature(a[::-1])).all()


def test_bounds_are_those_of_the_posterior():
    """m equal values of n are kept exactly if the Beta(m + 1, n - m + 1) tail above the threshold is at least MISS."""
    t = 0.85
    for k, least in enumerate(enough(85)):
        n = (k + 1) * BATCH
        x = (np.arange(200_000) + 0.5) / 200_000
        for m in (least - 1, least):
            if m >= 0:
                density = np.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * np.log(x) + (n - m) * np.log1p(-x))
                assert (density[x >= t].sum() / 200_000 >= MISS) == (m == least)


@pytest.mark.parametrize("percent", [85, 70])
def test_search_finds_partners_and_no_others(percent):
    rng = np.random.default_rng(percent)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for _ in range(150):
        own = base.copy()
        at = rng.choice(300, rng.integers(0, 60), replace=False)
        own[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
        sets.append(np.sort(own))
    how = SequentialBayes(percent)
    payloads = [how.carried(s, s, 0)[0] for s in sets]
    index = how.index(payloads, np.full(150, 300))
    assert isinstance(index, Signatures)
    for i in range(0, 150, 7):
        shared = np.array([len(np.intersect1d(sets[i], s)) for s in sets])
        want = np.flatnonzero(100 * shared >= percent * (600 - shared)).tolist()
        got = index.search(payloads[i], 300).tolist()
        assert set(got) <= set(want)
        assert percent < 80 or got == want  # bands are made for 85 percent
    bands = band_hashes(np.array([signature(s) for s in sets]))
    assert len(np.unique(bands[0])) == BANDS


def pairs_of(seed, n=12):
    rng = random.Random(seed)
    return [(f"l{rng.randrange(10**9)}", f"r{rng.randrange(10**9)}") for _ in range(n)]


#: Words of 16 bytes whose digests an earlier, unkeyed mixing function could not tell apart in one half.
ONCE_BUILT = ("4n6l1b4pm9ah6ofl", "bhsjcqop38[1`mi1")


@pytest.mark.parametrize("how", [TOccurrence(80), SequentialBayes(85)])
@pytest.mark.parametrize("half", [0, 1])
def test_joins_survive_digests_that_collide(spark, how, half):
    """Under the first key each word of one text has the same half of its digest as a word of another text."""
    pairs = pairs_of(half) + [ONCE_BUILT]
    one, two = (" ".join(p[i] for p in pairs) for i in (0, 1))
    again = " ".join([*(p[0] for p in pairs[:5]), "then", *(p[1] for p in pairs[:5])])
    rows = [(1, one), (2, two), (3, one + " x"), (4, two + " x"), (5, again), (6, one)]
    tried, same = [], {b.encode(): a.encode() for a, b in pairs}

    def digests(key):
        weak = key == tried[0]

        class Digests(wordhash.WordDigests):
            def halves(self, found):
                made = super().halves(found)
                if weak:
                    made[half][:] = wordhash.WordDigests(key).halves([same.get(w, w) for w in found])[half]
                return made

        return Digests(key)

    real = uuid.uuid4

    def keys():
        tried.append(real().bytes)
        return uuid.UUID(bytes=tried[-1])

    for rounds, some in ((2, rows), (1 + (half == 0), rows[:1] + rows[4:5])):  # links that do not hold; shingles of one text
        tried.clear()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(similar_sets, "new_key", lambda: keys().bytes)
            assert rows_of(similar_sets.similar_components(table(spark, some, False), how, digests=digests)) == brute_near(some, how.percent)
        assert len(tried) == (rounds if half == 0 else 1)


def test_links_are_held_against_words():
    a = " ".join(f"w{i}" for i in range(40)).encode()
    b = a + b" more"
    c = b"A B\tc D\ne f"
    pairs = [(a, b), (a, a.upper()), (a, c), (b"x", b"X "), (b"x", b"y"), (b"", b""), (c, b"a b c d e f")]
    assert list(false_pairs(iter(pairs), 5, 80)) == [False, False, True, False, True, True, False]
