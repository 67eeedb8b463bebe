"""Operator 11 against a brute-force version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import empty, table

from codeloom.llm import divergence
from codeloom.llm.divergence import shares, source_divergence


def brute(rows, min_docs=10):
    """rows: (lang, source, text)."""
    counts, in_docs, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        groups[lang].add(source)
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            in_docs[lang, t] += 1
    out = set()
    byte = lambda s: s.encode()
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), n in in_docs.items() if g == lang and n >= min_docs)
        v = len(kept)
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s, t] + 2) // (n[s] + 2 * v) for t in kept} for s in sources}
        every = sum(n.values())
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 2) // (every + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}), key=lambda x: (-x[0], byte(x[1])))
            out |= {(lang, s, "pair", o, value, i) for i, (value, o) in enumerate(pairs, 1)}
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]), key=lambda x: (-x[0], byte(x[1])))
            out |= {(lang, s, "term", t, value, i) for i, (value, t) in enumerate(terms[:10], 1)}
    return out


def sample(seed=3, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Straße", "été", "漢字", "naïve", "Zebra"]) if rng.random() < 0.1 else f"{'abcdefghij'[rng.randrange(10)]}{'klmno'[rng.randrange(5)]}"
    langs, sources = ["en", "de", None, "", "xx"], [f"s{i}" for i in range(7)] + [None, "", "ünder"]
    rows = [(rng.choice(langs), rng.choice(sources), rng.choice([" ", "1", "_", "\n", "é"]).join(word() for _ in range(rng.randrange(12)))) for _ in range(n)]
    rows += [("few", "a", "one two"), ("few", "b", None), ("one", "only", "x " * 50), (None, None, None), ("en", "blank", "12 ' 3"), ("en", "s0", "x" * 30_000 + " ak" * 20_000)]
    return rows + rows[:30]


def as_rows(spark, rows):
    made = table(spark, [(i, r[2]) for i, r in enumerate(rows)]).drop("lang", "source")
    return made.join(spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "doc_id long, lang string, source string"), "doc_id")


def results(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark):
    rows = sample()
    assert results(source_divergence(as_rows(spark, rows))) == brute(rows)


@pytest.mark.parametrize("terms, groups, entries, cells", [(3, 2, 10, 7), (5, 3, 1, 1)])
def test_blocks_chunks_and_flushes(spark, monkeypatch, terms, groups, entries, cells):
    for name, value in {"TERMS": terms, "GROUPS": groups, "ENTRIES": entries, "CELLS": cells}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = sample(5)
    assert results(source_divergence(as_rows(spark, rows), min_docs=4)) == brute(rows, 4)


def test_no_kept_terms_and_no_rows(spark):
    assert source_divergence(empty(spark)).count() == 0
    rows = [("en", "b", "x"), ("en", "a", ""), ("en", "c", None), ("fr", "a", "x")]
    got = results(source_divergence(as_rows(spark, rows)))
    assert got == brute(rows) and {r[4] for r in got} == {0} and len(got) == 6


def test_shares_of_large_counts():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        total, v = rng.randrange(1, 9 * 10**15), rng.randrange(1, 10**6)
        count = rng.randrange(total + 1)
        assert shares(np.array([count]), np.array([total]), v)[0] == 1 + 10**9 * (count + 2) // (total + 2 * v)
    with pytest.raises(OverflowError):
        shares(np.array([1]), np.array([10**16]), 1)
