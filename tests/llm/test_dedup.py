"""Operators 7, 8 and 9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import empty, odd_texts, table, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import similar_sets, suffix_dedup as suffix_module
from codeloom.llm.components import components
from codeloom.llm.exact_dedup import exact_dedup, first_copies
from codeloom.llm.jaccard_join import Inverted, TOccurrence, jaccard_components
from codeloom.llm.similar_sets import group_links, least_overlap
from codeloom.llm import suffix
from codeloom.llm.suffix import induced, permuted_lcp
from codeloom.llm.suffix_dedup import suffix_dedup

BIG = 2**62


def order(i):
    return BIG if i is None else i


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted(((i, min(groups[norm(t)], key=order), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_matches_brute_force(spark, clash):
    rows = odd_texts()
    got = exact_dedup(table(spark, rows, clash)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one row of each group, repeated ids included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_survives_a_weak_digest(spark):
    rows = odd_texts(2)
    weak = lambda raw: F.substring(F.sha2(raw, 256), 1, 1)
    got = exact_dedup(table(spark, rows, False), digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)


def test_exact_dedup_of_files_and_of_nothing(spark, tmp_path):
    assert exact_dedup(empty(spark)).count() == 0
    rows = odd_texts(3)
    table(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in rows})
    assert first_copies(empty(spark)).count() == 0


def test_exact_dedup_keeps_state_between_runs(spark, tmp_path):
    from codeloom.llm.exact_dedup import DedupState

    schema = "ord long, file string, `row` long, digest string"
    state, folder = DedupState(spark, str(tmp_path / "state")), str(tmp_path / "in")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    frame([(3, "f", 0, "x"), (4, "f", 1, "y")]).coalesce(1).write.mode("append").parquet(folder)
    state.ingest(folder, frame([]).schema)
    frame([(1, "g", 0, "x"), (9, "g", 1, "z")]).coalesce(1).write.mode("append").parquet(folder)
    state.ingest(folder, frame([]).schema)
    got = {r.digest: (r.keeper.ord, r.n) for r in state.table().collect()}
    assert got == {"x": (1, 2), "y": (4, 1), "z": (9, 1)}


def shingles(t, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) if x]
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_near(rows, percent=80):
    """Rows that share an id are one node."""
    sets = [(order(i), shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if root(order(i)) == BIG else root(order(i))) for (i, _), (_, s) in zip(rows, sets)), key=str)


def near_rows(seed):
    rng = random.Random(seed)
    rows = odd_texts(seed)
    base = words(rng, 80).split()
    for i in range(60, 100):  # a chain and a cloud of near copies, around the threshold
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    rows = near_rows(seed)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == brute_near(rows)


def test_jaccard_large_components_go_through_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "CLUSTER", 6)
    rows = near_rows(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows, False)).collect()), key=str)
    assert got == brute_near(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard_components(empty(spark)).count() == 0
    got = jaccard_components(table(spark, [(1, None), (2, ""), (3, " ")], False)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def connected(n, links):
    """The smallest number of its component for each of n."""
    at = list(range(n))
    for _ in range(n):
        for i, j in links:
            at[i] = at[j] = min(at[i], at[j])
    return at


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=1, max_size=24), st.sampled_from([50, 80, 100]))
def test_t_occurrence_search_finds_all_partners(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    index = Inverted(arrays, sizes, percent)
    for s, a in zip(sets, arrays):
        want = [j for j, u in enumerate(sets) if 100 * len(s & u) >= percent * len(s | u)]
        assert sorted(index.search(a.tobytes(), len(s)).tolist()) == want
    other = Inverted(arrays[::2], sizes[::2], percent)  # queries need not be in the index
    for s, a in zip(sets, arrays):
        assert sorted(other.search(a.tobytes(), len(s)).tolist()) == [j for j, u in enumerate(sets[::2]) if 100 * len(s & u) >= percent * len(s | u)]
    links = group_links([a.tobytes() for a in arrays], sizes, TOccurrence(percent))
    assert all(100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for i, j in links)
    assert connected(len(sets), links) == connected(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])
    assert least_overlap(10, 80) == 8


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2050)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}


def brute_spans(rows, k=50):
    texts = [(order(i), (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for p in range(len(b) - k + 1):
            w = b[p : p + k]
            least[w] = min(least.get(w, BIG), i)
    out = []
    for (raw, _), (i, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if least[b[p : p + k]] < i:
                gone[p : p + k] = b"\1" * k
        runs = len([m for m in re.finditer(rb"\x01+", bytes(gone))])
        out.append((raw, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = odd_texts(seed)
    passage = words(rng, 30)
    rows += [(50 + i, f"{words(rng, rng.randint(0, 30))} {passage[: rng.randint(40, 200)]}{words(rng, rng.randint(0, 20))}") for i in range(20)]
    got = suffix_dedup(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_spans(rows)


@pytest.mark.parametrize("same", [True, False])
def test_suffix_dedup_bounds_the_shard_of_a_hot_passage(spark, monkeypatch, same):
    """A passage in every row, or in every second row with its own words in the middle; null and repeated ids."""
    monkeypatch.setattr(suffix_module, "HOT", 100, raising=False)
    rng = random.Random(9)
    passage = words(rng, 16)
    rows = [(i, f"{words(rng, 8, 10**6)} {passage if same or i % 2 else passage[:62] + words(rng, 3) + passage[60:]} {words(rng, 8, 10**6)}") for i in range(400)]
    rows += [(None, rows[3][1] + "x"), (7, rows[9][1] + "y"), (7, passage), (500, "q" * 900), (501, "p" + "q" * 700)]
    inner = suffix_module._shard

    def bounded(table, length):
        places = sum(len(x) for x in table.column("firsts").to_pylist()) // 8
        assert places <= 350, f"{places} places in one shard"
        return inner(table, length)

    monkeypatch.setattr(suffix_module, "_shard", bounded)
    got = suffix_dedup(table(spark, rows, False).repartition(9)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_spans(rows)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup(empty(spark)).count() == 0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_arrays(symbols):
    text = [*symbols, 0]
    want = sorted(range(len(text)), key=lambda i: text[i:])
    for bucket in (0, 10**9):  # symbol by symbol, and all symbols at once, at every depth
        suffix.BUCKET, kept = bucket, suffix.BUCKET
        try:
            assert induced(np.array(text, np.uint16), 5).tolist() == want
        finally:
            suffix.BUCKET = kept
    plcp = permuted_lcp(np.array(text), np.array(want), stop=1)
    for a, b in zip(want, want[1:]):
        n = 0
        while b + n < len(text) and a + n < len(text) and text[a + n] == text[b + n] != 1:
            n += 1
        assert plcp[b] == n


def test_two_stars_give_few_links(spark, monkeypatch):
    """Two clouds of near copies around texts that differ in a quarter: links grow with the sets, not with their pairs."""
    monkeypatch.setattr(similar_sets, "CLUSTER", 100)
    rng = random.Random(11)
    base = words(rng, 160, 10**6).split()
    other = [*base[:125], *words(rng, 35, 10**6).split()]
    rows = []
    for k, text in enumerate((base, other)):
        for i in range(600):
            t = list(text)
            t[rng.randrange(10, 150)] = f"e{rng.randrange(10**6)}"
            rows.append((k * 1000 + i, " ".join(t)))
    made = []
    inner = similar_sets._links

    def counted(*args):
        links = inner(*args).cache()
        made.append(links.count())
        return links

    monkeypatch.setattr(similar_sets, "_links", counted)
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows, False)).collect()}
    assert got == {i: 0 if i < 1000 else 1000 for i, _ in rows}
    assert made[0] <= 3 * len(rows)
