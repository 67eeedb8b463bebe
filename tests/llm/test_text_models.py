"""Operators 1, 2, 3 and 5 against libraries, exact round trips and held-out accuracy."""

import json
import random

import numpy as np
import pytest
from helpers import empty, odd_texts, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import language_id, piece_codec, token_count, toxicity
from codeloom.llm.boosting import Boosted, Isotonic

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ANY = st.text(st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=40)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + [t for _, t in odd_texts()]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.Vocabulary(piece_codec.model_bytes()))


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_pieces_equal_the_library(codec, library, texts):
    for t in texts:
        assert ids(codec.encode(t)) == library.encode(t or "")
        assert codec.decode(ids(codec.encode(t))) == (t or "")


@settings(max_examples=200, deadline=None)
@given(ANY)
def test_pieces_of_any_text(codec, library, t):
    got = ids(codec.encode(t))
    assert got == library.encode(t)
    assert codec.decode(got) == t.replace("▁", " ")


def test_stream_in_small_pushes_equals_one_push(codec, texts):
    rng = random.Random(3)
    for t in texts[:12]:
        whole = piece_codec.SPACE + (t or "x")[:1500].replace(" ", piece_codec.SPACE)
        s, got, i, held = piece_codec.StreamEncoder(codec.v), [], 0, 0
        while i < len(whole):
            n = rng.randint(1, 90)
            got += s.push(whole[i : i + n])
            held = max(held, len(s.chars))
            i += n
        got += s.end()
        assert got == ids(codec.encode((t or "x")[:1500]))
        assert held < 400  # a window, not the text


def test_ordinary_texts_are_committed_where_paths_converge(library, texts):
    """Commits are counted where surviving paths pass one boundary only: one for each word of a text that is pushed, and one
    for each span that the memo does not know."""
    fresh = piece_codec.Codec(piece_codec.Vocabulary(piece_codec.model_bytes()))
    said: list[str] = []
    span = fresh.stream.span
    fresh.stream.span = lambda text, follow: [said.append(text), span(text, follow)][1]
    for t in texts[:40]:
        before, spans = fresh.stream.commits, len(said)
        assert ids(fresh.encode(t)) == library.encode(t or "")
        assert fresh.stream.commits - before >= len(said) - spans
    assert len(said) > 1000 and len(said) == len(fresh.memo) + sum(len(n) > piece_codec.MEMO_CHARS for n in said)
    commits = fresh.stream.commits
    fresh.encode("no" * 4000)
    assert fresh.stream.commits - commits > 50
    for t in texts[:12]:
        s = piece_codec.StreamEncoder(fresh.v)
        whole = piece_codec.SPACE + (t or "").replace(" ", piece_codec.SPACE)
        got = s.push(whole)
        assert s.commits >= len((t or "").split(" ")) - (t or "").count("  ") - 2
        assert len(s.chars) <= 2 * s.look  # what is left is a window
        assert got + s.end() == library.encode(t or "") or not t


def test_boundaries_are_found_and_not_taken_for_granted():
    """With pieces that run over space marks there is no boundary there, and the paths say so."""
    v = piece_codec.Vocabulary.of({"a": -1.0, "b": -1.0, "▁": -1.0, "b▁a": -1.5, "a▁": -1.5, "▁a▁b": -1.0}, bpe=False)
    s = piece_codec.StreamEncoder(v)
    s.extend("▁ab▁")
    assert s.boundary() < 3
    s.extend("b")
    assert s.boundary() == 4
    with pytest.raises(ValueError):
        piece_codec.StreamEncoder(v).span("▁ab", "▁")
    assert not v.cuts


def test_unigram_paths_are_the_best_of_all():
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.2, "aba": -4.9, "▁": -1.0, "▁a": -2.2, "bb": -6.0}
    v = piece_codec.Vocabulary.of(pieces, bpe=False)
    best = {}

    def score(s):
        if s not in best:
            best[s] = 0.0 if not s else max(score(s[: -len(p)]) + w for p, w in [*pieces.items(), (s[-1], v.least)] if s.endswith(p))
        return best[s]

    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 200)))
        e = piece_codec.StreamEncoder(v)
        got = e.push(s) + e.end()
        text = "".join(v.text.get(i) or chr(v.byte_of[i]) for i in got)
        assert text == s
        assert abs(sum(pieces[v.text[i]] if i in v.text else v.least for i in got) - score(s)) < 1e-6


def test_codec_query_handles_odd_rows(spark):
    rows = odd_texts()
    out = piece_codec.encoded(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert piece_codec.encoded(empty(spark)).count() == 0
    docs = table(spark, rows)
    back = piece_codec.decode_ids(piece_codec.encode_texts(docs, piece_codec.model_bytes()), piece_codec.model_bytes(), text_col="again")
    assert all(r.again == (r.text or "") for r in back.collect())


@pytest.fixture(scope="module")
def counting():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    with open(path) as f:
        return token_count.counter(json.load(f)), Tokenizer.from_file(path)


def test_token_counts_equal_the_library(counting, texts):
    count, lib = counting
    more = [*texts, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaa" * 300, "=" * 999, " \n\n x", "'s I'm"]
    assert count(more) == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in more]


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_token_counts_of_any_text(counting, t):
    count, lib = counting
    assert count([t]) == [len(lib.encode(t, add_special_tokens=False).ids)]


def test_token_count_operator(spark):
    rows = odd_texts()
    with open(P.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    got = token_count.token_counts(table(spark, rows), spec, limit=60).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[30].n_bytes, by[30].n_tokens, by[30].over_limit) == (0, 0, False)
    assert by[38].n_bytes == len(("naïve café 漢字 😀 " * 9).encode()) and by[40].over_limit
    assert token_count.token_counts(empty(spark), spec).count() == 0


def brute_code_length(counts, order, raw):
    """Method C code length in bits, byte by byte, without tables."""
    from math import log2

    bits = 0.0
    for i, b in enumerate(raw):
        for k in range(min(i, order), -2, -1):
            if k < 0:
                bits += 8
                break
            ctx = raw[i - k : i]
            own = {s[-1]: n for s, n in counts[k].items() if s[:-1] == ctx}
            n, d = sum(own.values()), len(own)
            if b in own:
                bits -= log2(own[b] / (n + d))
                break
            if n:
                bits += log2((n + d) / d)
    return bits


def test_ppm_scores_are_exact_code_lengths():
    rng = random.Random(2)
    train = {"x": "".join(rng.choice("abcab ") for _ in range(300)), "y": "".join(rng.choice("bcdé ") for _ in range(300))}
    order, counts, plain = 2, [], {}
    for g, t in train.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        counts.append([np.unique(language_id.grams(raw, k), return_counts=True) for k in range(1, order + 2)])
        b = t.encode()
        plain[g] = [{b[i : i + k + 1]: b.count(b[i : i + k + 1]) for i in range(len(b) - k)} for k in range(order + 1)]
        for k in range(order + 1):  # overlapping occurrences
            plain[g][k] = {}
            for i in range(len(b) - k):
                s = b[i : i + k + 1]
                plain[g][k][s] = plain[g][k].get(s, 0) + 1
    model = language_id.Model(["x", "y"], counts)
    texts = [t.encode() for t in ("a", "ab", "abcé d", "zzz ab", "bcd" * 9)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = model.score(raw, np.cumsum([0, *map(len, texts[:-1])]))
    want = [[brute_code_length(plain[g], order, t) for g in ("x", "y")] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_language_query_on_held_out_documents(spark):
    got = language_id.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_operator_on_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs.limit(60))
    rows = odd_texts() + [(90, "123 ... 45"), (91, "²³")]
    out = language_id.identify(table(spark, rows), model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (30, 31, 32, 90, 91)] == ["und"] * 5 and by[38].lang_pred != "und"
    assert language_id.identify(empty(spark), model).count() == 0
    none = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.identify(table(spark, rows), none).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    hit = [r for r in rows if r.predicted == 1]
    assert np.mean([r.toxic for r in hit]) > 0.95
    assert len([r for r in hit if r.toxic]) > 0.85 * len([r for r in rows if r.toxic])
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_odd_rows(spark):
    rows = odd_texts()
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i, _ in rows if i is not None] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, rows), labels)
    out = toxicity.score(table(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty(spark), model).count() == 0
    flat = toxicity.train(empty(spark), labels)
    assert {round(r.score, 6) for r in toxicity.score(table(spark, rows), flat).collect()} == {0.5}


def test_toxicity_lexicon_where_toxic_texts_are_rare(spark):
    """1 % are toxic; zork is in half of them and in 5 % of the others."""
    rng = random.Random(4)
    rows = [(i, f"w{rng.randrange(50)} w{rng.randrange(50)}" + (" zork" if (i // 100) % 2 == 0 and i % 100 == 0 or i % 20 == 1 else "")) for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert "zork" in toxicity.train(table(spark, rows, False), labels).lexicon


def test_features_see_obfuscation_and_address():
    f = dict(zip(toxicity.FEATURES, toxicity.Extractor({"idiot": 3.0, "idio*": 2.0})("You IDIOT!! st0pid sooooo idiotic")))
    assert f["distinct_hits"] == 2 and f["near_second_person"] == 1.0 and f["obfuscated"] > 0 and f["stretched"] > 0 and f["exclaims"] > 0 and f["shouted"] > 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    m = Boosted(trees=60).fit(x[:1000], y[:1000]).margin(x)
    assert ((m[1000:] > 0) == y[1000:]).mean() > 0.93
    curve = Isotonic().fit(m[:1000], y[:1000])
    grid = curve(np.linspace(m.min() - 5, m.max() + 5, 400))
    assert (np.diff(grid) >= 0).all() and 0 <= grid.min() and grid.max() <= 1


def test_training_is_stable(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels.orderBy(F.rand(3)))
    assert a.lexicon == b.lexicon and np.array_equal(a.curve.value, b.curve.value)


def brute_features(text, lexicon):
    """The dense features one character and one word at a time."""
    import math

    text = text or ""
    words = toxicity.WORDS.findall(text.lower())
    odds = [max([lexicon.get(e, 0.0) for e in (w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k))]) for w in words]
    hits = [i for i, o in enumerate(odds) if o]
    raw, n = text.encode(), max(1, len(words))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    letters = max(1, sum(map(letter, raw)))
    three = list(zip(raw, raw[1:], raw[2:]))
    return [
        math.log1p(len(words)), math.log1p(len(hits)), len(hits) / n, max([odds[i] for i in hits], default=0.0), math.log1p(sum(odds[i] for i in hits)), len({words[i] for i in hits}),
        sum(any(words[j] in toxicity.SECOND_PERSON for j in range(len(words)) if abs(i - j) <= 5) for i in hits) / max(1, len(hits)), sum(w in toxicity.SECOND_PERSON for w in words) / n,
        sum(65 <= b <= 90 for b in raw) / letters, sum(all(65 <= b <= 90 for b in t) for t in three) / letters, text.count("!") / n,
        sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / max(1, len(raw)), sum(letter(a) and b in b"0123456789@$*" and letter(c) for a, b, c in three) / n,
        sum(a == b == c and letter(c) for a, b, c in three) / letters,
    ]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["You", "idiot", "IDIOTIC", "st0pid!", "sooo", "a", "ß", "tu", "...", "1a2", "@b", "\n", "ABC", "漢字"]), max_size=25).map(" ".join))
def test_features_match_brute_force(text):
    lexicon = {"idiot": 3.0, "idio*": 2.0, "sooo": 1.7, "st": 1.8, "漢字": 2.5}
    assert np.allclose(toxicity.Extractor(lexicon)(text), brute_features(text, lexicon))


def check_tree(m, tree, x, g, h, edges, node, rows, depth):
    """Every cut of a tree gains as much as the best of all, and leaves hold what their rows give; leaf values by row."""
    total = lambda own: (sum(g[i] for i in own), sum(h[i] for i in own))
    score = lambda s: s[0] ** 2 / (s[1] + m.penalty)

    def split(f, c):
        left, right = [i for i in rows if x[i][f] < c], [i for i in rows if x[i][f] >= c]
        return score(total(left)) + score(total(right)) - score(total(rows)) if min(len(left), len(right)) >= m.least else 0.0, left, right

    if depth == 0:
        s, value = total(rows), tree["leaf"][node - len(tree["feature"])]
        assert not rows or np.isclose(value, -m.rate * s[0] / (s[1] + m.penalty))
        return dict.fromkeys(rows, value)
    best = max((split(f, c)[0] for f, cuts in enumerate(edges) for c in cuts), default=0.0)
    f, left, right = tree["feature"][node], rows, []
    if f >= 0:
        gain, left, right = split(f, tree["cut"][node])
        assert gain >= best - 1e-9
    else:
        assert best < 1e-8
    return check_tree(m, tree, x, g, h, edges, 2 * node + 1, left, depth - 1) | check_tree(m, tree, x, g, h, edges, 2 * node + 2, right, depth - 1)


def test_boosting_matches_brute_force():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(120, 3))
        y = ((x[:, 0] + rng.normal(size=120) > 0.3) ^ (x[:, 1] > 0.5)).astype(int)
        m = Boosted(trees=6, bins=9).fit(x, y)
        margin = np.full(len(y), m.base)
        assert len(m.trees) == 6 and np.isclose(m.base, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        for tree in m.trees:
            p = 1 / (1 + np.exp(-margin))
            leaf = check_tree(m, tree, x.tolist(), (p - y).tolist(), (p * (1 - p)).tolist(), [e.tolist() for e in m.edges], 0, list(range(len(y))), m.depth)
            margin = margin + np.array([leaf[i] for i in range(len(y))])
        assert np.allclose(m.margin(x), margin)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=30))
def test_isotonic_matches_brute_force(labels):
    """The fit is the greatest over beginnings of the least mean over ends; blocks are runs of equal values."""
    y, n = labels, len(labels)
    mean = lambda a, b: sum(y[a : b + 1]) / (b - a + 1)
    raw = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    blocks = [[i for i in range(n) if abs(raw[i] - v) < 1e-12] for v in dict.fromkeys(round(r, 12) for r in raw)]
    blocks = [b or [i for i in range(n) if abs(raw[i] - v) < 1e-9] for b, v in zip(blocks, dict.fromkeys(round(r, 12) for r in raw))]
    curve = Isotonic().fit(np.arange(n, dtype=float), np.array(y))
    assert np.allclose(curve.at, [np.mean(b) for b in blocks])
    assert np.allclose(curve.value, np.maximum.accumulate([(sum(y[i] for i in b) + 0.5) / (len(b) + 1) for b in blocks]))
