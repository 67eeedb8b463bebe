"""Relational, text and metric operators on small tables (A, T, W, U, P, M)."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions.similarity import python_parses, sequence_ratio, unified_diff
from codeloom.functions.text import balanced, camel_words, glob_regex, ignored, is_ignored, module_key, service_of, url_path
from codeloom.operators import metrics, relational, traverse
from codeloom.operators import text as T
from codeloom.operators.dense import dense_pairs
from codeloom.sources.repo import DEFAULT_IGNORES


def values(spark, items, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i long, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    assert values(spark, ["a/b.py", "a/__init__.py", "src/index.ts", "./x.js", "top.tsx", "a.b/c.py"], module_key) == ["a.b", "a", "src", "x", "top", "a.b.c"]
    assert values(spark, ["services/cart/x.py", "repo/src/web/a.ts", "top/x.py", "x.py", "", "microservices/pay/a"], service_of) == ["cart", "web", "top", "x.py", "", "pay"]
    assert values(spark, ["http://h/p?q", "https://h", "/p"], url_path) == ["/p?q", "", "/p"]
    assert values(spark, ["getUserName", "HTTPServer", "x"], camel_words)[0] == ["get", "User", "Name"]
    assert values(spark, ["f() { }", "f( {"], balanced) == [True, False]


@pytest.mark.parametrize("path", ["a/b_pb2.py", "vendor", "vendor/x/y.go", "src/vendor/z.go", "genproto/a.go", "a/node_modules/b.js", "ok.py", "dist/x.js", "distx/y.js", "x.pb.go", "deep/build/z.ts", "a[1].py"])
def test_ignore_policy(spark, path):
    patterns = [*DEFAULT_IGNORES, "a[[]1].py", "tmp?.py", "[!a]x.py"]
    assert values(spark, [path], lambda c: ignored(c, patterns)) == [is_ignored(path, patterns)]


def test_glob():
    assert glob_regex("*.py") == r"(?s)^.*\.py$" and "[^a]" in glob_regex("[!a]")


def test_similarity(spark):
    df = spark.createDataFrame([("GetQuote", "GetQuotes"), ("abcd", "bcde"), ("", "x"), (None, None)], "a string, b string")
    got = [r.s for r in df.select(sequence_ratio("a", "b").alias("s")).collect()]
    assert got[0] == max(0.85, difflib.SequenceMatcher(None, "getquote", "getquotes").ratio()) and got[1] == 0.75 and got[2] == 0.0
    d = spark.createDataFrame([("p.py", "a\nb\n", "a\nc\n")], "p string, o string, n string").select(unified_diff("p", "o", "n").alias("d")).first().d
    assert d == "".join(difflib.unified_diff(["a\n", "b\n"], ["a\n", "c\n"], "a/p.py", "b/p.py"))
    assert values(spark, ["x = 1", "def f(:", None], python_parses) == [True, False, True]


def brute_tfidf(docs):
    df, n = {}, len(docs)
    for toks in docs.values():
        for t in set(toks):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    out = {}
    for i, toks in docs.items():
        w = {t: toks.count(t) * idf[t] for t in set(toks)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / norm for t, x in w.items()}
    return out, idf


def test_tfidf_bm25_and_pairs(spark):
    rng = random.Random(1)
    docs = {i: [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(2, 9))] for i in range(30)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "id long, text string")
    posts = T.postings(df, T.terms(F.col("text")))
    vocab = T.vocabulary(posts, 30)
    w = T.weights(posts, vocab)
    want, idf = brute_tfidf(docs)
    got = {(r.id, r.term): r.w for r in w.collect()}
    assert got.keys() == {(i, t) for i, ws in want.items() for t in ws} and all(abs(got[i, t] - want[i][t]) < 1e-9 for i, t in got)
    query = ["aa", "bb", "bb", "zz"]
    qw = {t: query.count(t) * idf[t] for t in set(query) if t in idf}
    norm = math.sqrt(sum(x * x for x in qw.values()))
    cos = {r.id: r.score for r in T.cosine(w, vocab, T.query_terms(spark, query)).collect()}
    for i in docs:
        assert abs(cos.get(i, 0) - sum(qw[t] * want[i].get(t, 0) for t in qw) / norm) < 1e-9
    pairs = {(r.a, r.b) for r in T.similar_pairs(w, 0.6).collect()}
    assert pairs == {(i, j) for i in docs for j in docs if i < j and sum(x * want[j].get(t, 0) for t, x in want[i].items()) >= 0.6}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df_ = {t: sum(t in d for d in docs.values()) for t in idf}
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df_.items()}
    mean = sum(raw.values()) / len(raw)
    bm = {r.id: r.score for r in T.bm25(posts, T.query_terms(spark, query)).collect()}
    for i, toks in docs.items():
        s = sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * toks.count(t) * 2.5 / (toks.count(t) + 1.5 * (0.25 + 0.75 * len(toks) / avg)) for t in query if t in raw)
        assert abs(bm.get(i, 0) - s) < 1e-9
    assert T.vocabulary(posts, 30, max_features=3).count() == 3


def test_ngrams_band_chunks_softmax(spark):
    one = spark.createDataFrame([(1, "Aa bb the cc")], "id long, text string")
    assert one.select(T.terms(F.col("text"), ["the"], 2).alias("t")).first().t == ["aa", "bb", "cc", "aa bb", "bb cc"]
    rows = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "ord long")
    got = {(r.l.ord, r.r.ord) for r in T.band_pairs(rows, 10).collect()}
    assert got == {(a, b) for a in range(0, 200, 3) for b in range(0, 200, 3) if 0 < b - a < 10}
    docs = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, "x"), (3, "")], "id long, text string")
    parts = {(r.id, r.start): len(r.tokens) for r in T.chunks(docs, F.col("text")).collect()}
    assert parts == {(1, 0): 512, (1, 448): 512, (1, 896): 104, (2, 0): 1}
    s = T.softmax(spark.createDataFrame([("g", 0.1), ("g", 0.5), ("h", 9.0)], "g string, s double"), "s", ["g"]).collect()
    assert abs(sum(r.confidence for r in s if r.g == "g") - 1) < 1e-3 and [r.confidence for r in s if r.g == "h"] == [1.0]


def test_dense_pairs(spark):
    rng = random.Random(2)
    vs = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(90)}
    df = spark.createDataFrame(list(vs.items()), "id long, v array<double>")
    got = {(r.a, r.b) for r in dense_pairs(df, "id", "v", 3.0, block=16).collect()}
    assert got == {(i, j) for i in vs for j in vs if i < j and sum(x * y for x, y in zip(vs[i], vs[j])) >= 3.0}


def test_relational(spark):
    assert {r.layer: r.n for r in relational.layer_histogram(spark.createDataFrame([("Ldep",), (None,)], "layer string"), "Lsyn").collect()} == {"Lsyn": 1, "Ldep": 1, "Lflow": 0, "Lsem": 0, "Lcontract": 0}
    a, b = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string")
    assert sorted((r.id, r.v) for r in relational.first_wins([a, b]).collect()) == [(1, "a"), (2, "c")]
    c = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("x", 3, 1)], "k string, v long, p long")
    assert sorted(r.v for r in relational.first_rule(c, ["k"], "p").collect()) == [2, 3]
    assert relational.best(c.withColumn("s", F.col("v") * 1.0), ["k"], "s", ["v"]).first().v == 3
    assert sorted(r.c for r in relational.max_normal(spark.createDataFrame([(1.0,), (4.0,)], "c double"), "c").collect()) == [0.25, 1.0]


def brute_bfs(edges, root, depth):
    dist, at = {root: 0}, [root]
    for d in range(1, depth + 1):
        at = [b for a in at for x, b in edges if x == a and b not in dist and not dist.update({b: d})]
    return dist


def test_traversal(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(60)]
    edges = spark.createDataFrame([(a, b, "CALLS", "Ldep") for a, b in pairs], "src string, dst string, relation string, layer string")
    start = traverse.roots(spark, "n1")
    for way, moves in (("out", pairs), ("in", [(b, a) for a, b in pairs]), ("both", pairs + [(b, a) for a, b in pairs])):
        want = brute_bfs(moves, "n1", 3)
        assert {r.id: r.dist for r in traverse.bfs(traverse.steps(edges, way), start, 3).collect()} == want
        rows = traverse.adjacency(edges, start, None, way, 3).collect()
        assert len(rows) == sum(1 for a, _ in moves for n, d in want.items() if n == a and d < 3)
    closure = {(r.src, r.dst) for r in traverse.closure(edges).collect()}
    full = {n: brute_bfs(pairs, n, 99) for n in {x for p in pairs for x in p}}
    assert closure == {(a, b) for a in full for b in full for _ in [0] if any(b == y or b in full[y] for x, y in pairs if x == a)}
    assert {r.id for r in traverse.reachable(edges, start).collect()} == set(full.get("n1", {"n1": 0}))
    nodes = spark.createDataFrame([(f"n{i}", "function") for i in range(27)], "id string, type string")
    assert {r.id for r in traverse.isolates(nodes, edges).collect()} == {f"n{i}" for i in range(27)} - {x for p in pairs for x in p}
    assert traverse.adjacency(edges, traverse.roots(spark, "none")).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1)], "query string, id string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("r", "c"), ("s", "d")], "query string, id string")
    m = metrics.ranked_retrieval(hits, rel).first()
    assert (m.queries, m.mrr, m.hits1, m.hitsk) == (3, 0.5, 33.3, 66.7)
    q = metrics.set_quality(hits.select("id"), rel.select("id")).first()
    assert (q.tp, q.precision, q.recall) == (2, 0.6667, 0.6667)
    lab = spark.createDataFrame([("Cart", "s"), ("Nope", "s")], "entity string, contract string")
    got = metrics.label_quality(spark.createDataFrame([("x:Cart.get", "s"), ("y", "s")], "entity string, contract string"), lab).first()
    assert (got.precision, got.recall) == (0.5, 0.5)
    assert metrics.context_recall(hits.select("query", "id"), rel).orderBy("query").first().recall == 1.0
    edges = spark.createDataFrame([("a", "b", "Ldep"), ("b", "c", "Lsyn")], "src string, dst string, layer string")
    assert metrics.layer_ablation(edges, lambda e: e.count(), ("Ldep",)) == {"Ldep": -1}
