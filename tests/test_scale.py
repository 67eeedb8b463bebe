"""Operators whose work must stay bounded: brute force, and counts of what they read, make and repeat."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.operators import grams, ranked, resolve, text, traverse
from codeloom.operators.traverse import Adjacency
from codeloom.plans import commerce
from codeloom.storage import kept, running


def scanned(df) -> int:
    """Rows that the scans of a plan without shuffles put out."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    rows, leaves = 0, run.executedPlan().collectLeaves()
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        rows += metric.get().value() if metric.isDefined() else 0
    return rows


def edges_of(spark, pairs, **more):
    rows = [(f"e{i}", a, b, more.get("relation", "CALLS"), more.get("layer", "Ldep"), 1.0) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "edge_id string, src string, dst string, relation string, layer string, c_type double")


def test_closure_doubles_its_paths(spark, monkeypatch):
    made = []
    inner = traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, name: made.append(name) or inner(df, name))
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    got = {(r.src, r.dst): r.dist for r in traverse.closure(edges_of(spark, chain)).collect()}
    assert got == {(f"n{i:03}", f"n{j:03}"): j - i for i in range(101) for j in range(i + 1, 101)}
    assert len(made) <= 2 + math.ceil(math.log2(100))
    loops = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("a", "b"), ("x", None)]
    got = {(r.src, r.dst): r.dist for r in traverse.closure(edges_of(spark, loops)).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("b", "d"): 2, ("c", "a"): 1, ("c", "b"): 2, ("c", "c"): 3, ("c", "d"): 1, ("d", "d"): 1}
    assert traverse.closure(edges_of(spark, []).limit(0)).count() == 0


def depth_first(bases, cls):
    """Bases in the order in which a depth-first search first meets them."""
    seen = []

    def visit(c):
        if c not in seen:
            seen.append(c)
            for b in bases.get(c, []):
                visit(b)

    visit(cls)
    return seen


def known_of(spark, bases):
    return spark.createDataFrame([(c, b, i) for c, bs in bases.items() for i, b in enumerate(bs)], "class string, base string, pos long")


def order_of(up, cls):
    return [r.base for r in up.filter(F.col("class") == cls).orderBy("path").collect()]


def test_stacked_diamonds_keep_one_path_a_pair(spark):
    bases = {}
    for i in range(12):
        bases[f"t{i}"], bases[f"l{i}"], bases[f"r{i}"] = [f"l{i}", f"r{i}"], [f"t{i + 1}"], [f"t{i + 1}"]
    up = resolve.ancestors(known_of(spark, bases)).cache()
    assert up.count() == len({(c, b) for c in [*bases, "t12"] for b in depth_first(bases, c)})
    for cls in ("t0", "l3", "t11"):
        assert order_of(up, cls) == depth_first(bases, cls)


def test_ancestors_of_trees_and_cycles(spark):
    rng = random.Random(2)
    bases = {f"c{i:02}": [f"c{j:02}" for j in sorted(rng.sample(range(i + 1, 30), min(rng.randrange(3), 29 - i)))] for i in range(29)}
    for b in bases.values():
        rng.shuffle(b)
    up = resolve.ancestors(known_of(spark, bases)).cache()
    for cls in ("c00", "c05", "c11"):
        if bases[cls]:
            assert order_of(up, cls) == depth_first(bases, cls)
    loop = resolve.ancestors(known_of(spark, {"a": ["b"], "b": ["c", "a"], "c": ["a"]}))
    assert {(r["class"], r.base) for r in loop.collect()} == {(x, y) for x in "abc" for y in "abc"}
    with pytest.raises(RuntimeError):
        resolve.ancestors(known_of(spark, {f"k{i}": [f"k{i + 1}"] for i in range(6)}), max_levels=3)


def test_a_hop_reads_the_row_groups_of_its_frontier(spark):
    pairs = [(f"n{i % 20_000:05}", f"n{(i * 7919 + 13) % 20_000:05}") for i in range(60_000)]
    edges = edges_of(spark, pairs)
    near = Adjacency.of(edges, row_group=64 * 1024)
    found = near.at(["n00017", "n12345"], "both")
    want = Counter((d, s, t) for s, t in pairs for d, end in (("out", s), ("in", t)) if end in ("n00017", "n12345"))
    assert Counter((r.direction, r.src, r.dst) for r in found.collect()) == want
    assert scanned(near.at(["n00017"], "both")) < 2 * len(pairs) / 5


@pytest.mark.parametrize("frontier", [1000, 3])
def test_traversals_of_both_layouts_agree(spark, monkeypatch, frontier):
    monkeypatch.setattr(traverse, "FRONTIER", frontier)
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)]
    edges = edges_of(spark, pairs).withColumn("relation", F.when(F.xxhash64("edge_id") % 2 == 0, "CALLS").otherwise("CONTAINS"))
    near, start = Adjacency.of(edges), traverse.roots(spark, "n1", "n2")
    rows = lambda df: sorted(map(str, df.collect()))
    for direction in ("out", "in", "both"):
        assert rows(traverse.adjacency(edges, start, None, direction, 2)) == rows(traverse.adjacency(near, start, None, direction, 2))
        for depth in (0, 1, 3):
            assert rows(traverse.within(edges, start, depth, direction, None, ("CALLS",))) == rows(traverse.within(near, start, depth, direction, None, ("CALLS",)))
    assert rows(traverse.budget_selection(edges, start)) == rows(traverse.budget_selection(near, start))


def documents(seed, n=600):
    rng = random.Random(seed)
    return [(f"d{i:04}", " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(1, 60)))) for i in range(n)] + [("copy1", "w1 w2 w3"), ("copy2", "w1 w2 w3")]


def test_the_index_ranks_as_all_scores_do(spark):
    docs = spark.createDataFrame(documents(3), "id string, text string")
    posts = text.postings(docs, F.split("text", " ")).cache()
    vocab = text.vocabulary(posts, posts.select("id").distinct().count())
    index = ranked.Index.of(posts, size=16)
    for words in (["w1", "w2"], ["w1", "w1", "w250", "none"], ["w7"], ["none"], []):
        q = text.query_terms(spark, words) if words else None
        for k in (1, 5, 40, 2000):
            if q is None:
                assert index.cosine(words, k).count() == index.hybrid(words, k).count() == 0
                continue
            cos, bm = text.cosine(text.weights(posts, vocab), vocab, q), text.bm25(posts, q)
            for got, want in ((index.cosine(words, k), cos), (index.bm25(words, k), bm), (index.hybrid(words, k), text.hybrid(cos, bm))):
                assert [tuple(r) for r in got.collect()] == [tuple(r) for r in text.top_k(want, k).collect()], (words, k)


def test_the_index_rules_ranges_out(spark, monkeypatch):
    """Few documents hold the rare term, so the ranges without it cannot reach the best scores and are not read."""
    rows = [(f"d{i:05}", "common " * (1 + i % 40) + ("rare " * 3 if i % 400 == 7 else "")) for i in range(4000)]
    posts = text.postings(spark.createDataFrame(rows, "id string, text string"), F.array_remove(F.split("text", " "), ""))
    index = ranked.Index.of(posts, size=16)
    asked = []
    inner = ranked.top_k
    monkeypatch.setattr(ranked, "top_k", lambda df, *more: asked.append(df) or inner(df, *more))
    got = index.cosine(["rare", "common"], 5).collect()
    assert len(got) == 5 and all(int(r.id[1:]) % 400 == 7 for r in got)
    assert asked[-1].count() < 400


def test_substrings_by_grams(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["Steel", "steelwork", "", None, "s", "st", "a.b:c", "É tÉ", "xx" * 500, "tee l", "STEEL brass", "\x02\x02a"])]
    index = grams.GramIndex.of(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t"))
    low = [(i, (t or "")) for i, t in rows]
    for needle in ("steel", "STE", "st", "s", "", ".b:", "é t", "xxx", "l b", "nothing here", "a"):
        assert sorted(r.id for r in index.contains(needle).collect()) == [i for i, t in low if needle.lower() in t.lower()], needle
        assert sorted(r.id for r in index.contains(needle, ignore_case=False).collect()) == [i for i, t in low if needle in t], needle
    hits = {r.id: r.hits for r in index.hits(["steel", "l", "brass"]).collect()}
    assert hits == {i: n for i, t in low if (n := sum(x in t.lower() for x in ("steel", "l", "brass")))}


def unit_vectors(seed, n, heavy):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        raw = {f"t{rng.randrange(40)}": rng.random() + 0.1 for _ in range(rng.randrange(1, 8))}
        if heavy:
            raw["everywhere"] = 0.4 + rng.random() / 5
        length = math.sqrt(sum(w * w for w in raw.values()))
        out.append({t: w / length for t, w in raw.items()})
    return out


@pytest.mark.parametrize("threshold, heavy", [(0.6, False), (0.55, True), (0.95, True)])
def test_sparse_self_join_equals_brute_force(spark, threshold, heavy):
    vectors = unit_vectors(7, 250, heavy)
    w = spark.createDataFrame([(i, t, x) for i, v in enumerate(vectors) for t, x in v.items()], "id long, term string, w double").cache()
    want = {(i, j) for j, u in enumerate(vectors) for i, v in enumerate(vectors[:j]) if sum(x * u.get(t, 0) for t, x in v.items()) >= threshold}
    pairs = text.candidate_pairs(w, threshold, heavy=20).cache()
    made = {(r.a, r.b) for r in pairs.collect()}
    assert want <= made and len(made) == pairs.count()
    assert {(r.a, r.b) for r in text.similar_pairs(w, threshold).collect()} == want
    if threshold == 0.95:
        assert len(made) <= 31_125 / 25  # all pairs share the common term
    with pytest.raises(ValueError):
        text.similar_pairs(w, 0)


def test_two_hops_over_a_hub(spark):
    pairs = [(f"in{i}", "hub") for i in range(60)] + [("hub", f"out{i}") for i in range(70)] + [("out1", "far"), ("hub", "hub"), ("in1", "in2")]
    want = set(pairs) | {(a, d) for a, b in pairs for c, d in pairs if b == c}
    for side in (7, 2000):
        got = [(r.src, r.dst) for r in traverse.two_hop_pairs(edges_of(spark, pairs + pairs[:5]), side).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None, ""]), i, rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    want, sums = {}, defaultdict(int)
    for g, k, v in rows:
        sums[g] += v
        want[k] = sums[g]
    assert {r.k: r.s for r in running(df, ["g"], ["k"], F.col("v"), "s").collect()} == want
    cut = running(df, ["g"], ["k"], F.col("v"), "s", upto=100).collect()
    assert {r.k: r.s for r in cut} == {k: s for k, s in want.items() if s <= 100}
    assert running(df.limit(0), ["g"], ["k"], F.col("v"), "s").count() == 0
    alone = {r.k: r.s for r in running(df, [], ["k"], F.lit(1), "s").collect()}
    assert alone == {k: k + 1 for k in range(900)}


def test_pages_of_a_hub(spark):
    pairs = [("hub", f"n{i:04}") for i in range(250)] + [("n0001", "hub")]
    pages = traverse.explain_pages(edges_of(spark, pairs), size=100).collect()
    mine = sorted((r.page, [x.other for x in r["items"]]) for r in pages if r.id == "hub" and r.section == "outward_calls")
    assert [len(x) for _, x in mine] == [100, 100, 50] and [o for _, x in mine for o in x] == [f"n{i:04}" for i in range(250)]
    assert {(r.section, len(r["items"])) for r in pages if r.id == "n0001"} == {("outward_calls", 1), ("inward_callers", 1)}
    similar = edges_of(spark, [("a", "x"), ("a", "y"), ("a", "z")], layer="Lsem").withColumn("c_type", F.when(F.col("dst") == "y", 0.9).otherwise(0.6))
    page = traverse.explain_pages(similar).collect()[0]
    assert [(x.other, x.similarity) for x in page["items"]] == [("y", 0.9), ("x", 0.6), ("z", 0.6)]


def test_kept_tables_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    ask = lambda: kept(spark, ("follows",), lambda: spark.read.parquet(path), inputs=[path]).count()
    spark.range(5).write.parquet(path)
    assert ask() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    assert ask() == 9


def test_source_segments_are_cut_in_one_pass():
    import ast

    from codeloom.extract import python
    from codeloom.extract.emit import Emitter

    text = "class Ä:\r\n    def f(self, x='ß€'): return x; \r    def g(self):\n        def h(): pass\n        return 'é'\n\x0c\nasync def last(): return 1"
    walk = python._Walk(Emitter("", "a.py"), text)
    nodes = [n for n in ast.walk(ast.parse(text)) if hasattr(n, "lineno")]
    assert len(nodes) > 10 and all(walk.code(n) == ast.get_source_segment(text, n) for n in nodes)


def test_files_are_dealt_to_all_cores(spark):
    from codeloom.extract.facts import extract_facts

    files = spark.createDataFrame([("", f"m{i}.py", bytearray(b"x = 1\n")) for i in range(200)], "repo string, path string, content binary").coalesce(1)
    facts = extract_facts(files)
    assert facts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert facts.filter("kind = 'loc'").count() == 200


def test_large_files_are_dealt_apart(spark):
    from codeloom.extract.facts import extract_facts

    files = spark.createDataFrame([("", f"m{i}.py", bytearray(b"x = 1\n" * (1 if i % 7 else 500))) for i in range(100)], "repo string, path string, content binary").coalesce(1)
    facts = extract_facts(files).filter("kind = 'loc'").withColumn("part", F.spark_partition_id())
    assert facts.count() == 100
    assert max(r["count"] for r in facts.filter("n = 500").groupBy("part").count().collect()) == 1


PIECES = {
    "class": "# é\n\"\"\"Doc.\"\"\"\nimport a\n\n\nclass A(B, metaclass=M):\n    '''Doc'''\n\n" + "".join(f"    @mark('/{i}', methods=['GET'])\n    def f{i % 5}(self, x: T):\n        y = g(x)\n        self.h('é')\n        return y\n\n" for i in range(30)) + "    z = 'ß'  # end\n\n# after\nif A:\n    f(A)\n",
    "functions": "".join(f"@mark\n\ndef f{i}(x):\n    return x\n\n\n" if i == 3 else f"async def f{i}(x):\n    return x\n\n\n" for i in range(30)),
    "text": "def a():\n    return 1\n\n" * 9 + "x = \"\"\"\n\nclass B:\n    pass\n\ndef b(): pass\n\"\"\"\n\ndef c():\n    return x\n",
    "brackets": "def a():\n    return 1\n\n" * 9 + "x = (\n\ndef c():\n    return x\n",
    "generic": "class A[T: B](C):\n\n" + "    class D:\n        x = 1\n\n" * 9 + "    def f(self): return T\n\ndef last(): pass\n",
}


@pytest.mark.parametrize("name", PIECES)
def test_large_sources_are_parsed_by_pieces(name, monkeypatch):
    import ast

    from codeloom.extract import emit, python

    text, sizes, parse = PIECES[name], [], ast.parse

    def facts(size):
        e = emit.Emitter("r", "a.py", pack=list)
        sizes.clear()
        try:
            python.extract(e, text, size)
        except SyntaxError:
            return None
        return sorted([r for rows in [*e.packed, e.rows] for r in rows], key=lambda r: r[4])

    monkeypatch.setattr(python.ast, "parse", lambda t: sizes.append(len(t)) or parse(t))
    want = facts(1 << 40)
    assert sizes == [len(text)] and (want is None) == (name == "brackets")
    assert facts(150) == want
    if name in ("class", "generic"):
        assert len(sizes) > 1 and max(sizes) < 400
    monkeypatch.setattr(emit, "BATCH", 10)
    e = emit.Emitter("r", "a.py", pack=list)
    if want is not None:
        python.extract(e, text, 150)
        assert len(e.rows) < 10 and len(e.packed) == len(want) // 10


@pytest.mark.parametrize("common", [0, 3, 40, 1 << 17])
def test_heaviest_terms_move_few_postings(spark, tmp_path, monkeypatch, common):
    import duckdb

    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('ABcd')}{min(int(rng.expovariate(0.05)), 99)}" for _ in range(rng.randint(1, 120))) for _ in range(150)]
    texts += ["", None, "!? é", "x" * 70, "x" * 70 + " y y", " ".join(f"only{i}" for i in range(9)), "same1 same2 same3 same4"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "c1 c1 d2 twice"), (7, None), (None, "c1 lost"), (8, "A1")]
    rows = rows if common == 3 else rows[: len(texts)] + [(None, "c1 lost")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs, made, inner = spark.read.parquet(str(tmp_path / "documents.parquet")), {}, text.stored
    monkeypatch.setattr(text, "stored", lambda df, name: made.setdefault(name, inner(df, name)))
    got = text.heaviest_terms(docs, commerce.word_tokens(F.col("text")), 3, "doc_id", common=common)
    want = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet'), {commerce.ORACLES['tfidf_topk'].removeprefix('WITH ')}").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 300
    assert ("merged" in made) == (common == 3)
    if common == 1 << 17:  # all terms but one of 70 characters are common, and few postings go on
        postings = docs.select(F.explode(F.array_distinct(commerce.word_tokens(F.col("text"))))).count()
        assert made["weighed"].filter("w is null").count() == 2 and made["weighed"].count() < postings / 5


def test_homes_hold_their_stems(spark):
    from codeloom.operators import heal

    paths = ["svc1/model.py", "svc12/a.py", "svc120/model.py", "x/usvc12.go", "a.py", "éß/svc.js", "svcsvc7.ts", "-"]
    files = [(p, f"back/{p}", "." + p.rsplit(".", 1)[-1], p.replace("-", "")) for p in paths]
    stems = ["svc1", "svc12", "svc", "a", "é", "ß/", "svc7", "none", "vc120/model.py", "model.pyx"]
    absent = [(f"d{i}", f"R{i}", t) for i, t in enumerate(stems)]
    want = {(d, r, min(f for f in files if t in f[3])[:3]) for d, r, t in absent if any(t in f[3] for f in files)}
    got = heal.homes(spark.createDataFrame(absent, "defect string, rpc string, stem string"), spark.createDataFrame(files, "path string, ctx string, ext string, base string"))
    assert {(x.defect, x.rpc, (x.path, x.ctx, x.ext)) for x in got.collect()} == want and len(want) == 8
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_renames_compare_each_name_once(spark):
    from codeloom.operators import relational

    names = spark.createDataFrame([("b", "gear"), ("b", "bolt"), ("b", "gear")] * 50 + [("c", "rod"), ("c", None)], "g string, candidate string")
    lost = spark.createDataFrame([("b", "ear"), ("b", "olt")] * 100 + [("c", None), (None, "x")], "g string, old string")
    got = sorted((r.g, r.old or "", r.candidate or "", r.score) for r in relational.renames(lost, names, ["g"]).collect())
    assert got == [("b", "ear", "gear", 0.86), ("b", "olt", "bolt", 0.86), ("c", "", "", 1.0)]


def test_equal_vectors_are_compared_once(spark):
    sets = [{"a", "b", "c"}] * 40 + [{"a", "b", "d"}] * 30 + [{"x", "y"}] * 3 + [{"z"}] + [{"x", "q", "r"}]
    rows = [(i, t, 1 / math.sqrt(len(s))) for i, s in enumerate(sets) for t in sorted(s)]
    w = spark.createDataFrame(rows, "id long, term string, w double")
    members, classes = text.similar_classes(w, 0.6)
    assert members.count() == len(sets) and sorted((r.a, r.b) for r in classes.collect()) == [(0, 0), (0, 40), (40, 40), (70, 70), (73, 73), (74, 74)]
    want = {(i, j): len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    got = text.similar_pairs(w, 0.6, heavy=7).collect()
    assert sorted((r.a, r.b, round(r.score, 9)) for r in got) == sorted((a, b, round(s, 9)) for (a, b), s in want.items() if s > 0.6)


def test_graph_queries_store_no_graph(spark, monkeypatch):
    """Histograms, look-ups of contracts and hops from a node ask the tables themselves; the whole graph is not written first."""

    def no_store(*args, **kwargs):
        raise AssertionError("the graph was stored")

    for name in ("kept", "edge_store"):
        monkeypatch.setattr(commerce, name, no_store, raising=False)
    sf = "/root/testdata/sf0.001"
    got = {r.type: r.n for r in commerce.node_type_histogram(spark, sf).collect()}
    assert got["class"] == 25 and got["function"] > 0
    plan = commerce.node_type_histogram(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan
    plan = commerce.graph(spark, sf)[1].filter("relation = 'CONTAINS'")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    assert commerce.who_consumes(spark, sf).count() > 0
    assert [(r.source, r.target) for r in commerce.adjacency_in(spark, sf).filter("relation = 'CONTAINS'").collect()][0][1] == "C:1"


def test_folders_are_written_without_a_sort(spark, tmp_path):
    from codeloom import storage

    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    rows = spark.range(1000).select(F.concat(F.lit("L"), (F.col("id") % 40).cast("string")).alias("layer"), F.lit("").alias("empty"), "id")
    storage.by_folder(rows, str(tmp_path / "many"), "layer")  # more folders than a task keeps open
    storage.by_folder(rows.filter("layer < 'L2'"), str(tmp_path / "few"), "layer")
    assert spark.read.parquet(str(tmp_path / "many")).count() == 1000 and spark.conf.get(key) == before
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "few")).collect()) == sorted(r.id for r in rows.filter("layer < 'L2'").collect())


def test_relations_take_only_their_steps(spark):
    """A query on some relations or layers of a built graph resolves no others, and gives what the whole graph has of them."""
    from codeloom.plans.build import build

    texts = {"a.py": "class A:\n    def run(self):\n        return 1\n", "b.py": "from a import A\n\n\nclass B(A):\n    def go(self):\n        return self.run()\n", "p.proto": "service S { rpc R(Q) returns (P); }\n"}
    files = spark.createDataFrame([("", p, "." + p.split(".")[1], bytearray(t.encode())) for p, t in texts.items()], "repo string, path string, ext string, content binary")
    g = build(files, semantic=False)
    rows = lambda df: sorted((r.src, r.dst, r.relation, r.layer) for r in df.collect())
    some = rows(g.related("CONTAINS", "DEFINES_RPC"))
    assert some and not {"hierarchy", "called", "produced", "requests", "uses", "edges"} & set(g.kept)
    extends, syntax = rows(g.related("EXTENDS")), rows(g.layered("Lsyn", "Lcontract"))
    assert ("b.py:B", "a.py:A", "EXTENDS", "Ldep") in extends and not {"called", "requests", "edges"} & set(g.kept)
    whole = rows(g.edges)
    assert any(r[2] == "CALLS" and r[1] == "a.py:A.run" for r in whole)
    assert some == [r for r in whole if r[2] in ("CONTAINS", "DEFINES_RPC")] and extends == [r for r in whole if r[2] == "EXTENDS"]
    assert syntax == [r for r in whole if r[3] in ("Lsyn", "Lcontract")] == rows(g.layered("Lsyn", "Lcontract"))


def test_dense_blocks_come_from_arrow_buffers(spark):
    import numpy as np
    import pyarrow as pa

    from codeloom.operators.dense import block_of, dense_pairs

    ids, matrix = block_of(pa.array([1, 2, 3]).slice(1), pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]]).slice(1))
    assert ids.tolist() == [2, 3] and matrix.tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert block_of(pa.array([1, 2]), pa.array([[], []], pa.list_(pa.float64())))[1].shape == (2, 0)
    v = np.random.default_rng(5).normal(size=(60, 7))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {(r.a, r.b): r.score for r in dense_pairs(df, "id", "v", 2.0, block=8).collect()}
    dots = v @ v.T
    assert got.keys() == {(i, j) for i in range(60) for j in range(i + 1, 60) if dots[i, j] >= 2.0}
    assert all(abs(s - dots[k]) < 1e-9 for k, s in got.items())


def test_look_ups_build_no_index(spark, monkeypatch):
    from codeloom.operators.grams import GramIndex
    from codeloom.plans import answers

    def built(*args, **kwargs):
        raise AssertionError("an index of all nodes was built")

    monkeypatch.setattr(GramIndex, "of", staticmethod(built))
    monkeypatch.setattr(commerce, "kept", built)
    got = {r.part: r.id for r in answers.lookup_fuzzy(spark, "/root/testdata/sf0.001").collect()}
    assert got["C:1"] == "C:1" and "zzz" not in got


FAMILY_TEXTS = {
    "a.py": "import os, flask as fl\nfrom .b import C as D\n\n\nclass A(D, metaclass=M):\n    \"\"\"Doc.\"\"\"\n\n    @app.route('/x', methods=['GET'])\n    async def run(self, x: T = f(1), *a, **k) -> g(2):\n        stub = pb.ApiStub(chan)\n        y: int = stub.Get(x)\n        y += h(lambda z: q(z))\n        if x:\n            return y\n        elif r(x):\n            requests.get('http://h/p')\n        else:\n            def inner(): return super().run(y)\n        return [u(v) for v in y if (w := y)]\n",
    "b.py": "def f(x):\n    match g(x):\n        case P(a=1) if h(x):\n            import late\n            y = x\n        case _:\n            pass\n    try:\n        with o(x) as (p, q):\n            for i in p:\n                yield k(i)\n    except* E as e:\n        return e\n    return x\n\n\nclass G(api.ApiServicer):\n    def Get(self, request, context):\n        return request\n",
    "bad.py": "def (:\n",
    "s.go": "package main\nimport \"fmt\"\ntype S struct{}\nfunc (s *S) Run(x int) int {\n  y := x\n  fmt.Println(y)\n  return y\n}\n",
    "p.proto": "service Api { rpc Get(Q) returns (P); }\n",
    "m.js": "import { a } from './b';\nconst c = new ApiClient('x');\nfunction f(x) { let y = a(x); c.get(y); return y; }\n",
}


def test_families_of_facts_are_those_of_one_pass(spark):
    """Facts that are extracted apart are, with their numbers, the facts of one pass over the sources; none is made twice."""
    from codeloom.extract.facts import file_facts
    from codeloom.plans.build import DECLARED, FAMILIES, FAMILY, STEPS

    for path, text in FAMILY_TEXTS.items():
        whole = file_facts("r", path, text.encode())[1]
        assert len(set(map(str, whole))) == len(whole) > 1
        assert {r[7] if r[3] == "edge" else r[3] for r in whole} <= FAMILY.keys()
        apart = [file_facts("r", path, text.encode(), None, frozenset(kinds))[1] for kinds in FAMILIES.values()]
        assert all((r[7] if r[3] == "edge" else r[3]) in kinds for rows, kinds in zip(apart, FAMILIES.values()) for r in rows)
        assert sorted(str(r) for rows in apart for r in rows) == sorted(map(str, whole))
    assert not {r for made in DECLARED.values() for r in made} & {r for _, made in STEPS.values() for r in made}


def test_queries_extract_the_facts_that_they_need(spark, monkeypatch):
    from codeloom.plans import build

    asked, inner = [], build.extract_facts
    monkeypatch.setattr(build, "extract_facts", lambda files, want=None: asked.append(want) or inner(files, want))
    files = spark.createDataFrame([("", p, "." + p.split(".")[1], bytearray(t.encode())) for p, t in FAMILY_TEXTS.items() if p != "m.js"], "repo string, path string, ext string, content binary")
    rows = lambda df: sorted(map(str, df.collect()))
    g = build.build(files, semantic=False, by_need=True)
    assert not asked
    some = {"contains": rows(g.related("CONTAINS")), "imports": rows(g.related("IMPORTS")), "extends": rows(g.related("EXTENDS"))}
    assert len(asked) == 1 and not {"node", "call", "literal_call", "DEFINES", "USES"} & set(asked[0])
    assert g.table.having("loc").filter("kind = 'loc'").count() == 3 and len(asked) == 1
    some["http"] = rows(g.related("HTTP_CALLS", "DEFINES_RPC"))
    assert len(asked) == 2 and set(asked[1]) == {"literal_call", "http_call"}
    some["flow"], some["syntax"] = rows(g.related("DEFINES", "RETURNS")), rows(g.layered("Lsyn", "Lcontract"))
    assert len(asked) == 4
    whole = build.build(files, semantic=False)
    assert asked[4:] == [None] and all(some.values())
    of = lambda *names: rows(whole.edges.filter(F.col("relation").isin(*names)))
    assert some == {"contains": of("CONTAINS"), "imports": of("IMPORTS"), "extends": of("EXTENDS"), "http": of("HTTP_CALLS", "DEFINES_RPC"), "flow": of("DEFINES", "RETURNS"), "syntax": rows(whole.edges.filter("layer in ('Lsyn', 'Lcontract')"))}
    assert rows(g.edges) == rows(whole.edges) and len(asked) == 6
    script = spark.createDataFrame([("", p, "." + p.split(".")[1], bytearray(t.encode())) for p, t in FAMILY_TEXTS.items()], files.schema)
    assert rows(build.build(script, semantic=False, by_need=True).related("IMPORTS")) == rows(build.build(script, semantic=False).edges.filter("relation = 'IMPORTS'"))


def test_deep_expressions_lose_no_file():
    from codeloom.extract.facts import file_facts

    deep = "def f(x):\n    y = " + " + ".join(["g(x)"] * 1500) + "\n    if x:\n        h(x)\n" + "".join(f"    elif x == {i}:\n        h{i}(x)\n" for i in range(1500)) + "    else:\n        last(x)\n    return x" + ".a" * 1500 + "()\n"
    rows = file_facts("", "a.py", deep.encode())[1]
    called = [r[6] for r in rows if r[3] == "call"]
    assert not [r for r in rows if r[3] == "problem"]
    assert called == ["g"] * 1500 + ["h", *(f"h{i}" for i in range(1500)), "last", "x" + ".a" * 1500]
    assert [r[3] for r in file_facts("", "a.py", deep.encode(), None, frozenset(("loc", "symbol")))[1]] == ["loc", "symbol"]


def test_resolution_stores_what_its_facts_need(spark, monkeypatch):
    """Flat hierarchies take no rounds, bases are resolved once, and routes of decorators look for no handlers."""
    from codeloom.plans import build

    made, inner = [], resolve.stored
    for module in (resolve, build):
        monkeypatch.setattr(module, "stored", lambda df, name: made.append(name) or inner(df, name))
    flat = resolve.ancestors(known_of(spark, {"a": ["b", "c"], "d": ["d", "b"]}))
    assert not made and {(r["class"], r.base, r.path) for r in flat.collect()} == {*((x, x, "") for x in "abcd"), ("a", "b", "0000000000."), ("a", "c", "0000000001."), ("d", "b", "0000000001.")}
    files = spark.createDataFrame([("", p, ".py", bytearray(FAMILY_TEXTS[p].encode())) for p in ("a.py", "b.py")] + [("", "c.py", ".py", bytearray(b"import requests\n\n\ndef c():\n    requests.get('http://h/x')\n"))], "repo string, path string, ext string, content binary")
    g = build.build(files, semantic=False, by_need=True)
    assert [(r.src, r.dst) for r in g.related("HTTP_CALLS").collect()] == [("c.py:c", "a.py:A.run")] and made == ["facts", "requested"]
    assert {(r.src, r.dst) for r in g.related("EXTENDS").collect()} == {("a.py:A", "symbol::D"), ("b.py:G", "symbol::api.ApiServicer")}
    assert sorted(made) == sorted(["facts", "requested", "symbols", "modules", "imports", "bases"])


def test_pairs_of_similar_classes_are_dealt_to_many_tasks(spark):
    """few classes of many members were a few keys in few tasks, which made and rounded all pairs."""
    docs = [(i, t) for i in range(120) for t in (["hot", "bolt"], ["hot", "bolt", "x"], ["cold", "nut"])[i % 3]]
    w = spark.createDataFrame(docs, "id long, term string").withColumn("w", 1 / F.sqrt(F.when((F.col("id") % 3) == 1, 3).otherwise(2)))
    found = text.similar_pairs(w, 0.6, heavy=10, digits=4).withColumn("task", F.spark_partition_id()).collect()
    score = {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (0, 1): round(2 / math.sqrt(6), 4), (1, 0): round(2 / math.sqrt(6), 4)}
    want = {(a, b, score[a % 3, b % 3]) for a in range(120) for b in range(a + 1, 120) if (a % 3, b % 3) in score}
    assert {(r.a, r.b, r.score) for r in found} == want and len(found) == len(want)
    assert len({r.task for r in found}) > 8


def test_dense_pairs_move_no_vector(spark):
    """each block of vectors was written to the shuffle once for each other block."""
    from codeloom.operators.dense import dense_pairs

    rng = random.Random(5)
    vs = {i: [rng.choice((-1.0, 0.5, 0.25, 1.0)) for _ in range(6)] for i in range(150)}
    df = spark.createDataFrame(list(vs.items()), "id long, v array<float>").repartition(3)
    found = dense_pairs(df, "id", "v", 2.0, block=7)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(i, j, sum(x * y for x, y in zip(vs[i], vs[j]))) for i in vs for j in vs if i < j}
    got = found.collect()
    assert {(r.a, r.b, r.score) for r in got} == {w for w in want if w[2] >= 2.0} and len(got) == len({(r.a, r.b) for r in got})


def broken_clients(spark, n=40):
    from codeloom.plans.build import build
    from codeloom.sources.repo import files_table

    calls = "".join(f"\n\ndef call{i}(x):\n    y = x\n    return stub.{'Gone' if i % 2 else 'Get'}{i}(y)\n" for i in range(n))
    proto = "service Api {\n" + "".join(f"  rpc Get{i}(A) returns (B) {{}}\n" for i in range(n)) + "}\n"
    files = files_table(spark, [("", "client.py", "import api_pb2_grpc\n\nstub = api_pb2_grpc.ApiStub(None)\n" + calls), ("", "api.proto", proto)])
    return build(files, semantic=False, by_need=True)


def test_renamed_calls_need_no_nodes(spark):
    """the file of a caller came from all nodes of the graph, and each call carried its service's rpcs through a distinct()."""
    from codeloom.operators import heal

    g = broken_clients(spark)
    found = heal.renamed(g)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "nodes" not in g.kept and "edges" not in g.kept and not {"nodes", "flow", "calls", "requests"} & set(g.table.parts) and g.table.whole is None
    rows = found.collect()
    assert {(r.caller, r.file, r.old) for r in rows} == {(f"client.py:call{i}", "client.py", f"Gone{i}") for i in range(1, 40, 2)} and len(rows) == 20
    assert all(r.valid == sorted(f"Get{i}" for i in range(40)) for r in rows)
    assert not any(line.lstrip(" +-:").startswith("Aggregate") and "RENAMED_RPC" in line for line in plan.splitlines())


def test_large_files_are_walked_in_little_memory():
    """a walk kept the id of each variable, in three tables, and the facts of a file as they were."""
    from codeloom.extract import emit, python

    e = emit.Emitter("", "a.py")
    python.extract(e, "class C:\n" + "".join(f"    def f{i}(self, cart):\n        total = cart\n        return total\n\n" for i in range(500)))
    assert len(e.seen) <= 2 + 2 * 500 and len(e.types) == 502 and len(e.alike) == 1
    assert sum(r[3] == "edge" and r[7] == "USES" for r in e.rows) == 1000 and sum(r[3] == "node" and r[6] == "variable" for r in e.rows) == 1500


@pytest.mark.parametrize("common", [0, 3, 1 << 17])
def test_scans_answer_without_postings(spark, tmp_path, monkeypatch, common):
    """a query first wrote the postings of all documents, and moved them some six times to make an index."""
    import duckdb

    rng = random.Random(9)
    words = [*commerce.QUERY_TEXT.split(), *(f"w{i}" for i in range(60))]
    texts = [" ".join(words[min(int(rng.expovariate(0.1)), 69)] for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [*enumerate([*texts, "", None, "!? é", "The THE of"]), *([(7, "the contract"), (None, "the la de"), (None, "contract"), (8, None)] if common else [])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs, made, inner = spark.read.parquet(str(tmp_path / "documents.parquet")), {}, ranked.stored
    monkeypatch.setattr(ranked, "stored", lambda df, name: made.setdefault(name, inner(df, name)))
    keep = lambda name, make: made[name] if name in made else made.setdefault(name, inner(make(), name))
    scan = ranked.Scan.of(docs, commerce.word_tokens(F.col("text")), "doc_id", keep)
    scan.norms(common)
    asked = text.driver_tokens(commerce.QUERY_TEXT)
    for name, how in (("tfidf_query", scan.cosine), ("bm25_topk", scan.bm25), ("hybrid_topk", scan.hybrid)):
        want = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet'), {commerce.ORACLES[name].removeprefix('WITH ')}").fetchall()
        assert [tuple(r) for r in how(asked, 20).collect()] == want and len(want) == 20
    assert ("merged" in made) == bool(common) and scan.cosine(["nowhere"]).isEmpty() and scan.bm25([]).isEmpty()
    if common > 3:
        assert made["summed"].agg(F.sum(F.size("rare"))).first()[0] == 0


def test_ranked_queries_store_no_postings(spark, monkeypatch):
    def no_index(*args):
        raise AssertionError("an index was made")

    monkeypatch.setattr(commerce, "doc_index", no_index)
    for name in ("tfidf_query", "bm25_topk", "hybrid_topk"):
        assert commerce.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 20


def test_pages_are_cut_where_their_rows_lie(spark, monkeypatch):
    """every row was stored, moved to be numbered, and moved once more to its page."""
    from codeloom import storage

    rng, kept_rows, inner = random.Random(4), [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: kept_rows.append(inner(df, name)) or kept_rows[-1])
    pairs = [(f"s{rng.randint(0, 300)}", f"t{rng.randint(0, 40)}") for _ in range(3000)] + [("hub", f"x{i % 900:03}") for i in range(1500)] + [("a", None), (None, "b")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        pages = traverse.explain_pages(edges_of(spark, pairs), size=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for a, b in pairs:
        want[a, "outward_calls"].append(b)
        want[b, "inward_callers"].append(a)
    got = {(r.id, r.section, r.page): [x.other for x in r["items"]] for r in pages}
    assert len(got) == len(pages) and got == {(*key, i // 7): v[i : i + 7] for key, others in want.items() for v in [sorted(others, key=lambda x: (x is not None, x or ""))] for i in range(0, len(v), 7)}
    assert 0 < sum(len(r["items"]) for df in kept_rows for r in df.select("items").collect()) < 2 * len(pairs)
