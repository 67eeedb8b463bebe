"""Operators 4, 6 and 10, the pipeline, and the queries against their SQL."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from helpers import empty, odd_texts, table, words
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from codeloom.llm import chat_format, decontaminate, sharding
from codeloom.llm.catalogue import ORACLES, QUERIES
from codeloom.llm.decontaminate import contaminated, find_benchmark
from codeloom.llm.jaccard_join import jaccard_components
from codeloom.llm.fm_index import FMIndex, WaveletMatrix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[cols].values.tolist())
    assert rows(got) == rows(want)


def brute_shard(key, weights):
    u = [(int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(len(weights))]
    return max(range(len(weights)), key=lambda s: (-weights[s] / np.log(u[s]) if weights[s] else -1, -s))


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 2.0, 0.0, 4.0]])
def test_shards(spark, weights):
    rows = odd_texts() + [(i, "t") for i in range(100, 1500)] + [(7, "again")] * 5
    got = sharding.shard_rows(table(spark, rows), weights).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == brute_shard(r.doc_id, weights) and r.grown_shard in (r.shard, len(weights)) and r.law == "key"
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = np.mean([r.grown_shard != r.shard for r in got])
    assert moved < 2 / (sum(weights) + 1)


def test_shard_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 20)
    got = sharding.shard_rows(table(spark, [(i, "x") for i in range(2000)], False), [1.0] * 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_rows(empty(spark), [1.0] * 8).count() == 0


def test_chat_digests(spark):
    said = ["plain", "", None, "a\\b", "<|end|>\n<|turn|>user<|text|>x", "\\\\", "[INST]</s><s>", "é 漢", "a\nb", "<<SYS>>x<</SYS>>", "<\\|turn|>"]
    rows = [(c, t, "assistant" if t % 2 else "user", said[(c + t) % len(said)]) for c in range(12) for t in range(4)]
    rows += [(50, 0, None, "x"), (50, None, "us<|er", "y"), (None, 1, "assistant", "z"), (51, 0, "user", "w" * 100_000), (51, 1, "user", "same"), (51, 1, "user", "same")]
    turns = chat_format.turns_of_rows(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r for r in chat_format.conversations(chat_format.format_turns(turns)).collect()}
    assert all(len(whole[c].formatted) == got[c].formatted_chars for c in got)
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "a", "<", "|", ">", "/", "\n", "s>"]), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    out = text.replace("\\", "\\\\")
    for c in chat_format.CONTROL:
        out = out.replace(c, f"{c[0]}\\{c[1:]}")
    assert chat_format.unescaped(out) == text
    assert not any(c in out for c in chat_format.CONTROL)


def test_layouts_by_fingerprint(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": {"x": [1]}})),
        (2, json.dumps({"instruction": "do", "input": "this", "output": "done"})),
        (3, json.dumps({"instruction": "do", "output": "done"})),
        (4, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]})),
        (5, json.dumps({"prompt": "p", "completion": "c", "system": "s"})),
        (6, json.dumps({"what": 1})), (7, "not json"), (8, None), (9, "[]"),
    ]
    out = chat_format.turns_of_json(spark.createDataFrame(records, "id long, j string"), "id", "j").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.turn or 0)):
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert [x[1:] for x in got[1]] == [("user", "a"), ("assistant", "b")]
    assert [x[1:] for x in got[2]] == [("user", "do\nthis"), ("assistant", "done")] and got[3][0] == ("instruction", "user", "do")
    assert [x[1:] for x in got[4]] == [("user", "q"), ("assistant", "r")]
    assert [x[1] for x in got[5]] == ["system", "user", "assistant"]
    assert all(got[i] == [(None, None, None)] for i in (6, 7, 8, 9))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_every_occurrence(text, patterns):
    index = FMIndex(np.array(text))
    rows = np.array([[0] * (4 - len(p)) + p for p in patterns])
    lo, hi = index.search(rows, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    w = WaveletMatrix(np.array(text), 3)
    got, before = w.access(np.arange(len(text)))
    assert got.tolist() == text and before.tolist() == [text[:i].count(c) for i, c in enumerate(text)]


def bench_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute_benchmark(t, items, k=13):
    w = [x[0] for x in bench_words(t)]
    hit, met = set(), set()
    for item, text in items:
        b = [x[0] for x in bench_words(text)]
        for i in range(max(1, len(b) - k + 1)) if b else ():
            win = b[i : i + k]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    met.add(item if item is None else str(item))
    return len(w), len(hit), sorted(met, key=lambda x: (x is None, x))


@pytest.mark.parametrize("bound", [64 << 20, 300])
def test_decontamination_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", bound)  # the small one makes parts
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(9, 40), 60)) for i in range(8)] + [(8, None), (9, "..."), (10, "w1 Rare-Pair"), (10, "w1 Rare-Pair"), (None, "Tail-words")]
    rows = odd_texts(6)
    for i in range(60, 90):
        item = rng.choice(items[:8])[1].split()
        a = rng.randrange(len(item))
        rows.append((i, f"{words(rng, rng.randint(0, 40), 60)}, {' '.join(item[a : a + rng.randint(5, 30)]).upper()}. {words(rng, 9, 60)} rare pair" + " tail words" * (i % 3)))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    docs = table(spark, rows)
    got = find_benchmark(docs, bench).collect()
    assert len(got) == len(rows)
    assert any(r.n_hit for r in got) and any(None in r.items for r in got)
    assert [c for c in docs.columns if c not in decontaminate.OUTPUTS] == got[0].__fields__[:-4]
    for r in got:
        assert (r.n_words, r.n_hit, r.items) == brute_benchmark(r.text, items)
        raw = (r.text or "").encode()
        assert sum(len(bench_words(raw[s.start : s.end].decode())) for s in r.spans) == r.n_hit
    assert find_benchmark(empty(spark), bench).count() == 0
    assert find_benchmark(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def mirror_words(n):
    """A word over a and b, and the same with both letters changed, that a polynomial modulo 2**64 cannot tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomial_hashes(spark):
    a, b = mirror_words(1024)
    rng = random.Random(3)
    tail = words(rng, 40)
    rows = [(1, a), (2, b), (3, f"{tail} {a}"), (4, f"{tail} {b}"), (5, f"x {a} y"), (6, f"x {b} y"), (7, a), (8, f"{a} {b}")]
    items = [(1, a), (2, f"x {b} y"), (3, f"{tail} {a}")]
    for r in find_benchmark(table(spark, rows, False), spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r.n_words, r.n_hit, r.items) == brute_benchmark(r.text, items)
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows, False)).collect()}
    assert got == {i: 1 if i == 7 else 3 if i == 4 else i for i, _ in rows}  # 3 and 4 share 36 of 38 shingles


def test_pipeline_stages(spark, tmp_path):
    """Every stage keeps the columns, takes out what it should and leaves clean documents alone."""
    rng = random.Random(9)
    bench = words(rng, 30)
    clean = [(i, f"Clean {words(rng, 60)}") for i in range(40)]
    near = clean[3][1].split()
    near[30] = "changed"
    rows = [*clean, (100, "12 34 ..."), (101, None), (102, clean[5][1].replace(" ", "\n")), (103, " ".join(near)), (104, f"{words(rng, 20)} {bench}")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, gone = [i for i, _ in rows], {"language": {100, 101}, "exact": {102}, "near": {103}, "decontaminated": {104}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left = [i for i in left if i not in gone[name]]
        assert sorted(r.doc_id for r in out.collect()) == sorted(left), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == [i for i, _ in clean] and all(r.round_trip for r in last)


def test_layouts_with_fields_of_others(spark):
    other = ["prompt", "system", "input", "output", "response", "instruction", "completion"]
    plain = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    schema = "conv_id long, turn long, role string, text string"
    for names in (other[:1], other[3:4], other):
        rows = spark.createDataFrame([(*r, *names) for r in plain], schema + "".join(f", {n} string" for n in names))
        assert sorted(map(tuple, chat_format.turns_of_rows(rows).collect())) == plain
    said = chat_format.record_turns
    assert said({"prompt": "p", "response": "r", "input": "x"}) == ("prompt and response", [("user", "p"), ("assistant", "r")])
    assert said({"messages": [{"role": "user", "content": "a"}], "prompt": "p", "text": None}) == ("messages", [("user", "a")])
    assert said({"instruction": "i", "output": "o", "completion": "c"}) == ("instruction", [("user", "i"), ("assistant", "o")])
    assert said({"prompt": "p", "completion": "c", "response": "r"})[0] == "prompt and completion"
    for odd in ("oops", None, 3, ["x"]):
        assert said({"messages": [{"role": "user", "content": "a"}, odd]}) == (None, [])
    assert said({"messages": []}) == (None, [])
    assert said({"prompt": "p"}) == (None, []) and said({"conv_id": 1, "turn": 0, "role": "user", "text": "t"}) == (None, [])


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_without_labels_keeps_all_texts_with_a_letter(spark, lang):
    rows = [(i, t, lang) for i, t in [*odd_texts(), (90, "123 ... 45"), (91, "²³")]]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").collect() if r.doc_id not in (30, 31, 32, 90, 91))


def test_near_stage_decides_by_row(spark, tmp_path):
    rng = random.Random(12)
    copy = lambda t, w: t.replace(t.split()[30], w)
    a, b, c, d, e = (words(rng, 60, 10**6) for _ in range(5))
    rows = [(7, copy(a, "x")), (1, a), (7, b), (3, c), (3, copy(c, "y")), (None, d), (None, copy(d, "z")), (None, copy(e, "u")), (9, e), (None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(rows, "doc_id long, text string")):
        got = corpus_pipeline.near(spark, docs, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 3, 7, 9]
        texts = [r.text for r in got]
        assert a in texts and b in texts and e in texts and texts.count(None) == 2 and len(texts) == 7
        assert len({c, rows[4][1]} & set(texts)) == 1 and len({d, rows[6][1]} & set(texts)) == 1


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, docs in enumerate((table(spark, odd_texts()), empty(spark))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            if name != "tokens":
                docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
                assert len({(r.doc_id, r.text) for r in docs.collect()}) <= docs.count()


def test_contamination_rule(spark):
    rows = spark.createDataFrame([(100, 5), (101, 5), (0, 0), (10, 0)], "w long, h long")
    assert [r.c for r in rows.select(contaminated(rows.w, rows.h).alias("c")).collect()] == [True, False, False, False]
